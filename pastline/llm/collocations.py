"""Phrase collocations: frequent phrases by sketch, automata and exact counts.

Texts are scanned a few times. Two scans fill count-min sketches of the phrases (two words; then three and four, where all their pairs may be
frequent), whose cells never count too little; a third takes as candidates the phrases that no cell rules out. Candidates and their words are
compiled into Aho-Corasick automata of bounded size, each phrase guarded by a delimiter on both sides. A last scan cuts the texts into windows, the
words from each place that can begin a candidate, and deals them out by their first words, so that a window meets the one automaton that has
what begins there, and the texts are read once for any number of automata: every match is counted, overlapping ones too. Thresholds and scores use
these exact counts alone, so a full sketch costs time and loses nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastline.llm import store
from pastline.llm import textkernel as K

#: A phrase is a candidate from so many occurrences, has so many words at most, and goes if a longer one has this share (in percent) of them.
LEAST, WORDS, COVERED = 30, 4, 80
SCALE = 2_000_000
TOP = 2000
UNKNOWN = "und"
#: Cells of a sketch: two rows of ``2 ** CELL_BITS``, dealt out in blocks.
CELL_BITS, BLOCK_BITS = 26, 20
#: Cells that a task collects before it writes them.
HELD = 4 << 20
#: Places of the last candidates that a task has written: those that come again soon aren't written again.
SEEN = 1 << 20
#: Bytes of the phrases of one automaton, about, and the least number of parts that phrases and windows are dealt out by.
AUTOMATON_BYTES, SHARDS = 3 << 20, 128
#: Words from the start of a phrase that say where it is dealt: of shorter ones all.
FIRST = 3
#: Bytes of different windows that a task holds; phrases that it deals out, and bytes of windows that it counts, at once.
WINDOW_BYTES, DEALT_ROWS, TALLY_BYTES = 32 << 20, 200_000, 1 << 18
#: Bytes of texts that the kernels take at once.
SLICE = 1 << 20
#: Parts of a language's candidates that are ranked apart before their first ``TOP`` meet.
SALTS = 64

_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_OUT = _CUT.copy()
_OUT[[9, 32]] = True
CELLS = "block int, width int, cells binary, counts binary"
PACKED = "block int, langs array<string>, lang_at binary, keys binary, sizes binary, text binary"
#: Blocks (as a power of two) that candidates are dealt out by, and bytes of them that a task holds.
PARTS, PACKED_BYTES = 6, 2 << 20
FOUND = "lang string, phrase string, n long"
DEALT = "shard int, lang string, kind int, text binary, times binary"


@dataclass
class Words:
    """The words of some texts: hashes, pieces, and the texts written anew: each piece as `` w w w `` and a line feed."""

    hashes: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def split(column: pa.Array, lang: str) -> Words:
    data, offsets = K.utf8(column)
    data = K.LOWER[data]
    starts, ends, before = K.word_spans(data, offsets, _OUT)
    n = len(starts)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        cuts = np.concatenate([[0], np.cumsum(_CUT[data])])
        first[1:] = cuts[starts[1:]] > cuts[ends[:-1]]
        first[before[:-1][before[:-1] < n]] = True
        last[:-1], last[-1] = first[1:], True
    size = ends - starts
    room = size + 1 + first + last
    at = np.cumsum(room) - room
    text = np.full(int(room.sum()), 32, np.uint8)
    begin = at + first
    text[K.ragged(begin, size)] = data[K.ragged(starts, size)]
    text[(at + room - 1)[last]] = 10
    mine = K.mix(np.array([zlib.crc32(lang.encode())], np.uint64) + np.uint64(1))
    return Words(K.span_hash(data, starts, ends) ^ mine if n else np.zeros(0, np.uint64), np.cumsum(first), text, begin, begin + size)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n`` words from each place, and whether they are in one piece."""
    size = max(0, len(words.hashes) - n + 1)
    h = words.hashes[:size].copy()
    for j in range(1, n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words.hashes[j : j + size]
    return K.mix(h), words.piece[:size] == words.piece[n - 1 :]


def cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << CELL_BITS) - 1)
    return (hashes & mask).astype(np.uint32), ((hashes >> np.uint64(32)) & mask).astype(np.uint32) | np.uint32(1 << CELL_BITS)


def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both cells of a phrase reach the threshold."""
    out = np.ones(len(hashes), bool)
    for c in cells(hashes):
        out &= (bits[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & np.uint8(1) > 0
    return out


def possible(words: Words, pairs: np.ndarray, longer: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For two to ``WORDS`` words: ``n``, hashes of the words from each place, and whether they can be frequent: by the sketch of ``pairs``, by
    all shorter phrases inside, and by the sketch of ``longer`` phrases where there is one."""
    h, short = grams(words, 2)
    short[short] = held(pairs, h[short])
    yield 2, h, short
    for n in range(3, WORDS + 1):
        h, ok = grams(words, n)
        ok &= short[: len(ok)] & short[1 : len(ok) + 1]
        if longer is not None:
            ok[ok] = held(longer, h[ok])
        yield n, h, ok
        short = ok


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Languages and slices of their texts."""
    for batch in batches:
        text, langs = batch.column("text").cast(pa.large_string()), batch.column("lang")
        for lang in langs.unique().to_pylist():
            mine = text.filter(pc.equal(langs, lang))
            _, offsets = K.utf8(mine)
            for at, to in K.slices(offsets, SLICE):
                yield lang, mine.slice(at, to - at)


def sketch(spark: SparkSession, docs: DataFrame, least: int, pairs: Broadcast | None = None, size: int = 2) -> np.ndarray:
    """Bits of the cells that count ``least`` or more: of phrases of ``size`` words, or, with the bits of pairs, of longer ones. Fixed in size."""

    def written(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at, counts = np.unique(np.concatenate(parts), return_counts=True)
        counts = np.minimum(counts, least).astype(np.uint8)  # a sum of these reaches the threshold where the sum of the counts does
        block = at >> np.uint32(BLOCK_BITS)
        new = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(at) else []
        rows = []
        for lo, hi in zip(new, np.append(new[1:], len(at)) if len(at) else [], strict=True):
            gaps = np.diff(at[lo:hi] & np.uint32((1 << BLOCK_BITS) - 1), prepend=np.uint32(0))
            width = 2 if gaps.max() < 1 << 16 else 4
            rows.append((int(block[lo]), width, gaps.astype(f"<u{width}").tobytes(), counts[lo:hi].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "width", "cells", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for lang, text in _texts(batches):
            words = split(text, lang)
            for n, h, ok in [(size, *grams(words, size))] if pairs is None else possible(words, pairs.value):
                if pairs is not None and n == 2:
                    continue
                found = cells(h[ok])
                parts += found
                held += 2 * len(found[0])
            if held >= HELD:
                yield from written(parts)
                parts, held = [], 0
        if held:
            yield from written(parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << BLOCK_BITS, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(total >= least, bitorder="little"), 1)], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != now:
                    if now is not None:
                        yield done()
                    now = r["block"]
                    total[:] = 0
                at = np.cumsum(np.frombuffer(r["cells"], f"<u{r['width']}"), dtype=np.int64)
                total[at] += np.frombuffer(r["counts"], np.uint8)
        if now is not None:
            yield done()

    parts = docs.mapInArrow(count, CELLS).repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    bits = np.zeros((2 << CELL_BITS) // 8, np.uint8)
    each = (1 << BLOCK_BITS) // 8
    with store.freed(spark):
        rows = parts.collect()  # a row per block, of a fixed number of bits
    for r in rows:
        bits[r["block"] * each : (r["block"] + 1) * each] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return bits


def candidates(docs: DataFrame, pairs: Broadcast, longer: Broadcast) -> DataFrame:
    """``lang, phrase``: what the sketches leave, each once; and with a null ``phrase`` the words ``n`` of each language by task.

    A task writes its different candidates in blocks by hash, a row per block; blocks are merged where they meet. Phrases are told apart by 64-bit
    hashes there (two of a million share one with a chance below 1e-7).
    """

    def written(lang_of: list[str], keys: np.ndarray, langs: np.ndarray, begin: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
        block = (keys >> np.uint64(64 - PARTS)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        size = np.diff(begin)
        new = np.flatnonzero(np.diff(block[order], prepend=-1))
        rows = []
        for mine in np.split(order, new[1:]) if len(order) else []:
            rows.append((int(block[mine[0]]), lang_of, zlib.compress(langs[mine].astype("<i4"), 1), keys[mine].tobytes(), zlib.compress(size[mine].astype("<i8"), 1), zlib.compress(text[K.ragged(begin[mine], size[mine])], 1)))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 4))], names=[x.split()[0] for x in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, held, size = np.zeros(SEEN, np.uint64), {}, [], 0

        def flush() -> pa.RecordBatch:
            keys, langs, lengths, text = (np.concatenate(x) for x in zip(*held, strict=True))
            return written(list(total), keys, langs, np.concatenate([[0], np.cumsum(lengths)]), text)

        for lang, text in _texts(batches):
            words = split(text, lang)
            total[lang] = total.get(lang, 0) + len(words.hashes)
            keys, begin, end = [], [], []
            for n, h, ok in possible(words, pairs.value, longer.value):
                at = np.flatnonzero(ok)
                keys.append(h[at])
                begin.append(words.starts[at])
                end.append(words.ends[at + n - 1])
            keys, first = np.unique(np.concatenate(keys), return_index=True)
            fresh = seen[keys % np.uint64(SEEN)] != keys
            begin, end = np.concatenate(begin)[first[fresh]], np.concatenate(end)[first[fresh]]
            seen[keys[fresh] % np.uint64(SEEN)] = keys[fresh]
            held.append((keys[fresh], np.full(len(begin), list(total).index(lang)), end - begin, words.text[K.ragged(begin, end - begin)]))
            size += len(held[-1][3]) + 24 * len(begin)
            if size > PACKED_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        # Words of each language, by their own block so that they are told from candidates.
        counts = [pa.array([-1] * len(total), pa.int32()), pa.array([[x] for x in total], pa.list_(pa.string())), *[pa.array([b""] * len(total), pa.binary())] * 2, pa.array([zlib.compress(np.int64(n).tobytes(), 1) for n in total.values()], pa.binary()), pa.array([b""] * len(total), pa.binary())]
        yield pa.RecordBatch.from_arrays(counts, names=[x.split()[0] for x in PACKED.split(", ")])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                raw = lambda name: batch.column(name)[i].as_buffer()  # noqa: B023, E731
                of = lambda name, kind: np.frombuffer(zlib.decompress(raw(name)), kind)  # noqa: B023, E731
                names, size = batch.column("langs")[i].values, of("sizes", "<i8")
                if block < 0:
                    yield pa.RecordBatch.from_arrays([names, pa.nulls(1, pa.string()), pa.array(size)], names=["lang", "phrase", "n"])
                    continue
                if block != now:
                    now, known = block, np.zeros(0, np.uint64)
                keys, first = np.unique(np.frombuffer(raw("keys"), "<u8"), return_index=True)
                at = np.searchsorted(known, keys)
                fresh = np.ones(len(keys), bool) if not len(known) else known[np.minimum(at, len(known) - 1)] != keys
                first = first[fresh]
                known = np.insert(known, at[fresh], keys[fresh])
                begin = np.cumsum(size) - size
                text = of("text", np.uint8)[K.ragged(begin[first], size[first])]
                offsets = np.concatenate([[0], np.cumsum(size[first])]).astype(np.int64)
                phrases = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(text)).cast(pa.string())
                langs = names.take(pa.array(of("lang_at", "<i4")[first]))
                yield pa.RecordBatch.from_arrays([langs, phrases, pa.nulls(len(first), pa.int64())], names=["lang", "phrase", "n"])

    return docs.mapInArrow(run, PACKED).repartition("block").sortWithinPartitions("block").mapInArrow(merge, FOUND)


_built: dict[object, dict[str, ahocorasick.Automaton]] = {}


def automata(key: object, langs: list[str], phrases: list[str]) -> dict[str, ahocorasick.Automaton]:
    """Per language, the automaton of its guarded phrases, whose values are their places in the list. A worker keeps those of the last key."""
    if key not in _built:
        _built.clear()
        made: dict[str, ahocorasick.Automaton] = {}
        for i, (lang, phrase) in enumerate(zip(langs, phrases, strict=True)):
            made.setdefault(lang, ahocorasick.Automaton()).add_word(f" {phrase} ", i)
        for a in made.values():
            a.make_automaton()
        _built[key] = made
    return _built[key]


def _once(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each key, and the sum of its ``times``."""
    order = np.argsort(keys)
    new = np.flatnonzero(np.append(True, np.diff(keys[order]) > 0)) if len(order) else order
    return order[new], np.add.reduceat(times[order], new) if len(new) else times


@dataclass
class Windows:
    """Different windows of texts: hashes, parts, places of their languages, how often each occurs, and their bytes: `` w w w `` and a line feed."""

    keys: np.ndarray
    shard: np.ndarray
    lang: np.ndarray
    times: np.ndarray
    size: np.ndarray
    text: np.ndarray

    def once(self) -> Windows:
        """Equal windows as one."""
        first, times = _once(self.keys, self.times)
        begin = np.cumsum(self.size) - self.size
        return Windows(self.keys[first], self.shard[first], self.lang[first], times, self.size[first], self.text[K.ragged(begin[first], self.size[first])])

    def written(self, langs: list[str]) -> Iterator[pa.RecordBatch]:
        """A row for each part and language."""
        order, begin = np.lexsort((self.shard, self.lang)), np.cumsum(self.size) - self.size
        new = np.flatnonzero((np.diff(self.shard[order], prepend=-1) != 0) | (np.diff(self.lang[order], prepend=-1) != 0))
        rows = [(int(self.shard[m[0]]), langs[self.lang[m[0]]], 1, zlib.compress(self.text[K.ragged(begin[m], self.size[m])], 1), zlib.compress(self.times[m].astype("<u4"), 1)) for m in (np.split(order, new[1:]) if len(order) else [])]
        yield _dealt(rows)


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()))], names=[x.split()[0] for x in DEALT.split(", ")])


def windows(words: Words, lang: int, shards: int, marks: np.ndarray, pairs: np.ndarray, longer: np.ndarray) -> Windows:
    """What begins at each place, each once: a word of ``marks``, a possible pair, and the longest possible phrase of ``FIRST`` words or more. A phrase
    occurs as often as the windows of its kind (one word, two, more) that begin with it, each of them in the phrase's own part."""
    one, ok = grams(words, 1)
    ok[ok] = held(marks, one[ok])
    kinds = [(one, np.ones(len(one), np.int64), one, ok)]
    for n, h, ok in possible(words, pairs, longer):
        if n <= FIRST:
            kinds.append((h.copy(), np.full(len(h), n), h, ok))
        else:  # where a longer one is possible too, the window is that
            key, long, _, _ = kinds[-1]
            at = np.flatnonzero(ok)
            key[at], long[at] = h[at], n
    keys, long, by, at = [np.concatenate(x) for x in zip(*[(key[i], long[i], by[i], i) for key, long, by, i in ((key, long, by, np.flatnonzero(ok)) for key, long, by, ok in kinds)], strict=True)]
    first, times = _once(keys, np.ones(len(keys), np.int64))
    long, by, at = long[first], by[first], at[first]
    # The text has a space before and after each word.
    begin, size = words.starts[at] - 1, words.ends[at + long - 1] - words.starts[at] + 3
    text = words.text[K.ragged(begin, size)]
    text[np.cumsum(size) - 1] = 10
    return Windows(keys[first], (by % np.uint64(shards)).astype(np.int64), np.full(len(first), lang), times, size, text)


def places(phrases: pa.Array, lang: str, shards: int) -> np.ndarray:
    """The part of each phrase."""
    words = split(phrases, lang)
    first = np.flatnonzero(np.diff(words.piece, prepend=0))
    n, out = np.diff(np.append(first, len(words.hashes))), np.zeros(len(first), np.uint64)
    for k in range(1, FIRST + 1):
        mine = np.minimum(n, FIRST) == k
        out[mine] = grams(words, k)[0][first[mine]]
    return (out % np.uint64(shards)).astype(np.int64)


def tally(made: ahocorasick.Automaton, sizes: np.ndarray, kinds: np.ndarray, text: bytes, times: np.ndarray) -> np.ndarray:
    """How often each phrase of an automaton (of ``sizes`` in characters with both guards, of ``kinds`` words, ``FIRST`` at most) begins a window of its kind."""
    data = np.frombuffer(text, np.uint8)
    last = np.flatnonzero(data == 10)
    begin = np.append(0, last[:-1] + 1)
    kind = np.minimum(np.add.reduceat(data == 32, begin, dtype=np.int64) - 1, FIRST)
    at = np.cumsum((data & 0xC0) != 0x80)[begin] - 1  # in characters
    found = np.fromiter(chain.from_iterable(made.iter(text.decode())), np.int64).reshape(-1, 2)
    start = found[:, 0] - sizes[found[:, 1]] + 1
    of = np.searchsorted(at, start, "right") - 1
    mine = (at[of] == start) & (kind[of] == kinds[found[:, 1]])
    counts = np.zeros(len(sizes), np.int64)
    np.add.at(counts, found[mine, 1], times[of[mine]])
    return counts


def counted(spark: SparkSession, docs: DataFrame, patterns: DataFrame, pairs: Broadcast, longer: Broadcast) -> DataFrame:
    """``lang, phrase, f`` of the stored ``patterns`` (``lang, phrase``), each counted by an automaton; the texts are read once.

    Windows of a task that share a 64-bit hash count as one (two of a million do with a chance below 1e-7).
    """
    size = F.length(F.col("phrase").cast("binary")) + 8
    shards = max(SHARDS, -(-2 * (patterns.agg(F.sum(size)).first()[0] or 0) // AUTOMATON_BYTES))
    marks = spark.sparkContext.broadcast(sketch(spark, patterns.select(F.col("phrase").alias("text"), "lang"), 1, None, 1))
    most, run = WINDOW_BYTES, (spark.sparkContext.applicationId, marks._jbroadcast.id())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def written() -> Iterator[pa.RecordBatch]:
            all_ = pa.Table.from_batches(held)
            for lang in all_["lang"].unique().to_pylist():
                mine = all_["phrase"].filter(pc.equal(all_["lang"], lang)).combine_chunks()
                to = places(mine, lang, shards)
                order = np.argsort(to, kind="stable")
                yield _dealt([(int(to[x[0]]), lang, 0, zlib.compress("\n".join(mine.take(pa.array(x)).to_pylist()).encode(), 1), b"") for x in np.split(order, np.flatnonzero(np.diff(to[order])) + 1)])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= DEALT_ROWS:
                yield from written()
                held = []
        if any(map(len, held)):
            yield from written()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, parts, size = {}, [], 0

        def joined() -> Windows:
            return Windows(*(np.concatenate([getattr(p, f) for p in parts]) for f in Windows.__dataclass_fields__)).once()

        for lang, text in _texts(batches):
            parts.append(windows(split(text, lang), langs.setdefault(lang, len(langs)), shards, marks.value, pairs.value, longer.value))
            size += len(parts[-1].text) + 40 * len(parts[-1].keys)
            if size > most:
                parts = [joined()]
                size = len(parts[0].text) + 40 * len(parts[0].keys)
                if size > most // 2:
                    yield from parts[0].written(list(langs))
                    langs, parts, size = {}, [], 0
        if parts:
            yield from joined().written(list(langs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, phrases, text, times, counts = None, [], [], [], None

        def met() -> np.ndarray:
            made = automata((run, *now), [now[1]] * len(phrases), phrases)[now[1]]
            sizes, kinds = np.array([len(p) + 2 for p in phrases]), np.array([min(FIRST, p.count(" ") + 1) for p in phrases])
            return tally(made, sizes, kinds, b"".join(text), np.frombuffer(b"".join(times), "<u4"))

        def done() -> Iterator[pa.RecordBatch]:
            if phrases and (text or counts is not None):
                f = (met() if text else 0) + (0 if counts is None else counts)
                yield pa.RecordBatch.from_arrays([pa.array([now[1]] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(f)], names=["lang", "phrase", "n"])

        for batch in batches:
            for shard, lang, kind, some, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, lang) != now:
                    yield from done()
                    now, phrases, text, times, counts = (shard, lang), [], [], [], None
                if not kind:
                    phrases += zlib.decompress(some).decode().split("\n")
                elif phrases:
                    text.append(zlib.decompress(some))
                    times.append(zlib.decompress(n))
                    if sum(map(len, text)) >= TALLY_BYTES:
                        counts = met() if counts is None else counts + met()
                        text, times = [], []
        yield from done()

    rows = patterns.mapInArrow(deal, DEALT).unionByName(docs.mapInArrow(cut, DEALT))
    return rows.repartition("shard").sortWithinPartitions("shard", "lang", "kind").mapInArrow(count, FOUND).select("lang", "phrase", F.col("n").alias("f"))


def frequent(spark: SparkSession, docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of the phrases of one to four words (single words: those of longer phrases) with ``least`` occurrences or more,
    and ``lang, n``: all words of each language."""
    store.small_batches(spark)
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    pairs = spark.sparkContext.broadcast(sketch(spark, texts, least))
    longer = spark.sparkContext.broadcast(sketch(spark, texts, least, pairs))
    found = store.table(spark, candidates(texts, pairs, longer), "candidates")
    phrases = found.where(F.col("phrase").isNotNull()).select("lang", "phrase")
    single = phrases.select("lang", F.explode(F.split("phrase", " ")).alias("phrase"))
    patterns = store.table(spark, phrases.unionByName(single).distinct(), "phrases")
    counts = store.table(spark, counted(spark, texts, patterns, pairs, longer).where(F.col("f") >= least).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f"), "counts")
    return counts, found.where(F.col("phrase").isNull()).groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Per language of ``docs`` (``text, lang``; other columns may have any name) its ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A null text has no words, a null language is ``und``. ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut (of
    equal scores the first), ``n`` all words; the score is ``floor(2000000 a / (l + r))``, in whole numbers that do not overflow below 4e15
    words. Phrases with most of their occurrences inside a longer candidate go. Equal scores rank by ``a``, then by the phrase's bytes. Repeated
    rows count each time; a table without rows, or a language without candidates, gives no row. Very long texts are read whole, alone in their
    slice.
    """
    counts, totals = frequent(spark, docs, least)
    cand = counts.where("words > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), "words", F.col("f").alias("a"))
    cuts = cand.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    # floor(2000000 a / s) in two steps, so that no product passes 64 bits.
    score = F.expr(f"(({SCALE // 1000} * a) div (l + r)) * 1000 + ((({SCALE // 1000} * a) % (l + r)) * 1000) div (l + r)")
    best = cuts.select("lang", "phrase", "a", "k", "l", "r", score.alias("score")).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = cand.where("words > 2").select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    covers = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    open_ = best.join(covers, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (100 * F.col("cover") < COVERED * F.col("a")))
    rows = open_.select("lang", "phrase", "a", "c.l", "c.r", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
