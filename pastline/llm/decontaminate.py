"""Benchmark decontamination by SimHash windows.

Words are runs of letters and digits, lower-cased in ASCII; shingles are five words (a shorter item is one shingle). Each item has a 128-bit
SimHash of its weighted shingles. Documents are read once: windows of an item's size that hold at least one of that item's shingles
(others have similarity 0) get their SimHash from running sums of shingle bits; a document with fewer shingles than the item is one window. A multi-index over Hamming blocks returns every item
fingerprint within the radius (with one block more than the radius has bits, two fingerprints within it agree on some block). No radius
guarantees a similarity, so windows whose shingles in common with the item, counted or weighed, can reach the bound are candidates too, and
nothing is lost. The exact shingle similarity decides: sum of minima over sum of maxima, the greater of the plain and the weighted one. A
shingle weighs the inverse of the items of the whole benchmark that it occurs in; one that the item lacks never weighs more than the item's
own on average.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.llm import store
from pastline.llm import textkernel as K

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCK = 128, 4
#: 32 blocks of 4 bits: every fingerprint within 31 bits shares a block. Plain similarity 0.8 means about 19 bits with a deviation of 4; for
#: uneven weights, and for the rest of the deviation, :func:`_by_hits` has the windows that the radius leaves out.
RADIUS = BITS // BLOCK - 1
#: Items of one broadcast and bytes of their texts; a larger benchmark is searched in parts of about this many.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 16 << 20
#: Index entries that a look-up holds at a time.
LOOK_UP = 2_000_000
SCHEMA = "doc_id long, item_id long, similarity double, word_start long, n_words long, n_windows long"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lower = K.LOWER[data]
    starts, ends, before = K.word_spans(lower, offsets, K.PUNCTUATION)
    return K.span_hash(lower, starts, ends), before


def _bits(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 128 bits of each shingle."""
    both = np.stack([K.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), K.mix(shingles ^ np.uint64(0x14057B7EF767814F))], 1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.float64) * 2 - 1


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


@dataclass
class _Group:
    """Items of one shingle size and one number of shingles, with their Hamming index."""

    items: list[int]
    length: int
    prints: np.ndarray
    order: list[np.ndarray]
    bounds: list[np.ndarray]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) of fingerprints within the radius; about ``LOOK_UP`` index entries are held at a time."""
        step = max(1, LOOK_UP // (2 * len(self.items)))
        found = [self._look_up(prints[at : at + step], at) for at in range(0, len(prints), step)]
        return np.concatenate([w for w, _ in found] or [np.zeros(0, np.int64)]), np.concatenate([i for _, i in found] or [np.zeros(0, np.int64)])

    def _look_up(self, prints: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        codes = []
        for b in range(BITS // BLOCK):
            value = (prints[:, b // 2] >> (4 * (b % 2))) & 15
            lo, hi = self.bounds[b][value], self.bounds[b][value + 1]
            item = self.order[b][K.ragged(lo, hi - lo)]
            codes.append(np.repeat(np.arange(len(prints)), hi - lo) * len(self.items) + item)
        pairs = np.unique(np.concatenate(codes))
        window, item = pairs // len(self.items), pairs % len(self.items)
        near = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1) <= RADIUS
        return window[near] + first, item[near]


@dataclass
class Index:
    names: list[int]
    bags: list[dict[int, int]]
    weight: dict[int, float]
    #: Per item, its number of shingles and their weight.
    counts: np.ndarray
    mass: np.ndarray
    #: By shingle size: sorted shingles, the bitmap before them, the items of each shingle (runs), and groups by number of shingles.
    sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, _Group]]]


def _item_shingles(text: str | None) -> tuple[int, np.ndarray]:
    """An item's shingle size (0 without words) and its shingles."""
    hashes, _ = _words(*K.utf8(pa.array([text], pa.string())))
    k = min(SHINGLE, len(hashes))
    return k, K.window_hash(hashes, np.array([0, len(hashes)]), k)[0] if k else np.zeros(0, np.uint64)


def build_index(items: list[tuple[int, str | None]], shared: dict[int, int] | None = None) -> Index:
    """The index of benchmark items (``item_id, text``). Items without words, or without a text, match nothing.

    ``shared`` has the shingles that are in two or more items of the whole benchmark, with that number, where ``items`` are a part of it.
    """
    names, bags, of_size = [], [], {}
    df: Counter = Counter()
    for name, text in items:
        k, shingles = _item_shingles(text)
        if not k:
            continue
        bag = Counter(shingles.tolist())
        of_size.setdefault(k, []).append((len(names), len(shingles)))
        names.append(name)
        bags.append(dict(bag))
        df.update(bag.keys())
    weight = {s: 1.0 / (n if shared is None else shared.get(s, 1)) for s, n in df.items()}
    sizes = {}
    for k, members in of_size.items():
        flat = [(s, i) for i, _ in members for s in bags[i]]
        flat.sort()
        shingles = np.array([s for s, _ in flat], np.uint64)
        owners = np.array([i for _, i in flat], np.int64)
        unique, first = np.unique(shingles, return_index=True)
        seen = np.zeros(1 << 20, bool)
        seen[(unique >> np.uint64(44)).astype(np.int64)] = True
        groups = {}
        for n in {n for _, n in members}:
            chosen = [i for i, m in members if m == n]
            sums = np.stack([(_bits(np.array(list(bags[i]), np.uint64)) * np.array([weight[s] * c for s, c in bags[i].items()])[:, None]).sum(0) for i in chosen])
            prints = _fingerprint(sums)
            values = [(prints[:, b // 2] >> (4 * (b % 2))) & 15 for b in range(BITS // BLOCK)]
            order = [np.argsort(v, kind="stable") for v in values]
            bounds = [np.searchsorted(v[o], np.arange(17)) for v, o in zip(values, order, strict=True)]
            groups[n] = _Group(chosen, n, prints, order, bounds)
        sizes[k] = (unique, seen, np.append(first, len(shingles)), owners, groups)
    counts = np.array([sum(bag.values()) for bag in bags], np.int64)
    mass = np.array([sum(weight[s] * c for s, c in bag.items()) for bag in bags], np.float64)
    return Index(names, bags, weight, counts, mass, sizes)


def _similarity(index: Index, window: dict[int, int], i: int) -> float:
    """The greater of the plain and the weighted similarity of a window and item ``i``."""
    item, foreign = index.bags[i], index.mass[i] / index.counts[i]
    low = high = 0.0
    both = either = 0
    for s in window.keys() | item.keys():
        a, b = window.get(s, 0), item.get(s, 0)
        w = index.weight[s] if b else min(index.weight.get(s, 1.0), foreign)
        low += w * min(a, b)
        high += w * max(a, b)
        both += min(a, b)
        either += max(a, b)
    return max(both / either, low / high)


def _by_hits(index: Index, own: np.ndarray, where: np.ndarray, items: np.ndarray, similarity: float) -> dict[int, list[tuple[int, int]]]:
    """Windows (start, item), by the item's number of shingles, that have enough of the item's shingles to reach the similarity.

    ``where`` and ``items`` are the positions in ``own`` of shingles of each item. Plain similarity takes a share of
    ``similarity / (1 + similarity)`` of both numbers of shingles, weighted similarity a share of ``similarity`` of the item's weight.
    """
    weights = np.array([index.weight[s] for s in own[where].tolist()])
    _, inverse = np.unique(items, return_inverse=True)
    size = np.minimum(index.counts[items], len(own))
    least, heavy = similarity / (1 + similarity) * (index.counts[items] + size) - 1e-9, similarity * index.mass[items] - 1e-9
    # Most items share too little with the whole document.
    able = (np.bincount(inverse)[inverse] >= least) | (np.bincount(inverse, weights)[inverse] >= heavy)
    where, items, weights, size, least, heavy = (x[able] for x in (where, items, weights, size, least, heavy))
    order = np.lexsort((where, items))
    out: dict[int, list[tuple[int, int]]] = {}
    for mine in np.split(order, np.flatnonzero(np.diff(items[order])) + 1) if len(order) else ():
        i, m, p = int(items[mine[0]]), int(size[mine[0]]), where[mine]
        number, weight = np.zeros(len(own) + 1, np.int64), np.zeros(len(own) + 1)
        number[p + 1], weight[p + 1] = 1, weights[mine]
        number, weight = np.cumsum(number), np.cumsum(weight)
        fits = (number[m:] - number[:-m] >= least[mine[0]]) | (weight[m:] - weight[:-m] >= heavy[mine[0]])
        out.setdefault(int(index.counts[i]), []).extend((s, i) for s in np.flatnonzero(fits).tolist())
    return out


def _search(index: Index, hashes: np.ndarray, before: np.ndarray, similarity: float) -> list[tuple]:
    """Matches of some texts: (row, item, similarity, first word, words, windows)."""
    best: dict[tuple[int, int], list] = {}
    for k, (unique, seen, first, owners, groups) in index.sizes.items():
        shingles, at = K.window_hash(hashes, before, k)
        maybe = np.flatnonzero(seen[(shingles >> np.uint64(44)).astype(np.int64)])
        found = np.minimum(np.searchsorted(unique, shingles[maybe]), len(unique) - 1)
        hit = maybe[unique[found] == shingles[maybe]]
        if not len(hit):
            continue
        which = np.searchsorted(unique, shingles[hit])
        row_starts = np.searchsorted(at, before)
        rows = np.searchsorted(row_starts, hit, "right") - 1
        for row in np.unique(rows):
            lo, hi = row_starts[row], row_starts[row + 1]
            mine = rows == row
            own = shingles[lo:hi]
            pos, kind = hit[mine] - lo, which[mine]
            counts = first[kind + 1] - first[kind]
            items = owners[K.ragged(first[kind], counts)]
            where = np.repeat(pos, counts)
            lengths = index.counts[items]
            by_hits = _by_hits(index, own, where, items, similarity)
            # Only the neighbourhood of hits is ever summed.
            weights = np.array([index.weight.get(s, 1.0) for s in own.tolist()])
            sums = np.concatenate([np.zeros((1, BITS)), np.cumsum(_bits(own) * weights[:, None], axis=0)]) if len(own) <= 1 << 15 else None
            for n in np.unique(lengths):
                group = groups[int(n)]
                size = min(int(n), len(own))
                reach = np.zeros(len(own) + 1, np.int64)
                p = where[lengths == n]
                np.add.at(reach, np.maximum(p - size + 1, 0), 1)
                np.add.at(reach, p + 1, -1)
                starts = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
                starts = starts[starts + size <= len(own)]
                judged = set(by_hits.get(int(n), ()))
                for part in range(0, len(starts), 4096):
                    s = starts[part : part + 4096]
                    if sums is not None:
                        totals = sums[s + size] - sums[s]
                    else:
                        a, b = int(s[0]), int(s[-1]) + size
                        near = np.concatenate([np.zeros((1, BITS)), np.cumsum(_bits(own[a:b]) * weights[a:b, None], axis=0)]) if b - a <= 1 << 17 else None
                        totals = near[s + size - a] - near[s - a] if near is not None else np.stack([(_bits(own[x : x + size]) * weights[x : x + size, None]).sum(0) for x in s])
                    window, item = group.candidates(_fingerprint(totals))
                    judged.update(zip(s[window].tolist(), (group.items[j] for j in item), strict=True))
                for w, i in sorted(judged):
                    value = _similarity(index, Counter(own[w : w + size].tolist()), i)
                    if value >= similarity - 1e-12:
                        entry = best.setdefault((int(row), i), [-1.0, 0, 0, 0])
                        entry[3] += 1
                        if value > entry[0]:
                            entry[:3] = [value, int(at[lo + w] - before[row]), size + k - 1]
    found: dict[tuple[int, int | None], list] = {}
    for (row, i), v in best.items():  # texts of one item_id are one item
        held = found.setdefault((row, index.names[i]), v)
        if held is not v:
            held[3] += v[3]
            if v[0] > held[0]:
                held[:3] = v[:3]
    return [(row, name, *v) for (row, name), v in found.items()]


def _parts(spark: SparkSession, benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the benchmark's items in parts of bounded size: a stated query set, each part of which is held against all documents.

    How many items a shingle is in is counted over the whole benchmark, whatever the parts.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size["n"] // ITEMS_AT_ONCE), -(-size["bytes"] // BYTES_AT_ONCE))
    if parts == 1:
        yield build_index([(r["item_id"], r["text"]) for r in items.collect()])
        return

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.unique(_item_shingles(text)[1]) for text in batch.column("text").to_pylist()]
            part = np.repeat(batch.column("part").to_numpy(), [len(x) for x in each])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.uint64), *each]).view(np.int64))], names=["part", "shingle"])

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("long"))
    spread = dealt.select("part", "text").mapInArrow(shingles, "part long, shingle long").groupBy("shingle").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts"))
    shared = store.table(spark, spread.where("n > 1"), "shared-shingles")
    for part in range(parts):
        counted = shared.where(F.array_contains("parts", F.lit(part).cast("long"))).select("shingle", "n").collect()  # shingles of the part's own items
        yield build_index([(r["item_id"], r["text"]) for r in dealt.where(F.col("part") == part).collect()], {r["shingle"] % (1 << 64): r["n"] for r in counted})
    store.drop(spark, shared)


def _rows(index: Index, text: pa.Array, similarity: float) -> Iterator[tuple]:
    data, offsets = K.utf8(text)
    for at, to in K.slices(offsets, 1 << 20):
        hashes, before = _words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        for r in _search(index, hashes, before, similarity):
            yield (at + r[0], *r[1:])


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and benchmark item with a window of the item's size whose similarity is ``similarity`` or more.

    A document with fewer shingles than the item is judged whole.

    ``word_start`` and ``n_words`` tell the best window, ``n_windows`` how many reach the bound; rows of one item_id are one item, with the windows
    of all its texts. Null texts match nothing; clean
    documents have no row; an empty benchmark gives an empty result. Rows of one doc_id are judged, and named, each by its own text; of
    equally similar windows the first is told. A very long text is taken whole, alone in its kernel call.
    """
    store.small_batches(spark)

    def find(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)  # at most about ITEMS_AT_ONCE items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            for batch in batches:
                rows = list(_rows(shared.value, batch.column("text"), similarity))
                arrays = [pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), *arrays], names=[x.split()[0] for x in SCHEMA.split(", ")])

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionByName, map(find, _parts(spark, benchmark)))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that :func:`contaminated` would name. One pass over the texts; nothing is shuffled."""
    store.small_batches(spark)
    for index in _parts(spark, benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in _rows(shared.value, batch.column("text"), similarity)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
