"""Quality rules: plain counts of a text, and how far its distributions lie from its language's.

Language references are counted over all documents: the share of each character class and of each common word, per language. A document's
own histograms are compared with them by Jensen-Shannon distance. Short texts scatter, so the bounds widen with the square root of
the length, and below a minimum length the distances decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.llm import store
from pastline.llm import textkernel as K

CLASSES = ("lower", "upper", "other letter", "digit", "space", "line", "stop", "mark", "symbol", "control")
_CLASS = np.full(256, 2, np.uint8)  # bytes from 0xC2 begin a character outside ASCII
_CLASS[:128] = 9
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 3
_CLASS[[9, 11, 12, 32]], _CLASS[[10, 13]] = 4, 5
_CLASS[[ord(c) for c in ".,;:!?"]] = 6
_CLASS[[ord(c) for c in "'\"()-"]] = 7
_CLASS[[ord(c) for c in "#*$%&|<>[]{}@/\\^_`~+="]] = 8
_CONTINUES = np.zeros(256, bool)
_CONTINUES[128:192] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Common words in a language reference.
    common_words: int = 100
    #: Below these, a distance decides nothing.
    min_chars: int = 200
    min_judged_words: int = 50
    max_class_distance: float = 0.16
    max_word_distance: float = 0.30
    #: Added to both bounds after division by the root of the number of words.
    short_text: float = 2.0


def _features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, before = K.word_spans(data, offsets)
    n = len(offsets) - 1
    chars = np.concatenate([[0], np.cumsum(~_CONTINUES[data], dtype=np.int64)])
    n_words = np.diff(before)
    row = K.row_of(before)
    hashes = K.span_hash(data, starts, ends)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int64)])
    # Lines with a word, by row; equal ones keep the first.
    brk = np.flatnonzero(data == 10)
    inner = offsets[1:-1]
    line_starts = np.unique(np.concatenate([offsets[:-1], brk + 1, inner]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    stop = line_ends - (data[line_ends - 1] == 10) if len(line_ends) else line_ends
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, line_starts)
    line_starts, stop = line_starts[worded], stop[worded]
    line_row = np.searchsorted(offsets, line_starts, "right") - 1
    key = K.mix(K.span_hash(data, line_starts, stop) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    n_dup = np.bincount(line_row, minlength=n) - np.bincount(line_row[first], minlength=n)
    # Words in 3-word windows that occur twice or more in the row.
    h3, at = K.window_hash(hashes, before, 3)
    key = K.mix(h3 + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(starts), bool)
    for j in range(3):
        covered[at[twice] + j] = True
    kind = _CLASS[data].astype(np.int64)
    counted = ~_CONTINUES[data]
    byte_row = np.repeat(np.arange(n), np.diff(offsets))
    classes = np.bincount((byte_row * len(CLASSES) + kind)[counted], minlength=n * len(CLASSES)).reshape(n, -1)
    return {
        "n_words": n_words, "word_chars": K.per_row(chars[ends] - chars[starts], before), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": n_dup, "n_repeat_words": K.per_row(covered, before), "classes": classes, "hashes": hashes, "row": row, "before": before,
    }


def references(docs: DataFrame, rules: Rules = Rules()) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language (null: ``""``): class shares, hashes of the common words (sorted) and their shares, with one more for all others.

    Counts cover every word of every document, whatever the layout. What reaches the driver is bounded by languages, not by vocabulary.
    """
    spark = docs.sparkSession
    names = ["lang", "kind", "key", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([x or "" for x in batch.column("lang").to_pylist()], object)
            data, offsets = K.utf8(batch.column("text"))
            for at, to in K.slices(offsets, 1 << 20):
                part = offsets[at : to + 1] - offsets[at]
                piece = data[offsets[at] : offsets[to]]
                starts, ends, before = K.word_spans(piece, part)
                hashes, row = K.span_hash(piece, starts, ends), K.row_of(before)
                byte_row = np.repeat(np.arange(to - at), np.diff(part))
                for lang in set(langs[at:to]):
                    mine = langs[at:to] == lang
                    chosen = mine[byte_row] & ~_CONTINUES[piece]
                    classes = np.bincount(_CLASS[piece][chosen], minlength=len(CLASSES))
                    words, n = np.unique(hashes[mine[row]], return_counts=True)
                    kind = np.repeat([0, 1, 2], [len(CLASSES), 1, len(words)])
                    key = np.concatenate([np.arange(len(CLASSES)), [0], words.view(np.int64)])
                    number = np.concatenate([classes, [n.sum()], n]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(number)], names=names)

    counted = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counted = store.table(spark, counted, "word-counts")
    kept = counted.where("kind < 2").collect()  # classes and the number of words per language
    totals = {r["lang"]: r["n"] for r in kept if r["kind"] == 1}
    if totals:
        # A common word has a thousandth of the words at least: at most a thousand of a language reach the driver.
        total = F.element_at(F.create_map(*(F.lit(x) for pair in totals.items() for x in pair)), F.col("lang"))
        kept += counted.where((F.col("kind") == 2) & (F.col("n") * 1000 >= total)).collect()
    store.drop(spark, counted)
    out = {}
    for lang in {r["lang"] for r in kept}:
        rows = [r for r in kept if r["lang"] == lang]
        classes = np.zeros(len(CLASSES))
        for r in rows:
            if r["kind"] == 0:
                classes[r["key"]] = r["n"]
        total_words = max(1, sum(r["n"] for r in rows if r["kind"] == 1))
        words = sorted(((r["n"], r["key"]) for r in rows if r["kind"] == 2), key=lambda x: (-x[0], x[1]))[: rules.common_words]
        words.sort(key=lambda x: np.int64(x[1]).view(np.uint64))
        share = np.array([n for n, _ in words], float) / total_words
        out[lang] = (classes / max(1, classes.sum()), np.array([k for _, k in words], np.int64).view(np.uint64), np.append(share, max(0.0, 1 - share.sum())))
    return out


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances (root of the base-2 divergence) between the rows of ``p`` and the distribution ``q``; a row without mass has 0."""
    mass = p.sum(1, keepdims=True)
    p = p / np.where(mass > 0, mass, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(mass[:, 0] > 0, np.sqrt(np.maximum((left + right) / 2, 0)), 0.0)


RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def quality_rules(spark: SparkSession, docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document (``doc_id, text, lang``): counts, distances to its language's reference, and the verdict.

    A null text has no words; a null language has a reference of its own. Rows of one doc_id count and are judged each by its own text. Of
    equally frequent words at the end of a reference the lesser hashes stay. A very long text is taken whole, alone in its kernel call. An
    empty table gives an empty result.
    """
    store.small_batches(spark)
    shared = spark.sparkContext.broadcast(references(docs, rules))  # bounded: classes and common words per language

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for batch in batches:
            langs = np.array([x or "" for x in batch.column("lang").to_pylist()], object)
            data, offsets = K.utf8(batch.column("text"))
            for at, to in K.slices(offsets, 1 << 20):
                f = _features(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                n = to - at
                by_class, by_word = np.zeros(n), np.zeros(n)
                for lang in set(langs[at:to]):
                    mine = np.flatnonzero(langs[at:to] == lang)
                    classes, words, shares = refs[lang]
                    by_class[mine] = jensen_shannon(f["classes"][mine].astype(float), classes)
                    index = np.searchsorted(words, f["hashes"])
                    index[(index >= len(words)) | (words.take(np.minimum(index, len(words) - 1), mode="clip") != f["hashes"] if len(words) else True)] = len(words)
                    counts = np.bincount(f["row"] * (len(words) + 1) + index, minlength=n * (len(words) + 1)).reshape(n, -1)
                    by_word[mine] = jensen_shannon(counts[mine].astype(float), shares)
                n_words = f["n_words"]
                base = (n_words < rules.min_words) | (100 * f["n_repeat_words"] > rules.max_repeat_percent * n_words)
                slack = rules.short_text / np.sqrt(np.maximum(n_words, 1))
                far = (f["classes"].sum(1) >= rules.min_chars) & (by_class > rules.max_class_distance + slack / 10)
                far |= (n_words >= rules.min_judged_words) & (by_word > rules.max_word_distance + slack)
                arrays = [batch.column("doc_id").slice(at, n), *(pa.array(f[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(base), pa.array(~base & ~far), pa.array(by_class), pa.array(by_word)]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in RULES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(judge, RULES)
