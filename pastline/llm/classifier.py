"""Quality classifier: supervised subword embeddings.

Words and the character n-grams inside them are hashed to rows of one embedding table; a document is the mean of its rows, and a softmax
layer turns that into class probabilities. Rows and weights are learned together by stochastic gradient descent in numpy on a bounded
sample of labelled documents. For scoring, the table is folded with the layer once: a row's contribution to the log-odds is one number,
so a document costs a gather and a mean over all its words and n-grams.
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

ROWS_BITS = 18
DIM = 16
GRAMS = (3, 4)
#: Labelled documents of each class that the model is fitted on, chosen by hash (a documented bound of the fit).
FIT_DOCS = 1500
#: Distinct rows of one document that the fit sees; of a longer one's, those least by a hash (the bound in bytes of what the driver gets).
FIT_ROWS = 8192
EPOCHS = 12
RATE = 0.4
CUT = 0.7
SCHEMA = "doc_id long, score double"


@dataclass
class Model:
    log_odds: np.ndarray
    bias: float


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all words and n-grams of the texts, and the rows before each text. Case and punctuation stay: they tell much."""
    data, offsets = K.utf8(column)
    starts, ends, before = K.word_spans(data, offsets)
    mask = np.uint64((1 << ROWS_BITS) - 1)
    words = (K.span_hash(data, starts, ends) & mask).astype(np.int32)
    row = K.row_of(before)
    found, owner = [words], [row]
    inside = ~K.WHITE[data]
    byte_row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    wide = data.astype(np.uint64)
    for n in GRAMS:
        size = len(data) - n + 1
        if size <= 0:
            continue
        code, ok = np.zeros(size, np.uint64), byte_row[:size] == byte_row[n - 1 :]
        for j in range(n):
            code |= wide[j : j + size] << np.uint64(8 * j)
            ok &= inside[j : j + size]
        at = np.flatnonzero(ok)
        code = code[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        found.append(((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - ROWS_BITS)).astype(np.int32))
        owner.append(byte_row[at])
    return np.concatenate(found), np.concatenate(owner)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, seed: int = 7) -> Model:
    """Learns ``label`` (0 or 1; others and nulls are left out) of ``labels`` (``doc_id, label``) from ``docs`` (``doc_id, text``).

    Of several labels of one doc_id the greatest counts; each row of the id teaches. With one class or none, every score is a half.
    """
    known = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Model(np.zeros(1 << ROWS_BITS, np.float32), 0.0)
    share = F.when(F.col("label") == 1, min(1.0, fit_docs / sizes[1]) * 1e6).otherwise(min(1.0, fit_docs / sizes[0]) * 1e6)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, _ = _features(batch.column("text").slice(i, 1))
                rows, n = np.unique(ids, return_counts=True)
                if len(rows) > FIT_ROWS:
                    kept = np.sort(np.argsort(K.mix(rows.astype(np.uint64)), kind="stable")[:FIT_ROWS])
                    rows, n = rows[kept], n[kept]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.array([rows.astype("<i4").tobytes()]), pa.array([n.astype("<f4").tobytes()])], names=["doc_id", "rows", "counts"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen.select(F.col("doc_id").alias("d"))), F.col("doc_id") == F.col("d"), "left_semi")
    sample = texts.mapInArrow(count, "doc_id long, rows binary, counts binary").join(chosen, "doc_id").collect()  # about 2 * fit_docs rows
    sample.sort(key=lambda r: r["doc_id"])
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << ROWS_BITS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    data = [(np.frombuffer(r["rows"], "<i4"), np.frombuffer(r["counts"], "<f4"), r["label"]) for r in sample]
    data = [(rows, c / c.sum(), y) for rows, c, y in data if len(rows)]
    steps, step = EPOCHS * max(1, len(data)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            rows, share_, y = data[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = np.einsum("i,ij->j", share_, table[rows])
            z = (mean[:, None] * weights).sum(0) + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            table[rows] -= (rate * len(rows) ** 0.5) * np.outer(share_, (weights * p).sum(1))
            weights -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
    return Model((table * (weights[:, 1] - weights[:, 0])).sum(1), float(bias[1] - bias[0]))


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row's whole text: the probability of label 1. An empty or null text has the bias alone; equal texts have equal
    scores; a very long text is taken whole, alone in its kernel call."""
    store.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed size: 2 ** ROWS_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            _, offsets = K.utf8(text)
            for at, to in K.slices(offsets, 2 << 20):
                ids, owner = _features(text.slice(at, to - at))
                n = to - at
                mean = np.bincount(owner, model.log_odds[ids], n) / np.maximum(np.bincount(owner, minlength=n), 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.array(1 / (1 + np.exp(-np.clip(mean + model.bias, -50, 50))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
