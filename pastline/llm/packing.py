"""Packing by cutting-stock column generation.

Pieces (a document's ids, cut at every full sequence) fall into length classes. Only the histogram of classes reaches the driver, and its
size is bounded by ``capacity / unit`` whatever the corpus. There a linear program chooses how often to use each pattern (a
multiset of classes that fits one sequence): a restricted master keeps one basic pattern per class, and an unbounded knapsack by dynamic
programming prices new patterns from the duals until none improves. Rounded-down pattern counts plus a first-fit-decreasing tail
over the few remaining pieces give the sequences. Back in Spark every piece gets its rank inside its class (ranks are computed per bucket
of a class and shifted by bucket totals, so a class with a third of all pieces is spread), and class ranks map to pattern slots.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pastline.llm import store
from pastline.llm import textkernel as K
from pastline.llm.tokenize import tokenizer

CAPACITY = 4096
#: Width of a length class in ids; pieces are planned as if rounded up to it.
UNIT = 16
#: Pieces in a ranking bucket, about.
BUCKET_PIECES = 20_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of the tokenised texts: full sequences and, last, what is left. A null text is empty and gives the end id alone.

    ``ids`` holds little-endian unsigned 32-bit ids (null unless ``with_ids``).
    """
    import zlib

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            data, offsets = K.utf8(batch.column("text"))
            for at, to in K.slices(offsets, 8 << 20):
                ids, ends = coder.encode(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                raw = memoryview(ids.astype("<u4").tobytes())
                rows, starts, lengths, crcs, totals, blobs = [], [], [], [], [], []
                for i in range(to - at):
                    lo, hi = int(ends[i]), int(ends[i + 1])
                    for s in range(lo, hi, capacity):
                        e = min(hi, s + capacity)
                        blob = raw[4 * s : 4 * e]
                        rows.append(at + i)
                        starts.append(s - lo)
                        lengths.append(e - s)
                        crcs.append(zlib.crc32(blob))
                        totals.append(hi - lo)
                        blobs.append(bytes(blob) if with_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)), pa.array(blobs, pa.binary())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def solve_patterns(demand: np.ndarray, capacity: int, rounds: int = 4000, gain: float = 2e-3) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often to use each, covering ``demand[c]`` pieces of each class (class ``c`` takes ``c + 1`` of ``capacity`` units).

    The linear program's basis starts with one single-class pattern per class. Pricing ends when no pattern is worth ``gain`` more than
    the sequence it costs (so the program is within that share of its optimum), or after ``rounds`` steps (the patterns found
    so far are feasible at any time, so stopping early costs padding, never correctness).
    """
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    size, need = classes + 1, demand[classes].astype(float)
    m = len(classes)
    fit = capacity // size
    columns = np.diag(fit.astype(float))
    inverse = np.diag(1.0 / fit)
    amount = need / fit
    for step in range(rounds):
        duals = inverse.sum(axis=0)  # each pattern costs one sequence
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            n = int(np.searchsorted(size, c, "right"))
            best[c] = best[c - 1]
            if n:
                worth = duals[:n] + best[c - size[:n]]
                k = int(worth.argmax())
                if worth[k] > best[c] + 1e-12:
                    best[c], pick[c] = worth[k], k
        if best[capacity] <= 1 + gain:
            break
        pattern, c = np.zeros(m), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                pattern[pick[c]] += 1
                c -= size[pick[c]]
        direction = np.einsum("ij,j->i", inverse, pattern)
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        if not np.isfinite(theta):
            break
        amount = np.maximum(amount - theta * direction, 0)
        amount[out] = theta
        columns[:, out] = pattern
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        if step % 500 == 499:  # against drift
            amount = np.maximum(np.einsum("ij,j->i", inverse, need), 0)
    left = demand[classes].astype(np.int64)
    plan: list[tuple[dict[int, int], int]] = []
    for j in np.argsort(-amount, kind="stable"):
        use = columns[:, j].astype(np.int64)
        held = use > 0
        times = int(min(np.floor(amount[j] + 1e-6), (left[held] // use[held]).min())) if held.any() else 0
        if times > 0:
            plan.append(({int(classes[k]): int(use[k]) for k in np.flatnonzero(held)}, times))
            left = left - times * use
    free: list[int] = []
    bins: list[Counter] = []
    for k in range(m - 1, -1, -1):  # what rounding left: a few pieces per basic pattern
        for _ in range(int(left[k])):
            at = next((i for i, f in enumerate(free) if f >= size[k]), None)
            if at is None:
                at = len(free)
                free.append(capacity)
                bins.append(Counter())
            free[at] -= int(size[k])
            bins[at][int(classes[k])] += 1
    plan += [(dict(b), 1) for b in bins]
    return plan


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """``pieces`` (columns ``doc_id, start, length`` and any others, lengths 1 to ``capacity``) with ``sequence_id`` and ``offset``,
    which replace columns of these names; others may have any name.

    ``pieces`` should be a stored table, as it is read twice. Equal rows are placed one by one; an empty table gives an empty result.
    """
    unit = unit if capacity % unit == 0 else 1
    kind = F.ceil(F.col("length") / unit).cast("int") - 1
    counts = pieces.groupBy(kind.alias("kind")).count().collect()  # at most capacity / unit rows
    demand = np.zeros(capacity // unit, np.int64)
    for row in counts:
        demand[row["kind"]] = row["count"]
    plan = solve_patterns(demand, capacity // unit)
    # Class c's ranks [from, to) belong to a pattern that holds each of its sequences' a copies of the class.
    slots: dict[int, list[tuple[int, int, int]]] = {}
    filled: Counter = Counter()
    base = 0
    for pattern, times in plan:
        for c, copies in pattern.items():
            slots.setdefault(c, []).append((filled[c], copies, base))
            filled[c] += copies * times
        base += times
    table = {c: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for c, v in slots.items()}
    shared = spark.sparkContext.broadcast(table)  # bounded: a few entries per class and pattern

    buckets = max(1, int(demand.sum()) // bucket_pieces)
    tie = [c for c, kind_ in pieces.dtypes if c not in ("doc_id", "start") and kind_ in ("bigint", "int")]
    whole = F.struct(*[F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")]).alias("piece")  # so no name clashes
    placed = pieces.select("doc_id", "start", "length", *[F.col(f"`{c}`").alias(f"tie{k}") for k, c in enumerate(tie)], whole).withColumn("kind", kind).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    totals = placed.groupBy("kind", "bucket").count()
    before = totals.select("kind", "bucket", F.coalesce(F.sum("count").over(Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("doc_id", "start", *[f"tie{k}" for k in range(len(tie))])) - 1
    ranked = placed.withColumn("local", local).join(before, ["kind", "bucket"]).withColumn("rank", F.col("before") + F.col("local"))

    @F.pandas_udf(T.LongType())
    def sequence_of(kinds: pd.Series, ranks: pd.Series) -> pd.Series:
        out = np.zeros(len(kinds), np.int64)
        values, rank = kinds.to_numpy(), ranks.to_numpy()
        for c in np.unique(values):
            first, copies, start = shared.value[int(c)]
            here = np.flatnonzero(values == c)
            at = np.searchsorted(first, rank[here], "right") - 1
            out[here] = start[at] + (rank[here] - first[at]) // copies[at]
        return pd.Series(out)

    packed = ranked.withColumn("sequence_id", sequence_of("kind", "rank"))
    inside = Window.partitionBy("sequence_id").orderBy("kind", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return packed.select("piece.*", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs ``docs`` (``doc_id, text``; other columns are ignored)."""
    store.small_batches(spark)
    return pack(spark, store.table(spark, cut_documents(docs, vocabulary, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packed pieces with ids as rows ``sequence_id, ids, n_tokens``: the pieces of a sequence joined in order of offset (at most ``capacity`` ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens")).select("sequence_id", F.expr("aggregate(parts, x'', (a, p) -> concat(a, p.ids))").alias("ids"), "n_tokens")
