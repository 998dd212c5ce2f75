"""Exact dedup by counting quotient filters.

Every text, with each run of white space as one space, has a 64-bit fingerprint. Filters of each task's fingerprints are cut by their high
bits into shards, dealt out by shard and merged without loss. Fingerprints counted more than once, and only they, send their texts to a
verification that compares whole texts, byte by byte, as grouping keys: copies of one text meet once per task, so no group is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.llm import quotient, store

#: Fingerprints that a task holds before it writes filters of them, and about how many different ones a shard has.
HELD, SHARD = 1 << 20, 1 << 20
LEAST_SHARD_BITS = 4
WHITE_RUN = r"[\x20\x09-\x0D]+"
FILTERS = "shard int, filter binary"


def normalised(text: str = "text") -> Column:
    """A null text is empty; each run of ``[\\x20\\x09-\\x0D]`` is one space."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), WHITE_RUN, " ")


def merged_filters(spark: SparkSession, fingerprints: DataFrame, rows: int) -> DataFrame:
    """``shard, filter``: the counts of ``fp`` over all of about ``rows`` rows, a row per shard (the high bits of ``fp``)."""
    store.small_batches(spark, "100000")
    high = max(LEAST_SHARD_BITS, (max(1, rows // SHARD) - 1).bit_length())
    low = 64 - high

    def cut(values: np.ndarray) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(values, return_counts=True)
        shard = (values >> np.uint64(low)).astype(np.int64)
        new = np.flatnonzero(np.diff(shard, prepend=-1))
        for at, to in zip(new, np.append(new[1:], len(values)), strict=True):
            f = quotient.build(values[at:to] & np.uint64((1 << low) - 1), counts[at:to], low)
            yield pa.RecordBatch.from_arrays([pa.array([shard[at]], pa.int32()), pa.array([quotient.dump(f)], pa.binary())], names=["shard", "filter"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += batch.num_rows
            if size >= HELD:
                yield from cut(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from cut(np.concatenate(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([quotient.dump(quotient.merge(held))], pa.binary())], names=["shard", "filter"])

        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now and held:
                    yield done()
                    held, size = [], 0
                now = shard
                held.append(quotient.load(raw.as_py()))
                size += len(held[-1].slots)
                if size > 4 * SHARD and len(held) > 8:
                    held = [quotient.merge(held)]
                    size = len(held[0].slots)
        if held:
            yield done()

    return fingerprints.select("fp").mapInArrow(collect, FILTERS).repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, FILTERS)


def repeated(filters: DataFrame) -> DataFrame:
    """``fp, n`` of the fingerprints that ``filters`` count more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = quotient.load(raw.as_py())
                values, counts = quotient.read(f)
                more = counts > 1
                found = values[more] | np.uint64(shard << f.bits)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts[more])], names=["fp", "n"])

    return filters.mapInArrow(run, "fp long, n long")


def exact_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``; other columns may have any name): ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after :func:`normalised`; a null one equals an empty one. ``keep_id`` is the group's least doc_id, which is
    null only where no row has one. Exactly one row of a group is ``kept``: one of its least doc_id, any one of several such rows (null ids
    come last). Every row counts for ``group_size``. A table without rows gives none; a very long text is compared whole.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("t")).select("doc_id", F.xxhash64("t").alias("fp"), F.sha2("t", 256).alias("sha"))
    base = store.table(spark, found.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    total = base.count()
    counted = store.table(spark, repeated(merged_filters(spark, base, total)), "repeated").withColumnRenamed("n", "fp_n")
    mine = store.spread_left(spark, base, counted, ["fp"], "fp_n", total).where(F.col("fp_n").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = mine.groupBy("fp", "sha").agg(first.alias("first"), F.count("*").alias("size"))
    classes = groups.join(verified(spark, docs, counted, total), ["fp", "sha"]).select("fp", "sha", F.col("first.doc_id").alias("keep"), F.col("first.row").alias("keep_row"), "size")
    joined = store.spread_left(spark, base, store.table(spark, classes, "copies"), ["fp", "sha"], "size", total)
    single = F.col("size").isNull()
    return joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def verified(spark: SparkSession, docs: DataFrame, counted: DataFrame, total: int) -> DataFrame:
    """``fp, sha`` of the different texts behind the fingerprints ``counted`` more than once. Texts are told apart by their bytes; two of one
    fingerprint and one SHA-256 would be an error."""
    texts = docs.select(normalised().alias("t")).select("t", F.xxhash64("t").alias("fp"))
    same = store.spread_left(spark, texts, counted, ["fp"], "fp_n", total).where(F.col("fp_n").isNotNull()).groupBy("fp", "t").agg(F.count("*").alias("copies"))
    clash = F.raise_error(F.lit("different texts of one fingerprint and one SHA-256")).cast("string")
    return same.select("fp", F.sha2("t", 256).alias("s")).groupBy("fp", "s").count().select("fp", F.when(F.col("count") > 1, clash).otherwise(F.col("s")).alias("sha"))


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one that :func:`exact_classes` keeps."""
    found = store.table(spark, exact_classes(spark, docs), "classes").select(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("none"), F.col("text_sha256").alias("sha"), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")).withColumns({"i": F.coalesce(F.col("d.doc_id").cast("long"), F.lit(0)), "none": F.col("d.doc_id").isNull(), "sha": F.sha2(normalised("d.text"), 256)})
    keys = ["i", "none", "sha"]
    seen = found.groupBy(*keys).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    many = store.few(spark, seen.where(F.col("kept") & (F.col("n") > 1)).select(*keys))
    gone = store.few(spark, seen.where(~F.col("kept")).select(*keys))
    kept = rows.join(gone, keys, "left_anti")
    once = kept.join(many, keys, "left_anti").unionByName(kept.join(many, keys, "left_semi").dropDuplicates(keys))
    return once.select(*[F.col(f"d.`{c}`") for c in docs.columns])
