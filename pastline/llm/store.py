"""Intermediate tables in the folder that the whole cluster shares, and what the operators' Arrow stages need of a session."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: many short texts and a few long ones both stay small.
BATCH_ROWS, BATCH_BYTES = "1000", "4m"
#: Bytes of a row group of a stored table: what a writing task holds.
ROW_GROUP = 16 << 20
#: Rows of ids that :func:`few` broadcasts: 16 MB of longs.
FEW_ROWS = 2_000_000
#: Keys that :func:`spread_join` broadcasts, at most.
HEAVY_KEYS = 5_000
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, one machine (``local``) gets a folder made; a cluster is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="pastline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _ship(context: SparkContext) -> None:
    """Gives the workers this package, through Spark's own file server."""
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="pastline-zip-"), "pastline_workers.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession, rows: str = BATCH_ROWS) -> None:
    """Bounds the Arrow batches of this session in rows and bytes, and ships the package to its workers.

    The plan reads these settings when it runs, after the operator has returned; they stay set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    _ship(spark.sparkContext)


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs meanwhile go as soon as it has ended."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and reads it back: cuts the lineage, survives lost executors, frees the shuffle files behind it."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._stored_at = path
    return held


def few(spark: SparkSession, ids: DataFrame) -> DataFrame:
    """``ids`` (narrow rows, one per document) as a written table, broadcast in joins only if it is counted to have ``FEW_ROWS`` at most.

    Beyond that Spark's shuffled join takes it.
    """
    held = table(spark, ids, "ids")
    return F.broadcast(held) if held.count() <= FEW_ROWS else held


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups`` (one row per key; ``size``: about how many of ``rows`` have it; read twice, so store it).

    Keys with more than ``total / HEAVY_KEYS`` rows are broadcast: there can be ``HEAVY_KEYS`` of them at most, and their rows stay where
    they are. Only the others are dealt out by key, so no task gets a hot one.
    """
    most = max(1000, total // HEAVY_KEYS)
    heavy = F.broadcast(groups.where(F.col(size) > most))
    light = groups.where(F.col(size) <= most)
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys))


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files behind tables of :func:`table` that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in tables:
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(conf).delete(path, True)


def spread_left(spark: SparkSession, rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``groups``, a stored table of one row per key (``size``: how many of the ``total`` rows have it).

    Few groups are broadcast. Of more, those with over ``total / HEAVY_KEYS`` rows are (of which there can be ``HEAVY_KEYS`` at most), and
    only rows without such a key are dealt out. No column of ``groups`` but the keys may be one of ``rows``; ``size`` is never null there.
    """
    if groups.count() <= FEW_ROWS:
        return rows.join(F.broadcast(groups), keys, "left")
    most = max(1000, total // HEAVY_KEYS)
    held = rows.join(F.broadcast(groups.where(F.col(size) > most)), keys, "left")
    rest = held.where(F.col(size).isNull()).select(*rows.columns).join(groups.where(F.col(size) <= most), keys, "left")
    return held.where(F.col(size).isNotNull()).unionByName(rest)
