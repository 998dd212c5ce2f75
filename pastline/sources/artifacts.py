"""Small JSON records and hashes of stored files, read and written through Spark, so that any store works that the cluster can reach."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.sources.tables import InputError


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def to_json(record: object) -> str:
    """One form for equal records: keys in order, no spaces."""
    return json.dumps(record, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def order_hash(columns: list[str]) -> str:
    """A fingerprint of columns in their order."""
    return text_hash(json.dumps(columns, ensure_ascii=False, separators=(",", ":")))


def write_json(spark: SparkSession, record: dict, path: str) -> str:
    """Stores ``record`` under ``path``, which must be new, and returns the hash of its text."""
    text = to_json(record)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return text_hash(text)


def read_json(spark: SparkSession, path: str) -> tuple[dict, str]:
    """The record under ``path`` and the hash of its text as it is now."""
    rows = spark.read.text(path).collect()
    if len(rows) != 1:
        raise InputError(f"{path} is not one record")
    return json.loads(rows[0][0]), text_hash(rows[0][0])


def files_hash(spark: SparkSession, path: str) -> str:
    """A hash of all data files below ``path``: of their places there and contents, each hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha")).where(~F.col("name").rlike(r"/[._]")).orderBy("name", "sha").collect()
    return text_hash(to_json([[r["name"].split("/")[0], r["sha"]] for r in parts]))


def rows_hash(df: DataFrame) -> str:
    """A hash of a table's rows in any order: how many there are, and the sum and the exclusive or of parts of their SHA-256."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.conv(F.substring(F.col("h"), at, 15), 16, 10)
    r = df.select(row.alias("h")).agg(F.count("*").alias("n"), F.sum(part(1).cast("decimal(20,0)")).alias("s"), F.bit_xor(part(16).cast("long")).alias("x")).first()
    return text_hash(to_json([r["n"], str(r["s"]), r["x"]]))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a stored table: names, lengths and times of its files, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.unix_micros("modificationTime").alias("us"))
    return text_hash(to_json([list(r) for r in files.orderBy("name", "length", "us").collect()]))


def cached(spark: SparkSession, spec: dict, source: str, store: str, compute: Callable[[], DataFrame], force: bool = False) -> tuple[DataFrame, str]:
    """The result of ``compute`` for ``spec`` over the table stored at ``source``, kept under ``store``, and ``hit``, ``miss`` or ``stale``.

    A kept result is used if it was made by an equal spec from files that are still the same; if they changed it is made again, as with
    ``force``. A result counts once its record is written, which comes last.
    """
    at, now = f"{store}/{text_hash(to_json(spec))}", fingerprint(spark, source)
    key = f"{at}/{now}"
    if not force and files_at(spark, f"{key}/record") and read_json(spark, f"{key}/record")[0] == {"spec": spec, "source": now}:
        return spark.read.parquet(f"{key}/result"), "hit"
    state = "stale" if files_at(spark, at) else "miss"
    if files_at(spark, key):  # an unfinished or forced one
        where = spark._jvm.org.apache.hadoop.fs.Path(key)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    compute().write.parquet(f"{key}/result")
    write_json(spark, {"spec": spec, "source": now}, f"{key}/record")
    return spark.read.parquet(f"{key}/result"), state


def files_at(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
