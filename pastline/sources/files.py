"""File sources and sinks: projected and sampled reads, metadata, CSV and JSON, guarded writes, feature catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.functions.scalars import contract_bool
from pastline.sources.tables import InputError
from pastline.specs import check_no_leak


def read_columns(spark: SparkSession, path: str, columns: list[str], rows: int | None = None) -> DataFrame:
    """The columns in the given order, at most ``rows`` rows (a head, not a sample). A column that the file lacks is an error."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InputError(f"{path} lacks {', '.join(missing)}")
    df = df.select(*columns)
    return df if rows is None else df.limit(rows)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """``column, type, place, n_rows`` of a Parquet path. The count comes from the footers."""
    df = spark.read.parquet(path)
    rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "column string, type string, place int").crossJoin(F.broadcast(df.agg(F.count("*").alias("n_rows"))))  # one row


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def guard(spark: SparkSession, paths: list[str], overwrite: bool) -> None:
    """Refuses before anything is written if an output exists and ``overwrite`` is not set."""
    there = [] if overwrite else [p for p in paths if exists(spark, p)]
    if there:
        raise FileExistsError(f"already there: {', '.join(there)}")


def write(spark: SparkSession, df: DataFrame, path: str, kind: str = "parquet", overwrite: bool = False) -> None:
    """One of Parquet, CSV (with a header) or JSON lines."""
    guard(spark, [path], overwrite)
    df.write.mode("overwrite" if overwrite else "error").options(**({"header": True} if kind == "csv" else {})).format(kind).save(path)


def write_sorted(spark: SparkSession, df: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """Parquet files that are in ``order`` one after another (by name) and inside: rows are dealt by ranges and sorted there. ``order`` should end in a
    unique column, or equal rows stand in any order."""
    guard(spark, [path], overwrite)
    df.orderBy(*order).write.mode("overwrite" if overwrite else "error").parquet(path)


def write_splits(spark: SparkSession, df: DataFrame, path: str, overwrite: bool = False) -> dict[str, str]:
    """All rows under ``all`` and each split's under its own name, read from the stored whole. A row of another split, or of none, is an error before
    any split is written, so that the parts have all rows."""
    paths = {k: f"{path}/{k}" for k in ("all", "train", "val", "test")}
    guard(spark, list(paths.values()), overwrite)
    df.write.mode("overwrite").parquet(paths["all"])
    whole = spark.read.parquet(paths["all"])
    other = whole.where(F.col("split").isNull() | ~F.col("split").isin("train", "val", "test")).groupBy("split").count().limit(5).collect()
    if other:
        raise InputError(f"rows of no split to write: {', '.join(f'{r[0]} ({r[1]})' for r in other)}")
    for k in ("train", "val", "test"):
        whole.where(F.col("split") == k).write.mode("overwrite").parquet(paths[k])
    return paths


def check_written(spark: SparkSession, path: str, expected: DataFrame) -> None:
    """The stored columns and types are those of ``expected``, in order."""
    got, want = spark.read.parquet(path).dtypes, expected.dtypes
    if got != want:
        raise InputError(f"{path}: {[x for x in zip(got, want) if x[0] != x[1]] or (len(got), len(want))}")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By header names and a stated schema; a row that doesn't fit it is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_catalog(spark: SparkSession, path: str, available: list[str] | None = None) -> list[str]:
    """Feature names of a catalog CSV (``column_name, used_in_ml`` and others) whose flag is TRUE, in file order.

    Names that are blank, repeated, leak the label or aren't ``available``, flags other than TRUE or FALSE, and no feature at all are errors.
    A catalog has a row per column, so it is read on the driver.
    """
    df = spark.read.option("header", True).csv(path)
    lacking = [c for c in ("column_name", "used_in_ml") if c not in df.columns]
    if lacking:
        raise InputError(f"{path} lacks {', '.join(lacking)}")
    rows = df.select("column_name", "used_in_ml").collect()
    try:
        names = [r["column_name"] for r in rows if contract_bool(r["used_in_ml"])]
    except ValueError as e:
        raise InputError(f"{path}: used_in_ml {e}") from e
    every = [r["column_name"] for r in rows]
    if any(not n or not n.strip() or n != n.strip() for n in every):
        raise InputError(f"{path}: a column name is blank or padded")
    if len(set(every)) != len(every):
        raise InputError(f"{path}: repeated column {', '.join(sorted({n for n in every if every.count(n) > 1}))}")
    check_no_leak(names, "the catalog")
    absent = [n for n in names if available is not None and n not in available]
    if absent or not names:
        raise InputError(f"{path}: " + (f"not in the data: {', '.join(absent)}" if absent else "no feature is used"))
    return names
