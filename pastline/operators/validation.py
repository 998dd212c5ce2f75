"""Checks of feature tables. Each counts every breach in one pass; ``check_*`` raise with what they found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.operators.stats import long_form
from pastline.sources.tables import InputError

SPLITS = ("train", "val", "test")
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def normalize_split(df: DataFrame, column: str = "split") -> DataFrame:
    """The split column trimmed and in lower case; any other value is an error when the row is read."""
    s = F.lower(F.trim(F.col(column).cast("string")))
    known = F.when(s.isin(*SPLITS), s).otherwise(F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(s, F.lit("null")))))
    return df.withColumn(column, known)


def normalize_category(df: DataFrame, column: str) -> DataFrame:
    """The column as trimmed text; null or blank is an error when the row is read."""
    s = F.trim(F.col(column).cast("string"))
    return df.withColumn(column, F.when(F.length(s) > 0, s).otherwise(F.raise_error(F.lit(f"{column} is null or blank"))))


def feature_breaches(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, n, missing, infinite``; NaN counts as missing."""
    v = F.col("value")
    lost = v.isNull() | F.isnan(v)
    return long_form(df, columns, []).groupBy("feature").agg(F.count("*").alias("n"), F.count_if(lost).alias("missing"), F.count_if(~lost & (F.abs(v) == float("inf"))).alias("infinite"))


def check_features(df: DataFrame, columns: list[str], allow_missing: bool = False) -> None:
    types = dict(df.dtypes)
    wrong = [c for c in columns if c not in types or not types[c].startswith(_NUMERIC)]
    if wrong or len(set(columns)) != len(columns) or not columns:
        raise InputError(f"features that are absent, not numeric or repeated: {', '.join(wrong) or columns}")
    bad = feature_breaches(df, columns).where((F.col("infinite") > 0) | ((F.col("missing") > 0) & F.lit(not allow_missing))).collect()  # a row per feature
    if bad:
        raise InputError("; ".join(f"{r['feature']}: {r['missing']} missing, {r['infinite']} infinite" for r in bad))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: ``n, missing, other, negatives, positives``."""
    y = F.col(label).cast("double")
    return df.agg(F.count("*").alias("n"), F.count_if(y.isNull() | F.isnan(y)).alias("missing"), F.count_if(~y.isin(0.0, 1.0) & ~F.isnan(y)).alias("other"), F.count_if(y == 0).alias("negatives"), F.count_if(y == 1).alias("positives"))


def check_labels(df: DataFrame, label: str = "label") -> None:
    if label not in df.columns:
        raise InputError(f"no label column {label!r}")
    r = label_counts(df, label).first()
    if not r["n"] or r["missing"] or r["other"] or not r["negatives"] or not r["positives"]:
        raise InputError(f"labels: {r.asDict()}")


def check_split_column(df: DataFrame, expected: str) -> None:
    """Every row is of the split ``expected``."""
    if "split" not in df.columns:
        raise InputError("no split column")
    r = df.agg(F.count("*").alias("n"), F.count_if(~F.col("split").eqNullSafe(expected)).alias("other")).first()
    if not r["n"] or r["other"]:
        raise InputError(f"split {expected!r}: {r['n']} rows, {r['other']} of them of another split")


def check_required_splits(df: DataFrame) -> None:
    found = {r["split"] for r in df.select("split").distinct().limit(10).collect()}
    if found != set(SPLITS):
        raise InputError(f"splits {sorted(map(str, found))} instead of {', '.join(SPLITS)}")


def score_breaches(scores: DataFrame) -> DataFrame:
    """One row over ``score, label``: scores that are missing or outside 0 to 1, labels that aren't 0 or 1, and the classes' counts."""
    s = F.col("score")
    lost = s.isNull() | F.isnan(s)
    return scores.agg(F.count("*").alias("n"), F.count_if(lost).alias("missing"), F.count_if(~lost & ((s < 0) | (s > 1))).alias("outside"), F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("bad_label"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def check_scores(scores: DataFrame) -> None:
    r = score_breaches(scores).first()
    if not r["n"] or r["missing"] or r["outside"] or r["bad_label"] or not r["positives"] or not r["negatives"]:
        raise InputError(f"scores: {r.asDict()}")


def close(a: Column, b: Column, rtol: float = 1e-6, atol: float = 1e-7) -> Column:
    """Equal within tolerance; two nulls are equal."""
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False))


def check_existing(df: DataFrame, column: str, value: Column) -> None:
    """An existing derived column holds what it would be built as."""
    n = df.agg(F.count_if(~close(F.col(column), value)).alias("n")).first()["n"]
    if n:
        raise InputError(f"{column} differs from its rebuilt values in {n} rows")


def check_same_rows(result: DataFrame, source: DataFrame) -> None:
    a, b = result.count(), source.count()
    if a != b:
        raise InputError(f"{a} rows instead of {b}")


def preview_checks(parts: dict[str, DataFrame], summary: DataFrame) -> DataFrame:
    """``split, n, stated, ok``: the stored parts' counts against a split summary (``split, n``). Parts with different schemas are an error."""
    schemas = {k: df.dtypes for k, df in parts.items()}
    if len({tuple(x) for x in schemas.values()}) > 1:
        raise InputError(f"schemas differ: {schemas}")
    counted = None
    for k, df in parts.items():
        row = df.agg(F.lit(k).alias("split"), F.count("*").alias("n"))
        counted = row if counted is None else counted.unionByName(row)
    return counted.join(summary.select("split", F.col("n").alias("stated")), "split", "full").select("split", "n", "stated", F.col("n").eqNullSafe(F.col("stated")).alias("ok"))


def attach_split(tx: DataFrame, source: DataFrame) -> DataFrame:
    """``tx`` with the ``split`` of ``source`` by ``tx_id``. A row without one, or with several that differ, is an error when read."""
    differ = F.raise_error(F.concat(F.lit("several splits of "), F.col("tx_id").cast("string"))).cast("string")
    one = source.groupBy("tx_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).select("tx_id", F.when(F.col("lo") != F.col("hi"), differ).otherwise(F.col("lo")).alias("split"))
    joined = tx.join(one, "tx_id", "left")
    return joined.withColumn("split", F.coalesce("split", F.raise_error(F.lit("a transaction has no split"))))


def align_by_key(left: DataFrame, right: DataFrame, key: str, metadata: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right`` by ``key``. Keys that repeat or that only one side has, and ``metadata`` that differ between the
    sides (two nulls are equal), are errors, found in one pass before anything is joined for good."""
    mark = lambda df, n: df.groupBy(key).agg(F.count("*").alias(f"_n{n}"), *[F.max(c).alias(f"_{c}{n}") for c in metadata])
    both = mark(left, 1).withColumnRenamed(key, "_k1").join(mark(right, 2).withColumnRenamed(key, "_k2"), F.col("_k1").eqNullSafe(F.col("_k2")), "full")
    r = both.agg(
        F.count_if((F.col("_n1") > 1) | (F.col("_n2") > 1)).alias("repeated keys"), F.count_if(F.col("_n1").isNull()).alias("keys on the right alone"), F.count_if(F.col("_n2").isNull()).alias("keys on the left alone"),
        *[F.count_if(F.col("_n1").isNotNull() & F.col("_n2").isNotNull() & ~F.col(f"_{c}1").eqNullSafe(F.col(f"_{c}2"))).alias(f"rows with another {c}") for c in metadata],
    ).first()
    bad = [f"{n} {what}" for what, n in r.asDict().items() if n]
    if bad:
        raise InputError("; ".join(bad))
    more = [c for c in right.columns if c != key and c not in metadata and c not in left.columns]
    other = right.select(F.col(key).alias("_key"), *more)
    return left.join(other, F.col(key).eqNullSafe(F.col("_key"))).select(*left.columns, *more)


def load_split(spark: SparkSession, path: str, features: list[str], expected: str, label: str = "label", allow_missing: bool = False, rows: int | None = None) -> DataFrame:
    """``label`` and the features in order, of a stored split that passes every check."""
    df = spark.read.parquet(path)
    check_split_column(df, expected)
    check_labels(df, label)
    check_features(df, features, allow_missing)
    out = df.select(label, *features)
    return out if rows is None else out.limit(rows)
