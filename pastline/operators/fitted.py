"""Transforms and encoders that are fitted on the train split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastline.functions.scalars import base_ratios, derived_name, non_negative
from pastline.plans.ordered import numbered, quantiles
from pastline.sources.tables import InputError

UNKNOWN = "__UNKNOWN__"


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """``value, code``: the train split's values in order, numbered from 0 by ranges. As large as the column's distinct values."""
    values = df.where(F.col("split") == "train").select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return numbered(df.sparkSession, values, ["value"], "code").select("value", F.col("code").cast("int"))


def encode(df: DataFrame, column: str) -> DataFrame:
    """Three encoders of one column: ``*_code`` (unseen -1), ``*_node`` (unseen: number of values) and ``*_native`` (unseen ``__UNKNOWN__``)."""
    vocab = vocabulary(df, column)
    size = F.broadcast(vocab.agg(F.count("*").cast("int").alias("_size")))  # one row
    joined = df.join(vocab, F.col(column).cast("string") == F.col("value"), "left").join(size)
    return joined.select(*df.columns, F.coalesce("code", F.lit(-1)).alias(f"{column}_code"), F.coalesce("code", "_size").alias(f"{column}_node"), F.coalesce("value", F.lit(UNKNOWN)).alias(f"{column}_native"))


def encode_one(df: DataFrame, column: str, name: str, source: DataFrame) -> DataFrame:
    """``df`` with the code of ``column`` by the train rows of ``source``; unseen and null are -1."""
    vocab = vocabulary(source, column).toDF("_value", "_code")
    return df.join(vocab, F.col(column).cast("string") == F.col("_value"), "left").select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_code", F.lit(-1)).alias(name))


def unknown_summary(df: DataFrame, column: str) -> DataFrame:
    """Per split: rows with a value that train lacks, how many such values, and the first five."""
    unseen = df.where(F.col(column).isNotNull()).join(vocabulary(df, column), F.col(column).cast("string") == F.col("value"), "left_anti")
    by_value = unseen.groupBy("split", F.col(column).cast("string").alias("v")).count()
    first = F.row_number().over(Window.partitionBy("split").orderBy("v"))
    return by_value.withColumn("r", first).groupBy("split").agg(F.sum("count").alias("unknown_count"), F.count("*").alias("unknown_unique"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("v")))), ";").alias("examples"))


def quantiles_of_train(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row: per name of ``wanted`` (a value and a share) its train quantile as ``cap|name``, null where train has no value. All values go
    through one pass in long form."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value")) for n, (c, _) in wanted.items()])).alias("p")
    long = df.where(F.col("split") == "train").select(pairs).select("p.*")
    shares = sorted({q for _, q in wanted.values()})
    found = quantiles(long, "value", shares, ["feature"])
    return found.agg(*[F.max(F.when(F.col("feature") == n, F.col("q")[shares.index(q)])).alias(f"cap|{n}") for n, (_, q) in wanted.items()])


def train_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    return quantiles(df.where(F.col("split") == "train"), column, [q]).select(F.col("q")[0].alias("cap"))


def ratio_transforms(df: DataFrame, column: str, q: float = 0.9999) -> DataFrame:
    """The ratio's log1p and its value clipped at a train quantile."""
    cap = F.broadcast(train_quantile(df, column, q))  # one row
    return df.join(cap).select(*df.columns, F.log1p(column).alias(f"{column}__log1p"), F.least(column, "cap").alias(f"{column}__clip_train"), (F.col(column) > F.col("cap")).cast("int").alias(f"{column}__clipped"))


def sentinel_to_zero(recency: Column) -> Column:
    return F.when(recency == -1, 0.0).otherwise(recency)


def clamp_residual(x: Column, tolerance: float = 1e-3) -> Column:
    """Small negative rests of a sum become 0; larger ones are an error."""
    return F.when(x >= 0, x).when(x > -tolerance, F.lit(0.0)).otherwise(F.raise_error(F.lit("a sum of amounts is negative")))


def z_norm(df: DataFrame, column: str) -> DataFrame:
    """By the train split's mean and sample deviation; a deviation of 0 counts as 1."""
    fit = df.where(F.col("split") == "train").agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    scaled = (F.col(column) - F.col("_m")) / F.when(F.coalesce(F.col("_s"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("_s"))
    return df.join(F.broadcast(fit)).select(*df.columns, scaled.alias(f"{column}_z"))  # one row


def scale_pos_weight(df: DataFrame) -> float:
    r = df.where(F.col("split") == "train").agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos")).first()
    if not r["pos"] or not r["neg"]:
        raise InputError("train needs both classes")
    return r["neg"] / r["pos"]


def check_sentinels(df: DataFrame, recency: str, first: str) -> int:
    """Rows whose recency is -1 without being first, or the other way round, or negative otherwise."""
    r, f = F.col(recency), F.col(first)
    return df.agg(F.count_if(((r == -1) != (f == 1)) | ((r < 0) & (r != -1))).alias("n")).first()["n"]


def post_stage(df: DataFrame, features: list[str], recency: dict[str, str], q: float = 0.9999) -> DataFrame:
    """``df`` with, for each base ratio among ``features``, its log1p and its value clipped at the train quantile (named by :func:`derived_name`), and
    with the sentinel of the ``recency`` columns (each with its first-row flag) as 0.

    All quantiles are fitted in one pass over the train rows. A ratio below 0, and a recency of -1 that its flag does not match, are errors when
    the row is read.
    """
    ratios = base_ratios(features)
    caps = quantiles_of_train(df, {c: (F.col(f"`{c}`"), q) for c in ratios}) if ratios else None
    joined = df.join(F.broadcast(caps)) if ratios else df  # one row
    columns = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        if c in recency:
            first = F.col(f"`{recency[c]}`")
            bad = ((x == -1) != (first == 1)) | ((x < 0) & (x != -1))
            x = F.when(bad, F.raise_error(F.lit(f"{c} does not match {recency[c]}")).cast("double")).otherwise(sentinel_to_zero(x))
        columns.append(x.alias(c))
    for c in ratios:
        x = non_negative(F.col(f"`{c}`"), c)
        columns += [F.log1p(x).alias(derived_name(c, "log1p")), F.least(F.col(f"`{c}`"), F.col(f"`cap|{c}`")).alias(derived_name(c, "clip_train_p9999"))]
    return joined.select(*columns)


def clip_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature, split, clipped``: rows of each split whose value :func:`post_stage` clipped, per base ratio of ``features``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"`{c}`") > F.col(f"`{derived_name(c, 'clip_train_p9999')}`")).alias("over")) for c in base_ratios(features)])).alias("p")
    return df.select("split", pairs).groupBy("p.feature", "split").agg(F.count_if("p.over").alias("clipped"))
