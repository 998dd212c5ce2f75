"""Review tables over features and scores: cell rates, samples, rankings, mixed association, group comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastline.functions.scalars import hour_of
from pastline.operators import association, stats
from pastline.plans.checkpoint import table
from pastline.plans.ordered import numbered, previous, quantiles, totals_before

def cell_rates(df: DataFrame, columns: list[str], group: str = "label") -> DataFrame:
    """Per feature, group and split: rows, and the shares of missing, zero and nonzero values."""
    v = F.col("value")
    return stats.long_form(df, columns, [group, "split"]).groupBy("feature", group, "split").agg(F.count("*").alias("n"), F.avg(v.isNull().cast("int")).alias("missing_rate"), F.avg(F.coalesce(v == 0, F.lit(False)).cast("int")).alias("zero_rate"), F.avg(F.coalesce(v != 0, F.lit(False)).cast("int")).alias("nonzero_rate"))


def confusion_group(score: Column, label: Column, threshold: float) -> Column:
    hit = score >= threshold
    return F.when(hit & (label == 1), "TP").when(hit, "FP").when(label == 1, "FN").otherwise("TN")


def group_summary(df: DataFrame, value: str = "amount", group: str = "grp") -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def hourly(tx: DataFrame) -> DataFrame:
    """Rows and share of positives by hour of day."""
    return tx.groupBy(hour_of(F.col("us")).alias("hour")).agg(F.count("*").alias("n"), F.avg("label").alias("positive_rate"))


def quantiles_by(df: DataFrame, columns: list[str], group: str, at: list[float]) -> DataFrame:
    """Per feature and group: rows, mean, deviation, and a row per quantile."""
    long = stats.long_form(df, columns, [group])
    x = long.groupBy("feature", group).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    cuts = quantiles(long, "value", at, ["feature", group]).withColumnsRenamed({"feature": "_f", group: "_g"})
    x = x.join(F.broadcast(cuts), (F.col("feature") == F.col("_f")) & F.col(group).eqNullSafe(F.col("_g")), "left")  # a row per feature and group
    places = F.posexplode(F.array(*[F.lit(float(p)) for p in at])).alias("i", "quantile")
    return x.select("feature", group, "n", "mean", "std", "q", places).select("feature", group, "n", "mean", "std", "quantile", F.element_at("q", F.col("i") + 1).alias("value"))


def first_per_label(df: DataFrame, n: int, order: str = "tx_id") -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(order))).where(F.col("_r") <= n).drop("_r")


def evenly_spaced(spark: SparkSession, df: DataFrame, most: int, order: list[str]) -> DataFrame:
    """``most`` rows at equal steps of the order, first and last included; all rows if there are no more."""
    n = df.count()
    if n <= most:
        return df
    step = (n - 1) / max(1, most - 1)
    wanted = F.broadcast(spark.range(most).select(F.floor(F.col("id") * step + 1e-9).alias("_place")).distinct())  # ``most`` rows
    return numbered(spark, df, order, "_place").join(wanted, "_place").select(*df.columns)


def group_sample(df: DataFrame, n: int, seed: int, group: str = "grp", key: str = "tx_id") -> DataFrame:
    """``n`` rows of each group without replacement, in the order of a seeded hash of the key."""
    at = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(at, key))).where(F.col("_r") <= n).drop("_r")


def class_weights(df: DataFrame) -> DataFrame:
    """Each row's sampling weight: one over the rows of its label."""
    sizes = F.broadcast(df.groupBy("label").agg(F.count("*").alias("_n")))  # a row per label
    return df.join(sizes, "label").select(*df.columns, (1 / F.col("_n")).alias("weight"))


def weighted_draws(spark: SparkSession, df: DataFrame, n: int, seed: int, units: str, key: str = "tx_id") -> DataFrame:
    """``draw, key``: ``n`` draws with replacement, each row with a chance in proportion to its whole, non-negative ``units``.

    A draw's place is a seeded hash of its number below the sum of all units. Rows get their places in the order of ``key`` by running totals over
    ranges, and each draw takes the last row at or before its place; so draws are the same at any partitioning.
    """
    rows = df.select(F.col(key).alias("key"), F.col(units).cast("long").alias("units")).where("units > 0")
    placed = table(spark, totals_before(spark, rows, ["key"], {"at": F.col("units")}), "placed")
    total = placed.agg(F.sum("units")).first()[0] or 0
    at = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    draws = spark.range(n if total else 0).select(F.lit(None).cast(dict(placed.dtypes)["key"]).alias("key"), F.pmod(at, F.lit(max(1, total))).alias("at"), F.col("id").alias("draw"))
    both = placed.select("key", "at", F.lit(-1).cast("long").alias("draw")).unionByName(draws)
    found = previous(spark, both, ["at", "draw"], {"row": F.col("key")}, last=True)
    return found.where("draw >= 0").select("draw", F.col("row").alias(key))


def column_profile(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """``column, type, non_null, missing, missing_rate, n_unique, low, high, mean, top_values``: numbers and times have a range (as text), numbers a
    mean, other columns their ``top`` values with counts as JSON, in order. NaN is missing. One pass over (column, value)."""
    types = dict(df.dtypes)
    number = {c: types[c].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) for c in columns}
    time = {c: types[c].startswith(("timestamp", "date")) for c in columns}
    text = lambda c: F.when(~F.isnan(F.col(c)), F.col(c).cast("string")) if types[c] in ("float", "double") else F.col(c).cast("string")
    pairs = [F.struct(F.lit(c).alias("column"), text(c).alias("v"), (F.col(c).cast("double") if number[c] else F.lit(None).cast("double")).alias("x")) for c in columns]
    values = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").groupBy("column", "v").agg(F.count("*").alias("n"), F.min("x").alias("x"))
    values = table(df.sparkSession, values, "values")
    x = F.when(~F.isnan("x"), F.col("x"))
    found = values.groupBy("column").agg(
        F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.count("v").alias("n_unique"),
        F.min_by("v", x).alias("low"), F.max_by("v", x).alias("high"), (F.sum(x * F.col("n")) / F.sum(F.when(x.isNotNull(), F.col("n")))).alias("mean"), F.min("v").alias("first"), F.max("v").alias("last"),
    )
    ranked = values.where(F.col("v").isNotNull()).withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "v"))).where(F.col("r") <= top)
    said = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "v", "n"))), lambda e: F.concat(F.regexp_replace(F.to_json(F.array(e["v"])), r"^\[|\]$", ""), F.lit(":"), e["n"].cast("string"))), ","), F.lit("}"))
    tops = ranked.groupBy(F.col("column").alias("c")).agg(said.alias("top_values"))
    kinds = F.broadcast(df.sparkSession.createDataFrame([(c, types[c], number[c], time[c]) for c in columns], "k string, type string, number boolean, time boolean"))
    j = found.join(kinds, F.col("column") == F.col("k")).join(F.broadcast(tops), F.col("column") == F.col("c"), "left")  # a row per column
    low, high = (F.when(F.col("number"), F.col(a)).when(F.col("time"), F.col(b)) for a, b in (("low", "first"), ("high", "last")))
    rate = F.col("missing") / (F.col("missing") + F.col("non_null"))
    return j.select("column", "type", "non_null", "missing", rate.alias("missing_rate"), "n_unique", low.alias("low"), high.alias("high"), "mean", F.when(~F.col("number") & ~F.col("time"), F.coalesce("top_values", F.lit("{}"))).alias("top_values"))


def sliding_batches(spark: SparkSession, df: DataFrame, size: int, stride: int, order: list[str]) -> DataFrame:
    """Rows with the ids of the batches that hold them: batch ``b`` has the places from ``b * stride`` to ``b * stride + size - 1``."""
    placed = numbered(spark, df, order, "_place")
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_place") - size) / stride) + 1)
    high = F.floor(F.col("_place") / stride)
    return placed.where(low <= high).select(*df.columns, F.explode(F.sequence(low, high)).alias("batch"))


def typed_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, n_unique, kind``: a numeric column with more than five values is numeric, any other categorical. Different values of all columns
    are found in one grouped pass."""
    types = dict(df.dtypes)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v"), F.lit(types[c] not in ("string", "boolean")).alias("number")) for c in columns])).alias("p")
    values = df.select(each).select("p.*").groupBy("feature", "number", "v").agg(F.count("*").alias("n"))
    found = values.groupBy("feature", "number").agg(F.count("v").alias("n_unique"))
    return found.select("feature", "n_unique", F.when(F.col("number") & (F.col("n_unique") > 5), "numeric").otherwise("categorical").alias("kind"))


def categorical_woe(df: DataFrame, column: str, alpha: float = 0.5) -> DataFrame:
    """WOE and IV of a categorical column's levels."""
    g = df.groupBy(F.col(column).alias("level")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    totals = F.broadcast(g.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.count("*").alias("nb")))  # one row
    pd, nd = (F.col("pos") + alpha) / (F.col("p") + alpha * F.col("nb")), (F.col("neg") + alpha) / (F.col("q") + alpha * F.col("nb"))
    return g.join(totals).select("level", "pos", "neg", F.log(pd / nd).alias("woe"), ((pd - nd) * F.log(pd / nd)).alias("iv"))


def iv_ranking(df: DataFrame, columns: list[str]) -> DataFrame:
    """``place, feature, bins, iv, strength``: the features by information value."""
    total = stats.woe_iv(df, columns).groupBy("feature").agg(F.count("*").alias("bins"), F.sum("iv").alias("iv"))
    return total.select(F.rank().over(Window.orderBy(F.desc("iv"))).alias("place"), "feature", "bins", "iv", stats.iv_strength(F.col("iv")).alias("strength"))  # a row per feature


def top_pairs(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    r = stats.correlations(df, columns)
    return r.orderBy(F.desc(F.abs("r")), "a", "b").limit(k)


def mixed_association(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``a, b, measure, value`` of all pairs: Pearson of two numeric columns, Cramér's V of two categorical ones, else the correlation ratio."""
    return association.mixed(df, kinds)


def review_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Features by the sum of five absolute indicators (nulls as 0): the share of zeros, drift of signed log means and of nonzero rates, label
    separation of means and of nonzero rates."""
    zero = stats.long_form(df, columns, []).groupBy("feature").agg(F.avg(F.coalesce(F.col("value") == 0, F.lit(False)).cast("int")).alias("zero_rate"))
    both = zero.join(stats.drift(df, columns), "feature").join(stats.label_separation(df, columns), "feature")
    indicators = ("zero_rate", "log_gap", "nonzero_gap", "smd", "nonzero_diff")
    score = reduce(lambda x, y: x + y, [F.abs(F.coalesce(F.col(c), F.lit(0.0))) for c in indicators])
    return both.select("feature", *indicators, score.alias("review_score"))


def compare_groups(spark: SparkSession, df: DataFrame, columns: list[str], group: str = "grp", least: int = 5) -> DataFrame:
    """Mann-Whitney tests of ``columns`` between all pairs of TP, FP, FN and TN with ``least`` values or more each: U of the first group,
    rank-biserial effect, two-sided p, and p adjusted by Benjamini and Hochberg over the features of a pair."""
    long = stats.long_form(df.withColumn("grp", F.col(group)), columns, ["grp"])
    t = association.rank_tests(spark, long, ["TP", "FP", "FN", "TN"], association.PAIRS).where((F.col("n1") >= least) & (F.col("n2") >= least))
    t = association.adjusted(t, ["first", "second"])
    return t.select("first", "second", "feature", "n1", "n2", "u", (F.try_divide(2 * F.col("u"), F.col("n1") * F.col("n2")) - 1).alias("rank_biserial"), "p", "p_adjusted")
