"""Summaries, drift, association, WOE/IV and score evaluation as plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastline.operators.association import correlations, cramers_pairs, eta_pairs, rank_tests  # noqa: F401  (correlations is one of these summaries)
from pastline.plans.ordered import quantiles, totals_before


def split_summary(tx: DataFrame) -> DataFrame:
    return tx.groupBy("split").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count_if(F.col("label") == 1).alias("positives"), F.avg("label").alias("positive_rate"))


def label_pivot(tx: DataFrame) -> DataFrame:
    p = tx.groupBy("split").pivot("label", [0, 1]).count().na.fill(0)
    return p.select("split", F.col("0").alias("negatives"), F.col("1").alias("positives"), (F.col("1") / (F.col("0") + F.col("1"))).alias("positive_rate"))


def time_bins(tx: DataFrame, unit: str = "day") -> DataFrame:
    """Rows and positives per split and hour or day (in UTC)."""
    width = {"hour": 3_600_000_000, "day": 86_400_000_000}[unit]
    return tx.groupBy("split", (F.col("us") - F.pmod("us", F.lit(width))).alias("bin_us")).agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


def long_form(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per source row and column: many columns are then summed in one pass and one shuffle. NaN becomes null."""
    pairs = ", ".join(f"'{c}', nullif(cast(`{c}` as double), double('NaN'))" for c in columns)
    return df.select(*keep, F.expr(f"stack({len(columns)}, {pairs}) as (feature, value)"))


def finite(v: Column) -> Column:
    """``v`` if it is a finite number, else null."""
    return F.when(F.abs(v) < float("inf"), v)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature: rows, missing (null or NaN), infinite and zero values, different values, and ``near_zero_variance``: no more than one of them.
    The least, quartiles, mean and greatest are those of finite values."""
    v = F.col("value")
    x = long_form(df, columns, [])
    cuts = F.broadcast(quantiles(x, finite(v), [0.25, 0.5, 0.75], ["feature"]))  # a row per feature
    return x.groupBy("feature").agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("missing"), F.count_if(F.abs(v) == float("inf")).alias("infinite"), F.count_if(v == 0).alias("zero"), F.countDistinct("value").alias("n_unique"),
        F.min(finite(v)).alias("low"), F.avg(finite(v)).alias("mean"), F.max(finite(v)).alias("high"),
    ).join(cuts, "feature", "left").select(
        "feature", "n", "missing", "infinite", "zero", "n_unique", (F.col("n_unique") <= 1).cast("int").alias("near_zero_variance"), "low", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), "mean", F.col("q")[2].alias("p75"), "high",
    )


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Partial sums per feature for all rows, each split and each label (``part``: ``all``, ``split train``, ``label 1`` ...). Sums and zeros are of
    finite values."""
    v, ok = F.col("value"), finite(F.col("value"))
    part = F.when(F.grouping("split") == 0, F.concat(F.lit("split "), F.coalesce(F.col("split"), F.lit("null")))).when(F.grouping("label") == 0, F.concat(F.lit("label "), F.coalesce(F.col("label").cast("string"), F.lit("null")))).otherwise("all")
    return long_form(df, columns, ["split", "label"]).groupingSets([["feature", "split"], ["feature", "label"], ["feature"]], "feature", "split", "label").agg(
        part.alias("part"), F.count("*").alias("n"), F.sum(ok).alias("total"), F.sum(ok * ok).alias("squares"), F.count_if(ok == 0).alias("zero"), F.count_if(ok != 0).alias("nonzero"), F.count_if(v.isNull()).alias("missing"), F.count_if(F.abs(v) == float("inf")).alias("infinite"),
    ).select("feature", "part", "n", "total", "squares", "zero", "nonzero", "missing", "infinite")


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def _clean() -> Column:
    """Values as they enter means and rates over all rows: what isn't finite is 0."""
    return F.coalesce(finite(F.col("value")), F.lit(0.0))


def drift(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means by split, ratios against train, the largest gap of signed log1p means against train, and the range of nonzero rates. Missing and
    infinite values are 0 in them, over all rows of a split; splits without rows count for no gap."""
    v, splits = _clean(), ("train", "val", "test")
    m = long_form(df, columns, ["split"]).groupBy("feature").agg(
        *[F.avg(F.when(F.col("split") == s, v)).alias(f"mean_{s}") for s in splits],
        *[F.avg(F.when(F.col("split") == s, (v != 0).cast("int"))).alias(f"nz_{s}") for s in splits],
    )
    log = {s: signed_log1p(F.col(f"mean_{s}")) for s in splits}
    rates = [F.col(f"nz_{s}") for s in splits]
    return m.select(
        "feature", "mean_train", "mean_val", "mean_test", F.try_divide("mean_val", "mean_train").alias("val_ratio"), F.try_divide("mean_test", "mean_train").alias("test_ratio"),
        F.greatest(*[F.abs(log[s] - log["train"]) for s in splits]).alias("log_gap"), (F.greatest(*rates) - F.least(*rates)).alias("nonzero_gap"),
    )


def label_separation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means by label, their standardised difference and that of nonzero rates. Missing and infinite values are 0 in them."""
    pick = lambda l, x: F.when(F.col("label") == l, x)  # noqa: E731, E741
    v, nz = _clean(), (_clean() != 0).cast("int")
    g = long_form(df, columns, ["label"]).groupBy("feature").agg(*[f(pick(k, x)).alias(f"{n}{k}") for k in (0, 1) for n, f, x in (("mean", F.avg, v), ("var", F.var_pop, v), ("nz", F.avg, nz))])
    return g.select("feature", "mean0", "mean1", F.try_divide(F.col("mean1") - F.col("mean0"), F.sqrt((F.col("var0") + F.col("var1")) / 2)).alias("smd"), (F.col("nz1") - F.col("nz0")).alias("nonzero_diff"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """From the contingency table's present cells alone; no row without any."""
    return cramers_pairs(df, [a, b]).select(F.col("value").alias("cramers_v"))


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """Rows without a category or a value don't count."""
    return eta_pairs(df, [category], [value]).select(F.col("value").alias("eta"))


def _few_edges(x: DataFrame, bins: int) -> DataFrame:
    """``feature, q``: quantiles of features with fewer than ``bins`` different values, at as many steps as they have values. Spark's own
    percentile holds no more than those few."""
    v = finite(F.col("value"))
    sizes = x.groupBy("feature").agg(F.countDistinct(v).alias("_u")).where((F.col("_u") >= 2) & (F.col("_u") < bins))
    shares = [[k / q for k in range(q + 1)] for q in range(2, bins)]
    found = x.join(F.broadcast(sizes), "feature").groupBy("feature", "_u").agg(F.percentile(v, F.array(*[F.lit(s) for part in shares for s in part])).alias("_all"))
    starts = [sum(len(p) for p in shares[:k]) + 1 for k in range(len(shares))]
    return found.select("feature", F.slice("_all", F.element_at(F.array(*map(F.lit, starts)), F.col("_u").cast("int") - 1), F.col("_u").cast("int") + 1).alias("q"))


def woe_iv(df: DataFrame, columns: list[str], bins: int = 10, alpha: float = 0.5) -> DataFrame:
    """Per feature and quantile bin: counts, smoothed WOE and IV. A feature has as many bins as different finite values, ``bins`` at most; repeated
    edges merge and belong to the lower bin. Null and NaN are bin -1, infinities in the outer bins. Features with fewer than three edges have no
    rows."""
    x = long_form(df, columns, ["label"])
    many = quantiles(x, finite(F.col("value")), [k / bins for k in range(bins + 1)], ["feature"])
    few = _few_edges(x, bins)
    q = many.join(few.withColumnRenamed("q", "few"), "feature", "left").select("feature", F.coalesce("few", "q").alias("q"))
    edges = q.select("feature", F.array_distinct("q").alias("e")).withColumn("inner", F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0))))
    kept = F.broadcast(edges.where(F.size("e") >= 3).select("feature", "inner"))  # a row per feature
    binned = x.join(kept, "feature").withColumn("bin", F.when(F.col("value").isNull(), -1).otherwise(F.size(F.filter("inner", lambda e: e < F.col("value")))))
    g = binned.groupBy("feature", "bin").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    w = Window.partitionBy("feature")
    nb = F.count("*").over(w)
    pd, nd = (F.col("pos") + alpha) / (F.sum("pos").over(w) + alpha * nb), (F.col("neg") + alpha) / (F.sum("neg").over(w) + alpha * nb)
    return g.select("feature", "bin", "pos", "neg", pd.alias("pd"), nd.alias("nd")).select("feature", "bin", "pos", "neg", F.log(F.col("pd") / F.col("nd")).alias("woe"), ((F.col("pd") - F.col("nd")) * F.log(F.col("pd") / F.col("nd"))).alias("iv"))


def iv_strength(iv: Column) -> Column:
    return F.when(iv.isNull(), "na").when(iv < 0.02, "useless").when(iv < 0.1, "weak").when(iv < 0.3, "medium").when(iv < 0.5, "strong").otherwise("suspicious")


def score_curve(spark: SparkSession, scores: DataFrame) -> DataFrame:
    """Per distinct score, from the top: predicted positives, true positives, precision, recall, F1. ``scores``: ``score, label``.

    Totals above a score are summed over ranges of scores, so no task sorts every score.
    """
    g = scores.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    total = F.broadcast(g.agg(F.sum("p").alias("all")))  # one row
    c = totals_before(spark, g, [F.desc("score")], {"n0": F.col("n"), "p0": F.col("p")}).join(total)
    c = c.select("score", (F.col("n") + F.col("n0")).alias("predicted"), (F.col("p") + F.col("p0")).alias("tp"), "p", "all")
    return c.select("score", "predicted", "tp", "p", "all", (F.col("tp") / F.col("predicted")).alias("precision"), (F.col("tp") / F.col("all")).alias("recall"), (2 * F.col("tp") / (F.col("predicted") + F.col("all"))).alias("f1"))


def best_threshold(spark: SparkSession, scores: DataFrame) -> DataFrame:
    """The score with the highest F1; the lowest of equals."""
    return score_curve(spark, scores).orderBy(F.desc("f1"), "score").limit(1).select(F.col("score").alias("threshold"), "precision", "recall", "f1")


def average_precision(spark: SparkSession, scores: DataFrame) -> DataFrame:
    return score_curve(spark, scores).agg(F.sum(F.col("p") / F.col("all") * F.col("precision")).alias("average_precision"))


def metrics_at(scores: DataFrame, threshold: float, eps: float = 1e-15) -> DataFrame:
    hit, y = F.col("score") >= threshold, F.col("label") == 1
    s = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    loss = F.avg(-F.when(y, F.log(s)).otherwise(F.log(1 - s)))
    c = scores.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"), loss.alias("log_loss"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", "tn", "log_loss", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


def capture_at(scores: DataFrame, ks: list[int]) -> DataFrame:
    """Positives among the ``k`` highest scores (ties by tx_id), as a share of all; only the largest ``k`` rows are ranked."""
    top = scores.orderBy(F.desc("score"), "tx_id").limit(max(ks)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "tx_id")))
    total = F.broadcast(scores.agg(F.sum("label").alias("all")))  # one row
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    return top.select("place", "label", k).where("place <= k").groupBy("k").agg(F.sum("label").alias("captured")).join(total).select("k", "captured", (F.col("captured") / F.col("all")).alias("capture_rate"))


def score_histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    return scores.groupBy("label", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.9).alias("high_risk"))


def mann_whitney(spark: SparkSession, df: DataFrame, value: str = "value", group: str = "label") -> DataFrame:
    """U of group 1 against group 0 with average ranks, the rank-biserial effect, and z and p by the normal approximation with ties corrected.
    Null and NaN values don't count."""
    long = df.select(F.lit(value).alias("feature"), F.col(value).cast("double").alias("value"), F.when(F.col(group) == 1, "1").when(F.col(group) == 0, "0").alias("grp"))
    t = rank_tests(spark, long, ["1", "0"], [("1", "0")])
    return t.select("u", F.col("n2").alias("n0"), "n1", (F.try_divide(2 * F.col("u"), F.col("n1") * F.col("n2")) - 1).alias("rank_biserial"), "z", "p")


def keep_levels(df: DataFrame, column: str, top: int = 50, least: int = 100) -> DataFrame:
    """Frequent levels stay, others become ``__OTHER__``, null ``__MISSING__``; if none is frequent enough, the top ones stay."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).count()
    first = counts.orderBy(F.desc("count"), "level").limit(top)
    enough = F.max("count").over(Window.partitionBy()) >= least
    kept = first.withColumn("any", enough).where(~F.col("any") | (F.col("count") >= least)).select("level", F.lit(True).alias("kept"))  # ``top`` rows
    named = F.when(F.col(column).isNull(), "__MISSING__").when(F.col("kept"), F.col(column)).otherwise("__OTHER__")
    return df.join(F.broadcast(kept), F.col(column) == F.col("level"), "left").select(*df.columns, named.alias(f"{column}_level"))
