"""Association of many columns at once: cross products per Arrow batch, contingency tables of all pairs in one pass, rank tests by ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastline.functions.scalars import normal_tail
from pastline.plans.checkpoint import ship
from pastline.plans.ordered import totals_before

PAIRS = [("TP", "FP"), ("TP", "FN"), ("TP", "TN"), ("FP", "FN"), ("FP", "TN"), ("FN", "TN")]
PRODUCTS = "i int, j int, n double, bad double, si double, sj double, qi double, qj double, p double"


def cross_products(df: DataFrame, columns: list[str], fill: bool) -> DataFrame:
    """``i, j, n, cov, vi, vj`` of all pairs of ``columns`` (places, ``i < j``): rows with both values, covariance and variances over those rows
    (population). One scan, whatever the number of columns.

    With ``fill``, null, NaN and infinity are 0; else rows without both values don't count for a pair, and a pair with an infinity has a null
    ``cov``. Sums are taken around the values of some first row, so that little is lost where a mean is far from 0; a task sends one row per pair.
    """
    ship(df.sparkSession)
    d = len(columns)
    upper = np.triu_indices(d, 1)
    values = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    some = values.head(1)
    shift = np.nan_to_num(np.array([x or 0.0 for x in some[0]] if some else [0.0] * d), nan=0.0, posinf=0.0, neginf=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bad, s, q, p = (np.zeros((d, d)) for _ in range(5))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])  # a null is NaN here
            inf, known = np.isinf(x), np.isfinite(x)
            if fill:
                x, known, inf = np.where(known, x, 0.0), np.ones_like(known), np.zeros_like(inf)
            x = np.where(known, x - shift, 0.0)
            k, there = known.astype(np.float64), (known | inf).astype(np.float64)
            n += k.T @ k
            bad += there.T @ there - k.T @ k
            s += x.T @ k
            q += (x * x).T @ k
            p += x.T @ x
        found = [n, bad, s, s.T, q, q.T, p]
        yield pa.RecordBatch.from_arrays([*[pa.array(u, pa.int32()) for u in upper], *[pa.array(f[upper]) for f in found]], names=[c.split()[0] for c in PRODUCTS.split(", ")])

    parts = values.mapInArrow(run, PRODUCTS)
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "si", "sj", "qi", "qj", "p")]).where("n > 0")
    n = F.col("n")
    about = lambda c, a, b: F.col(c) / n - (F.col(a) / n) * (F.col(b) / n)
    return sums.select("i", "j", n.cast("long").alias("n"), F.when(F.col("bad") == 0, about("p", "si", "sj")).alias("cov"), about("qi", "si", "si").alias("vi"), about("qj", "sj", "sj").alias("vj"))


def _named(found: DataFrame, columns: list[str]) -> DataFrame:
    name = F.array(*map(F.lit, columns))
    return found.select(name[F.col("i")].alias("a"), name[F.col("j")].alias("b"), "n", "cov", "vi", "vj")


def _bounded(r: Column) -> Column:
    return F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r``: population correlations of all pairs. Null, NaN and infinity count as 0; a column without spread gives 0."""
    x = _named(cross_products(df, columns, True), columns)
    spread = F.sqrt(F.col("vi")) * F.sqrt(F.col("vj"))
    return x.select("a", "b", F.when((F.col("vi") > 0) & (F.col("vj") > 0), _bounded(F.try_divide(F.col("cov"), spread))).otherwise(0.0).alias("r"))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r`` of all pairs over the rows that have both values (null and NaN are none). Null with fewer than two such rows, an infinity, or a
    column without spread."""
    x = _named(cross_products(df, columns, False), columns)
    spread = F.sqrt(F.col("vi")) * F.sqrt(F.col("vj"))
    return x.select("a", "b", F.when((F.col("n") > 1) & (F.col("vi") > 0) & (F.col("vj") > 0), _bounded(F.try_divide(F.col("cov"), spread))).alias("r"))


def _strength(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cramér's V per ``by`` from the present cells (``x, y, o``) of contingency tables."""
    rows = cells.groupBy(*by, "x").agg(F.sum("o").alias("rx"))
    columns = cells.groupBy(*by, "y").agg(F.sum("o").alias("cy"))
    both = cells.join(rows, [*by, "x"]).join(columns, [*by, "y"])
    s = both.groupBy(*by).agg(F.sum(F.col("o") * F.col("o") / (F.col("rx") * F.col("cy"))).alias("q"), F.countDistinct("x").alias("r"), F.countDistinct("y").alias("c"))
    k = F.least("r", "c") - 1
    return s.select(*by, F.when(k > 0, F.sqrt(F.least(F.greatest(F.try_divide(F.col("q") - 1, k), F.lit(0.0)), F.lit(1.0)))).otherwise(0.0).alias("value"))


def cramers_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, value`` of all pairs of categorical columns: their contingency tables are counted in one grouped pass. Rows with a null in a pair
    don't count for it; a pair with one level on a side gives 0, a pair without rows no row."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs])).alias("p")
    cells = df.select(each).select("p.*").where("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count("*").alias("o"))
    return _strength(cells, ["a", "b"])


def eta_pairs(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """``category, number, value``: correlation ratios of all pairs in one grouped pass. Rows without a category or a number (NaN is none) don't
    count; one category, or no spread, gives 0; a pair without rows gives none."""
    pairs = [F.struct(F.lit(c).alias("category"), F.lit(v).alias("number"), F.col(c).cast("string").alias("k"), F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")).alias("v")) for c in categories for v in numbers]
    each = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("k is not null and v is not null")
    g = each.groupBy("category", "number", "k").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("w"))
    grand = g.groupBy("category", "number").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu")).withColumnsRenamed({"category": "c", "number": "x"})
    j = g.join(F.broadcast(grand), (F.col("category") == F.col("c")) & (F.col("number") == F.col("x")))  # a row per pair of columns
    away = F.col("m") - F.col("mu")
    s = j.groupBy("category", "number").agg(F.sum(F.col("n") * away * away).alias("between"), F.sum(F.col("n") * F.col("w")).alias("within"), F.count("*").alias("k"))
    share = F.try_divide(F.col("between"), F.col("between") + F.col("within"))
    return s.select("category", "number", F.when((F.col("k") > 1) & (F.col("between") + F.col("within") > 0), F.sqrt(F.least(share, F.lit(1.0)))).otherwise(0.0).alias("value"))


def mixed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``a, b, measure, value`` of all pairs of ``kinds``: Pearson of two numeric columns, Cramér's V of two categorical ones, else the correlation
    ratio. Three grouped passes, whatever the number of columns."""
    names = list(kinds)
    numbers, categories = ([c for c in names if (kinds[c] == "numeric") == want] for want in (True, False))
    parts = []
    if len(numbers) > 1:
        parts.append(pearson(df, numbers).select("a", "b", F.lit("pearson").alias("measure"), F.col("r").alias("value")))
    if len(categories) > 1:
        parts.append(cramers_pairs(df, categories).select("a", "b", F.lit("cramers_v").alias("measure"), "value"))
    if numbers and categories:
        place = F.array(*map(F.lit, names))
        first = F.array_position(place, F.col("category")) < F.array_position(place, F.col("number"))
        a, b = F.when(first, F.col("category")).otherwise(F.col("number")), F.when(first, F.col("number")).otherwise(F.col("category"))
        parts.append(eta_pairs(df, categories, numbers).select(a.alias("a"), b.alias("b"), F.lit("eta").alias("measure"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank_tests(spark: SparkSession, long: DataFrame, groups: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Mann-Whitney tests of each feature of ``long`` (``feature, value, grp``) between all ``pairs`` of ``groups``: ``first, second, feature, n1, n2,
    u`` (of the first), ``z`` (with the variance corrected for ties) and two-sided ``p`` (with a correction for continuity).

    Null and NaN values don't count. Values are counted per feature and group, and one pass over their ranges gives what lies below each, from
    which the ranks of every pair follow; no task sorts a feature. All values equal: ``z`` is null and ``p`` 1.
    """
    known = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    names = [f"_g{i}" for i in range(len(groups))]
    counts = known.groupBy("feature", "value").agg(*[F.count_if(F.col("grp") == g).alias(n) for g, n in zip(groups, names, strict=True)])
    run = totals_before(spark, counts, ["feature", "value"], {f"_b{n}": F.col(n) for n in names})
    starts = run.groupBy("feature").agg(*[F.min(f"_b{n}").alias(f"_s{n}") for n in names])
    run = run.join(F.broadcast(starts), "feature")  # a row per feature
    at = dict(zip(groups, names, strict=True))
    below = lambda g: F.col(f"_b{at[g]}") - F.col(f"_s{at[g]}")
    sides = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(at[a]).alias("k1"), F.col(at[b]).alias("k2"), (below(a) + below(b)).alias("below")) for a, b in pairs]
    x = run.select("feature", F.explode(F.array(*sides)).alias("p")).select("feature", "p.*").where("k1 + k2 > 0")
    t = (F.col("k1") + F.col("k2")).cast("double")
    s = x.groupBy("first", "second", "feature").agg(F.sum(F.col("k1") * (F.col("below") + (t + 1) / 2)).alias("r1"), F.sum("k1").alias("n1"), F.sum("k2").alias("n2"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = s.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2).withColumn("s", F.sqrt(n1 * n2 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0)))))
    mean = n1 * n2 / 2
    far = F.try_divide(F.greatest(F.col("u"), n1 * n2 - F.col("u")) - mean - 0.5, F.col("s"))
    p = F.when(F.col("s") > 0, F.when(far > 0, F.least(normal_tail(far), F.lit(1.0))).otherwise(1.0)).otherwise(1.0)
    return u.select("first", "second", "feature", "n1", "n2", "u", F.when(F.col("s") > 0, F.try_divide(F.col("u") - mean, F.col("s"))).alias("z"), p.alias("p"))


def adjusted(tests: DataFrame, by: list[str]) -> DataFrame:
    """``p_adjusted`` by Benjamini and Hochberg over the features of each ``by``."""
    ranked = tests.withColumn("m", F.count("*").over(Window.partitionBy(*by))).withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("p", "feature")))
    worst = F.min(F.col("p") * F.col("m") / F.col("i")).over(Window.partitionBy(*by).orderBy("i").rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("p_adjusted", F.least(worst, F.lit(1.0))).drop("m", "i")
