"""Totals in a global order without a task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastline.plans.checkpoint import table


def totals_before(spark: SparkSession, df: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, per name of ``sums``, the sum of its column over all rows before the row in ``order`` (which should have no ties).

    Rows are dealt by ranges of the order and stored; each range sums its own rows and adds the totals of the ranges before it, of which
    there is one row per partition.
    """
    names = list(sums)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.select("*", *[c.alias(f"_v{i}") for i, c in enumerate(sums.values())]).repartitionByRange(*keys)
    dealt = table(spark, dealt.withColumn("_range", F.spark_partition_id()), "ordered")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(names))])
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(names))])
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(f"_v{i}").over(inside), F.lit(0)).alias(f"_l{i}") for i in range(len(names))])
    return local.join(F.broadcast(ranges), "_range").select(*df.columns, *[(F.col(f"_l{i}") + F.col(f"_b{i}")).alias(n) for i, n in enumerate(names)])


def numbered(spark: SparkSession, df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with each row's place in ``order``, from 0."""
    return totals_before(spark, df, order, {name: F.lit(1).cast("long")})


def numbered_within(spark: SparkSession, df: DataFrame, by: str, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with each row's place in ``order`` among the rows of the same ``by``, from 0. A value of ``by`` that most rows have is in many tasks."""
    run = totals_before(spark, df, [by, *order], {"_before": F.lit(1).cast("long")})
    starts = run.groupBy(F.col(by).alias("_by")).agg(F.min("_before").alias("_start"))
    return run.join(starts, F.col(by).eqNullSafe(F.col("_by"))).select(*df.columns, (F.col("_before") - F.col("_start")).alias(name))


def previous(spark: SparkSession, df: DataFrame, order: list[str], columns: dict[str, Column], last: bool = False) -> DataFrame:
    """``df`` with the values that ``columns`` have in the row before, in ``order`` (without ties); null for the first row. With ``last``, each is
    the latest value before the row that isn't null.

    Rows are dealt by ranges and stored; where a range begins, the values come from the ranges before it, of which there is one row per
    partition.
    """
    names = list(columns)
    dealt = df.select("*", *[c.alias(f"_p{i}") for i, c in enumerate(columns.values())]).repartitionByRange(*[F.col(c) for c in order])
    dealt = table(spark, dealt.withColumn("_range", F.spark_partition_id()), "ordered")
    key = F.struct(*[F.col(c) for c in order])
    if last:
        ends = [F.max_by(F.when(F.col(f"_p{i}").isNotNull(), F.col(f"_p{i}")), F.when(F.col(f"_p{i}").isNotNull(), key)).alias(f"_e{i}") for i in range(len(names))]
    else:
        ends = [F.max_by(f"_p{i}", key).alias(f"_e{i}") for i in range(len(names))]
    ranges = dealt.groupBy("_range").agg(*ends)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = [(F.last(f"_e{i}", True).over(before) if last else F.lag(f"_e{i}").over(Window.orderBy("_range"))).alias(f"_c{i}") for i in range(len(names))]
    ranges = F.broadcast(ranges.select("_range", *carried))
    inside = Window.partitionBy("_range").orderBy(*order)
    rows = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", F.row_number().over(inside).alias("_n"), *[(F.last(f"_p{i}", True).over(rows) if last else F.lag(f"_p{i}").over(inside)).alias(f"_l{i}") for i in range(len(names))])
    at_start = [F.coalesce(f"_l{i}", f"_c{i}") if last else F.when(F.col("_n") == 1, F.col(f"_c{i}")).otherwise(F.col(f"_l{i}")) for i in range(len(names))]
    return local.join(ranges, "_range").select(*df.columns, *[c.alias(n) for n, c in zip(names, at_start, strict=True)])


def quantiles(df: DataFrame, value: str | Column, at: list[float], by: list[str] | None = None) -> DataFrame:
    """Per group of ``by`` (columns with few different values, such as a feature's name; none: one row): ``q``, the values at the shares ``at``,
    between neighbours by straight lines.

    Equal to Spark's exact ``percentile``, which holds all different values of a group in one task. Here they are counted, stored and dealt by
    ranges instead, and each place is read from the running totals. Nulls don't count; a group without values has no row, and with no ``by``
    an array of nulls. NaN is above all numbers.
    """
    by = by or []
    column = F.col(value) if isinstance(value, str) else value
    counts = df.select(*by, column.cast("double").alias("_value")).where(F.col("_value").isNotNull()).groupBy(*by, "_value").agg(F.count("*").alias("_n"))
    counts = table(df.sparkSession, counts, "value-counts")
    run = totals_before(df.sparkSession, counts, [*by, "_value"], {"_before": F.col("_n")})
    # Totals run on over the groups: a group's own begin at its least.
    groups = run.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.min("_before").alias("_start"), F.sum("_n").alias("_size"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    placed = run.join(F.broadcast(groups), same or None)  # a row per group
    first = F.col("_before") - F.col("_start")

    def value_at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place < first + F.col("_n")), F.col("_value")))

    places = [(F.col("_size") - 1) * F.lit(float(p)) for p in at]
    ends = [c for i, p in enumerate(places) for c in (value_at(F.floor(p)).alias(f"_lo{i}"), value_at(F.ceil(p)).alias(f"_hi{i}"))]
    found = placed.groupBy(*by).agg(F.max("_size").alias("_size"), *ends)

    def between(i: int, p: Column) -> Column:
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    return found.select(*by, F.array(*[between(i, p) for i, p in enumerate(places)]).alias("q"))
