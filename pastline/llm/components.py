"""Connected components of a link table by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.llm import store


def _large(spark: SparkSession, edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = store.table(spark, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("size")), "least")
    return store.spread_join(both.where(F.col("b") > F.col("a")), least, ["a"], "size", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _small(spark: SparkSession, edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = store.table(spark, down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size")), "least")
    moved = store.spread_join(down, least, ["a"], "size", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (``a, b``) but the least of each component; ``component`` is the least node.

    A hub with any number of links is a row key of joins and sums only, never a list in memory, and its rows stay in many tasks. Steps go on
    until one changes no row. No edges, or self-links alone, give an empty table.
    """
    now = store.table(spark, edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    total = now.count()
    while total:
        spread = store.table(spark, _large(spark, now, total), "edges")
        after = store.table(spark, _small(spark, spread, total), "edges")
        count = after.count()
        done = count == total and after.join(now, ["a", "b"], "left_anti").isEmpty()
        store.drop(spark, now, spread)
        now, total = after, count
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
