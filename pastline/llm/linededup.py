"""Line dedup by distinct-site spread, in DataFrame functions only.

A line's spread is the number of distinct sites (``source``) it occurs on. HyperLogLog sketches of the sites are built per line hash and salt
where the lines are read, before any shuffle, and merged by aggregation. Estimates far from the threshold decide; lines near it, and they
alone, get exact distinct counts. Boilerplate (a spread of ``min_sites`` or more) is then removed from every document; the other lines stay
as they are, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastline.llm import store

MIN_SITES = 8
SKETCH_BITS = 12
#: Estimates within this share of the threshold are counted exactly (fifteen times the sketch's standard error).
NEAR = 0.25
SALTS = 8


def _hashed(docs: DataFrame, *others: Column) -> DataFrame:
    """One row per line that isn't only spaces: two 64-bit hashes as its key (equal lines alone share it, but for a chance of about
    1 in 2 ** 90 for a billion lines), its place and ``others``."""
    lines = docs.select(*others, F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.trim("line") != "")
    return lines.select(F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), F.reverse("line")).alias("b"), "at", *[c for c in lines.columns if c not in ("at", "line")])


def _one_site(docs: DataFrame) -> DataFrame:
    """``text, source``, where equal texts all have the least of their sources."""
    keys = docs.where(F.col("source").isNotNull()).select("text", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), F.reverse("text")).alias("b"))
    moved = keys.groupBy("a", "b").agg(F.min("source").alias("lo"), F.max("source").alias("hi")).where(F.col("lo") != F.col("hi")).select("a", "b", "lo")
    return keys.join(store.few(docs.sparkSession, moved), ["a", "b"], "left").select("text", F.coalesce("lo", "source").alias("source"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, distinct_texts: bool = False) -> DataFrame:
    """Keys (``a, b``) of the lines that occur on ``min_sites`` sites or more. White-space-only lines and null sites do not count.

    With ``distinct_texts``, equal texts count as one page, on the least of their sites.
    """
    spark = docs.sparkSession
    docs = _one_site(docs) if distinct_texts else docs
    hashed = _hashed(docs.where(F.col("source").isNotNull()), F.col("source").cast("string").alias("source"))
    if min_sites <= 1:
        return hashed.select("a", "b").distinct()
    # A line on every page of a site is one row from each task and salt; the salts keep a line of all sites out of a single merge.
    parts = hashed.groupBy("a", "b", F.pmod(F.xxhash64("source"), F.lit(SALTS)).alias("salt")).agg(F.hll_sketch_agg("source", F.lit(SKETCH_BITS)).alias("sketch"))
    merged = parts.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites")).where(F.col("sites") >= int(min_sites * (1 - NEAR)))
    spread = store.table(spark, merged, "spread")
    sure = F.col("sites") > min_sites * (1 + NEAR)
    near = store.few(spark, spread.where(~sure).select("a", "b"))
    exact = hashed.join(near, ["a", "b"], "left_semi").groupBy("a", "b", "source").count().groupBy("a", "b").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where(sure).select("a", "b").unionByName(exact.select("a", "b"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, distinct_texts: bool = False) -> DataFrame:
    """``docs`` (``doc_id, text, source`` and any others) with boilerplate lines taken out of ``text``, and ``n_lines`` and ``n_removed``.

    With ``distinct_texts``, a page copied to many sites as a whole is no boilerplate for that: its lines are if different texts share them.
    A null text stays null (0 lines), an empty one has one line. A text of boilerplate alone becomes empty. Every row stays and is judged on
    its own text, so repeated rows of one doc_id, or rows without one, come out as many as they are; a line that is repeated in a text
    goes each time. Very long texts cost time and memory in proportion to their lines. Other columns may have any name; columns named
    ``n_lines`` or ``n_removed`` are replaced.
    """
    keys = store.few(docs.sparkSession, boilerplate(docs, min_sites, distinct_texts))
    # The places of a text's boilerplate lines are no more than its own lines.
    lines = _hashed(docs, F.col("doc_id").alias("doc"), F.xxhash64("text").alias("t")).join(keys, ["a", "b"], "left_semi")
    bad = lines.groupBy("doc", "t").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    joined = rows.join(bad, F.col("d.doc_id").eqNullSafe(F.col("doc")) & (F.xxhash64("d.text") == F.col("t")), "left")
    split, none = F.split("d.text", "\n"), F.array().cast("array<int>")
    # What stays are the runs of lines between those that go.
    runs = F.zip_with(F.concat(F.array(F.lit(0)), F.transform("gone", lambda i: i + 1)), F.concat(F.col("gone"), F.array(F.size(split))), lambda begin, end: F.slice(split, begin + 1, end - begin))
    text = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(F.col("d.text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.size(F.coalesce("gone", none)).cast("long").alias("n_removed"),
    )
