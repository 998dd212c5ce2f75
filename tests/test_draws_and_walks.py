"""Rows before in a global order, draws with replacement, walks and sampled neighbours: against plain versions, at several partitionings."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pastline.operators import graph, review
from pastline.plans.ordered import numbered_within, previous

TX = "tx_id long, sender long, receiver long, us long"


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_before(spark, uncoalesced):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else rng.choice("abc"), rng.choice([None, i])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i long, g string, v long").repartition(6)
    by = sorted(rows)
    got = {r["i"]: (r["was"], r["known"]) for r in previous(spark, df, ["i"], {"was": F.col("v"), "known": F.col("i")}).collect()}
    assert got == {r[0]: (by[k - 1][2] if k else None, by[k - 1][0] if k else None) for k, r in enumerate(by)}
    got = {r["i"]: r["last"] for r in previous(spark, df, ["i"], {"last": F.col("v")}, last=True).collect()}
    assert got == {r[0]: next((x[2] for x in reversed(by[:k]) if x[2] is not None), None) for k, r in enumerate(by)}
    placed = numbered_within(spark, df, "g", ["i"], "n")
    seen = Counter()
    want = {}
    for i, g, _ in by:
        want[i] = seen[g]
        seen[g] += 1
    assert {r["i"]: r["n"] for r in placed.collect()} == want
    assert previous(spark, df.limit(0), ["i"], {"was": F.col("v")}).count() == 0


def test_a_hub_is_many_tasks(spark, uncoalesced):
    rows = [(i, i, 7, i * 1_500_000) for i in range(400)]
    df = spark.createDataFrame(rows, TX)
    assert {r["tx_id"]: (r["in_port"], r["out_port"]) for r in graph.ports(df).collect()} == {i: (i, 0) for i in range(400)}
    assert {r["tx_id"]: (r["in_delta"], r["out_delta"]) for r in graph.time_deltas(df).collect()} == {i: (1 if i else 0, 0) for i in range(400)}
    parts = numbered_within(spark, df, "receiver", ["tx_id"], "n").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 3


def test_draws(spark, uncoalesced):
    rows = [(i, 0 if i % 10 else 90, i % 10 == 0) for i in range(1000)] + [(2000 + i, 10, False) for i in range(100)]
    df = spark.createDataFrame(rows, "tx_id long, units long, rare boolean")
    found = sorted(map(tuple, review.weighted_draws(spark, df.repartition(7), 5000, 3, "units").select("draw", "tx_id").collect()))
    assert [d for d, _ in found] == list(range(5000))
    assert found == sorted(map(tuple, review.weighted_draws(spark, df.repartition(2), 5000, 3, "units").select("draw", "tx_id").collect()))
    drawn = Counter(t for _, t in found)
    assert not any(0 < t < 1000 and t % 10 for t in drawn)
    share = sum(n for t, n in drawn.items() if t < 1000) / 5000
    assert abs(share - 0.9) < 0.02  # 100 rows of 90 units against 100 of 10
    assert review.weighted_draws(spark, df.withColumn("units", F.lit(0)), 5, 3, "units").count() == 0
    assert review.weighted_draws(spark, df.limit(0), 5, 3, "units").count() == 0


def _draw(*parts):
    return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def test_walks_and_samples(spark, uncoalesced):
    rng = random.Random(4)
    pairs = [(0, i) for i in range(1, 60)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(80)] + [(90, 90)]
    tx = spark.createDataFrame([(k, a, b, k) for k, (a, b) in enumerate(pairs)], TX)
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seeds = spark.createDataFrame([(0,), (3,), (90,)], "node long")
    want = set()
    for root in (0, 3, 90):
        for walk in range(3):
            node = root
            want.add((root, walk, 0, root))
            for step in range(1, 6):
                around = sorted(near.get(node, ()))
                if not around:
                    break
                node = around[_draw(7, root, walk, step) % len(around)]
                want.add((root, walk, step, node))
    got = [tuple(r) for r in graph.random_walks(spark, tx.repartition(5), seeds, 5, 3).select("root", "walk", "step", "node").collect()]
    assert set(got) == want and len(got) == len(want)
    want, now = set(), {(r, r) for r in (0, 3, 90)}
    for hop, k in enumerate((4, 2), 1):
        fresh = {(r, n, x) for r, n in now for x in sorted(near.get(n, ()), key=lambda x: (_draw(7, r, hop, n, x), x))[:k]}  # noqa: B023
        want |= {(r, hop, n, x) for r, n, x in fresh}
        now = {(r, x) for r, _, x in fresh}
    got = [tuple(r) for r in graph.sampled_neighbours(spark, tx.repartition(3), seeds, [4, 2]).select("root", "hop", "node", "next").collect()]
    assert set(got) == want and len(got) == len(want)


def test_column_profile(spark):
    df = spark.createDataFrame([("a\"b", 1.0, None), ("a\"b", float("nan"), None), (None, -3.0, None), ("z", None, None)], "s string, x double, n int").withColumn("t", F.lit("2024-01-02").cast("date"))
    got = {r["column"]: r for r in review.column_profile(df, ["s", "x", "n", "t"]).collect()}
    assert got["s"]["top_values"] == '{"a\\"b":2,"z":1}' and (got["s"]["non_null"], got["s"]["missing"], got["s"]["n_unique"]) == (3, 1, 2)
    assert (got["x"]["low"], got["x"]["high"], got["x"]["mean"], got["x"]["missing_rate"], got["x"]["n_unique"]) == ("-3.0", "1.0", -1.0, 0.5, 2)
    assert (got["n"]["low"], got["n"]["mean"], got["n"]["missing"]) == (None, None, 4) and (got["t"]["low"], got["t"]["high"]) == ("2024-01-02", "2024-01-02")
