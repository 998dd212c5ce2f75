"""Streams against Spark's own windows and brute force: dirty values, ties, null keys, hot accounts in blocks of time."""

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pastline.operators import fitted, flows
from pastline.plans import catalog, relations, streams
from pastline.plans.compiler import BALANCED, build_features
from pastline.plans.frames import past
from pastline.specs import FeatureSpec, SpecError

TX = "tx_id long, sender string, receiver string, sender_bank int, receiver_bank int, us long, amount double, amount_received double, split string"
S = 1_000_000
AGGS = {"count": F.count, "sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _rows(n=600, dirty=False, seed=1):
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf"), -float("inf")] if dirty else []
    names = [None, "a", "b", "c", "hot", "hot", "hot", "hot"]
    out = []
    for i in range(n):
        v = rng.choice(odd) if odd and rng.random() < 0.05 else round(rng.random() * 100, 2) if rng.random() < 0.9 else 7.0
        out.append((i, rng.choice(names), rng.choice(names[1:]), rng.randrange(3), rng.randrange(3), rng.randrange(400) * S, v, v, "train" if i % 5 < 3 else "val" if i % 5 == 3 else "test"))
    return out


def _same(x, y):
    return x == y or x is not None and y is not None and (math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("heavy", [10**9, 30])
def test_frames_are_those_of_windows(spark, monkeypatch, heavy):
    monkeypatch.setattr(streams, "HEAVY_ROWS", heavy)
    df = spark.createDataFrame(_rows(dirty=True), TX).repartition(3)
    specs = [FeatureSpec("rolling_agg", f"{a}_{w}", {"entity": "sender", "value": "amount"}, {"window": w, "agg": a, "fill_value": -5}) for w in ("1s", "20s", "3min") for a in AGGS]
    got = {r["tx_id"]: r for r in build_features(df, specs).collect()}
    columns = [F.coalesce(AGGS[s.params["agg"]]("amount").over(past("sender", s.window())).cast("double"), F.lit(-5.0 if s.params["agg"] != "count" else 0.0)).alias(s.output) for s in specs]
    want = df.select("tx_id", *columns).collect()
    assert len(want) == len(got) == 600
    for w in want:
        for s in specs:
            assert _same(got[w["tx_id"]][s.output], w[s.output]), (s.output, w, got[w["tx_id"]])


def test_a_hot_account_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(streams, "HEAVY_ROWS", 200)
    rows = [(i, "hot" if i % 2 else f"s{i}", "r", 0, 0, i * S, 1.0, 1.0, "train") for i in range(8000)]
    spec = [FeatureSpec("rolling_agg", "n", {"entity": "sender", "value": "amount"}, {"window": "30s", "agg": "count"})]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = relations.entity_windows(spark.createDataFrame(rows, TX), "sender", spec, spark.createDataFrame(rows, TX)).select("tx_id", "sender", "n", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = [r for r in found if r["sender"] == "hot"]
    assert len(found) == 8000 and len(hot) == 4000 and len({r["p"] for r in hot}) >= 8
    assert all(r["n"] == min(15, r["tx_id"] // 2) for r in hot)


def _brute_sets(rows, entity, other, value, width):
    out = {}
    for r in rows:
        sums = {}
        for q in rows:
            if q[entity] == r[entity] and r[5] - width <= q[5] < r[5] and q[other] is not None:
                sums[q[other]] = sums.get(q[other], 0.0) + q[value]
        total = sum(sums.values())
        out[r[0]] = (len(sums), total * total / sum(v * v for v in sums.values()) if total > 0 else 0.0, max(sums.values()) / total if total > 0 else 0.0)
    return out


@pytest.mark.parametrize("heavy", [10**9, 25])
def test_sliding_multisets(spark, monkeypatch, heavy):
    monkeypatch.setattr(streams, "HEAVY_ROWS", heavy)
    rows = _rows(300)
    for width in (2 * S, 60 * S):
        at = {"entity": "receiver", "counterparty": "sender", "value": "amount"}
        specs = [FeatureSpec(f"rolling_counterparty_{m}", m, at, {"window": f"{width // S}s"}) for m in ("nunique", "effective_n", "top1_share")]
        specs.append(FeatureSpec("fan_in", "fan", {"entity": "receiver", "counterparty": "sender"}, {"window": f"{width // S}s"}))
        want = _brute_sets(rows, 2, 1, 6, width)
        for r in build_features(spark.createDataFrame(rows, TX), specs).collect():
            n, effective, top = want[r["tx_id"]]
            assert (r["nunique"], r["fan"]) == (n, n) and _same(r["effective_n"], effective) and _same(r["top1_share"], top)


@pytest.mark.parametrize("stage", [catalog.stage2, catalog.stage3, catalog.stage4])
def test_blocks_change_no_stage(spark, monkeypatch, stage):
    """Hot accounts and pairs cut into blocks give the same columns, on few rows with many ties."""
    rows = [(i, s or "n", r, sb, rb, us * 600, v, w, sp) for i, s, r, sb, rb, us, v, w, sp in _rows(400, seed=3)]
    df = spark.createDataFrame(rows, TX)
    whole = {r["tx_id"]: r for r in build_features(df, stage()).collect()}
    monkeypatch.setattr(streams, "HEAVY_ROWS", 20)
    for r in build_features(df, stage()).collect():
        assert all(_same(r[c], whole[r["tx_id"]][c]) for c in r.asDict())


def test_counts_of_stages():
    assert [len(s()) for s in (catalog.stage0, catalog.stage1_stats, catalog.stage2, catalog.stage3, catalog.stage4)] == [62, 12, 46, 45, 48]
    names = [s.output for f in (catalog.stage0, catalog.stage1_stats, catalog.stage2, catalog.stage3, catalog.stage4) for s in f()]
    assert len(set(names)) == len(names)


def test_one_exchange_per_key_set(spark):
    """Stage 2 has two keys; the list of hot keys is broadcast."""
    plan = build_features(spark.createDataFrame(_rows(10), TX), catalog.stage2())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("REPARTITION_BY_COL") == 2


@pytest.mark.parametrize(
    ("spec", "says"),
    [
        (FeatureSpec("pair_window", "x", {"sender": "sender", "receiver": "receiver", "value": "amount"}, {"window": "1d", "metric": "nope"}), "unknown metric"),
        (FeatureSpec("pair_history", "x", {"sender": "sender", "receiver": "receiver"}, {"metric": "nope"}), "unknown metric"),
        (FeatureSpec("flowbalance_window", "x", {"sender": "sender", "receiver": "receiver", "value": "amount"}, {"window": "1d", "metric": "sumdiff", "role": "bank"}), "role"),
        (FeatureSpec("passflow_window", "x", {"sender": "sender", "receiver": "receiver", "value": "amount"}, {"window": "1d", "metric": "sequence_count", "role": "receiver"}), "role"),
        (FeatureSpec("fan_in", "x", {"entity": "sender"}, {"window": "1d"}), "lacks the input"),
    ],
)
def test_bad_relations(spark, spec, says):
    with pytest.raises(SpecError, match=says):
        build_features(spark.createDataFrame([], TX), [spec])


def test_fits_need_splits_and_amounts_are_not_negative(spark):
    flow = FeatureSpec("flowbalance_window", "x", {"sender": "sender", "receiver": "receiver", "value": "amount"}, {"window": "1d", "metric": BALANCED, "role": "sender"})
    df = spark.createDataFrame(_rows(20), TX)
    with pytest.raises(SpecError, match="split"):
        build_features(df.drop("split"), [flow])
    bad = df.withColumn("amount", -F.col("amount"))
    for name in ("stage2", "stage3", "stage4"):
        with pytest.raises(Exception, match="negative"):
            build_features(bad.withColumn("amount_received", F.col("amount")), getattr(catalog, name)()).collect()


def test_entity_of_the_other_role(spark):
    """The current sender's inbound sums: what came to its account before."""
    rows = [(1, "a", "b", 0, 0, 0, 5.0, 5.0, "train"), (2, "b", "c", 0, 0, S, 3.0, 3.0, "train"), (3, "b", "b", 0, 0, 2 * S, 1.0, 1.0, "train"), (4, "b", "a", 0, 0, 3 * S, 1.0, 1.0, "train")]
    ends = {"sender": "sender", "receiver": "receiver", "value": "amount"}
    specs = [FeatureSpec("rolling_entity_agg", "x", {**ends, "current": "sender", "history": "receiver"}, {"window": "1h"}), FeatureSpec("rolling_entity_agg", "z", {**ends, "current": "receiver", "history": "sender"}, {"window": "1h"})]
    got = {r["tx_id"]: (r["x"], r["z"]) for r in build_features(spark.createDataFrame(rows, TX), specs).collect()}
    assert got == {1: (0.0, 0.0), 2: (5.0, 0.0), 3: (5.0, 3.0), 4: (6.0, 5.0)}


def test_no_rows(spark):
    df = spark.createDataFrame([], TX)
    for stage in (catalog.stage2, catalog.stage3, catalog.stage4):
        assert build_features(df, stage()).count() == 0


def _zero_windows(senders=20, cycles=60, seed=5):
    """Per sender, over and over: two amounts, days later an amount of 0, and a row (test) whose window holds that 0 alone."""
    rng = random.Random(seed)
    out = []
    for s in range(senders):
        for i in range(cycles):
            t = i * 400_000
            own = [(t, round(rng.expovariate(rng.choice([0.00001, 30])), 2)), (t + 10, 1.0), (t + 200_000, 0.0), (t + 200_010, round(rng.expovariate(0.00001), 2))]
            out += [(f"s{s}", at * S, v, "test" if at == t + 200_010 else "train") for at, v in own]
    return [(i, s, "shop", 0, 0, t, v, v, split) for i, (s, t, v, split) in enumerate(out)]


def test_nothing_stays_of_rows_that_left_a_ratio_window(spark):
    df = spark.createDataFrame(_zero_windows(), TX)
    spec = FeatureSpec("cur_vs_mean_ratio", "out__ratio__w1d", {"entity": "sender", "value": "amount"}, {"window": "1d"})
    f = build_features(df, [spec], ("tx_id", "split"))
    assert {r[1] for r in fitted.post_stage(f, f.columns, {}).where("split = 'test'").select("tx_id", "out__ratio__w1d").collect()} == {0.0}


def test_balanced_state_without_history_but_zeros(spark):
    tx = spark.createDataFrame(_zero_windows(), TX)
    found = flows.balanced_state(flows.flow_balance(tx, 86_400 * S), tx).join(tx, "tx_id").where("split = 'test'")
    assert {r["balanced_state_flag"] for r in found.collect()} == {0}


def test_flow_balance_of_zeros(spark):
    tx = spark.createDataFrame(_zero_windows(), TX)
    last = flows.flow_balance(tx, 86_400 * S).join(tx, "tx_id").where("split = 'test'").collect()
    assert len(last) == 1200
    assert {(r["sender_in"], r["sender_out"], r["sender_in_out_ratio"], r["sender_sumdiff"], r["sender_relative_gap"]) for r in last} == {(0.0, 0.0, 0.0, 0.0, None)}


def test_sums_are_rounded_once():
    rng = np.random.default_rng(3)
    n = 2000
    us = np.sort(rng.integers(0, 900, (4, n // 4)), axis=1).ravel()
    for scale in (1.0, 1e-300, 1e290):
        x = np.round(rng.exponential(50, n), 2) * rng.choice([1, 0, -1], n) * scale
        chunk = streams.Chunk(pa.table({"us": us, "x": x}), np.repeat(np.arange(4), n // 4), "us", 1000)
        lo, hi = chunk.lo(100), chunk.hi()
        got = streams.Frames(chunk, x, np.ones(n, bool)).sum(lo, hi)
        assert all(g == float(sum(map(Fraction, x[a:b].tolist()))) for g, a, b in zip(got, lo, hi, strict=True) if b > a)
