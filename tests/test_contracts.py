"""Declarations and input tables that break their contract fail early and say why; hand-made ties, boundaries and loops."""

import pytest
from pyspark.sql import functions as F

from pastline.operators import fitted, flows, split
from pastline.plans.compiler import build_features
from pastline.sources.tables import InputError, resolve, standardize
from pastline.specs import FeatureSpec, SpecError, parse_window

TX = "tx_id long, sender long, receiver long, us long, amount double"


@pytest.mark.parametrize("text", ["", "0d", "1w", "-1h", "d1", "1.5h"])
def test_bad_windows(text):
    with pytest.raises(SpecError, match="window"):
        parse_window(text)


@pytest.mark.parametrize("name", ["label", "is_laundering", "y", "pattern_id", "my_typology"])
def test_leaks_are_refused(name):
    with pytest.raises(SpecError, match="leak"):
        FeatureSpec("current_value", name, {"value": "amount"})
    with pytest.raises(SpecError, match="leak"):
        FeatureSpec("current_value", "x", {"value": name})


@pytest.mark.parametrize(
    ("spec", "says"),
    [
        (FeatureSpec("nothing", "x"), "unknown operation"),
        (FeatureSpec("rolling_agg", "x", {"entity": "sender", "value": "nope"}, {"window": "1d", "agg": "sum"}), "no column"),
        (FeatureSpec("rolling_agg", "x", {"entity": "sender", "value": "amount"}, {"window": "1d", "agg": "median"}), "unknown aggregate"),
        (FeatureSpec("rolling_agg", "x", {"entity": "sender"}, {"window": "1d", "agg": "sum"}), "lacks the input"),
        (FeatureSpec("datetime_part", "x", {}, {"part": "era"}), "unknown part"),
        (FeatureSpec("current_value", "amount", {"value": "amount"}), "repeat or hide"),
    ],
)
def test_bad_specs(spark, spec, says):
    with pytest.raises(SpecError, match=says):
        build_features(spark.createDataFrame([], TX), [spec])


@pytest.mark.parametrize(
    ("rows", "says"),
    [
        ([(None, "2024-01-01", "0")], "null tx_id"),
        ([(1, None, "0")], "timestamp"),
        ([(1, "soon", "0")], "timestamp"),
        ([(1, "2024-01-01", None)], "label"),
        ([(1, "2024-01-01", "2")], "label"),
        ([(1, "2024-01-01", "yes")], "label"),
        ([(1, "2024-01-01", "0"), (1, "2024-01-02", "1")], "repeated"),
    ],
)
def test_bad_inputs(spark, rows, says):
    with pytest.raises(InputError, match=says):
        standardize(spark.createDataFrame(rows, "id long, ts string, is_laundering string"))


def test_aliases_and_missing_columns(spark):
    good = spark.createDataFrame([(1, "2024-01-01 00:00:01", "1", 5.0)], "id long, Timestamp string, `Is Laundering` string, extra double")
    assert standardize(good).columns == ["tx_id", "us", "label", "extra"]
    assert resolve(good, "tx_id", {"tx_id": "extra"}) == "extra"
    with pytest.raises(InputError, match="amount"):
        resolve(good, "amount")


def test_peers_and_boundaries(spark):
    day = parse_window("1d")
    tx = spark.createDataFrame([(1, 1, 2, 0, 1.0), (2, 1, 2, 0, 2.0), (3, 1, 2, day, 4.0), (4, 1, 2, day + 1, 8.0)], TX)
    sums = {r["tx_id"]: r["s"] for r in build_features(tx, [FeatureSpec("rolling_agg", "s", {"entity": "sender", "value": "amount"}, {"window": "1d", "agg": "sum"})]).collect()}
    assert sums == {1: 0.0, 2: 0.0, 3: 3.0, 4: 4.0}  # peers unseen; exactly a day ago is in, a microsecond more is out
    std = build_features(tx.where("tx_id <> 2"), [FeatureSpec("rolling_agg", "s", {"entity": "sender", "value": "amount"}, {"window": "1d", "agg": "std"})])
    assert {r["tx_id"]: r["s"] for r in std.collect()}[4] == 0.0  # one earlier row has no deviation


def test_self_loop_and_chain(spark):
    tx = spark.createDataFrame([(1, 5, 5, 0, 3.0), (2, 5, 5, 10, 4.0), (3, 9, 1, 20, 1.0), (4, 1, 7, 30, 2.0), (5, 1, 8, 40, 6.0)], TX)
    f = {r["tx_id"]: r for r in flows.flow_balance(tx, 1000).collect()}
    assert (f[2]["sender_in"], f[2]["sender_out"]) == (3.0, 3.0)
    p = {r["tx_id"]: r for r in flows.pass_flow(tx, 1000).collect()}
    assert [p[i]["recent_flag"] for i in (1, 2, 4, 5)] == [0, 1, 1, 1] and p[5]["sequence_count"] == 1 and p[5]["current_to_last_in_amount_ratio"] == 6.0


def test_negative_log_and_residuals(spark):
    tx = spark.createDataFrame([(1, 1, 2, 0, -5.0)], TX)
    with pytest.raises(Exception, match="negative"):
        build_features(tx, [FeatureSpec("log1p", "x", {"value": "amount"})]).collect()
    with pytest.raises(Exception, match="negative"):
        tx.select(fitted.clamp_residual(F.col("amount"))).collect()
    assert tx.select(fitted.clamp_residual(F.lit(-1e-4))).first()[0] == 0.0


def test_splits(spark):
    tx = spark.createDataFrame([(i, 1, 2, i // 3, 1.0) for i in range(30)], TX)
    out = split.chronological(tx)
    split.check_order(out)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 18, "val": 6, "test": 6}
    with pytest.raises(InputError, match="overlap"):
        split.check_order(out.where("split <> 'val'"))
    with pytest.raises(InputError, match="empty"):
        split.chronological(tx.limit(1))


def test_class_weight_and_sentinels(spark):
    t = spark.createDataFrame([(0, "train"), (0, "train"), (1, "train"), (1, "val")], "label int, split string")
    assert fitted.scale_pos_weight(t) == 2.0
    with pytest.raises(InputError, match="classes"):
        fitted.scale_pos_weight(t.where("label = 0"))
    s = spark.createDataFrame([(-1.0, 1), (5.0, 0), (-1.0, 0), (-2.0, 0)], "r double, f int")
    assert fitted.check_sentinels(s, "r", "f") == 2
