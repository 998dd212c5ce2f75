"""Statistics, splits and sinks on dirty rows, against hand-made values and plain formulas."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pastline.functions.scalars import stage_family
from pastline.operators import association, review, split, stats, validation
from pastline.sources import files, tables
from pastline.sources.tables import InputError

NAN, INF = float("nan"), float("inf")


def test_splits_of_few_times_are_refused(spark):
    with pytest.raises(InputError, match="empty"):
        split.chronological(spark.createDataFrame([(i, 5) for i in range(10)], "tx_id long, us long"))
    with pytest.raises(InputError, match="empty"):
        split.chronological(spark.createDataFrame([(i, 1 if i < 7 else 2) for i in range(10)], "tx_id long, us long"))
    with pytest.raises(InputError, match="empty"):
        split.chronological(spark.createDataFrame([], "tx_id long, us long"))
    rng = random.Random(3)
    for span in (3, 1 << 20, 1 << 50):
        us = sorted(rng.randrange(-span, span) for _ in range(200)) + [span] * 3
        one, two = us[int(203 * 0.6) - 1], us[int(203 * 0.8) - 1]
        got = split.boundaries(spark.createDataFrame([(x,) for x in us], "us long")) if one < two else (one, two)
        assert got == (one, two)


def test_rank_tests_pass_over_nulls_and_correct_for_ties(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 0), (None, 1), (NAN, 1)], "value double, label int")
    assert stats.mann_whitney(spark, df).first()["rank_biserial"] == 0.0
    rng = random.Random(1)
    rows = [(g, float(rng.randrange(4 if f == "a" else 40)) + (g == "TP"), f) for g in ("TP", "FP", "FN") for f in ("a", "b") for _ in range(rng.randrange(20, 40))]
    rows += [("TN", 1.0, "a")] * 4 + [("FN", None, "b"), ("TP", 2.0, "c"), ("FP", 2.0, "c"), ("TP", 2.0, "c")]
    long = spark.createDataFrame(rows, "grp string, value double, feature string")
    found = {(r["first"], r["second"], r["feature"]): r for r in association.rank_tests(spark, long, ["TP", "FP", "FN", "TN"], association.PAIRS).collect()}
    for (a, b), f in [(p, f) for p in combinations(["TP", "FP", "FN"], 2) for f in "ab"]:
        x, y = ([v for g, v, k in rows if g == s and k == f and v is not None] for s in (a, b))
        u = sum((p > q) + (p == q) / 2 for p in x for q in y)
        n1, n2, both = len(x), len(y), x + y
        n = n1 + n2
        ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
        s = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
        r = found[a, b, f]
        assert (r["n1"], r["n2"], r["u"]) == (n1, n2, u) and math.isclose(r["z"], (u - n1 * n2 / 2) / s, abs_tol=1e-12)
        assert math.isclose(r["p"], min(1.0, math.erfc((max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / s / math.sqrt(2))), abs_tol=4e-7)
    assert found["TP", "FP", "c"]["z"] is None and found["TP", "FP", "c"]["p"] == 1.0


def test_p_is_adjusted_over_the_features_of_a_pair(spark):
    tests = spark.createDataFrame([("TP", "FP", f, p) for f, p in zip("abcd", (0.01, 0.04, 0.03, 0.5), strict=True)] + [("FN", "TN", "a", 0.2)], "first string, second string, feature string, p double")
    got = {(r["first"], r["feature"]): round(r["p_adjusted"], 6) for r in association.adjusted(tests, ["first", "second"]).collect()}
    assert got == {("TP", "a"): 0.04, ("TP", "b"): round(0.16 / 3, 6), ("TP", "c"): round(0.16 / 3, 6), ("TP", "d"): 0.5, ("FN", "a"): 0.2}


def test_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0, 1e9 + 1), (2.0, 4.0, 7.0, 1e9 + 2), (3.0, 6.0, 7.0, 1e9 + 3), (None, 8.0, 7.0, NAN)], "a double, b double, c double, d double")
    pearson = {(r["a"], r["b"]): r["r"] for r in association.pearson(df, list("abcd")).collect()}
    assert math.isclose(pearson["a", "b"], 1.0) and pearson["a", "c"] is None and math.isclose(pearson["a", "d"], 1.0, abs_tol=1e-9)
    zeros = {(r["a"], r["b"]): r["r"] for r in association.correlations(df, list("abc")).collect()}
    assert math.isclose(zeros["a", "b"], -0.2) and zeros["a", "c"] == 0.0
    odd = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, INF)], "a double, b double")
    assert association.pearson(odd, ["a", "b"]).first()["r"] is None
    assert math.isclose(association.correlations(odd, ["a", "b"]).first()["r"], -0.5)
    assert association.pearson(df.limit(0), ["a", "b"]).count() == 0


def test_one_scan_of_many_columns(spark):
    """236 columns: one read of the rows, and the same as Spark's own correlation."""
    columns = [f"c{i}" for i in range(236)]
    df = spark.range(300).select(*[(F.pmod(F.col("id") * (i + 3) * 7919, F.lit(97 + i)) / 3.0).alias(c) for i, c in enumerate(columns)])
    found = association.correlations(df, columns)
    assert found._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    rows = {(r["a"], r["b"]): r["r"] for r in found.collect()}
    assert len(rows) == 236 * 235 // 2
    for a, b in (("c0", "c1"), ("c17", "c200"), ("c234", "c235")):
        assert math.isclose(rows[a, b], df.agg(F.corr(a, b)).first()[0], abs_tol=1e-9)


def test_associations_drop_nulls(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), (None, 90.0), (None, NAN), ("x", NAN)], "k string, v double")
    assert stats.correlation_ratio(df, "k", "v").first()["eta"] == 0.0
    two = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 6.0), ("y", None)], "k string, v double")
    between, total = 2 * (2 - 10 / 3) ** 2 + (6 - 10 / 3) ** 2, sum((v - 10 / 3) ** 2 for v in (1, 3, 6))
    assert math.isclose(stats.correlation_ratio(two, "k", "v").first()["eta"], math.sqrt(between / total))
    kinds = {"k": "categorical", "v": "numeric", "w": "numeric", "l": "categorical"}
    mixed = review.mixed_association(two.withColumns({"w": F.col("v") * 2, "l": F.col("k")}), kinds).collect()
    assert {(r["a"], r["b"]): r["measure"] for r in mixed} == {("k", "v"): "eta", ("k", "w"): "eta", ("k", "l"): "cramers_v", ("v", "w"): "pearson", ("v", "l"): "eta", ("w", "l"): "eta"}


def test_profile_of_dirty_values(spark):
    df = spark.createDataFrame([(1.0, 5.0), (NAN, 5.0), (None, 5.0), (INF, 5.0), (0.0, 5.0)], "a double, b double")
    got = {r["feature"]: r for r in stats.profile(df, ["a", "b"]).collect()}
    a, b = got["a"], got["b"]
    assert (a["n"], a["missing"], a["infinite"], a["zero"], a["n_unique"], a["low"], a["p25"], a["mean"], a["high"], a["near_zero_variance"]) == (5, 2, 1, 1, 3, 0.0, 0.25, 0.5, 1.0, 0)
    assert (b["n_unique"], b["near_zero_variance"], b["median"]) == (1, 1, 5.0)


def test_bins_of_few_values(spark):
    """Four values, equally often: inner edges 1.75, 2.5 and 3.25; null and NaN are a bin of their own, one value has none."""
    rows = [(float(1 + i % 4), 3.0, i % 2) for i in range(40)] + [(None, 3.0, 1), (NAN, 3.0, 0), (INF, 3.0, 0)]
    got = stats.woe_iv(spark.createDataFrame(rows, "v double, same double, label int"), ["v", "same"]).collect()
    assert sorted((r["feature"], r["bin"], r["pos"] + r["neg"]) for r in got) == [("v", -1, 2), ("v", 0, 10), ("v", 1, 10), ("v", 2, 10), ("v", 3, 11)]


def test_drift_counts_missing_values_as_zero(spark):
    df = spark.createDataFrame([("train", 4.0, 0), ("train", None, 0), ("val", INF, 1), ("val", 2.0, 1), ("test", 0.0, 1)], "split string, v double, label int")
    r = stats.drift(df, ["v"]).first()
    assert (r["mean_train"], r["mean_val"], r["mean_test"], r["val_ratio"], r["nonzero_gap"]) == (2.0, 1.0, 0.0, 0.5, 0.5)
    assert math.isclose(r["log_gap"], math.log1p(2))
    assert review.review_scores(df, ["v"]).first()["zero_rate"] == 0.2


def test_rows_of_no_split_are_not_lost(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test"), (4, "holdout"), (5, None)], "tx_id long, split string")
    with pytest.raises(InputError, match="holdout"):
        files.write_splits(spark, df, str(tmp_path / "a"))
    assert set(files.write_splits(spark, df.where("tx_id < 4"), str(tmp_path / "b"))) == {"all", "train", "val", "test"}


def test_conflicting_splits_are_refused(spark):
    source = spark.createDataFrame([(1, "train"), (1, "train"), (2, "val"), (2, "test")], "tx_id long, split string")
    tx = spark.createDataFrame([(1,), (2,)], "tx_id long")
    assert validation.attach_split(tx.limit(1).where("tx_id = 1"), source.where("tx_id = 1")).first()["split"] == "train"
    with pytest.raises(Exception, match="several splits"):
        validation.attach_split(tx, source).collect()


def test_times_do_not_follow_the_session(spark):
    d = "/root/testdata/sf0.001"
    sums = lambda: [tables.tx_events(spark, d).agg(F.sum("us")).first()[0], tables.tx_lines(spark, d).agg(F.sum("us")).first()[0]]
    want = sums()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sums() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    ("column", "family", "kind"),
    [
        ("timehist__sender__out__amount__sum__w1d", "Stage 0 time history", "amount_or_balance"), ("pair__sender_receiver__reverse__exists__w1d", "Stage 3 pair/reverse", "flag"),
        ("passflow__sender__in_then_out__recent_flag__w1h", "ML-05 Stage 4 pass-through", "flag"), ("flowbalance__sender__net__amount__in_out_ratio__w6h", "ML-05 Stage 4 flow-balance", "ratio_or_rate"),
        ("accountstats__sender__out__amount__mean__w1d", "Stage 1 account stats", "amount_or_balance"), ("is_weekend", "other selected feature", "flag"), ("hour", "other selected feature", "other"),
        ("timehist__sender__out__recency__seconds__whist", "Stage 0 time history", "time_gap"), ("fanin__receiver__in__counterparty__nunique__w1h", "Stage 2 fan-in/fan-out", "count_or_degree"),
    ],
)
def test_families(column, family, kind):
    assert stage_family(column) == (family, kind)
    assert stage_family("x", group="parent features")[0] == "carried-forward selected"
