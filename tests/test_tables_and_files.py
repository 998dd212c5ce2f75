"""Files, catalogs, validators, names and the boosted trees: accepted inputs and each refusal."""

import random

import pytest
from pyspark.sql import functions as F

from pastline.functions import scalars
from pastline.operators import flows, graph, model, review, validation
from pastline.plans import catalog
from pastline.plans.ordered import numbered, totals_before
from pastline.sources import files
from pastline.sources.tables import InputError
from pastline.specs import SpecError, check_no_leak


def test_names_and_contracts():
    assert scalars.derived_name("pair__amount_ratio__w7d", "log1p") == "pair__amount_ratio__log1p__w7d"
    assert scalars.derived_name("amount_ratio", "log1p") == "amount_ratio__log1p"
    columns = ["a_ratio__w1d", "b", "c_ratio__log1p__w1d", "hist_lt2_flag_ratio"]
    assert scalars.base_ratios(columns) == ["a_ratio__w1d"]
    assert scalars.contract_variant(columns, "log1p")[:2] == ["a_ratio__log1p__w1d", "b"] and scalars.contract_variant(columns, "original") == columns
    with pytest.raises(ValueError, match="variant"):
        scalars.contract_variant(columns, "x")
    assert scalars.contract_bool("TRUE") and not scalars.contract_bool("FALSE")
    for bad in ("true", "1", "", None):
        with pytest.raises(ValueError, match="neither"):
            scalars.contract_bool(bad)
    assert scalars.stage_family("pair__amount_ratio__w7d") == ("Stage 3 pair/reverse", "ratio_or_rate")
    with pytest.raises(SpecError, match="leak"):
        check_no_leak([" Label "], "x")


def test_generated_sets():
    stage0 = catalog.stage0()
    assert len(stage0) == len({s.output for s in stage0}) == 62 and len(catalog.stage1_stats()) == 12 and len(catalog.baseline()) == 5


def test_catalog(spark, tmp_path):
    def load(text, available=None):
        path = tmp_path / f"{random.random()}.csv"
        path.write_text(text)
        return files.load_catalog(spark, f"file://{path}", available)

    assert load("column_name,used_in_ml,stage\nb,TRUE,1\na,FALSE,1\nc,TRUE,2\n") == ["b", "c"]
    for text, message in [
        ("name,used_in_ml\na,TRUE\n", "column_name"), ("column_name,x\na,TRUE\n", "used_in_ml"), ("column_name,used_in_ml\na,true\n", "neither"), ("column_name,used_in_ml\na,\n", "neither"),
        ("column_name,used_in_ml\na,TRUE\na,TRUE\n", "repeated"), ("column_name,used_in_ml\n,TRUE\n", "blank"), ('column_name,used_in_ml\n" a",TRUE\n', "neither|blank|data"), ("column_name,used_in_ml\na,FALSE\n", "no feature"),
    ]:
        with pytest.raises(InputError, match=message):
            load(text, ["b"])
    with pytest.raises(InputError, match="not in the data: a"):
        load("column_name,used_in_ml\na,TRUE\n", ["b"])
    with pytest.raises(SpecError, match="leak"):
        load("column_name,used_in_ml\nlabel,TRUE\n")


def test_sinks_and_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc", None, "train"), (2, None, 2.5, "val"), (3, "", -0.0, "test")], "i long, s string, x double, split string")
    for kind, read in (("csv", files.read_csv), ("json", files.read_json)):
        path = f"file://{tmp_path}/{kind}"
        files.write(spark, df.select("i", "x"), path, kind)
        assert sorted(map(tuple, read(spark, path, "i long, x double").collect())) == [(1, None), (2, 2.5), (3, 0.0)]
        with pytest.raises(FileExistsError, match="already there"):
            files.write(spark, df, path, kind)
        files.write(spark, df.select("i", "x").where("i = 1"), path, kind, overwrite=True)
        assert read(spark, path, "i long, x double").count() == 1
    with pytest.raises(Exception, match="."):
        files.read_csv(spark, f"file://{tmp_path}/csv", "i long, other double").collect()
    paths = files.write_splits(spark, df, f"file://{tmp_path}/parts")
    assert {k: spark.read.parquet(p).count() for k, p in paths.items()} == {"all": 3, "train": 1, "val": 1, "test": 1}
    with pytest.raises(FileExistsError):
        files.write_splits(spark, df, f"file://{tmp_path}/parts")
    files.check_written(spark, paths["val"], df)
    with pytest.raises(InputError, match="x"):
        files.check_written(spark, paths["val"], df.withColumn("x", F.col("x").cast("float")))
    assert files.read_columns(spark, paths["all"], ["x", "i"], 2).columns == ["x", "i"] and files.read_columns(spark, paths["all"], ["i"], 2).count() == 2
    with pytest.raises(InputError, match="nope"):
        files.read_columns(spark, paths["all"], ["nope"])


@pytest.fixture
def good(spark):
    return spark.createDataFrame([(i, "train", i % 2, float(i), 1.5) for i in range(20)], "tx_id long, split string, label int, a double, b double")


def test_load_split(spark, good, tmp_path):
    def load(df, features=("a", "b"), **kw):
        path = f"file://{tmp_path}/{random.random()}"
        df.write.parquet(path)
        return files and validation.load_split(spark, path, list(features), "train", **kw)

    assert load(good).columns == ["label", "a", "b"] and load(good, rows=3).count() == 3 and load(good, ["b", "a"]).columns == ["label", "b", "a"]
    null, nan, inf = (F.when(F.col("tx_id") == 3, x).otherwise(F.col("a")) for x in (F.lit(None), F.lit(float("nan")), F.lit(float("-inf"))))
    assert load(good.withColumn("a", null), allow_missing=True).count() == 20
    refused = [
        (good.where("false"), "split"), (good.withColumn("split", F.lit("val")), "split"), (good.withColumn("split", F.lit(None).cast("string")), "split"), (good.drop("split"), "split"),
        (good.withColumn("split", F.when(F.col("tx_id") == 1, "test").otherwise("train")), "1 of them"), (good.drop("label"), "label"), (good.withColumn("label", F.lit(1)), "labels"), (good.withColumn("label", F.lit(2)), "labels"),
        (good.withColumn("label", F.when(F.col("tx_id") > 1, F.col("label"))), "labels"), (good.withColumn("label", F.lit(float("nan"))), "labels"), (good.drop("a"), "a"), (good.withColumn("a", F.lit("x")), "numeric"),
        (good.withColumn("a", null), "1 missing"), (good.withColumn("a", nan), "1 missing"), (good.withColumn("a", inf), "1 infinite"),
    ]
    for df, message in refused:
        with pytest.raises(InputError, match=message):
            load(df)
    for features in (["a", "a"], [], ["zz"]):
        with pytest.raises(InputError, match="features"):
            load(good, features)
    with pytest.raises(InputError, match="infinite"):
        load(good.withColumn("a", inf), allow_missing=True)


def test_other_checks(spark, good):
    with pytest.raises(InputError, match="splits"):
        validation.check_required_splits(good)
    with pytest.raises(Exception, match="unknown split"):
        validation.normalize_split(good.withColumn("split", F.lit("holdout"))).collect()
    with pytest.raises(Exception, match="blank"):
        validation.normalize_category(good.withColumn("c", F.lit("  ")), "c").collect()
    validation.check_existing(good, "b", F.lit(1.5 + 1e-7))
    with pytest.raises(InputError, match="20 rows"):
        validation.check_existing(good, "b", F.lit(1.51))
    with pytest.raises(InputError, match="19"):
        validation.check_same_rows(good.limit(19), good)
    with pytest.raises(InputError, match="schemas"):
        validation.preview_checks({"train": good, "val": good.drop("a")}, good)
    summary = spark.createDataFrame([("train", 20), ("val", 1)], "split string, n long")
    assert {r["split"]: r["ok"] for r in validation.preview_checks({"train": good}, summary).collect()} == {"train": True, "val": False}
    scores = good.select(F.lit(0.5).alias("score"), "label")
    validation.check_scores(scores)
    for bad in (scores.withColumn("score", F.lit(1.5)), scores.withColumn("score", F.lit(float("nan"))), scores.where("label = 1"), scores.where("false")):
        with pytest.raises(InputError, match="scores"):
            validation.check_scores(bad)
    with pytest.raises(Exception, match="no split"):
        validation.attach_split(good.drop("split"), good.where("tx_id > 3").select("tx_id", "split")).collect()
    tx = spark.createDataFrame([(1, 1, 2, 0, -5.0)], "tx_id long, sender long, receiver long, us long, amount double")
    for f in (flows.flow_balance, flows.pair_window):
        with pytest.raises(Exception, match="negative"):
            f(tx, 10).collect()


def test_ordered_totals(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(101)], "k long, v long").repartition(5)
    rows = sorted(map(tuple, df.collect()))
    got = {r["k"]: r["t"] for r in totals_before(spark, df, ["k"], {"t": F.col("v")}).collect()}
    assert got == {k: sum(v for _, v in rows[:i]) for i, (k, _) in enumerate(rows)}
    assert {r["k"]: r["n"] for r in numbered(spark, df, [F.desc("k")], "n").collect()} == {k: 100 - k for k in range(101)}
    assert numbered(spark, df.where("false"), ["k"], "n").count() == 0


def test_samples(spark, good):
    assert review.evenly_spaced(spark, good, 50, ["tx_id"]).count() == 20
    assert [r["tx_id"] for r in review.evenly_spaced(spark, good, 5, ["tx_id"]).orderBy("tx_id").collect()] == [0, 4, 9, 14, 19]
    assert review.first_per_label(good, 3).groupBy("label").count().where("count = 3").count() == 2


def test_pagerank_stops_at_the_first_small_step(spark):
    rng = random.Random(1)
    edges = list({(rng.randrange(30), rng.randrange(25)) for _ in range(70)})
    tx = spark.createDataFrame([(i, a, b, "train") for i, (a, b) in enumerate(edges)], "tx_id long, sender long, receiver long, split string")
    nodes = sorted({x for e in edges for x in e})
    rank = {n: 1 / len(nodes) for n in nodes}
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    while True:
        was, loose = rank, sum(r for n, r in rank.items() if not out[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * loose / len(nodes) for n in nodes}
        for n in nodes:
            for b in out[n]:
                rank[b] += 0.85 * was[n] / len(out[n])
        if sum(abs(rank[n] - was[n]) for n in nodes) < len(nodes) * 1e-4:
            break
    got = {r["node"]: r["rank"] for r in graph.pagerank(spark, tx, tol=1e-4).collect()}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-9 for n in nodes)


def test_boosted_trees(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        a, b = rng.random(), rng.random()
        rows.append((i, ("train", "val", "test")[i // 300], int(a + 0.2 * rng.random() > 0.8), a, b))
    df = spark.createDataFrame(rows, "tx_id long, split string, label int, a double, b double")
    fit = model.train(df, ["a", "b"], maxIter=3, maxDepth=2)
    report = {r["split"]: r for r in model.evaluate(spark, model.score(df, fit, ["a", "b"])).collect()}
    assert report["test"]["f1"] > 0.8 and report["test"]["average_precision"] > 0.8 and report["val"]["threshold"] == report["test"]["threshold"]
    places = {r["feature"]: r["place"] for r in model.importance(spark, fit, ["a", "b"]).collect()}
    assert places == {"a": 1, "b": 2}
    trials = model.search(spark, df, ["a", "b"], {"maxIter": [1], "maxDepth": [1, 2]}, 2)
    assert len(trials) == 2 and trials[0][1] >= trials[1][1]
