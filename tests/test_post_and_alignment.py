"""The post stage, rows aligned by key, node features, sorted sinks and the recompute cache."""

import math

import pytest
from pyspark.sql import functions as F

from pastline.operators import fitted, graph, validation
from pastline.plans import catalog
from pastline.plans.compiler import build_features
from pastline.sources import artifacts, files
from pastline.sources.tables import InputError
from pastline.specs import SpecError

ROWS = [(1, "train", 0.5, -1.0, 1), (2, "train", 9.0, 3.0, 0), (3, "val", 100.0, 4.0, 0), (4, "test", 8.0, -1.0, 1)]


def test_post_stage(spark):
    df = spark.createDataFrame(ROWS, "tx_id long, split string, a__ratio__w1d double, rec double, first int")
    out = fitted.post_stage(df, df.columns, {"rec": "first"}, q=1.0)
    got = {r["tx_id"]: r for r in out.collect()}
    assert out.columns == [*df.columns, "a__ratio__log1p__w1d", "a__ratio__clip_train_p9999__w1d"]
    assert [got[i]["rec"] for i in (1, 2, 3, 4)] == [0.0, 3.0, 4.0, 0.0] and got[3]["a__ratio__clip_train_p9999__w1d"] == 9.0 and math.isclose(got[1]["a__ratio__log1p__w1d"], math.log1p(0.5))
    assert {(r["split"], r["clipped"]) for r in fitted.clip_summary(out, ["a__ratio__w1d"]).collect()} == {("train", 0), ("val", 1), ("test", 0)}
    for bad in (df.withColumn("first", F.lit(0)), df.withColumn("rec", F.lit(-3.0)), df.withColumn("a__ratio__w1d", F.lit(-1.0))):
        with pytest.raises(Exception, match="does not match|negative"):
            fitted.post_stage(bad, df.columns, {"rec": "first"}).collect()
    assert fitted.post_stage(df, ["tx_id"], {}).columns == df.columns


def test_baseline_codes_need_a_split(spark):
    df = spark.createDataFrame([(1, 0, 2.0, "b", "train"), (2, 0, 2.0, None, "train"), (3, 0, 2.0, "z", "val")], "tx_id long, us long, amount double, k string, split string")
    specs = catalog.baseline(categories=("k",))
    assert {r["tx_id"]: r["base__k__code"] for r in build_features(df, specs).collect()} == {1: 0, 2: -1, 3: -1}
    with pytest.raises(SpecError, match="split"):
        build_features(df.drop("split"), specs)


def test_alignment(spark):
    left = spark.createDataFrame([(1, "train", 0), (2, None, 1)], "k long, split string, label int")
    right = left.withColumn("x", F.col("k") * 2)
    out = validation.align_by_key(left, right, "k", ["split", "label"])
    assert out.columns == ["k", "split", "label", "x"] and sorted(r["x"] for r in out.collect()) == [2, 4]
    for bad, says in (
        (right.where("k = 1"), "1 keys on the left alone"), (right.unionByName(right.where("k = 2")), "1 repeated keys"), (right.withColumn("label", F.lit(0)), "1 rows with another label"),
        (right.withColumn("split", F.lit("train")), "1 rows with another split"), (right.unionByName(right.where("k = 1").withColumn("k", F.lit(9).cast("long"))), "1 keys on the right alone"),
    ):
        with pytest.raises(InputError, match=says):
            validation.align_by_key(left, bad, "k", ["split", "label"])


def test_node_features(spark):
    edges = spark.createDataFrame([(1, 0, 1), (2, 1, 5), (3, None, 0)], "tx_id long, from_idx long, to_idx long")
    nodes = spark.createDataFrame([(0, 1.5), (1, None)], "node_idx long, rank double")
    got = {r["tx_id"]: (r["from_rank"], r["to_rank"]) for r in graph.with_node_features(edges, nodes, ["rank"]).collect()}
    assert got == {1: (1.5, 0.0), 2: (0.0, 0.0), 3: (0.0, 1.5)}
    with pytest.raises(Exception, match="several rows"):
        graph.with_node_features(edges, nodes.unionByName(nodes), ["rank"]).collect()
    with pytest.raises(InputError, match="hidden"):
        graph.with_node_features(edges.withColumn("from_rank", F.lit(1)), nodes, ["rank"])
    said = {r["column_name"]: r for r in graph.feature_metadata([("from_id", "bigint"), ("pair_count", "double"), ("time__row__hour", "int"), ("x", "int"), ("label", "int")], "edge")}
    assert [said[c]["used"] for c in ("from_id", "pair_count", "label")] == [False, True, False] and said["from_id"]["null_policy"] == "must_not_null" and said["x"]["leakage"] == "review"
    assert graph.feature_metadata([("train_only_pagerank", "double")], "node")[0]["leakage"] == "fit_on_train_split_edges_only"


def test_sorted_sink(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("v"), "id").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_sorted(spark, df, f"file://{tmp_path}/s", ["v", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    import pyarrow.parquet as pq

    parts = [pq.read_table(p)["v"].to_pylist() for p in sorted((tmp_path / "s").glob("*.parquet"))]
    values = [v for p in parts for v in p]
    assert len(parts) > 1 and values == sorted(values) and len(values) == 2000
    with pytest.raises(FileExistsError):
        files.write_sorted(spark, df, f"file://{tmp_path}/s", ["v"])


def test_recompute_cache(spark, tmp_path):
    source, store, calls = f"file://{tmp_path}/in", f"file://{tmp_path}/kept", []

    def compute():
        calls.append(1)
        return spark.read.parquet(source).agg(F.sum("id").alias("s"))

    spark.range(10).write.parquet(source)
    ask = lambda spec, **more: artifacts.cached(spark, spec, source, store, compute, **more)
    first, state = ask({"bins": 10})
    assert (first.first()["s"], state, len(calls)) == (45, "miss", 1)
    again, state = ask({"bins": 10})
    assert (again.first()["s"], state, len(calls)) == (45, "hit", 1)
    assert ask({"bins": 5})[1] == "miss" and len(calls) == 2
    assert ask({"bins": 10}, force=True)[1] == "stale" and len(calls) == 3
    spark.range(20).write.mode("overwrite").parquet(source)
    new, state = ask({"bins": 10})
    assert (new.first()["s"], state, len(calls)) == (190, "stale", 4)
    import shutil

    for record in (tmp_path / "kept").rglob("record"):  # a result without its record is unfinished
        shutil.rmtree(record)
    assert ask({"bins": 10})[0].first()["s"] == 190 and len(calls) == 5
