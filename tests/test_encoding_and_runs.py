"""Encodings with a stored vocabulary, training that stops, and the chain of hashes from model to test."""

import random

import pytest
from pyspark.sql import functions as F

from pastline.operators import encoding, model
from pastline.operators.encoding import EncodingSpec
from pastline.sources import artifacts
from pastline.sources.tables import InputError
from pastline.specs import SpecError

ROWS = [(1, "train", 0, " b ", 1.5), (2, "train", 1, "a", 2.5), (3, "val", 0, "z", 3.5), (4, "test", 1, "a", 4.5), (5, "train", 0, "é", 0.5), (6, "test", 0, "__UNKNOWN__", 0.5)]
SPECS = [EncodingSpec("", "x"), EncodingSpec("k", "k_code", "LABEL_CODE "), EncodingSpec(" k ", "k_native", "xgb_native", "encode"), EncodingSpec("", "unused", used=False)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "tx_id long, split string, label int, k string, x double").withColumn("unused", F.lit(1))


@pytest.mark.parametrize(
    ("specs", "says"),
    [
        ([], "no encoding"), ([EncodingSpec("a", "b", used=False)], "no encoding"), ([EncodingSpec("a", "b", "one_hot")], "none of"), ([EncodingSpec("a", "b", "", "encode")], "none of"),
        ([EncodingSpec("a", "b", "label_code", "drop")], "unknown action"), ([EncodingSpec(" ", "b", "label_code")], "blank"), ([EncodingSpec("a", " ")], "blank"), ([EncodingSpec("a", "b"), EncodingSpec("c", "b ")], "repeated"),
    ],
)
def test_bad_specs(specs, says):
    with pytest.raises(InputError, match=says):
        encoding.normalize_specs(specs)


def test_specs_are_normalised():
    found = encoding.normalize_specs([*SPECS, EncodingSpec("k", "c", "label_code", "build")])
    assert [(s.source, s.encoding, s.action, s.kind) for s in found] == [("x", "passthrough", "carry_forward", "q"), ("k", "label_code", "encode", "q"), ("k", "xgb_native", "encode", "c"), ("unused", "passthrough", "carry_forward", "q"), ("c", "passthrough", "build", "q")]
    with pytest.raises(SpecError, match="leak"):
        encoding.normalize_specs([EncodingSpec("k", "pattern_k", "label_code")])


def test_stored_and_restored(spark, df, tmp_path):
    path = f"file://{tmp_path}/e"
    record = encoding.store(spark, df, SPECS, path)
    assert record["feature_columns"] == ["x", "k_code", "k_native"] and record["feature_types"] == {"x": "q", "k_code": "q", "k_native": "c"}
    want = {1: (1.5, 1, "b"), 2: (2.5, 0, "a"), 3: (3.5, -1, "__UNKNOWN__"), 4: (4.5, 0, "a"), 5: (0.5, 2, "é"), 6: (0.5, -1, "__UNKNOWN__")}
    other = spark.newSession()  # replayed elsewhere, on rows without any train
    again = other.createDataFrame(ROWS, "tx_id long, split string, label int, k string, x double").withColumn("unused", F.lit(1))
    for rows in (again, again.where("split <> 'train'")):
        got = {r["tx_id"]: (r["x"], r["k_code"], r["k_native"]) for r in encoding.encode_stored(other, rows, path).collect()}
        assert got == {k: v for k, v in want.items() if k in got} and len(got) == rows.count()
    encoded, vocabulary = encoding.encode_new(spark, df, SPECS)
    assert {r["tx_id"]: r["k_code"] for r in encoded.collect()} == {k: v[1] for k, v in want.items()}
    rows = encoding.mapping_rows(encoding.normalize_specs(SPECS), vocabulary).collect()
    assert sorted((r["output"], r["category"], r["code"]) for r in rows if r["output"] == "k_code") == [("k_code", "a", 0), ("k_code", "b", 1), ("k_code", "é", 2)]
    assert {(r["category"], r["code"]) for r in rows if r["output"] == "k_native"} == {(c, None) for c in ("a", "b", "é", "__UNKNOWN__")}
    with pytest.raises(Exception, match="blank"):
        encoding.encode_stored(spark, df.withColumn("k", F.lit(" ")), path).collect()


def test_changed_vocabularies_are_refused(spark, df, tmp_path):
    path = f"file://{tmp_path}/e"
    encoding.store(spark, df, SPECS, path)
    record, _ = artifacts.read_json(spark, f"{path}/manifest")
    vocabulary = spark.read.parquet(f"{path}/vocabulary")
    for k, change in enumerate((vocabulary.withColumn("code", 2 - F.col("code")), vocabulary.where("category <> 'a'"), vocabulary.unionByName(vocabulary))):
        bad = f"file://{tmp_path}/bad{k}"
        change.write.parquet(f"{bad}/vocabulary")
        artifacts.write_json(spark, record, f"{bad}/manifest")
        with pytest.raises(InputError, match="vocabulary"):
            encoding.restore(spark, bad)
    vocabulary.repartition(3).write.parquet(f"file://{tmp_path}/same/vocabulary")
    artifacts.write_json(spark, record, f"file://{tmp_path}/same/manifest")
    assert encoding.restore(spark, f"file://{tmp_path}/same")[2] == record  # the same rows in other files
    for k, change in enumerate(({"feature_columns": ["k_code", "x", "k_native"]}, {"feature_order_hash": "0"}, {"specs": record["specs"][1:]}, {"unknown_category": None})):
        bad = f"file://{tmp_path}/order{k}"
        vocabulary.write.parquet(f"{bad}/vocabulary")
        artifacts.write_json(spark, {**record, **change}, f"{bad}/manifest")
        with pytest.raises(InputError, match="features|unknown"):
            encoding.restore(spark, bad)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = []
    for i in range(900):
        x, k = rng.random(), rng.choice("abcdef")
        out.append((i, ("train", "val", "test")[i % 3], int((x > 0.7) != (k in "ace")) if rng.random() < 0.95 else rng.randrange(2), x, k, rng.random()))
    return spark.createDataFrame(out, "tx_id long, split string, label int, x double, k string, noise double").repartition(2).cache()


FEATURES, CATEGORIES = ["x", "k", "noise"], ("k",)


def test_training_stops_and_splits_categories(spark, rows):
    m = model.train_stopped(rows, FEATURES, CATEGORIES, maxIter=40, maxDepth=3, validationTol=0.05)
    assert m.stages[-1].getNumTrees < 40
    assert "in {" in m.stages[-1].toDebugString  # sets of categories
    found = model.evaluate(spark, model.score_stopped(rows, m, FEATURES, CATEGORIES)).collect()
    assert all(r["f1"] > 0.85 for r in found)
    unseen = rows.limit(3).withColumns({"k": F.lit("new"), "x": F.lit(None).cast("double")})
    assert model.score_stopped(unseen, m, FEATURES, CATEGORIES).where("score between 0 and 1").count() == 3


def _copy(spark, source, target, **changes):
    import shutil

    shutil.copytree(source, target)
    for part, change in changes.items():
        record, _ = artifacts.read_json(spark, f"file://{target}/{part}")
        shutil.rmtree(f"{target}/{part}")
        artifacts.write_json(spark, {k: v for k, v in {**record, **change}.items() if v != "drop"}, f"file://{target}/{part}")
    return f"file://{target}"


def test_runs_refuse_what_does_not_fit(spark, rows, tmp_path):
    path = f"file://{tmp_path}/run"
    small = {"maxIter": 3, "maxDepth": 2}
    model.train_run(spark, rows, FEATURES, path, "r01", CATEGORIES, **small)
    with pytest.raises(FileExistsError):
        model.train_run(spark, rows, FEATURES, path, "r02", CATEGORIES, **small)
    with pytest.raises(InputError, match="id"):
        model.train_run(spark, rows, FEATURES, f"file://{tmp_path}/x", "", CATEGORIES, **small)
    chosen = model.validate_run(spark, rows, path)
    (result,) = model.test_run(spark, rows, path).collect()
    assert result["run_id"] == "r01" and result["threshold"] == chosen["threshold"] and result["tp"] + result["fn"] == rows.where("split = 'test' and label = 1").count()
    source = tmp_path / "run"
    cases = {
        "model_hash": {"train": {"model_hash": "0"}}, "feature_order_hash": {"train": {"features": ["k", "x", "noise"]}}, "run_id of": {"threshold": {"run_id": "r02"}}, "no run_id": {"train": {"run_id": None}},
        "training comes": {"train": {"sample_rows": 10}}, "threshold comes": {"threshold": {"sample_rows": 10}}, "selection_split": {"threshold": {"selection_split": "test"}}, "train_hash": {"train": {"params": {"maxIter": 4}}},
    }
    for k, (says, changes) in enumerate(cases.items()):
        with pytest.raises(InputError, match=says):
            model.test_run(spark, rows, _copy(spark, source, tmp_path / f"case{k}", **changes))
    other = f"file://{tmp_path}/other"
    model.train_run(spark, rows, FEATURES, other, "r01", CATEGORIES, maxIter=2, maxDepth=2)
    model.PipelineModel.load(f"{other}/model").write().overwrite().save(f"{path}/model")
    with pytest.raises(InputError, match="model_hash"):
        model.test_run(spark, rows, path)
    sampled = f"file://{tmp_path}/sampled"
    model.train_run(spark, rows, FEATURES, sampled, "r03", CATEGORIES, sample_rows=150, **small)
    model.validate_run(spark, rows, sampled)
    with pytest.raises(InputError, match="sample"):
        model.test_run(spark, rows, sampled)


def test_parzen_search_beats_the_seeded_sample():
    space = {"depth": list(range(2, 12)), "rate": [k / 20 for k in range(1, 15)], "rows": [k / 10 for k in range(1, 11)]}
    value = lambda p: -((p["depth"] - 7) ** 2) / 10 - (p["rate"] - 0.3) ** 2 * 20 - (p["rows"] - 0.8) ** 2 * 4
    better = 0
    for seed in range(20):
        found = model.parzen_search(value, space, 40, seed)
        assert found == model.parzen_search(value, space, 40, seed) and len({str(p) for p, _ in found}) == 40
        rng = random.Random(seed)
        better += found[0][1] >= max(value({k: rng.choice(v) for k, v in space.items()}) for _ in range(40))
    assert better >= 14
    assert len(model.parzen_search(value, {"depth": [1, 2], "rate": [0.1], "rows": [0.5]}, 40)) == 2


def test_search_over_spark_jobs(spark, rows):
    found = model.search_parzen(spark, rows, FEATURES, {"maxDepth": [1, 3], "maxIter": [1, 2]}, 2, categories=CATEGORIES)
    assert len(found) == 2 and found[0][1] >= found[1][1] > 0
