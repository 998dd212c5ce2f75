"""Boosted trees on feature tables: train on one split, fix the threshold on the next, report on the last."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastline.operators import fitted, stats
from pastline.operators.validation import check_features, check_labels
from pastline.plans.checkpoint import table
from pastline.sources import artifacts, files
from pastline.sources.tables import InputError

DEFAULTS = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 1.0, "seed": 7}


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df.na.fill(0.0, features))


def train(df: DataFrame, features: list[str], **params: object) -> Model:
    """A model of the train split; classes are weighed equally."""
    rows = df.where(F.col("split") == "train")
    check_features(rows, features, allow_missing=True)
    check_labels(rows)
    weight = F.when(F.col("label") == 1, fitted.scale_pos_weight(df)).otherwise(1.0)
    data = _vectors(rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.col("label").cast("double").alias("label"), weight.alias("_w")), features)
    return GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_w", **{**DEFAULTS, **params}).fit(data)


def score(df: DataFrame, model: Model, features: list[str]) -> DataFrame:
    """``tx_id, split, label, score``."""
    numbers = df.select("tx_id", "split", "label", *[F.col(c).cast("double").alias(c) for c in features])
    return model.transform(_vectors(numbers, features)).select("tx_id", "split", "label", vector_to_array("probability")[1].alias("score"))


def evaluate(spark: SparkSession, scores: DataFrame) -> DataFrame:
    """Metrics of val and test at the threshold with val's best F1. The scores are stored: each metric reads them."""
    scores = table(spark, scores.where(F.col("split").isin("val", "test")), "scores")
    val = scores.where(F.col("split") == "val")
    threshold = stats.best_threshold(spark, val).first()["threshold"]
    rows = []
    for s in ("val", "test"):
        part = scores.where(F.col("split") == s)
        rows.append(stats.metrics_at(part, threshold).join(stats.average_precision(spark, part)).select(F.lit(s).alias("split"), F.lit(threshold).alias("threshold"), "*"))  # one row each
    return rows[0].unionByName(rows[1])


def importance(spark: SparkSession, model: Model, features: list[str]) -> DataFrame:
    """``feature, importance, place``; equal values share the lesser place."""
    rows = [(f, float(x)) for f, x in zip(features, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").withColumn("place", F.rank().over(Window.orderBy(F.desc("importance"))))  # a row per feature


def search(spark: SparkSession, df: DataFrame, features: list[str], space: dict[str, list], trials: int, seed: int = 7) -> list[tuple[dict, float]]:
    """Seeded sample of ``trials`` combinations of ``space``, each with val's average precision, best first. Test is never read."""
    df = table(spark, df.where(F.col("split") != "test").select("tx_id", "split", "label", *features), "features")
    every = [dict(zip(space, x, strict=True)) for x in itertools.product(*space.values())]
    seen = []
    for params in random.Random(seed).sample(every, min(trials, len(every))):
        scores = score(df.where(F.col("split") == "val"), train(df, features, **params), features)
        seen.append((params, stats.average_precision(spark, scores).first()[0]))
    return sorted(seen, key=lambda x: -x[1])


#: Rounds of a stopped training at most, and the least gain of the validation loss that goes on.
ROUNDS, GAIN = 100, 0.001
PARTS = ("model", "train", "threshold")


def train_stopped(df: DataFrame, features: list[str], categories: tuple[str, ...] = (), **params: object) -> PipelineModel:
    """Trees of the train split that stop when the loss on val no longer gets better. ``categories`` among the features are split as sets of
    values, not by order; values that train lacks are one more."""
    rows = df.where(F.col("split").isin("train", "val"))
    numbers = [c for c in features if c not in categories]
    check_features(rows, numbers, allow_missing=True)
    for s in ("train", "val"):
        check_labels(rows.where(F.col("split") == s))
    weight = F.when(F.col("label") == 1, fitted.scale_pos_weight(df)).otherwise(1.0)
    data = _numbers(rows, features, categories, "label", "split").withColumns({"label": F.col("label").cast("double"), "_w": weight, "_val": F.col("split") == "val"})
    indexers = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep").fit(data.where(~F.col("_val"))) for c in categories]
    bins = max([32, *[len(i.labels) + 1 for i in indexers]])
    assembler = VectorAssembler(inputCols=[f"_{c}" if c in categories else c for c in features], outputCol="_x", handleInvalid="keep")
    settings = {**DEFAULTS, "maxIter": ROUNDS, "validationTol": GAIN, "maxBins": bins, **params}
    trees = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_w", validationIndicatorCol="_val", **settings)
    return Pipeline(stages=[*indexers, assembler, trees]).fit(data)


def _numbers(df: DataFrame, features: list[str], categories: tuple[str, ...], *keep: str) -> DataFrame:
    cast = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in categories else F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(c) for c in features]
    return df.select(*keep, *cast)


def score_stopped(df: DataFrame, model: PipelineModel, features: list[str], categories: tuple[str, ...] = ()) -> DataFrame:
    """``tx_id, split, label, score``."""
    scored = model.transform(_numbers(df, features, categories, "tx_id", "split", "label"))
    return scored.select("tx_id", "split", "label", vector_to_array("probability")[1].alias("score"))


def train_run(spark: SparkSession, df: DataFrame, features: list[str], path: str, run_id: str, categories: tuple[str, ...] = (), sample_rows: int | None = None, **params: object) -> dict:
    """Trains and stores the model and its record under ``path``, which must be new. With ``sample_rows`` the first rows of each split alone are
    used, and the record says so. The record has the hashes of the features' order and of the model's files."""
    if not run_id:
        raise InputError("a run needs an id")
    files.guard(spark, [f"{path}/{p}" for p in PARTS], False)
    rows = df if sample_rows is None else df.withColumn("_r", F.row_number().over(Window.partitionBy("split").orderBy("tx_id"))).where(F.col("_r") <= sample_rows).drop("_r")
    model = train_stopped(rows, features, categories, **params)
    model.save(f"{path}/model")
    record = {
        "run_id": run_id, "features": features, "categories": list(categories), "feature_order_hash": artifacts.order_hash(features), "model_hash": artifacts.files_hash(spark, f"{path}/model"),
        "trees": model.stages[-1].getNumTrees, "params": {k: v for k, v in sorted(params.items())}, "sample_rows": sample_rows,
    }
    artifacts.write_json(spark, record, f"{path}/train")
    return record


def _checked(spark: SparkSession, path: str) -> tuple[dict, str]:
    """The train record of ``path`` and its hash, if the model and the order of features are those it was written for."""
    record, own = artifacts.read_json(spark, f"{path}/train")
    if not record.get("run_id"):
        raise InputError(f"{path}: the training record has no run_id")
    if artifacts.order_hash(record["features"]) != record["feature_order_hash"]:
        raise InputError(f"{path}: feature_order_hash is not that of the record's features")
    if artifacts.files_hash(spark, f"{path}/model") != record["model_hash"]:
        raise InputError(f"{path}: model_hash is not that of the model's files")
    return record, own


def validate_run(spark: SparkSession, df: DataFrame, path: str, sample_rows: int | None = None) -> dict:
    """Fixes the threshold with val's best F1, and stores it with the chain of hashes that it rests on."""
    record, own = _checked(spark, path)
    val = df.where(F.col("split") == "val")
    val = val if sample_rows is None else val.orderBy("tx_id").limit(sample_rows)
    scores = table(spark, score_stopped(val, PipelineModel.load(f"{path}/model"), record["features"], tuple(record["categories"])), "scores")
    best = stats.best_threshold(spark, scores).first()
    said = {k: record[k] for k in ("run_id", "feature_order_hash", "model_hash")}
    found = {**said, "train_hash": own, "selection_split": "val", "threshold": best["threshold"], "f1": best["f1"], "sample_rows": sample_rows}
    artifacts.write_json(spark, found, f"{path}/threshold")
    return found


def test_run(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Metrics of the test split at the stored threshold: one row. Refused if training or threshold come from a sample, if the threshold was not
    chosen on val, or if run, features, model or training record are not those that the threshold was chosen with."""
    record, own = _checked(spark, path)
    chosen, _ = artifacts.read_json(spark, f"{path}/threshold")
    for what, r in (("training", record), ("threshold", chosen)):
        if r.get("sample_rows") is not None:
            raise InputError(f"{path}: the {what} comes from a sample")
    want = {"run_id": record["run_id"], "selection_split": "val", "feature_order_hash": record["feature_order_hash"], "model_hash": record["model_hash"], "train_hash": own}
    for name, value in want.items():
        if chosen.get(name) != value:
            raise InputError(f"{path}: {name} of the threshold is {chosen.get(name)!r}, not {value!r}")
    scores = score_stopped(df.where(F.col("split") == "test"), PipelineModel.load(f"{path}/model"), record["features"], tuple(record["categories"]))
    scores = table(spark, scores, "scores")
    return stats.metrics_at(scores, chosen["threshold"]).join(stats.average_precision(spark, scores)).select(F.lit(record["run_id"]).alias("run_id"), F.lit(chosen["threshold"]).alias("threshold"), "*")  # one row each


def parzen_search(objective: Callable[[dict], float], space: dict[str, list], trials: int, seed: int = 7, startup: int = 8, good: float = 0.25, draws: int = 24) -> list[tuple[dict, float]]:
    """Sequential search of ``space`` for a high ``objective``, which stays a Spark job: after ``startup`` random trials, the combination with the
    greatest ratio of the good trials' density to the others' is tried next, of ``draws`` drawn from the good ones. Best first; equal seeds
    give equal trials.

    Densities are per parameter: each trial adds weight to its value and, halving by step, to the values beside it in the list.
    """
    rng, seen = random.Random(seed), []
    every = math.prod(len(v) for v in space.values())

    def density(rows: list[dict], name: str) -> list[float]:
        values = space[name]
        weight = [1.0 / len(values)] * len(values)
        for r in rows:
            at = values.index(r[name])
            for i in range(len(values)):
                weight[i] += 0.5 ** (2 * abs(i - at))
        return [w / sum(weight) for w in weight]

    while len(seen) < min(trials, every):
        tried = [p for p, _ in seen]
        if len(seen) < startup:
            params = {k: rng.choice(v) for k, v in space.items()}
        else:
            ranked = [p for p, _ in sorted(seen, key=lambda x: -x[1])]
            cut = max(1, math.ceil(good * len(ranked)))
            above, below = ({k: density(rows, k) for k in space} for rows in (ranked[:cut], ranked[cut:]))
            gain = lambda p: sum(math.log(above[k][space[k].index(p[k])] / below[k][space[k].index(p[k])]) for k in space)  # noqa: B023, E731
            fresh = [p for p in ({k: rng.choices(v, above[k])[0] for k, v in space.items()} for _ in range(draws)) if p not in tried]
            params = max(fresh, key=gain) if fresh else {k: rng.choice(v) for k, v in space.items()}
        if params not in tried:
            seen.append((params, objective(params)))
    return sorted(seen, key=lambda x: -x[1])


def search_parzen(spark: SparkSession, df: DataFrame, features: list[str], space: dict[str, list], trials: int, seed: int = 7, categories: tuple[str, ...] = ()) -> list[tuple[dict, float]]:
    """:func:`parzen_search` of training settings for val's average precision, over stored features. Test is never read."""
    rows = table(spark, df.where(F.col("split").isin("train", "val")).select("tx_id", "split", "label", *features), "features")
    val = rows.where(F.col("split") == "val")
    objective = lambda p: stats.average_precision(spark, score_stopped(val, train_stopped(rows, features, categories, **p), features, categories)).first()[0]
    return parzen_search(objective, space, trials, seed)
