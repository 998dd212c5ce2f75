"""Quantiles by ranges against Spark's own exact percentile."""

import math
import random

from pyspark.sql import functions as F

from pastline.plans.ordered import quantiles

AT = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]


def test_same_as_percentile(spark):
    r = random.Random(5)
    rows = [("ties", float(r.randrange(7))) for _ in range(300)] + [("spread", r.gauss(0, 1e4)) for _ in range(501)] + [("one", -2.5), ("null", None), ("two", 1.0), ("two", 4.0), ("two", None)]
    rows += [("nan", math.nan), ("nan", 1.0), ("nan", math.inf), (None, 3.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {x["g"]: x["p"] for x in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, AT))).alias("p")).collect() if x["p"] is not None}
    got = {x["g"]: x["q"] for x in quantiles(df, "v", AT, ["g"]).collect()}
    assert repr(sorted(got.items(), key=str)) == repr(sorted(want.items(), key=str))
    plain = df.where("g is null or g <> 'nan'")
    assert quantiles(plain, F.col("v") * 2, AT).first()["q"] == plain.agg(F.percentile(F.col("v") * 2, F.array(*map(F.lit, AT))).alias("p")).first()["p"]


def test_no_values(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles(df, "v", [0.5]).first()["q"] == [None]
    assert quantiles(df, "v", [0.5], ["g"]).count() == 0
