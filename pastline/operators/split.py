"""Chronological splits with whole timestamp groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastline.sources.tables import InputError


#: Counts that a narrowing step gathers for a place, as a power of two.
STEP = 18


def _places(df: DataFrame, ks: list[int], order: str) -> list[tuple[int, int]]:
    """For each k (from 1) the ``order`` value of the k-th row and the rows up to that value, by narrowing histograms: no sort and no single task
    over all rows. All places are narrowed together, a scan per step."""
    lo, hi = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    bits = max(1, int(hi - lo).bit_length())
    base, before = [lo] * len(ks), [0] * len(ks)
    while bits > 0:
        step = max(0, bits - STEP)
        parts = [F.when((F.col(order) >= b) & (F.col(order) < b + (1 << bits)), F.shiftright(F.col(order) - b, step)) for b in base]
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), p.alias("b")) for i, p in enumerate(parts)])).alias("p")
        counts = df.select(each).select("p.*").where("b is not null").groupBy("i", "b").count().orderBy("i", "b").collect()  # 2 ** STEP rows a place at most
        for i, k in enumerate(ks):
            for row in (r for r in counts if r["i"] == i):
                if k <= before[i] + row["count"]:
                    base[i] += row["b"] << step
                    upto = before[i] + row["count"]
                    break
                before[i] += row["count"]
            if not step:
                before[i] = upto
        bits = step
    return list(zip(base, before, strict=True))


def boundaries(df: DataFrame, train: float = 0.6, val: float = 0.2, order: str = "us") -> tuple[int, int]:
    """The last times of train and of val. A split that is empty, also after both have moved to the end of their time's rows, is an error."""
    n = df.count()
    first, second = int(n * train), int(n * (train + val))
    if not 0 < first < second < n:
        raise InputError("a split would be empty")
    (one, to_one), (two, to_two) = _places(df, [first, second], order)
    if not 0 < to_one < to_two < n:
        raise InputError(f"a split would be empty: of {n} rows, {to_one} are up to the first boundary's time and {to_two} up to the second's")
    return one, two


def chronological(df: DataFrame, train: float = 0.6, val: float = 0.2, order: str = "us") -> DataFrame:
    """Adds ``split``: rows up to the boundary row's timestamp are train, then val, then test."""
    one, two = boundaries(df, train, val, order)
    return df.withColumn("split", F.when(F.col(order) <= one, "train").when(F.col(order) <= two, "val").otherwise("test"))


def check_order(df: DataFrame, order: str = "us") -> None:
    """Raises unless train ends before val begins and val before test, and none is empty."""
    r = {x["split"]: x for x in df.groupBy("split").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).collect()}
    if set(r) != {"train", "val", "test"} or not (r["train"]["hi"] < r["val"]["lo"] and r["val"]["hi"] < r["test"]["lo"]):
        raise InputError("the splits are missing or overlap in time")
