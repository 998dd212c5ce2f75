"""Sources: readers, the bound transaction views, strict standardisation and split-aware samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastline.functions.scalars import HOUR, micros


class InputError(ValueError):
    """An input table that breaks its contract."""


#: Accepted names of the canonical columns (fixed values).
ALIASES = {
    "tx_id": ("tx_id", "transaction_id", "id"),
    "timestamp": ("timestamp", "Timestamp", "ts"),
    "label": ("label", "is_laundering", "Is Laundering"),
    "amount": ("amount", "amount_paid", "Amount Paid"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resolve(df: DataFrame, logical: str, explicit: dict[str, str] | None = None) -> str:
    """The physical column of a logical name: an explicit mapping, the name itself, or an alias."""
    for name in [(explicit or {}).get(logical), logical, *ALIASES.get(logical, ())]:
        if name in df.columns:
            return name
    raise InputError(f"no column for {logical!r}; looked for {ALIASES.get(logical, (logical,))} in {df.columns}")


def standardize(df: DataFrame, explicit: dict[str, str] | None = None) -> DataFrame:
    """Canonical ``tx_id, us, label`` first, then the other columns. One pass counts every breach of the contract; any breach raises."""
    tx, ts, label = (resolve(df, x, explicit) for x in ("tx_id", "timestamp", "label"))
    when = F.try_to_timestamp(F.col(ts).cast("string")) if dict(df.dtypes)[ts] == "string" else F.col(ts).cast("timestamp")
    value = F.expr(f"try_cast(`{label}` as int)")
    bad = df.agg(
        F.count_if(F.col(tx).isNull()).alias("null tx_id"),
        F.count_if(when.isNull()).alias("null or unreadable timestamp"),
        F.count_if(value.isNull() | ~value.isin(0, 1)).alias("label that is not 0 or 1"),
    ).first()
    repeats = df.groupBy(tx).count().where("count > 1").limit(1).count()
    found = [f"{n} rows with {k}" for k, n in bad.asDict().items() if n] + ["repeated tx_id"] * repeats
    if found:
        raise InputError("; ".join(found))
    rest = [c for c in df.columns if c not in (tx, ts, label)]
    return df.select(F.col(tx).alias("tx_id"), F.unix_micros(when).alias("us"), value.cast("byte").alias("label"), *rest)


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions; hours make the timestamp ties that the past-only law is about."""
    events = read(spark, sf_dir, "events")
    us = micros(events, "ts")
    return events.select(
        F.col("event_id").alias("tx_id"), F.col("user_id").alias("sender"), ((F.col("event_id") * 31 + 7) % 97).alias("receiver"),
        (us - F.pmod(us, F.lit(HOUR))).alias("us"), F.col("value").alias("amount"), F.col("event_type").alias("fmt"),
        (F.col("event_type") == "error").cast("int").alias("label"), (F.col("user_id") % 25).alias("sender_bank"), (((F.col("event_id") * 31 + 7) % 97) % 25).alias("receiver_bank"),
    )


def tx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as transactions: customers and suppliers share one account space."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("o_custkey").alias("sender"), F.col("l_suppkey").alias("receiver"), micros(li, "l_shipdate").alias("us"),
        F.col("l_extendedprice").alias("amount"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount_received"), F.col("o_orderpriority").alias("fmt"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def split_sample(df: DataFrame, rows: int, order: str = "tx_id") -> DataFrame:
    """A third of ``rows`` from each split at most, the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("split").orderBy(order))).where(F.col("_n") <= rows // 3).drop("_n")
