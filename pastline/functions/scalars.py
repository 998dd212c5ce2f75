"""Scalar expressions and names that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def non_negative(x: Column, name: str) -> Column:
    """``x``; a negative value is an error."""
    return F.when(x < 0, F.raise_error(F.lit(f"{name} has a negative value"))).otherwise(x)


HOUR, DAY = 3_600_000_000, 86_400_000_000


def hour_of(us: Column) -> Column:
    """The hour of a time in microseconds, in UTC whatever the session's zone."""
    return F.floor(F.pmod(us, F.lit(DAY)) / F.lit(HOUR)).cast("int")


def date_of(us: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(DAY)).cast("int"))


def micros(df: DataFrame, column: str) -> Column:
    """A timestamp column in microseconds. One without a zone is in UTC, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(F.col(column).cast("timestamp"))


def to_usd(amount: Column, currency: Column, rates: dict[str, float]) -> Column:
    """``amount`` times its currency's rate, to four digits; null for a currency without one."""
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), currency)
    return F.round(amount * rate, 4)


def normal_tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal ``z``, by a rational approximation of the error function (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def derived_name(base: str, token: str) -> str:
    """``token`` goes before a name's last ``w...`` part (its window), else to the end."""
    parts = base.split("__")
    at = len(parts) - 1 if re.fullmatch(r"w\w+", parts[-1]) else len(parts)
    return "__".join([*parts[:at], token, *parts[at:]])


def base_ratios(columns: list[str]) -> list[str]:
    """Columns that are ratios and not derived from one."""
    return [c for c in columns if "ratio" in c and not any(x in c for x in ("log1p", "clip", "hist_lt2_flag"))]


def contract_variant(selected: list[str], variant: str) -> list[str]:
    """The selected columns with each base ratio swapped for its ``log1p`` or ``clip`` column; ``original`` changes nothing."""
    tokens = {"original": None, "log1p": "log1p", "clip": "clip_train_p9999"}
    if variant not in tokens:
        raise ValueError(f"variant {variant!r} is not one of {', '.join(tokens)}")
    bases = set(base_ratios(selected))
    return [derived_name(c, tokens[variant]) if tokens[variant] and c in bases else c for c in selected]


def contract_bool(text: object) -> bool:
    """``TRUE`` or ``FALSE``, nothing else."""
    if str(text) not in ("TRUE", "FALSE"):
        raise ValueError(f"{text!r} is neither TRUE nor FALSE")
    return text == "TRUE"


#: Parts of names and what they stand for, in order of precedence (fixed values).
METRICS = (
    ("ratio_or_rate", ("ratio", "rate", "pct")), ("amount_or_balance", ("amount", "sumdiff", "residual", "balance", "net_flow")), ("flag", ("flag", "exists")),
    ("count_or_degree", ("count", "degree", "fan", "unique")), ("time_gap", ("seconds", "hours", "time_since", "age", "recency")),
)
FAMILIES = (
    ("ML-05 Stage 4 flow-balance", ("flowbalance", "flow_balance")), ("ML-05 Stage 4 pass-through", ("passflow", "pass_through")), ("Stage 5 gather-scatter optional", ("gather", "scatter")),
    ("Stage 5 2-hop optional", ("twohop", "two_hop", "2hop", "temporal_path")), ("Stage 5 cycle optional", ("cycle", "triad")), ("Stage 5 bipartite optional", ("bipartite", "component_density")),
    ("Stage 5 train-only topology optional", ("topology", "pagerank", "centrality")), ("Stage 3 pair/reverse", ("pair", "reverse", "self_loop")), ("Stage 2 fan-in/fan-out", ("fanin", "fanout", "fan_in", "fan_out")),
    ("Stage 0 time history", ("timehist", "recency", "time_history")), ("Stage 1 account stats", ("account", "acct")), ("carried-forward selected", ("carry_forward",)),
)


def metric_type(column: str) -> str:
    """What a feature measures, by the parts of its name; a name that begins with ``is_`` is a flag."""
    name = column.strip().lower()
    return next((k for k, parts in METRICS if any(p in name for p in parts) or k == "flag" and name.startswith("is_")), "other")


def stage_family(column: str, group: str = "", operation: str = "", spec: str = "", stage: str = "") -> tuple[str, str]:
    """A feature's family, by its name and what its contract says of it, and what it measures."""
    said = " ".join(x.strip().lower() for x in (column, group, operation, spec, stage))
    family = next((k for k, parts in FAMILIES if any(p in said for p in parts)), None)
    if family is None:
        family = "carried-forward selected" if "parent" in group.lower() else "other selected feature"
    return family, metric_type(column)
