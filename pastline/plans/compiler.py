"""Compiles feature declarations to DataFrame expressions and streams.

Operations on the row itself and on all of an entity's history are window expressions; those with a moving window go to the relations of
:mod:`pastline.plans.relations`. Specs of one relation and key set are computed together, so Spark sorts and shuffles once per key set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastline.functions.scalars import date_of, hour_of
from pastline.operators.fitted import encode_one, quantiles_of_train
from pastline.plans import relations as R
from pastline.plans.checkpoint import table
from pastline.plans.frames import history
from pastline.specs import FeatureSpec, SpecError


def _recency(s: FeatureSpec) -> Column:
    last = F.max("us").over(history(s.role("entity")))
    return F.coalesce((F.col("us") - last) / F.lit(1e6), F.lit(s.fill(-1.0)))


def _is_first(s: FeatureSpec) -> Column:
    return (F.count(F.lit(1)).over(history(s.role("entity"))) == 0).cast("int")


def _cumulative(s: FeatureSpec) -> Column:
    return F.count(F.lit(1)).over(history(s.role("entity"))).cast("int")


def _value(s: FeatureSpec) -> Column:
    return F.col(s.role("value")).cast("double")


def _log1p(s: FeatureSpec) -> Column:
    x = F.col(s.role("value"))
    return F.when(x < 0, F.raise_error(F.lit(f"{s.output}: log1p of a negative value"))).otherwise(F.log1p(x))


def _part(s: FeatureSpec) -> Column:
    """Parts of the time in UTC, whatever the session's zone."""
    day = date_of(F.col("us"))
    weekday = F.weekday(day)
    parts = {"hour": hour_of(F.col("us")), "dayofweek": weekday, "is_weekend": (weekday >= 5).cast("int"), "day": F.dayofmonth(day), "month": F.month(day)}
    name = str(s.params.get("part"))
    if name not in parts:
        raise SpecError(f"{s.output!r}: unknown part {name!r}")
    return parts[name]


def _self_loop(s: FeatureSpec) -> Column:
    return (F.col(s.role("sender")) == F.col(s.role("receiver"))).cast("int")


ROW: dict[str, Callable[[FeatureSpec], Column]] = {
    "recency_seconds_since_last": _recency, "is_first_by_entity": _is_first, "cumulative_count": _cumulative, "current_value": _value, "log1p": _log1p, "datetime_part": _part, "current_self_loop": _self_loop,
}
OPERATIONS = (*ROW, *R.ENTITY, *R.ACCOUNT, "pair_window", "pair_history", "bank_pair_history", "category_code")
#: Fixed names of two metrics that are fitted on the train split.
BALANCED, CLIPPED = "balanced_state_flag", "current_vs_forward_mean_ratio_log1p_clip_p999_hist2"


def _check(s: FeatureSpec, columns: list[str]) -> None:
    if s.operation not in OPERATIONS:
        raise SpecError(f"unknown operation {s.operation!r}")
    missing = [c for c in s.inputs.values() if c not in columns]
    if missing:
        raise SpecError(f"{s.output!r}: no column {', '.join(missing)}")
    metric, role = s.params.get("metric"), s.params.get("role")
    if s.operation == "pair_window" and metric not in (*R.PAIR_METRICS, CLIPPED) or s.operation == "pair_history" and metric not in R.PAIR_HISTORY:
        raise SpecError(f"{s.output!r}: unknown metric {metric!r}")
    if s.operation == "flowbalance_window" and (metric not in (*R.FLOW, BALANCED) or role not in ("sender", "receiver")):
        raise SpecError(f"{s.output!r}: unknown metric {metric!r} or role {role!r}")
    if s.operation == "passflow_window" and (metric not in R.PASS or (role == "receiver") != (metric == "historical_sequence_count")):
        raise SpecError(f"{s.output!r}: metric {metric!r} is not one of role {role!r}")
    if (metric in (BALANCED, CLIPPED) or s.operation == "category_code") and "split" not in columns:
        raise SpecError(f"{s.output!r} is fitted on the train split: no column split")


def _account(out: DataFrame, df: DataFrame, key: str, specs: list[FeatureSpec]) -> tuple[DataFrame, list[tuple]]:
    """Adds the metrics of accounts; returns what is still to be fitted: output, what it is fitted on, quantile, and how it is applied."""
    groups: dict[tuple[str, str, str, str], dict[tuple[str, str, int], list[FeatureSpec]]] = {}
    for s in specs:
        if s.operation == "rolling_entity_agg":
            now, other = s.role("current"), s.role("history")
            inputs = tuple(s.role(r) for r in ("sender", "receiver", "value", "value"))
            if now not in inputs[:2] or other not in inputs[:2]:
                raise SpecError(f"{s.output!r}: {now!r} and {other!r} are not the sender and the receiver")
            want = ("sender" if now == inputs[0] else "receiver", "out_sum" if other == inputs[0] else "in_sum", s.window())
        else:
            inputs = (s.role("sender"), s.role("receiver"), s.role("value"), s.role("value"))
            metric = str(s.params["metric"])
            want = (str(s.params["role"]), "relative_gap" if metric == BALANCED else metric, s.window())
        groups.setdefault(inputs, {}).setdefault(want, []).append(s)
    fits = []
    for inputs, wanted in groups.items():
        found = R.account_metrics(df, key, inputs, set(wanted))
        columns = []
        for (role, metric, width), mine in wanted.items():
            c = F.col(f"`{role}|{metric}|{width}`")
            for s in mine:
                fitted = s.params.get("metric") == BALANCED
                columns.append((c if fitted else F.coalesce(c, F.lit(0.0))).alias(s.output))
                if fitted:
                    q = float(s.params.get("balance_threshold_quantile", 0.25))
                    fits.append((s.output, s.output, q, lambda x, cap: F.coalesce((x <= cap).cast("double"), F.lit(0.0))))
        out = out.join(found.select(F.col("_key").alias(key), *columns), key)
    return out, fits


def _pairs(out: DataFrame, df: DataFrame, specs: list[FeatureSpec]) -> tuple[DataFrame, list[tuple], list[str]]:
    fits, hidden = [], []
    groups: dict[tuple[str, str, str], dict[str, tuple[str, int]]] = {}
    for s in specs:
        mine = groups.setdefault((s.role("sender"), s.role("receiver"), s.role("value")), {})
        if s.params["metric"] == CLIPPED:
            n = f"{s.output}|n"
            mine[s.output], mine[n] = ("current_vs_forward_mean_ratio", s.window()), ("forward_tx_count", s.window())
            hidden.append(n)
            enough = F.col(f"`{n}`") >= 2
            fits.append((s.output, F.when(enough, F.col(s.output)), 0.999, lambda x, cap, ok=enough: F.when(ok, F.log1p(F.least(x, cap))).otherwise(0.0)))
        else:
            mine[s.output] = (str(s.params["metric"]), s.window())
    for (sender, receiver, value), wanted in groups.items():
        out = R.pair_windows(out, sender, receiver, value, wanted, df)
    return out, fits, hidden


def build_features(df: DataFrame, specs: list[FeatureSpec], keep: tuple[str, ...] = ("tx_id", "us"), key: str = "tx_id") -> DataFrame:
    """``keep`` and then one column per spec, in spec order. Unknown operations, missing inputs and repeated outputs fail before any job.

    ``us`` has no nulls. Metrics of accounts are put back by ``key``, which is unique. Train-fitted metrics need a column ``split``; their
    quantiles are fitted together on the stored features, and without any value to fit they are 0.
    """
    names = [s.output for s in specs]
    if len(set(names)) != len(names) or set(names) & set(df.columns):
        raise SpecError("feature names repeat or hide source columns")
    rows: dict[str, list[tuple[str, Column]]] = {}
    streams: dict[str, list[FeatureSpec]] = {}
    for s in specs:
        _check(s, df.columns)
        if s.operation in ROW:
            rows.setdefault(s.inputs.get("entity", ""), []).append((s.output, ROW[s.operation](s)))
        elif s.operation in R.ENTITY:
            s.role("counterparty" if s.operation in R.SET_METRICS else "value")
            streams.setdefault(s.role("entity"), []).append(s)
    of = lambda *operations: [s for s in specs if s.operation in operations]
    out = df
    for entity, mine in streams.items():
        out = R.entity_windows(out, entity, mine, df)
    out, fits, hidden = _pairs(out, df, of("pair_window"))
    past: dict[tuple[str, str], dict[str, str]] = {}
    for s in of("pair_history"):
        past.setdefault((s.role("sender"), s.role("receiver")), {})[s.output] = str(s.params["metric"])
    for (sender, receiver), wanted in past.items():
        out = R.pair_history(out, sender, receiver, wanted)
    for columns in rows.values():
        out = out.select("*", *[c.alias(n) for n, c in columns])
    for s in of("bank_pair_history"):
        out = R.earlier_rows(out, [s.role("sender_bank"), s.role("receiver_bank")], s.output, df)
    for s in of("category_code"):
        out = encode_one(out, s.role("value"), s.output, df)
    if accounts := of(*R.ACCOUNT):
        out, more = _account(out, df, key, accounts)
        fits += more
    if fits:
        out = _fitted(out, fits)
    return out.drop(*hidden).select(*keep, *names)


def _fitted(out: DataFrame, fits: list[tuple]) -> DataFrame:
    """Replaces fitted columns: their quantiles come from the train rows of the stored table, all in one pass; then a row per column is broadcast."""
    out = table(out.sparkSession, out, "features")
    caps = quantiles_of_train(out, {name: (c if isinstance(c, Column) else F.col(c), q) for name, c, q, _ in fits})
    names = {name for name, *_ in fits}
    # Names of caps by place, for outputs have long names.
    joined = out.join(F.broadcast(caps))
    made = {name: use(F.col(f"`{name}`"), F.col(f"`cap|{name}`")).alias(name) for name, _, _, use in fits}
    return joined.select(*[made[c] if c in names else F.col(f"`{c}`") for c in out.columns])
