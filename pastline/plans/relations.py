"""Relations that features are computed on besides the rows themselves: streams by account or counterparty, accounts' events of both sides,
unordered pairs, and ordered bank pairs. Each takes all its specs at once, so a relation costs one exchange on its keys, whatever the number of
windows; :mod:`pastline.plans.compiler` adds the results to the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastline.functions.scalars import non_negative
from pastline.plans.frames import history
from pastline.plans.ordered import totals_before
from pastline.plans.streams import Chunk, Frames, before, multiset, stream
from pastline.specs import FeatureSpec, SpecError

AGGS = ("count", "sum", "mean", "std", "min", "max")
SET_METRICS = {"fan_in": 0, "fan_out": 0, "rolling_counterparty_nunique": 0, "rolling_counterparty_effective_n": 1, "rolling_counterparty_top1_share": 2}
ENTITY = ("rolling_agg", "cur_vs_mean_ratio", *SET_METRICS)
ACCOUNT = ("rolling_entity_agg", "flowbalance_window", "passflow_window")
#: Metrics of the sender's and the receiver's account, and those that look back from their window's rows once more.
FLOW = ("in_out_ratio", "sumdiff", "residual_abs", "relative_gap", "in_sum", "out_sum")
PASS = ("seconds_since_last_in", "current_to_last_in_amount_ratio", "recent_flag", "sequence_count", "historical_sequence_count")
PAIR_METRICS = (
    "forward_tx_count", "forward_amount_sum", "forward_amount_mean", "forward_amount_std", "forward_amount_max", "reverse_exists", "reverse_tx_count", "reverse_amount_sum",
    "net_amount_sumdiff", "current_vs_forward_mean_ratio", "current_vs_forward_mean_ratio_hist_lt2_flag", "bidirectional_amount_ratio",
)
PAIR_HISTORY = ("seconds_since_last_tx", "is_new_pair", "age_hours_since_first")


def _ratio(a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """``a / b`` where ``ok``, else 0."""
    return np.divide(a, b, out=np.zeros(len(a)), where=ok)


def _refuse_negative(x: np.ndarray, known: np.ndarray, name: str) -> None:
    if (x[known] < 0).any():
        raise ValueError(f"{name}: a negative amount")


def frame_value(f: Frames, agg: str, lo: np.ndarray, hi: np.ndarray, fill: float) -> np.ndarray:
    n = f.count(lo, hi)
    if agg == "count":
        return n.astype(np.float64)
    if agg == "std":
        return np.where(n > 1, f.std(lo, hi), fill)
    return np.where(n > 0, {"sum": f.sum, "mean": f.mean}[agg](lo, hi) if agg in ("sum", "mean") else f.extreme(lo, hi, agg == "max"), fill)


def _kind(s: FeatureSpec) -> str:
    return "int" if s.operation in ("fan_in", "fan_out") else "double"


def entity_windows(df: DataFrame, entity: str, specs: list[FeatureSpec], source: DataFrame) -> DataFrame:
    """``df`` with the columns of ``specs`` (operations ``ENTITY``) over the rows of the same ``entity``."""
    for s in specs:
        if s.operation == "rolling_agg" and s.params.get("agg") not in AGGS:
            raise SpecError(f"{s.output!r}: unknown aggregate {s.params.get('agg')!r}")

    def kernel(chunk: Chunk) -> dict[str, np.ndarray]:
        frames: dict[str, Frames] = {}
        sets: dict[tuple, tuple] = {}
        with_amount = {(s.inputs["counterparty"], s.window()): s.inputs["value"] for s in specs if SET_METRICS.get(s.operation, 0)}
        out, hi = {}, chunk.hi()
        for s in specs:
            width = s.window()
            lo = chunk.lo(width)
            if s.operation in SET_METRICS:
                other = s.inputs["counterparty"]
                # One pass serves all metrics of a counterparty and width, unless their amounts differ.
                value = s.inputs.get("value") if SET_METRICS[s.operation] else with_amount.get((other, width))
                key = (other, width, value)
                if key not in sets:
                    amounts = None
                    if value is not None:
                        x, known = chunk.values(value)
                        _refuse_negative(x, known, value)
                        amounts = np.where(known, x, 0.0)
                    sets[key] = multiset(chunk, chunk.codes(other), width, amounts)
                out[s.output] = sets[key][SET_METRICS[s.operation]]
                continue
            value = s.inputs["value"]
            if value not in frames:
                frames[value] = Frames(chunk, *chunk.values(value))
            f = frames[value]
            if s.operation == "rolling_agg":
                out[s.output] = frame_value(f, str(s.params["agg"]), lo, hi, s.fill())
            else:
                mean, zero = f.mean(lo, hi), float(s.params.get("zero_division_value", 0.0))
                ok = (f.count(lo, hi) > 0) & (mean != 0) & f.known
                out[s.output] = np.where(ok, f.x / np.where(ok, mean, 1.0), zero)
        return out

    margin = max(s.window() for s in specs)
    return stream(df, [entity], margin, kernel, {s.output: _kind(s) for s in specs}, source=source)


def _events(tx: DataFrame, key: str, sender: str, receiver: str, out_value: str, in_value: str) -> DataFrame:
    """Two rows per transaction: of its sender (not ``_in``) and of its receiver."""
    side = lambda account, into, v: F.struct(F.col(account).alias("_account"), F.lit(into).alias("_in"), non_negative(F.col(v).cast("double"), v).alias("_v"))
    return tx.select(F.col(key).alias("_key"), "us", F.explode(F.array(side(sender, False, out_value), side(receiver, True, in_value))).alias("e")).select("_key", "us", "e.*")


def account_metrics(tx: DataFrame, key: str, inputs: tuple[str, str, str, str], wanted: set[tuple[str, str, int]]) -> DataFrame:
    """``_key`` and a column ``role|metric|width`` for each of ``wanted``: metrics of ``FLOW`` and ``PASS`` of the ``sender``'s or ``receiver``'s
    account. ``inputs``: sender, receiver, and the amounts that count as sent and received. One exchange on accounts, one back."""
    measures = sorted({(m, w) for _, m, w in wanted})
    names = {f"{m}|{w}": "double" for m, w in measures}

    def kernel(chunk: Chunk) -> dict[str, object]:
        into = chunk.table.column("_in").combine_chunks().to_numpy(zero_copy_only=False)
        x, known = chunk.values("_v")
        got, sent = Frames(chunk, x, known & into), Frames(chunk, x, known & ~into)
        hi, out = chunk.hi(), {}
        start = np.repeat(chunk.begins, chunk.ends - chunk.begins)
        last = np.maximum.accumulate(np.where(into, np.arange(chunk.n), -1))
        last = np.where(hi > start, last[np.maximum(hi - 1, 0)], -1)
        last = np.where(last >= start, last, -1)  # the latest inbound row before now, of equal times the last by key
        for m, w in measures:
            lo = chunk.lo(w)
            if m in FLOW:
                a = np.maximum(np.where(got.count(lo, hi) > 0, got.sum(lo, hi), 0.0), 0.0)
                b = np.maximum(np.where(sent.count(lo, hi) > 0, sent.sum(lo, hi), 0.0), 0.0)
                both = a + b
                out[f"{m}|{w}"] = {
                    "in_sum": a, "out_sum": b, "in_out_ratio": _ratio(a, b, b > 0), "sumdiff": a - b, "residual_abs": np.abs(a - b),
                    "relative_gap": (_ratio(np.abs(a - b), both, both > 0), ~(both > 0)),
                }[m]
                continue
            has = (last >= 0) & (last >= lo)
            if m == "recent_flag":
                out[f"{m}|{w}"] = has.astype(np.float64)
            elif m == "seconds_since_last_in":
                out[f"{m}|{w}"] = np.where(has, (chunk.us - chunk.us[last]) / 1e6, 0.0)
            elif m == "current_to_last_in_amount_ratio":
                out[f"{m}|{w}"] = _ratio(x, x[last], has & (x[last] > 0))
            else:
                seen = before(has & ~into)
                out[f"{m}|{w}"] = (seen[hi] - seen[lo]).astype(np.float64)
        return out

    # A sequence in the window needs an inbound row in its own window, so those look back twice.
    margin = max(w * (2 if m in PASS else 1) for m, w in measures)
    events = _events(tx, key, *inputs)
    seen = stream(events, ["_account"], margin, kernel, names, ties=("_key",))
    pick = lambda role, m, w: F.max(F.when(F.col("_in") == (role == "receiver"), F.col(f"`{m}|{w}`"))).alias(f"{role}|{m}|{w}")
    return seen.groupBy("_key").agg(*[pick(*x) for x in sorted(wanted)])


def pair_windows(df: DataFrame, sender: str, receiver: str, value: str, wanted: dict[str, tuple[str, int]], source: DataFrame) -> DataFrame:
    """``df`` with a column per name of ``wanted`` (metric of ``PAIR_METRICS``, width): the directed pair's and its reverse's history, from one
    stream over unordered pairs."""
    pair = lambda x: x.withColumns({"_lo": F.least(sender, receiver), "_hi": F.greatest(sender, receiver)})

    def kernel(chunk: Chunk) -> dict[str, np.ndarray]:
        up = chunk.table.column("_up").combine_chunks().to_numpy(zero_copy_only=False)
        loop = chunk.table.column("_loop").combine_chunks().to_numpy(zero_copy_only=False)
        x, known = chunk.values(value)
        _refuse_negative(x, known, value)
        one, two = Frames(chunk, x, known & up), Frames(chunk, x, known & (~up | loop))  # a self loop is its own reverse
        hi, out = chunk.hi(), {}
        done: dict[int, dict[str, np.ndarray]] = {}
        for name, (metric, width) in wanted.items():
            if width not in done:
                lo = chunk.lo(width)
                n = [f.count(lo, hi) for f in (one, two)]
                total = [np.where(f.count(lo, hi) > 0, f.sum(lo, hi), 0.0) for f in (one, two)]
                fn, rn = np.where(up, n[0], n[1]), np.where(up, n[1], n[0])
                fs, rs = np.where(up, total[0], total[1]), np.where(up, total[1], total[0])
                mean = _ratio(fs, fn, fn > 0)
                done[width] = {
                    "forward_tx_count": fn, "forward_amount_sum": fs, "forward_amount_mean": mean, "reverse_exists": rn > 0, "reverse_tx_count": rn, "reverse_amount_sum": rs,
                    "net_amount_sumdiff": fs - rs, "current_vs_forward_mean_ratio": _ratio(x, mean, mean > 0), "current_vs_forward_mean_ratio_hist_lt2_flag": fn < 2,
                    "bidirectional_amount_ratio": _ratio(fs, rs, rs > 0),
                }
            if metric in ("forward_amount_std", "forward_amount_max"):
                lo = chunk.lo(width)
                agg = metric.rpartition("_")[2]
                found = np.where(up, frame_value(one, agg, lo, hi, 0.0), frame_value(two, agg, lo, hi, 0.0))
            else:
                found = done[width][metric]
            out[name] = np.asarray(found, np.float64)
        return out

    rows = pair(df).withColumns({"_up": F.col(sender) <= F.col(receiver), "_loop": F.col(sender) == F.col(receiver)})
    margin = max(w for _, w in wanted.values())
    return stream(rows, ["_lo", "_hi"], margin, kernel, {n: "double" for n in wanted}, source=pair(source)).drop("_lo", "_hi", "_up", "_loop")


def pair_history(df: DataFrame, sender: str, receiver: str, wanted: dict[str, str]) -> DataFrame:
    """``df`` with a column per name of ``wanted`` (metric of ``PAIR_HISTORY``): all earlier rows of the directed pair."""
    h = history([sender, receiver])
    first, last = F.min("us").over(h), F.max("us").over(h)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    made = {"seconds_since_last_tx": zero((F.col("us") - last) / 1e6), "is_new_pair": last.isNull().cast("double"), "age_hours_since_first": zero((F.col("us") - first) / 3.6e9)}
    return df.select("*", *[made[m].alias(n) for n, m in wanted.items()])


def earlier_rows(df: DataFrame, keys: list[str], name: str, source: DataFrame) -> DataFrame:
    """``df`` with the number of earlier rows of the same ``keys``: counts per key and time, added up over ranges of both, so that a key with
    most of the rows is in many tasks."""
    names = [f"_e{i}" for i in range(len(keys))]
    counts = source.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("us").alias("_us")).agg(F.count("*").alias("_n"))
    run = totals_before(df.sparkSession, counts, [*names, "_us"], {"_before": F.col("_n")})
    starts = run.groupBy(*names).agg(F.min("_before").alias("_start")).withColumnsRenamed({n: f"{n}s" for n in names})
    placed = run.join(starts, [F.col(n).eqNullSafe(F.col(f"{n}s")) for n in names]).select(*names, "_us", (F.col("_before") - F.col("_start")).cast("double").alias(name))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return df.join(placed, [*same, F.col("us") == F.col("_us")]).drop(*names, "_us")
