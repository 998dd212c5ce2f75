"""Generated feature sets: the declarations of the account-history stages."""

from __future__ import annotations

from pastline.specs import FeatureSpec

#: Windows, aggregates and the parts of column names are fixed values.
HISTORY_WINDOWS = ("1h", "6h", "1d", "3d", "7d")
HISTORY_AGGS = ("count", "sum", "mean", "std", "max")
RATIO_WINDOWS = ("1d", "3d", "7d")
STATS_WINDOWS = ("1d", "3d", "7d")
FLOW_WINDOWS = ("6h", "1d", "3d", "7d")
BANK_WINDOWS, STABLE_WINDOWS, SENDER_PASS_WINDOWS = ("1d", "3d", "7d"), ("1d", "3d", "7d"), ("1h", "6h", "1d")


def baseline(value: str = "amount", categories: tuple[str, ...] = ()) -> list[FeatureSpec]:
    """Current-row features: the amount, its log1p, hour, weekday and weekend, and a train-fitted code of each of ``categories`` (five of them make
    the ten columns of the baseline)."""
    parts = [FeatureSpec("datetime_part", f"base__{n}", {}, {"part": p}) for n, p in (("dayofweek", "dayofweek"), ("hour", "hour"), ("is_weekend", "is_weekend"))]
    codes = [FeatureSpec("category_code", f"base__{c}__code", {"value": c}) for c in categories]
    return [FeatureSpec("log1p", "base__amount_log1p", {"value": value}), FeatureSpec("current_value", "base__amount", {"value": value}), *codes, *parts]


def stage0(sender: str = "sender", receiver: str = "receiver", amount: str = "amount", received: str = "amount_received") -> list[FeatureSpec]:
    """62 columns of time history: rolling aggregates, recency, current against mean, cumulative counts."""
    sides = (("sender", "out", sender, amount), ("receiver", "in", receiver, received))
    out: list[FeatureSpec] = []
    for role, way, entity, value in sides:
        for w in HISTORY_WINDOWS:
            for a in HISTORY_AGGS:
                what = "tx_count__count" if a == "count" else f"amount__{a}"
                out.append(FeatureSpec("rolling_agg", f"timehist__{role}__{way}__{what}__w{w}", {"entity": entity, "value": value}, {"window": w, "agg": a}))
    for role, way, entity, _ in sides:
        out.append(FeatureSpec("recency_seconds_since_last", f"timehist__{role}__{way}__recency__seconds__whist", {"entity": entity}))
        out.append(FeatureSpec("is_first_by_entity", f"timehist__{role}__{way}__recency__is_first__whist", {"entity": entity}))
    for role, way, entity, value in sides:
        out += [FeatureSpec("cur_vs_mean_ratio", f"timehist__{role}__{way}__amount__cur_vs_mean_ratio__w{w}", {"entity": entity, "value": value}, {"window": w}) for w in RATIO_WINDOWS]
    out += [FeatureSpec("cumulative_count", f"timehist__{role}__all__tx_count__cum__whist", {"entity": entity}) for role, _, entity, _ in sides]
    return out


def stage1_stats(sender: str = "sender", receiver: str = "receiver", amount: str = "amount", received: str = "amount_received") -> list[FeatureSpec]:
    """Twelve means and deviations of both roles; the stage's sixteen flow sums are :func:`pastline.operators.flows.account_flow_sums`."""
    sides = (("sender", "out", sender, amount), ("receiver", "in", receiver, received))
    return [FeatureSpec("rolling_agg", f"accountstats__{role}__{way}__amount__{a}__w{w}", {"entity": entity, "value": value}, {"window": w, "agg": a}) for w in STATS_WINDOWS for a in ("mean", "std") for role, way, entity, value in sides]


def stage2(sender: str = "sender", receiver: str = "receiver", amount: str = "amount", received: str = "amount_received", sender_bank: str = "sender_bank", receiver_bank: str = "receiver_bank") -> list[FeatureSpec]:
    """46 columns of counterparties: how many, their effective number, transactions, the largest one's share, and banks."""
    sides = (("fanin", "receiver", "in", receiver, sender, received), ("fanout", "sender", "out", sender, receiver, amount))
    out: list[FeatureSpec] = []
    for family, role, way, entity, other, value in sides:
        at = {"entity": entity, "counterparty": other}
        for w in HISTORY_WINDOWS:
            out.append(FeatureSpec("rolling_counterparty_nunique", f"{family}__{role}__{way}__counterparty__nunique__w{w}", at, {"window": w}))
            out.append(FeatureSpec("rolling_agg", f"{family}__{role}__{way}__tx_count__degree__w{w}", {"entity": entity, "value": value}, {"window": w, "agg": "count"}))
            out.append(FeatureSpec("rolling_counterparty_effective_n", f"{family}__{role}__{way}__counterparty_amount__effective_n__w{w}", {**at, "value": value}, {"window": w}))
    for w in HISTORY_WINDOWS:
        out += [FeatureSpec("rolling_counterparty_top1_share", f"{family}__{role}__{way}__counterparty_amount__top1_share__w{w}", {"entity": entity, "counterparty": other, "value": value}, {"window": w}) for family, role, way, entity, other, value in sides]
    for w in BANK_WINDOWS:
        out.append(FeatureSpec("rolling_counterparty_nunique", f"bankfan__sender__out__to_bank__nunique__w{w}", {"entity": sender, "counterparty": receiver_bank}, {"window": w}))
        out.append(FeatureSpec("rolling_counterparty_nunique", f"bankfan__receiver__in__from_bank__nunique__w{w}", {"entity": receiver, "counterparty": sender_bank}, {"window": w}))
    return out


def stage3(sender: str = "sender", receiver: str = "receiver", amount: str = "amount", sender_bank: str = "sender_bank", receiver_bank: str = "receiver_bank") -> list[FeatureSpec]:
    """45 columns of the directed pair, its reverse, and the bank pair; one of them is fitted on the train split."""
    ends, pair = {"sender": sender, "receiver": receiver}, {"sender": sender, "receiver": receiver, "value": amount}
    name = "pair__sender_receiver__{}"
    made = lambda part, metric, w: FeatureSpec("pair_window", name.format(f"{part}__w{w}"), pair, {"window": w, "metric": metric})
    out = [made(part, metric, w) for w in HISTORY_WINDOWS for part, metric in (("forward__tx_count__count", "forward_tx_count"), ("forward__amount__sum", "forward_amount_sum"))]
    out += [made(f"forward__amount__{a}", f"forward_amount_{a}", w) for w in STABLE_WINDOWS for a in ("mean", "std", "max")]
    ratio = "forward__amount__cur_vs_mean_ratio"
    parts = (
        ("reverse__exists", "reverse_exists"), ("reverse__tx_count__count", "reverse_tx_count"), ("net__amount__sumdiff", "net_amount_sumdiff"), (ratio, "current_vs_forward_mean_ratio"),
        (f"{ratio}__log1p_clip_p999_hist2", "current_vs_forward_mean_ratio_log1p_clip_p999_hist2"), (f"{ratio}__hist_lt2_flag", "current_vs_forward_mean_ratio_hist_lt2_flag"),
        ("bidirectional__amount_ratio", "bidirectional_amount_ratio"),
    )
    out += [made(part, metric, w) for w in STABLE_WINDOWS for part, metric in parts]
    past = lambda m: FeatureSpec("pair_history", name.format(f"forward__{m}"), ends, {"metric": m})
    loop = FeatureSpec("current_self_loop", name.format("current__is_self_loop"), ends)
    banks = FeatureSpec("bank_pair_history", "pairhist__bank_pair__all__tx_count__cum__whist", {"sender_bank": sender_bank, "receiver_bank": receiver_bank})
    return [*out, past("seconds_since_last_tx"), past("is_new_pair"), loop, past("age_hours_since_first"), banks]


def stage4(sender: str = "sender", receiver: str = "receiver", amount: str = "amount") -> list[FeatureSpec]:
    """48 columns of accounts' flows: balances of what came in and went out, and inbound-then-outbound sequences."""
    ends = {"sender": sender, "receiver": receiver, "value": amount}
    balance = ("in_out_ratio", "sumdiff", "residual_abs", "balanced_state_flag")
    out = [FeatureSpec("flowbalance_window", f"flowbalance__{r}__net__amount__{m}__w{w}", ends, {"window": w, "metric": m, "role": r}) for r in ("sender", "receiver") for w in FLOW_WINDOWS for m in balance]
    passes = ("seconds_since_last_in", "current_to_last_in_amount_ratio", "recent_flag", "sequence_count")
    out += [FeatureSpec("passflow_window", f"passflow__sender__in_then_out__{m}__w{w}", ends, {"window": w, "metric": m, "role": "sender"}) for w in SENDER_PASS_WINDOWS for m in passes]
    out += [FeatureSpec("passflow_window", f"passflow__receiver__in_then_out__historical_sequence_count__w{w}", ends, {"window": w, "metric": "historical_sequence_count", "role": "receiver"}) for w in FLOW_WINDOWS]
    return out
