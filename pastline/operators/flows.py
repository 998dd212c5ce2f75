"""Account, pair and counterparty history: every column sees strictly earlier rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastline.plans import relations
from pastline.plans.frames import history
from pastline.plans.ordered import quantiles
from pastline.specs import FeatureSpec


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _account(tx: DataFrame, wanted: list[tuple[str, str, int, str]], in_value: str = "amount") -> DataFrame:
    """``tx_id`` and a column per (role, metric, width, name)."""
    found = relations.account_metrics(tx, "tx_id", ("sender", "receiver", "amount", in_value), {w[:3] for w in wanted})
    return found.select(F.col("_key").alias("tx_id"), *[F.col(f"`{r}|{m}|{w}`").alias(n) for r, m, w, n in wanted])


def flow_balance(tx: DataFrame, width: int) -> DataFrame:
    """Inbound and outbound sums of the sender's and the receiver's account, and what follows from them. One shuffle on accounts, one back."""
    names = {"in_sum": "in", "out_sum": "out", "in_out_ratio": "in_out_ratio", "sumdiff": "sumdiff", "residual_abs": "residual_abs", "relative_gap": "relative_gap"}
    return _account(tx, [(r, m, width, f"{r}_{n}") for r in ("sender", "receiver") for m, n in names.items()])


def balanced_state(flows: DataFrame, tx: DataFrame, role: str = "sender") -> DataFrame:
    """1 where the relative gap is within the first quartile of the train rows that have history."""
    gap = F.col(f"{role}_relative_gap")
    joined = tx.select("tx_id", "split").join(flows, "tx_id")
    fit = quantiles(joined.where(F.col("split") == "train"), gap, [0.25]).select(F.col("q")[0].alias("q25"))
    return joined.join(F.broadcast(fit)).select("tx_id", F.coalesce((gap <= F.col("q25")).cast("int"), F.lit(0)).alias("balanced_state_flag"))  # one row


def pass_flow(tx: DataFrame, width: int) -> DataFrame:
    """Inbound-then-outbound sequences: outbound rows with an inbound one in their window, and how many of those the window holds."""
    whole = ("recent_flag", "sequence_count", "historical_sequence_count")
    found = _account(tx, [("receiver" if m.startswith("hist") else "sender", m, width, m) for m in relations.PASS])
    return found.select(*[F.col(c).cast("int" if c == "recent_flag" else "long").alias(c) if c in whole else F.col(c) for c in found.columns])


def account_flow_sums(tx: DataFrame, widths: dict[str, int], received: str = "amount") -> DataFrame:
    """Sums that the sender's and the receiver's account sent and received before, per width (``name: microseconds``). One shuffle on accounts
    and one back, however many widths."""
    return _account(tx, [(r, f"{way}_sum", width, f"accountstats__{r}__{way}__amount__sum__w{name}") for r in ("sender", "receiver") for way in ("out", "in") for name, width in widths.items()], received)


def entity_sums(tx: DataFrame, width: int) -> DataFrame:
    """The current sender's inbound and the current receiver's outbound sums: the other role's history."""
    f = flow_balance(tx, width)
    return f.select("tx_id", F.col("sender_in").alias("sender_in_sum"), F.col("receiver_out").alias("receiver_out_sum"))


def pair_window(tx: DataFrame, width: int) -> DataFrame:
    """History of (sender, receiver) and of its reverse, from one stream over the unordered pair."""
    names = {m: "hist_lt2_flag" if m.endswith("hist_lt2_flag") else "current_vs_forward_mean_ratio" if m == "current_vs_forward_mean_ratio" else m for m in relations.PAIR_METRICS if m != "reverse_amount_sum"}
    whole = {"forward_tx_count": "long", "reverse_tx_count": "long", "reverse_exists": "int", "hist_lt2_flag": "int"}
    found = relations.pair_windows(tx, "sender", "receiver", "amount", {n: (m, width) for m, n in names.items()}, tx)
    return found.select("tx_id", *[F.col(n).cast(whole.get(n, "double")).alias(n) for n in names.values()])


def pair_clip(pairs: DataFrame, tx: DataFrame, q: float = 0.999) -> DataFrame:
    """log1p of the ratio, clipped at the train quantile of rows with two or more forward payments; 0 with fewer."""
    j = tx.select("tx_id", "split").join(pairs, "tx_id")
    ratio, known = F.col("current_vs_forward_mean_ratio"), F.col("forward_tx_count") >= 2
    fit = quantiles(j.where((F.col("split") == "train") & known), ratio, [q]).select(F.col("q")[0].alias("cap"))
    return j.join(F.broadcast(fit)).select("tx_id", F.when(known, F.log1p(F.least(ratio, F.col("cap")))).otherwise(0.0).alias("ratio_log1p_clip_p999_hist2"))  # one row


def pair_history(tx: DataFrame) -> DataFrame:
    """All prior history of the directed pair, of the bank pair, and whether the row is a self loop."""
    h, b = history(["sender", "receiver"]), history(["sender_bank", "receiver_bank"])
    first, last = F.min("us").over(h), F.max("us").over(h)
    return tx.select(
        "tx_id", _zero((F.col("us") - last) / 1e6).alias("seconds_since_last_tx"), last.isNull().cast("int").alias("is_new_pair"), _zero((F.col("us") - first) / 3.6e9).alias("age_hours_since_first"),
        F.count(F.lit(1)).over(b).alias("bank_pair_count"), (F.col("sender") == F.col("receiver")).cast("int").alias("self_loop"),
    )


def counterparties(tx: DataFrame, width: int, entity: str = "receiver", other: str = "sender") -> DataFrame:
    """Distinct counterparties, their effective number and the share of the largest, over the entity's window. A negative amount is an error."""
    window = {"window": f"{width // 1_000_000}s"}
    at = {"entity": entity, "counterparty": other, "value": "amount"}
    specs = [FeatureSpec(f"rolling_counterparty_{m}", m, at, window) for m in ("nunique", "effective_n", "top1_share")]
    found = relations.entity_windows(tx, entity, specs, tx)
    return found.select("tx_id", F.col("nunique").cast("int").alias("nunique"), "effective_n", "top1_share")
