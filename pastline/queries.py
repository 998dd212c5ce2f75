"""One query per operator on the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.functions.scalars import date_of, hour_of
from pastline.operators import association, fitted, flows, graph, split, stats
from pastline.plans.compiler import build_features
from pastline.sources import tables
from pastline.specs import FeatureSpec, parse_window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
H, D = 3_600_000_000, 86_400_000_000

#: Events as transactions, and the chronological split on them.
EV = """ev AS (SELECT event_id AS tx_id, user_id AS sender, (event_id * 31 + 7) % 97 AS receiver, epoch_us(date_trunc('hour', ts)) AS us, value AS amount,
  event_type AS fmt, (event_type = 'error')::INT AS label, user_id % 25 AS sender_bank, ((event_id * 31 + 7) % 97) % 25 AS receiver_bank FROM events)"""
SP = EV + """, o AS (SELECT us, row_number() OVER (ORDER BY us, tx_id) AS rn, count(*) OVER () AS n FROM ev),
bd AS (SELECT max(us) FILTER (rn = floor(n * 0.6)) AS b1, max(us) FILTER (rn = floor(n * 0.8)) AS b2 FROM o),
t AS (SELECT ev.*, CASE WHEN us <= b1 THEN 'train' WHEN us <= b2 THEN 'val' ELSE 'test' END AS split FROM ev, bd)"""
#: A feature table for the statistics: amount, hour and a rolling count, with split and label.
FT = SP + f""", f AS (SELECT tx_id, split, label, fmt, amount, hour(make_timestamp(us))::DOUBLE AS hour,
  (count(*) OVER (PARTITION BY sender ORDER BY us RANGE BETWEEN {D} PRECEDING AND 1 PRECEDING))::DOUBLE AS n_1d, round(amount / 10)::DOUBLE AS coarse FROM t)"""
#: The same with columns that have nulls, NaN, infinities and ties: ``dirty``, one of four values (``few``), one value (``same``), and ``kind`` with nulls.
DT = FT + """, d AS (SELECT f.*, CASE tx_id % 23 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN '-inf'::DOUBLE ELSE coarse END AS dirty,
  CASE WHEN tx_id % 11 = 0 THEN NULL ELSE (1 + tx_id % 4)::DOUBLE END AS few, 3.0::DOUBLE AS same, CASE WHEN tx_id % 13 > 0 THEN fmt END AS kind FROM f)"""
#: Scores between 0 and 1 with many ties.
SC = EV + ", s AS (SELECT tx_id, label, ((tx_id * 7919 + label * 211) % 1000) / 1000.0::DOUBLE AS score FROM ev)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _events(spark, sf_dir):
    return tables.tx_events(spark, sf_dir)


def _split(spark, sf_dir):
    return split.chronological(_events(spark, sf_dir))


def _features(spark, sf_dir):
    tx = _split(spark, sf_dir).withColumn("hour", hour_of(F.col("us")).cast("double"))
    n = FeatureSpec("rolling_agg", "n_1d", {"entity": "sender", "value": "amount"}, {"window": "1d", "agg": "count"})
    return build_features(tx, [n], ("tx_id", "split", "label", "fmt", "amount", "hour")).withColumn("coarse", F.round(F.col("amount") / 10).cast("double"))


def _dirty(spark, sf_dir):
    k, f = F.col("tx_id") % 23, _features(spark, sf_dir)
    dirty = F.when(k == 0, None).when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, -float("inf")).otherwise(F.col("coarse"))
    few = F.when(F.col("tx_id") % 11 > 0, (1 + F.col("tx_id") % 4).cast("double"))
    return f.withColumns({"dirty": dirty, "few": few, "same": F.lit(3.0), "kind": F.when(F.col("tx_id") % 13 > 0, F.col("fmt"))})


def _scores(spark, sf_dir):
    return _events(spark, sf_dir).select("tx_id", "label", (((F.col("tx_id") * 7919 + F.col("label") * 211) % 1000) / 1000.0).alias("score"))


def rounded(df: DataFrame, digits: int = 6, apart: float = 0.0) -> DataFrame:
    """``apart`` keeps ratios of amounts that end in a 5 behind the last digit from falling either way by the last bit; the SQL adds it too."""
    return df.select(*[F.round(F.col(c) + apart if apart else c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


APART = 1e-9


def _w(width: int, keys: str = "sender") -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY us RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)"


def _h(keys: str) -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


_AGG = {"sum": "sum", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "count": "count"}


@query(f"WITH {EV} SELECT tx_id, us, " + ", ".join(f"round(coalesce({fn}(amount) {_w(parse_window(w))}, 0)::DOUBLE, 6) AS amount_{a}_{w}" for w in ("1h", "1d", "7d") for a, fn in _AGG.items()) + " FROM ev")
def rolling_agg(spark, sf_dir):
    specs = [FeatureSpec("rolling_agg", f"amount_{a}_{w}", {"entity": "sender", "value": "amount"}, {"window": w, "agg": a}) for w in ("1h", "1d", "7d") for a in _AGG]
    return rounded(build_features(_events(spark, sf_dir), specs))


@query(f"""WITH {EV} SELECT tx_id, us, round(coalesce((us - max(us) {_h("sender")}) / 1e6, -1)::DOUBLE, 6) AS recency, (count(*) {_h("sender")} = 0)::INT AS is_first,
  (count(*) {_h("sender")})::INT AS n_before, round(coalesce(amount / nullif(avg(amount) {_w(3 * D)}, 0), 0)::DOUBLE, 6) AS vs_mean_3d,
  (count(*) {_h("receiver")})::INT AS n_before_in FROM ev""")
def history_features(spark, sf_dir):
    s, v = {"entity": "sender"}, {"entity": "sender", "value": "amount"}
    specs = [
        FeatureSpec("recency_seconds_since_last", "recency", s), FeatureSpec("is_first_by_entity", "is_first", s), FeatureSpec("cumulative_count", "n_before", s),
        FeatureSpec("cur_vs_mean_ratio", "vs_mean_3d", v, {"window": "3d"}), FeatureSpec("cumulative_count", "n_before_in", {"entity": "receiver"}),
    ]
    return rounded(build_features(_events(spark, sf_dir), specs))


@query(f"""WITH {EV} SELECT tx_id, us, (count(DISTINCT receiver) {_w(3 * D)})::INT AS fan_out_3d, (count(DISTINCT sender) {_w(3 * D, "receiver")})::INT AS fan_in_3d FROM ev""")
def fan_in_out(spark, sf_dir):
    specs = [FeatureSpec("fan_out", "fan_out_3d", {"entity": "sender", "counterparty": "receiver"}, {"window": "3d"}), FeatureSpec("fan_in", "fan_in_3d", {"entity": "receiver", "counterparty": "sender"}, {"window": "3d"})]
    return build_features(_events(spark, sf_dir), specs)


@query(f"""WITH {EV} SELECT tx_id, us, round(ln(1 + amount), 6) AS amount_log1p, round(amount::DOUBLE, 6) AS amount_now, hour(make_timestamp(us))::INT AS hour, (isodow(make_timestamp(us)) - 1)::INT AS dow,
  (isodow(make_timestamp(us)) >= 6)::INT AS weekend, day(make_timestamp(us))::INT AS day, month(make_timestamp(us))::INT AS month, (sender = receiver)::INT AS self_loop FROM ev""")
def current_row(spark, sf_dir):
    parts = [FeatureSpec("datetime_part", n, {}, {"part": p}) for n, p in (("hour", "hour"), ("dow", "dayofweek"), ("weekend", "is_weekend"), ("day", "day"), ("month", "month"))]
    specs = [FeatureSpec("log1p", "amount_log1p", {"value": "amount"}), FeatureSpec("current_value", "amount_now", {"value": "amount"}), *parts, FeatureSpec("current_self_loop", "self_loop", {"sender": "sender", "receiver": "receiver"})]
    return rounded(build_features(_events(spark, sf_dir), specs))


@query(f"WITH {EV} SELECT tx_id, CASE WHEN amount > 0 THEN round(ln(1 + amount), 6) ELSE 0 END AS amount_log1p, isodow(make_timestamp(us))::INT AS weekday, (isodow(make_timestamp(us)) >= 5)::INT AS weekend FROM ev")
def edge_features(spark, sf_dir):
    """The graph's own rules: ISO weekdays from 1, and a weekend that begins on Friday."""
    day = F.weekday(date_of(F.col("us"))) + 1
    return rounded(_events(spark, sf_dir).select("tx_id", F.when(F.col("amount") > 0, F.log1p("amount")).otherwise(0.0).alias("amount_log1p"), day.alias("weekday"), (day >= 5).cast("int").alias("weekend")))


_ACC = EV + f""", e AS (SELECT tx_id, us, sender AS a, 'out' AS side, amount AS v FROM ev UNION ALL SELECT tx_id, us, receiver, 'in', amount FROM ev),
g AS (SELECT tx_id, side, greatest(coalesce(sum(v) FILTER (side = 'in') {_w(D, "a")}, 0), 0) AS i, greatest(coalesce(sum(v) FILTER (side = 'out') {_w(D, "a")}, 0), 0) AS o FROM e),
k AS (SELECT s.tx_id, s.i AS si, s.o AS so, r.i AS ri, r.o AS ro FROM g s JOIN g r ON s.tx_id = r.tx_id AND s.side = 'out' AND r.side = 'in')"""


def _role(r: str, i: str, o: str) -> str:
    return f"""round(CASE WHEN {o} > 0 THEN {i} / {o} ELSE 0 END, 4) AS {r}_in_out_ratio, round({i} - {o}, 4) AS {r}_sumdiff, round(abs({i} - {o}), 4) AS {r}_residual_abs, round(abs({i} - {o}) / nullif({i} + {o}, 0), 4) AS {r}_relative_gap"""


@query(f"WITH {_ACC} SELECT tx_id, round(si, 4) AS sender_in, round(so, 4) AS sender_out, round(ri, 4) AS receiver_in, round(ro, 4) AS receiver_out, {_role('sender', 'si', 'so')}, {_role('receiver', 'ri', 'ro')} FROM k")
def flow_balance(spark, sf_dir):
    return rounded(flows.flow_balance(_events(spark, sf_dir), D), 4)


@query(f"WITH {_ACC} SELECT tx_id, round(si, 4) AS sender_in_sum, round(ro, 4) AS receiver_out_sum FROM k")
def rolling_entity_agg(spark, sf_dir):
    return rounded(flows.entity_sums(_events(spark, sf_dir), D), 4)


@query(f"WITH {SP}, {_ACC[len(EV) + 2 :]}, r AS (SELECT k.tx_id, split, abs(si - so) / nullif(si + so, 0) AS gap FROM k JOIN t USING (tx_id)), q AS (SELECT quantile_cont(gap, 0.25) AS q25 FROM r WHERE split = 'train') SELECT tx_id, coalesce((gap <= q25)::INT, 0) AS balanced_state_flag FROM r, q")
def balanced_state(spark, sf_dir):
    tx = _split(spark, sf_dir)
    return flows.balanced_state(flows.flow_balance(tx, D), tx)


@query(f"""WITH {EV}, e AS (SELECT tx_id, us, sender AS a, 'out' AS side, amount AS v FROM ev UNION ALL SELECT tx_id, us, receiver, 'in', amount FROM ev),
l AS (SELECT *, max(CASE WHEN side = 'in' THEN us END) {_w(3 * D, "a")} AS lu FROM e),
m AS (SELECT l.*, (SELECT max_by(x.v, x.tx_id) FROM e x WHERE x.a = l.a AND x.side = 'in' AND x.us = l.lu) AS lv, (side = 'out' AND lu IS NOT NULL)::INT AS seq FROM l),
n AS (SELECT *, coalesce(sum(seq) {_w(3 * D, "a")}, 0)::BIGINT AS c FROM m)
SELECT tx_id, coalesce(max((us - lu) / 1e6) FILTER (side = 'out'), 0)::DOUBLE AS seconds_since_last_in, max((lu IS NOT NULL)::INT) FILTER (side = 'out') AS recent_flag,
  round(coalesce(max(v / nullif(lv, 0)) FILTER (side = 'out' AND lv > 0), 0), 6) AS current_to_last_in_amount_ratio, max(c) FILTER (side = 'out') AS sequence_count, max(c) FILTER (side = 'in') AS historical_sequence_count FROM n GROUP BY tx_id""")
def pass_flow(spark, sf_dir):
    return rounded(flows.pass_flow(_events(spark, sf_dir), 3 * D))


_PAIR = f"""p AS (SELECT tx_id, amount, count(*) {_w(7 * D, "sender, receiver")} AS n, coalesce(sum(amount) {_w(7 * D, "sender, receiver")}, 0) AS s, stddev_samp(amount) {_w(7 * D, "sender, receiver")} AS sd, max(amount) {_w(7 * D, "sender, receiver")} AS mx, us, sender, receiver FROM ev),
q AS (SELECT p.*, (SELECT count(*) FROM ev r WHERE r.sender = p.receiver AND r.receiver = p.sender AND r.us >= p.us - {7 * D} AND r.us < p.us) AS rn, (SELECT coalesce(sum(amount), 0) FROM ev r WHERE r.sender = p.receiver AND r.receiver = p.sender AND r.us >= p.us - {7 * D} AND r.us < p.us) AS rs FROM p)"""


@query(f"""WITH {EV}, {_PAIR} SELECT tx_id, n AS forward_tx_count, round(s, 4) AS forward_amount_sum, round(coalesce(s / nullif(n, 0), 0), 4) AS forward_amount_mean, round(coalesce(sd, 0), 4) AS forward_amount_std, round(coalesce(mx, 0), 4) AS forward_amount_max,
  (rn > 0)::INT AS reverse_exists, rn AS reverse_tx_count, round(s - rs, 4) AS net_amount_sumdiff, round(CASE WHEN s / nullif(n, 0) > 0 THEN amount / (s / n) ELSE 0 END, 4) AS current_vs_forward_mean_ratio, (n < 2)::INT AS hist_lt2_flag,
  round(CASE WHEN rs > 0 THEN s / rs ELSE 0 END, 4) AS bidirectional_amount_ratio FROM q""")
def pair_window(spark, sf_dir):
    return rounded(flows.pair_window(_events(spark, sf_dir), 7 * D), 4)


@query(f"WITH {SP}, {_PAIR}, z AS (SELECT tx_id, split, n, CASE WHEN s / nullif(n, 0) > 0 THEN amount / (s / n) ELSE 0 END AS ratio FROM p JOIN t USING (tx_id)), c AS (SELECT quantile_cont(ratio, 0.999) AS cap FROM z WHERE split = 'train' AND n >= 2) SELECT tx_id, round(CASE WHEN n >= 2 THEN ln(1 + least(ratio, cap)) ELSE 0 END, 6) AS ratio_log1p_clip_p999_hist2 FROM z, c".replace("amount, count", "ev.amount AS amount, count").replace("FROM p JOIN t USING (tx_id)", "FROM p JOIN (SELECT tx_id, split FROM t) USING (tx_id)"))
def pair_clip(spark, sf_dir):
    tx = _split(spark, sf_dir)
    return rounded(flows.pair_clip(flows.pair_window(tx, 7 * D), tx))


@query(f"""WITH {EV} SELECT tx_id, round(coalesce((us - max(us) {_h("sender, receiver")}) / 1e6, 0)::DOUBLE, 6) AS seconds_since_last_tx, (count(*) {_h("sender, receiver")} = 0)::INT AS is_new_pair,
  round(coalesce((us - min(us) {_h("sender, receiver")}) / 3.6e9, 0)::DOUBLE, 6) AS age_hours_since_first, count(*) {_h("sender_bank, receiver_bank")} AS bank_pair_count, (sender = receiver)::INT AS self_loop FROM ev""")
def pair_history(spark, sf_dir):
    return rounded(flows.pair_history(_events(spark, sf_dir)))


@query(f"""WITH {EV}, j AS (SELECT a.tx_id, b.sender AS k, sum(b.amount) AS v FROM ev a JOIN ev b ON a.receiver = b.receiver AND b.us < a.us AND b.us >= a.us - {D} GROUP BY 1, 2),
g AS (SELECT tx_id, count(*) AS n, sum(v) AS s, sum(v * v) AS q, max(v) AS m FROM j GROUP BY 1)
SELECT ev.tx_id, coalesce(n, 0)::INT AS nunique, round(CASE WHEN s > 0 THEN s * s / q ELSE 0 END + {APART}, 6) AS effective_n, round(CASE WHEN s > 0 THEN least(greatest(m / s, 0), 1) ELSE 0 END + {APART}, 6) AS top1_share FROM ev LEFT JOIN g USING (tx_id)""")
def counterparties(spark, sf_dir):
    return rounded(flows.counterparties(_events(spark, sf_dir), D), apart=APART)


@query("""WITH tx AS (SELECT l_orderkey, l_linenumber, l_partkey, o_custkey AS sender, l_suppkey AS receiver, epoch_us(l_shipdate) AS us, l_extendedprice AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, receiver, us, round(coalesce(sum(amount) OVER w, 0), 2) AS amount_sum_90d, (count(*) OVER w)::BIGINT AS n_90d FROM tx
WINDOW w AS (PARTITION BY sender ORDER BY us RANGE BETWEEN 7776000000000 PRECEDING AND 1 PRECEDING)""")
def rolling_lines(spark, sf_dir):
    tx = tables.tx_lines(spark, sf_dir)
    role = {"entity": "sender", "value": "amount"}
    specs = [FeatureSpec("rolling_agg", "amount_sum_90d", role, {"window": "90d", "agg": "sum"}), FeatureSpec("rolling_agg", "n_90d", role, {"window": "90d", "agg": "count"})]
    out = build_features(tx, specs, ("l_orderkey", "l_linenumber", "l_partkey", "receiver", "us"))
    return out.withColumn("amount_sum_90d", F.round("amount_sum_90d", 2)).withColumn("n_90d", F.col("n_90d").cast("long"))


@query(f"WITH {SP} SELECT tx_id, us, split FROM t")
def chronological_split(spark, sf_dir):
    return _split(spark, sf_dir).select("tx_id", "us", "split")


@query(f"WITH {SP} SELECT tx_id, split FROM (SELECT tx_id, split, row_number() OVER (PARTITION BY split ORDER BY tx_id) AS r FROM t) WHERE r <= 100")
def split_sample(spark, sf_dir):
    return tables.split_sample(_split(spark, sf_dir), 300).select("tx_id", "split")


@query(f"""WITH {SP}, x AS (SELECT tx_id, split, sender::VARCHAR || '>' || receiver::VARCHAR AS c FROM t), v AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS code FROM (SELECT DISTINCT c FROM x WHERE split = 'train')), n AS (SELECT count(*) AS n FROM v)
SELECT tx_id, coalesce(code, -1)::INT AS c_code, coalesce(code, n.n)::INT AS c_node, coalesce(v.c, '__UNKNOWN__') AS c_native FROM x LEFT JOIN v USING (c), n""")
def category_codes(spark, sf_dir):
    return fitted.encode(_unseen(spark, sf_dir), "c").select("tx_id", "c_code", "c_node", "c_native")


def _unseen(spark, sf_dir):
    """Pairs of accounts: later splits have many that train has not."""
    return _split(spark, sf_dir).select("tx_id", "split", F.concat(F.col("sender").cast("string"), F.lit(">"), F.col("receiver").cast("string")).alias("c"))


@query(f"""WITH {SP}, x AS (SELECT tx_id, split, sender::VARCHAR || '>' || receiver::VARCHAR AS c FROM t), u AS (SELECT split, c, count(*) AS n FROM x WHERE c NOT IN (SELECT c FROM x WHERE split = 'train') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY c) AS r FROM u) SELECT split, sum(n)::BIGINT AS unknown_count, count(*) AS unknown_unique, string_agg(c, ';' ORDER BY c) FILTER (r <= 5) AS examples FROM r GROUP BY split""")
def unknown_summary(spark, sf_dir):
    return fitted.unknown_summary(_unseen(spark, sf_dir), "c")


@query(f"WITH {FT}, c AS (SELECT quantile_cont(amount, 0.9999) AS cap, avg(amount) AS m, stddev_samp(amount) AS s FROM f WHERE split = 'train') SELECT tx_id, round(ln(1 + amount), 6) AS amount__log1p, round(least(amount, cap), 6) AS amount__clip_train, (amount > cap)::INT AS amount__clipped, round((amount - m) / s, 6) AS amount_z FROM f, c")
def ratio_transforms(spark, sf_dir):
    f = _features(spark, sf_dir)
    return rounded(fitted.z_norm(fitted.ratio_transforms(f, "amount"), "amount").select("tx_id", "amount__log1p", "amount__clip_train", "amount__clipped", "amount_z"))


@query(f"WITH {EV} SELECT tx_id, coalesce((us - max(us) {_h('sender')}) / 1e6, 0)::DOUBLE AS recency FROM ev")
def recency_sentinel(spark, sf_dir):
    r = build_features(_events(spark, sf_dir), [FeatureSpec("recency_seconds_since_last", "recency", {"entity": "sender"})])
    return r.select("tx_id", fitted.sentinel_to_zero(F.col("recency")).alias("recency"))


@query(f"WITH {SP} SELECT split, count(*) AS n, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (label = 1) AS positives, round(avg(label), 6) AS positive_rate FROM t GROUP BY split")
def split_summary(spark, sf_dir):
    return rounded(stats.split_summary(_split(spark, sf_dir)))


@query(f"WITH {SP} SELECT split, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives, round(avg(label), 6) AS positive_rate FROM t GROUP BY split")
def label_pivot(spark, sf_dir):
    return rounded(stats.label_pivot(_split(spark, sf_dir)))


@query(f"WITH {SP} SELECT split, us // {D} * {D} AS bin_us, count(*) AS n, sum(label)::BIGINT AS positives FROM t GROUP BY 1, 2")
def time_bins(spark, sf_dir):
    return stats.time_bins(_split(spark, sf_dir))


_COLS = ["amount", "hour", "n_1d"]
_MESS = [*_COLS, "dirty", "few", "same"]
_LONG = FT + ", l AS (" + " UNION ALL ".join(f"SELECT tx_id, split, label, '{c}' AS feature, {c} AS value FROM f" for c in _COLS) + ")"
#: Long form of the dirty columns: NaN is missing; ``fin`` is the value if it is finite, ``v0`` 0 where it isn't.
_DLONG = DT + ", l AS (SELECT *, CASE WHEN isfinite(value) THEN value END AS fin, CASE WHEN isfinite(value) THEN value ELSE 0 END AS v0 FROM (SELECT tx_id, split, label, grp, feature, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM (" + " UNION ALL ".join(
    f"SELECT tx_id, split, label, CASE WHEN (tx_id * 7919 + label * 211) % 1000 >= 500 THEN CASE WHEN label = 1 THEN 'TP' ELSE 'FP' END WHEN label = 1 THEN 'FN' ELSE 'TN' END AS grp, '{c}' AS feature, {c} AS value FROM d" for c in _MESS
) + ")))"


@query(f"""WITH {_DLONG} SELECT feature, count(*) AS n, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (isinf(value)) AS infinite, count(*) FILTER (value = 0) AS zero, count(DISTINCT value) AS n_unique, (count(DISTINCT value) <= 1)::INT AS near_zero_variance,
  round(min(fin), 6) AS low, round(quantile_cont(fin, 0.25), 6) AS p25, round(quantile_cont(fin, 0.5), 6) AS median, round(avg(fin), 6) AS mean, round(quantile_cont(fin, 0.75), 6) AS p75, round(max(fin), 6) AS high FROM l GROUP BY feature""")
def feature_profile(spark, sf_dir):
    return rounded(stats.profile(_dirty(spark, sf_dir), _MESS))


@query(f"""WITH {_DLONG}, p AS (SELECT *, 'all' AS part FROM l UNION ALL SELECT *, 'split ' || split FROM l UNION ALL SELECT *, 'label ' || label FROM l)
SELECT feature, part, count(*) AS n, round(sum(fin), 3) AS total, round(sum(fin * fin), 1) AS squares, count(*) FILTER (fin = 0) AS zero, count(*) FILTER (fin <> 0) AS nonzero, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (isinf(value)) AS infinite FROM p GROUP BY 1, 2""")
def partial_sums(spark, sf_dir):
    m = stats.moments(_dirty(spark, sf_dir), _MESS)
    return m.withColumn("total", F.round("total", 3)).withColumn("squares", F.round("squares", 1))


_SL = "(sign({0}) * ln(1 + abs({0})))"


@query(f"""WITH {_DLONG}, m AS (SELECT feature, {", ".join(f"avg(v0) FILTER (split = '{s}') AS {s}, avg((v0 <> 0)::INT) FILTER (split = '{s}') AS nz_{s}" for s in ("train", "val", "test"))} FROM l GROUP BY feature)
SELECT feature, round(train, 6) AS mean_train, round(val, 6) AS mean_val, round(test, 6) AS mean_test, round(val / nullif(train, 0), 6) AS val_ratio, round(test / nullif(train, 0), 6) AS test_ratio,
  round(greatest(abs({_SL.format("val")} - {_SL.format("train")}), abs({_SL.format("test")} - {_SL.format("train")})), 6) AS log_gap, round(greatest(nz_val, nz_train, nz_test) - least(nz_val, nz_train, nz_test), 6) AS nonzero_gap FROM m""")
def split_drift(spark, sf_dir):
    return rounded(stats.drift(_dirty(spark, sf_dir), _MESS))


@query(f"""WITH {_DLONG}, m AS (SELECT feature, {", ".join(f"avg(v0) FILTER (label = {k}) AS m{k}, var_pop(v0) FILTER (label = {k}) AS v{k}, avg((v0 <> 0)::INT) FILTER (label = {k}) AS z{k}" for k in (0, 1))} FROM l GROUP BY feature)
SELECT feature, round(m0, 6) AS mean0, round(m1, 6) AS mean1, round((m1 - m0) / nullif(sqrt((v0 + v1) / 2), 0), 6) + 0.0::DOUBLE AS smd, round(z1 - z0, 6) + 0.0::DOUBLE AS nonzero_diff FROM m""")
def label_separation(spark, sf_dir):
    return rounded(stats.label_separation(_dirty(spark, sf_dir), _MESS)).withColumns({c: F.col(c) + 0.0 for c in ("smd", "nonzero_diff")})


_PAIRED = [(a, b) for i, a in enumerate(_MESS) for b in _MESS[i + 1 :]]
_ZERO = "CASE WHEN isfinite({0}) THEN {0} ELSE 0 END"


def _corr_sql(clean, empty: str) -> str:
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, {clean(a, b)} AS r FROM d" for a, b in _PAIRED]
    return f"WITH {DT} SELECT a, b, round({empty}, 6) + 0.0::DOUBLE AS r FROM (" + " UNION ALL ".join(parts) + ")"


@query(_corr_sql(lambda a, b: f"CASE WHEN var_pop({_ZERO.format(a)}) > 0 AND var_pop({_ZERO.format(b)}) > 0 THEN corr({_ZERO.format(a)}, {_ZERO.format(b)}) END", "coalesce(r, 0)"))
def correlation_matrix(spark, sf_dir):
    """All pairs from one scan; what isn't finite is 0, a column of one value correlates with nothing."""
    return rounded(stats.correlations(_dirty(spark, sf_dir), _MESS)).withColumn("r", F.col("r") + 0.0)


def _pairwise(a: str, b: str) -> str:
    both = f"NOT coalesce(isnan({a}), true) AND NOT coalesce(isnan({b}), true)"
    x, y = (_ZERO.format(c) for c in (a, b))
    return f"CASE WHEN count(*) FILTER ({both} AND (isinf({a}) OR isinf({b}))) = 0 AND var_pop({x}) FILTER ({both}) > 0 AND var_pop({y}) FILTER ({both}) > 0 THEN corr({x}, {y}) FILTER ({both}) END"


@query(_corr_sql(_pairwise, "r"))
def pearson_pairs(spark, sf_dir):
    """Over the rows that have both values; a pair with an infinity has none."""
    return rounded(association.pearson(_dirty(spark, sf_dir), _MESS)).withColumn("r", F.col("r") + 0.0)


_CRAMER = "SELECT round(sqrt(least(greatest((sum(o * o / (ra * cb)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1), 0), 1)), 6) AS cramers_v FROM c JOIN r USING (a) JOIN k USING (b)"


@query(f"""WITH {DT}, c AS (SELECT kind AS a, hour AS b, count(*) AS o FROM d WHERE kind IS NOT NULL AND hour IS NOT NULL GROUP BY 1, 2), r AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY 1) {_CRAMER}""")
def cramers_v(spark, sf_dir):
    return rounded(stats.cramers_v(_dirty(spark, sf_dir), "kind", "hour"))


def _eta(category: str, value: str) -> str:
    rows = f"(SELECT {category} AS k, {value} AS v FROM d WHERE {category} IS NOT NULL AND NOT coalesce(isnan({value}), true))"
    return f"(SELECT round(sqrt(sum(n * (m - mu) * (m - mu)) / max(sst)), 6) FROM (SELECT k, count(*) AS n, avg(v) AS m FROM {rows} GROUP BY k), (SELECT avg(v) AS mu, var_pop(v) * count(*) AS sst FROM {rows}))"


@query(f"WITH {DT} SELECT {_eta('kind', 'few')} AS eta")
def correlation_ratio(spark, sf_dir):
    return rounded(stats.correlation_ratio(_dirty(spark, sf_dir), "kind", "few"))


def _woe_sql(final: str) -> str:
    """As many bins as different finite values, ten at most."""
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont(fin, {[k / q for k in range(q + 1)]}))) AS e{q}" for q in range(2, 11))
    pick = "CASE least(u, 10) " + " ".join(f"WHEN {q} THEN e{q}" for q in range(2, 11)) + " END"
    return f"""WITH {_DLONG}, e AS (SELECT feature, count(DISTINCT fin) AS u, {edges} FROM l GROUP BY feature), i0 AS (SELECT feature, {pick} AS e FROM e), i AS (SELECT feature, e[2:-2] AS e FROM i0 WHERE len(e) >= 3),
b AS (SELECT feature, label, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(e, lambda x: x < value)) END AS bin FROM l JOIN i USING (feature)), g AS (SELECT feature, bin::INT AS bin, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM b GROUP BY 1, 2),
h AS (SELECT *, (pos + 0.5) / (sum(pos) OVER w + 0.5 * count(*) OVER w) AS pd, (neg + 0.5) / (sum(neg) OVER w + 0.5 * count(*) OVER w) AS nd FROM g WINDOW w AS (PARTITION BY feature)) {final}"""


@query(_woe_sql("SELECT feature, bin, pos, neg, round(ln(pd / nd), 6) + 0.0::DOUBLE AS woe, round((pd - nd) * ln(pd / nd), 6) AS iv FROM h"))
def woe_iv(spark, sf_dir):
    return rounded(stats.woe_iv(_dirty(spark, sf_dir), _MESS)).withColumn("woe", F.col("woe") + 0.0)


@query(f"WITH {SC}, g AS (SELECT score, count(*) AS n, sum(label) AS p FROM s GROUP BY score), c AS (SELECT score, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER () AS a FROM g WINDOW w AS (ORDER BY score DESC)) SELECT score AS threshold, round(cp / cn, 6) AS precision, round(cp / a, 6) AS recall, round(2 * cp / (cn + a), 6) AS f1 FROM c ORDER BY 2 * cp / (cn + a) DESC, score LIMIT 1")
def best_threshold(spark, sf_dir):
    return rounded(stats.best_threshold(spark, _scores(spark, sf_dir)))


@query(f"WITH {SC}, g AS (SELECT score, count(*) AS n, sum(label) AS p FROM s GROUP BY score), c AS (SELECT p, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER () AS a FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p / a * cp / cn), 6) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return rounded(stats.average_precision(spark, _scores(spark, sf_dir)))


@query(f"""WITH {SC}, c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn,
  avg(-CASE WHEN label = 1 THEN ln(least(greatest(score, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) END) AS l FROM s)
SELECT tp, fp, fn, tn, round(l, 6) AS log_loss, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def metrics_at_threshold(spark, sf_dir):
    return rounded(stats.metrics_at(_scores(spark, sf_dir), 0.5))


@query(f"WITH {SC}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, tx_id) AS r FROM s), k AS (SELECT unnest([100, 500, 1000]) AS k) SELECT k, sum(label)::BIGINT AS captured, round(sum(label) / (SELECT sum(label) FROM s), 6) AS capture_rate FROM r, k WHERE r <= k GROUP BY k")
def capture_at_k(spark, sf_dir):
    return rounded(stats.capture_at(_scores(spark, sf_dir), [100, 500, 1000]))


@query(f"WITH {SC} SELECT label, least(floor(score * 20), 19)::INT AS bin, count(*) AS n, count(*) FILTER (score >= 0.9) AS high_risk FROM s GROUP BY 1, 2")
def score_histogram(spark, sf_dir):
    return stats.score_histogram(_scores(spark, sf_dir))


#: Two-sided normal tail of ``far``, by the same approximation of the error function.
_TAIL = "(1 / (1 + 0.3275911 * x))"
_P = f"CASE WHEN s > 0 AND far > 0 THEN least({_TAIL} * (0.254829592 + {_TAIL} * (-0.284496736 + {_TAIL} * (1.421413741 + {_TAIL} * (-1.453152027 + {_TAIL} * 1.061405429)))) * exp(-x * x), 1) ELSE 1 END"


def _ranks_sql(rows: str, by: str) -> str:
    """From ``rows`` (``by, one, v``; ``one`` marks the first group): u, z and p with ties corrected."""
    return f"""k0 AS ({rows}), k1 AS (SELECT {by}, v, count(*) AS n, sum(one) AS k FROM k0 GROUP BY ALL), k2 AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY v) - n AS below FROM k1),
k3 AS (SELECT {by}, sum(k * (below + (n + 1) / 2.0))::DOUBLE AS r1, sum(k)::DOUBLE AS n1, sum(n - k)::DOUBLE AS n2, sum(n::DOUBLE * n * n - n) AS ties FROM k2 GROUP BY ALL),
k4 AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS s FROM k3),
k5 AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / nullif(s, 0) AS far FROM k4), k6 AS (SELECT *, abs(far) / sqrt(2.0) AS x FROM k5), tests AS (SELECT *, {_P} AS p, CASE WHEN s > 0 THEN (u - n1 * n2 / 2) / s END AS z FROM k6)"""


@query(f"WITH {DT}, {_ranks_sql('SELECT 0 AS b, label AS one, dirty AS v FROM d WHERE NOT coalesce(isnan(dirty), true)', 'b')} SELECT u, n2::BIGINT AS n0, n1::BIGINT AS n1, round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial, round(z, 6) AS z, round(p, 6) AS p FROM tests")
def mann_whitney(spark, sf_dir):
    return rounded(stats.mann_whitney(spark, _dirty(spark, sf_dir), "dirty"))


@query(f"WITH {EV}, c AS (SELECT receiver AS l, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, l LIMIT 20), k AS (SELECT l FROM c WHERE n >= 100 OR (SELECT max(n) FROM c) < 100) SELECT tx_id, CASE WHEN l IS NULL THEN '__OTHER__' ELSE receiver::VARCHAR END AS r_level FROM ev LEFT JOIN k ON receiver = l".replace("receiver AS l", "receiver::VARCHAR AS l").replace("receiver = l", "receiver::VARCHAR = l"))
def category_levels(spark, sf_dir):
    return stats.keep_levels(_events(spark, sf_dir).select("tx_id", F.col("receiver").cast("string").alias("r")), "r", 20).select("tx_id", "r_level")


_NODES = "nd AS (SELECT sender AS node FROM ev UNION SELECT receiver FROM ev), pr AS (SELECT DISTINCT sender, receiver FROM t WHERE split = 'train')"


@query(f"WITH {SP}, {_NODES} SELECT node, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM nd LEFT JOIN (SELECT sender AS node, count(*) AS n FROM pr GROUP BY 1) o USING (node) LEFT JOIN (SELECT receiver AS node, count(*) AS n FROM pr GROUP BY 1) i USING (node)")
def graph_degrees(spark, sf_dir):
    return graph.degrees(_split(spark, sf_dir))


@query(f"WITH {SP}, {_NODES} SELECT node, round(ln(1 + coalesce(o.n, 0)), 6) AS out_amount_log1p, round(ln(1 + coalesce(i.n, 0)), 6) AS in_amount_log1p FROM nd LEFT JOIN (SELECT sender AS node, sum(amount) AS n FROM t WHERE split = 'train' GROUP BY 1) o USING (node) LEFT JOIN (SELECT receiver AS node, sum(amount) AS n FROM t WHERE split = 'train' GROUP BY 1) i USING (node)")
def graph_amounts(spark, sf_dir):
    return rounded(graph.amounts(_split(spark, sf_dir)))


def _pagerank_sql(steps: int) -> str:
    out = f"WITH {SP}, {_NODES}, e AS (SELECT sender, receiver, count(*) OVER (PARTITION BY sender) AS n FROM pr), z AS (SELECT count(*)::DOUBLE AS z FROM nd), r0 AS MATERIALIZED (SELECT node, 1 / z AS rank FROM nd, z)"
    for k in range(1, steps + 1):
        p = f"r{k - 1}"
        out += f", r{k} AS MATERIALIZED (SELECT nd.node, 0.15 / z + 0.85 * (coalesce(g.got, 0) + l.loose / z) AS rank FROM nd LEFT JOIN (SELECT receiver AS node, sum(rank / n) AS got FROM e JOIN {p} ON {p}.node = sender GROUP BY 1) g USING (node), z, (SELECT coalesce(sum(rank), 0) AS loose FROM {p} WHERE node NOT IN (SELECT sender FROM pr)) l)"
    return out + f" SELECT node, round(rank, 9) AS rank FROM r{steps}"


@query(_pagerank_sql(10))
def pagerank(spark, sf_dir):
    return rounded(graph.pagerank(spark, _split(spark, sf_dir), iterations=10, tol=0), 9)


@query(f"WITH {EV}, c AS (SELECT sender, receiver, min((us, tx_id)) AS m FROM ev GROUP BY 1, 2), p AS (SELECT sender, receiver, row_number() OVER (PARTITION BY receiver ORDER BY m) - 1 AS i, row_number() OVER (PARTITION BY sender ORDER BY m) - 1 AS o FROM c) SELECT tx_id, i::INT AS in_port, o::INT AS out_port FROM ev JOIN p USING (sender, receiver)")
def graph_ports(spark, sf_dir):
    return graph.ports(_events(spark, sf_dir))


@query(f"WITH {EV} SELECT tx_id, coalesce((us - lag(us) OVER (PARTITION BY receiver ORDER BY us, tx_id)) // 1000000, 0) AS in_delta, coalesce((us - lag(us) OVER (PARTITION BY sender ORDER BY us, tx_id)) // 1000000, 0) AS out_delta FROM ev")
def graph_time_deltas(spark, sf_dir):
    return graph.time_deltas(_events(spark, sf_dir))


@query(f"WITH {EV} SELECT tx_id, sender AS src, receiver AS dst, 0 AS reversed FROM ev UNION ALL SELECT tx_id, receiver, sender, 1 FROM ev")
def graph_reverse(spark, sf_dir):
    return graph.with_reverse(_events(spark, sf_dir))


@query(f"WITH RECURSIVE {EV}, l AS (SELECT sender AS node, receiver AS nx FROM ev UNION SELECT receiver, sender FROM ev), w AS (SELECT 3::BIGINT AS node, 0 AS hop UNION SELECT nx, hop + 1 FROM w JOIN l USING (node) WHERE hop < 2) SELECT node, min(hop) AS hop FROM w GROUP BY node")
def graph_khop(spark, sf_dir):
    return graph.khop(_events(spark, sf_dir), spark.createDataFrame([(3,)], "node long"), 2)


@query(f"WITH {EV} SELECT tx_id, receiver, place FROM (SELECT tx_id, receiver, (row_number() OVER (PARTITION BY receiver ORDER BY us DESC, tx_id DESC))::INT AS place FROM ev) WHERE place <= 5")
def graph_last_neighbours(spark, sf_dir):
    return graph.last_neighbours(_events(spark, sf_dir), 5)
