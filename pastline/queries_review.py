"""Queries of files, validation, generated feature sets, review tables, graph building and models, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pastline.functions import scalars
from pastline.operators import encoding, fitted, flows, graph, model, review, validation
from pastline.plans import catalog
from pastline.plans.checkpoint import shared_dir, table
from pastline.plans.compiler import build_features
from pastline.queries import (
    _COLS, _CRAMER, _DLONG, _LONG, _MESS, _ZERO, APART, DT, EV, FT, SC, SP, _dirty, _eta, _events, _features, _h, _pairwise, _ranks_sql, _scores, _split, _w, _woe_sql, query, rounded,
)
from pastline.sources import files
from pastline.specs import FeatureSpec, parse_window

_CONF = SC.replace("s AS (SELECT tx_id, label,", "s AS (SELECT tx_id, label, amount, us,") + ", c AS (SELECT *, CASE WHEN score >= 0.5 THEN CASE WHEN label = 1 THEN 'TP' ELSE 'FP' END WHEN label = 1 THEN 'FN' ELSE 'TN' END AS grp FROM s)"
_TX = "tx_id long, us long, split string, label int, amount double"


def _grouped(spark, sf_dir):
    tx = _events(spark, sf_dir).select("tx_id", "amount", "us")
    return tx.join(_scores(spark, sf_dir), "tx_id").withColumn("grp", review.confusion_group(F.col("score"), F.col("label"), 0.5))


def _new_path(spark, name):
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _rows(spark, sf_dir):
    return _split(spark, sf_dir).select("tx_id", "us", "split", "label", "amount")


_ROWS = f"WITH {SP} SELECT tx_id, us, split, label, amount FROM t"


@query(_ROWS)
def csv_round_trip(spark, sf_dir):
    path = _new_path(spark, "csv")
    files.write(spark, _rows(spark, sf_dir), path, "csv")
    return files.read_csv(spark, path, _TX)


@query(_ROWS)
def json_round_trip(spark, sf_dir):
    path = _new_path(spark, "json")
    files.write(spark, _rows(spark, sf_dir), path, "json")
    return files.read_json(spark, path, _TX)


@query(f"WITH {SP}, r AS (SELECT split, count(*) AS n, round(sum(amount), 3) AS total FROM t GROUP BY 1) SELECT 'all' AS part, sum(n)::BIGINT AS n, round(sum(total), 2) AS total FROM r UNION ALL SELECT split, n, round(total, 2) FROM r")
def split_files(spark, sf_dir):
    paths = files.write_splits(spark, _rows(spark, sf_dir), _new_path(spark, "splits"))
    out = None
    for part, path in paths.items():
        files.check_written(spark, path, _rows(spark, sf_dir))
        row = spark.read.parquet(path).agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT name AS \"column\", CASE type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE 'double' END AS type, (cid)::INT AS place, (SELECT count(*) FROM supplier) AS n_rows FROM pragma_table_info('supplier')")
def parquet_metadata(spark, sf_dir):
    return files.metadata(spark, f"{sf_dir}/supplier.parquet")


@query(f"WITH {SP} SELECT tx_id, split FROM t")
def split_normalize(spark, sf_dir):
    tx = _split(spark, sf_dir)
    untidy = F.when(F.col("tx_id") % 3 == 0, F.upper("split")).when(F.col("tx_id") % 3 == 1, F.concat(F.lit("  "), "split", F.lit(" "))).otherwise(F.initcap("split"))
    return validation.normalize_split(tx.withColumn("split", untidy)).select("tx_id", "split")


@query(f"WITH {SP} SELECT tx_id, split FROM t")
def split_attach(spark, sf_dir):
    source = _split(spark, sf_dir).select("tx_id", "split")
    return validation.attach_split(_events(spark, sf_dir), source.unionByName(source)).select("tx_id", "split")


_DIRTY = "CASE WHEN tx_id % 10 = 0 THEN NULL WHEN tx_id % 10 = 1 THEN 'NaN'::DOUBLE WHEN tx_id % 10 = 2 THEN 'inf'::DOUBLE ELSE amount END"


@query(f"WITH {EV}, x AS (SELECT amount, {_DIRTY} AS dirty FROM ev) SELECT 'amount' AS feature, count(*) AS n, 0::BIGINT AS missing, 0::BIGINT AS infinite FROM x UNION ALL SELECT 'dirty', count(*), count(*) FILTER (dirty IS NULL OR isnan(dirty)), count(*) FILTER (isinf(dirty)) FROM x")
def feature_breaches(spark, sf_dir):
    k = F.col("tx_id") % 10
    dirty = F.when(k == 0, None).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).otherwise(F.col("amount"))
    return validation.feature_breaches(_events(spark, sf_dir).withColumn("dirty", dirty), ["amount", "dirty"])


_BAD_LABEL = "CASE WHEN tx_id % 19 = 1 THEN NULL WHEN tx_id % 19 = 2 THEN 'NaN'::DOUBLE WHEN tx_id % 19 = 3 THEN 2 ELSE label END"


@query(f"WITH {EV}, x AS (SELECT {_BAD_LABEL} AS y FROM ev) SELECT count(*) AS n, count(*) FILTER (y IS NULL OR isnan(y)) AS missing, count(*) FILTER (y NOT IN (0, 1) AND NOT isnan(y)) AS other, count(*) FILTER (y = 0) AS negatives, count(*) FILTER (y = 1) AS positives FROM x")
def label_counts(spark, sf_dir):
    k = F.col("tx_id") % 19
    return validation.label_counts(_events(spark, sf_dir).withColumn("label", F.when(k == 1, None).when(k == 2, float("nan")).when(k == 3, 2.0).otherwise(F.col("label"))))


@query(f"""WITH {SC}, x AS (SELECT CASE WHEN tx_id % 17 = 1 THEN NULL WHEN tx_id % 17 = 2 THEN 'NaN'::DOUBLE WHEN score > 0.95 THEN score + 1 WHEN tx_id % 17 = 3 THEN -score - 0.001 ELSE score END AS score, CASE WHEN tx_id % 23 = 4 THEN NULL WHEN tx_id % 23 = 5 THEN 9 ELSE label END AS label FROM s)
SELECT count(*) AS n, count(*) FILTER (score IS NULL OR isnan(score)) AS missing, count(*) FILTER (NOT isnan(score) AND (score < 0 OR score > 1)) AS outside, count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) AS bad_label, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM x""")
def score_breaches(spark, sf_dir):
    k, j, s = F.col("tx_id") % 17, F.col("tx_id") % 23, F.col("score")
    score = F.when(k == 1, None).when(k == 2, float("nan")).when(s > 0.95, s + 1).when(k == 3, -s - 0.001).otherwise(s)
    return validation.score_breaches(_scores(spark, sf_dir).withColumns({"score": score, "label": F.when(j == 4, None).when(j == 5, 9).otherwise(F.col("label"))}))


@query(f"WITH {SP}, n AS (SELECT split, count(*) AS n FROM t WHERE split <> 'test' GROUP BY 1), s AS (SELECT split, count(*) FILTER (split <> 'val' OR tx_id % 7 > 0) AS stated FROM t GROUP BY 1) SELECT split, n, stated, n IS NOT DISTINCT FROM stated AS ok FROM n FULL JOIN s USING (split)")
def preview_checks(spark, sf_dir):
    """A part that is absent and one with fewer rows stated than it has."""
    tx = _split(spark, sf_dir)
    summary = tx.groupBy("split").agg(F.count_if((F.col("split") != "val") | (F.col("tx_id") % 7 > 0)).alias("n"))
    return validation.preview_checks({s: tx.where(F.col("split") == s) for s in ("train", "val")}, summary)


@query(f"WITH {EV} SELECT tx_id, round(amount * CASE fmt WHEN 'click' THEN 1.0 WHEN 'view' THEN 1.25 WHEN 'purchase' THEN 0.5 END, 4) AS usd FROM ev")
def usd_conversion(spark, sf_dir):
    return _events(spark, sf_dir).select("tx_id", scalars.to_usd(F.col("amount"), F.col("fmt"), {"click": 1.0, "view": 1.25, "purchase": 0.5}).alias("usd"))


_AGG = {"sum": "coalesce(sum({v}) {w}, 0)", "mean": "coalesce(avg({v}) {w}, 0)", "std": "coalesce(stddev_samp({v}) {w}, 0)", "max": "coalesce(max({v}) {w}, 0)", "count": "count({v}) {w}"}


def _stage_sql(specs) -> str:
    out = []
    for s in specs:
        key, v = s.inputs.get("entity"), s.inputs.get("value")
        if s.operation == "rolling_agg":
            x = _AGG[s.params["agg"]].format(v=v, w=_w(parse_window(s.params["window"]), key)) + "::DOUBLE"
        elif s.operation == "recency_seconds_since_last":
            x = f"coalesce((us - max(us) {_h(key)}) / 1e6, -1)::DOUBLE"
        elif s.operation == "is_first_by_entity":
            x = f"(count(*) {_h(key)} = 0)::INT"
        elif s.operation == "cur_vs_mean_ratio":
            x = f"coalesce({v} / nullif(avg({v}) {_w(parse_window(s.params['window']), key)}, 0), 0)::DOUBLE"
        else:
            x = f"(count(*) {_h(key)})::INT"
        out.append(f"{x if x.endswith('INT') else f'round({x} + {APART}, 6)'} AS {s.output}")
    return f"WITH {EV}, e2 AS (SELECT *, amount / 3.0 AS amount_received FROM ev) SELECT tx_id, us, {', '.join(out)} FROM e2"


def _stage2_sql() -> str:
    """Counterparty sums of all rows of the longest window once, then per width."""
    ctes, columns = [], []
    for r, entity, other, value in (("receiver", "receiver", "sender", "amount_received"), ("sender", "sender", "receiver", "amount")):
        gap = {w: parse_window(w) for w in catalog.HISTORY_WINDOWS}
        ctes.append(f"j_{r} AS (SELECT a.tx_id, b.{other} AS k, a.us - b.us AS gap, b.{value} AS v FROM e2 a JOIN e2 b ON a.{entity} = b.{entity} AND b.us < a.us AND b.us >= a.us - {7 * 86_400_000_000})")
        ctes.append(f"g_{r} AS (SELECT tx_id, k, " + ", ".join(f"sum(v) FILTER (gap <= {x}) AS s{w}" for w, x in gap.items()) + f" FROM j_{r} GROUP BY 1, 2)")
        ctes.append(f"h_{r} AS (SELECT tx_id, " + ", ".join(f"sum(s{w}) AS a{w}, sum(s{w} * s{w}) AS q{w}, max(s{w}) AS m{w}" for w in gap) + f" FROM g_{r} GROUP BY 1)")
    for s in catalog.stage2():
        w, entity = s.params["window"], s.inputs["entity"]
        over = _w(parse_window(w), entity)
        if s.operation == "rolling_counterparty_nunique":
            x = f"(count(DISTINCT {s.inputs['counterparty']}) {over})::DOUBLE"
        elif s.operation == "rolling_agg":
            x = f"(count({s.inputs['value']}) {over})::DOUBLE"
        elif s.operation == "rolling_counterparty_effective_n":
            x = f"round(CASE WHEN h_{entity}.a{w} > 0 THEN h_{entity}.a{w} * h_{entity}.a{w} / h_{entity}.q{w} ELSE 0 END + {APART}, 6)"
        else:
            x = f"round(CASE WHEN h_{entity}.a{w} > 0 THEN least(h_{entity}.m{w} / h_{entity}.a{w}, 1) ELSE 0 END + {APART}, 6)"
        columns.append(f"{x} AS {s.output}")
    return f"WITH {EV}, e2 AS (SELECT *, amount / 3.0 AS amount_received FROM ev), {', '.join(ctes)} SELECT e2.tx_id, us, {', '.join(columns)} FROM e2 LEFT JOIN h_receiver ON h_receiver.tx_id = e2.tx_id LEFT JOIN h_sender ON h_sender.tx_id = e2.tx_id"


@query(_stage2_sql())
def stage2_features(spark, sf_dir):
    """All 46 counterparty columns: two streams, one per account role."""
    return rounded(build_features(_events(spark, sf_dir).withColumn("amount_received", F.col("amount") / 3), catalog.stage2()), apart=APART)


def _stage3_sql() -> str:
    widths = {w: parse_window(w) for w in catalog.HISTORY_WINDOWS}
    parts = [f"{a} FILTER ({d} AND gap <= {x}) AS {d}_{n}{w}" for w, x in widths.items() for d in ("fwd", "rev") for n, a in (("n", "count(*)"), ("s", "sum(v)"), ("d", "stddev_samp(v)"), ("m", "max(v)"))]
    names = {
        "forward_tx_count": "coalesce(fwd_n{w}, 0)", "forward_amount_sum": "coalesce(fwd_s{w}, 0)", "forward_amount_mean": "coalesce(fwd_s{w} / nullif(fwd_n{w}, 0), 0)", "forward_amount_std": "coalesce(fwd_d{w}, 0)",
        "forward_amount_max": "coalesce(fwd_m{w}, 0)", "reverse_exists": "coalesce((rev_n{w} > 0)::INT, 0)", "reverse_tx_count": "coalesce(rev_n{w}, 0)", "net_amount_sumdiff": "coalesce(fwd_s{w}, 0) - coalesce(rev_s{w}, 0)",
        "current_vs_forward_mean_ratio": "CASE WHEN fwd_s{w} > 0 THEN amount / (fwd_s{w} / fwd_n{w}) ELSE 0 END", "current_vs_forward_mean_ratio_hist_lt2_flag": "(coalesce(fwd_n{w}, 0) < 2)::INT",
        "bidirectional_amount_ratio": "CASE WHEN rev_s{w} > 0 THEN coalesce(fwd_s{w}, 0) / rev_s{w} ELSE 0 END",
    }
    pair = "sender, receiver"
    past = {"seconds_since_last_tx": f"coalesce((us - max(us) {_h(pair)}) / 1e6, 0)", "is_new_pair": f"(count(*) {_h(pair)} = 0)::INT", "age_hours_since_first": f"coalesce((us - min(us) {_h(pair)}) / 3.6e9, 0)"}
    columns = []
    for s in catalog.stage3():
        metric, w = s.params.get("metric"), s.params.get("window")
        if s.operation == "pair_history":
            x = past[metric]
        elif s.operation == "current_self_loop":
            x = "(sender = receiver)::INT"
        elif s.operation == "bank_pair_history":
            x = f"count(*) {_h('sender_bank, receiver_bank')}"
        elif metric in names:
            x = names[metric].format(w=w)
        else:
            x = f"CASE WHEN fwd_n{w} >= 2 THEN ln(1 + least({names['current_vs_forward_mean_ratio'].format(w=w)}, c{w})) ELSE 0 END"
        columns.append(f"{x}::INT AS {s.output}" if s.operation == "current_self_loop" else f"round(({x})::DOUBLE + {APART}, 6) AS {s.output}")
    caps = ", ".join(f"quantile_cont({names['current_vs_forward_mean_ratio'].format(w=w)}, 0.999) FILTER (split = 'train' AND fwd_n{w} >= 2) AS c{w}" for w in catalog.STABLE_WINDOWS)
    return f"""WITH {SP}, j AS (SELECT a.tx_id, a.us - b.us AS gap, b.amount AS v, b.sender = a.sender AND b.receiver = a.receiver AS fwd, b.sender = a.receiver AND b.receiver = a.sender AS rev
      FROM ev a JOIN ev b ON least(a.sender, a.receiver) = least(b.sender, b.receiver) AND greatest(a.sender, a.receiver) = greatest(b.sender, b.receiver) AND b.us < a.us AND b.us >= a.us - {7 * 86_400_000_000}),
    g AS (SELECT tx_id, {", ".join(parts)} FROM j GROUP BY 1), x AS (SELECT t.*, g.* EXCLUDE (tx_id) FROM t LEFT JOIN g USING (tx_id)), c AS (SELECT {caps} FROM x) SELECT tx_id, us, {", ".join(columns)} FROM x, c"""


@query(_stage3_sql())
def stage3_features(spark, sf_dir):
    """All 45 pair columns: one stream over unordered pairs, one window over directed ones, ranges of bank pairs, and one fit."""
    return rounded(build_features(_split(spark, sf_dir), catalog.stage3()), apart=APART)


def _stage4_sql() -> str:
    widths = {w: parse_window(w) for w in catalog.HISTORY_WINDOWS}
    over = {w: _w(x, "a") for w, x in widths.items()}
    one = [f"greatest(coalesce(sum(v) FILTER (side = '{d}') {over[w]}, 0), 0) AS {d}{w}" for w in widths for d in ("in", "out")]
    one += [f"max(us) FILTER (side = 'in') {over[w]} AS lu{w}, arg_max(v, us::HUGEINT * 100000000 + tx_id) FILTER (side = 'in') {over[w]} AS lv{w}" for w in widths]
    two = [f"coalesce(sum((side = 'out' AND lu{w} IS NOT NULL)::INT) {over[w]}, 0) AS sq{w}" for w in widths]
    gap = "abs({r}.in{w} - {r}.out{w}) / nullif({r}.in{w} + {r}.out{w}, 0)"
    caps = ", ".join(f"quantile_cont({gap.format(r=r, w=w)}, 0.25) FILTER (split = 'train') AS {r}_{w}" for r in ("s", "r") for w in catalog.FLOW_WINDOWS)
    columns = []
    for f in catalog.stage4():
        metric, w, r = f.params["metric"], f.params["window"], f.params["role"][0]
        x = {
            "in_out_ratio": f"CASE WHEN {r}.out{w} > 0 THEN {r}.in{w} / {r}.out{w} ELSE 0 END", "sumdiff": f"{r}.in{w} - {r}.out{w}", "residual_abs": f"abs({r}.in{w} - {r}.out{w})",
            "balanced_state_flag": f"coalesce(({gap.format(r=r, w=w)} <= {r}_{w})::INT, 0)", "seconds_since_last_in": f"coalesce((s.us - s.lu{w}) / 1e6, 0)",
            "current_to_last_in_amount_ratio": f"CASE WHEN s.lv{w} > 0 THEN s.v / s.lv{w} ELSE 0 END", "recent_flag": f"(s.lu{w} IS NOT NULL)::INT", "sequence_count": f"s.sq{w}", "historical_sequence_count": f"r.sq{w}",
        }[metric]
        columns.append(f"round(({x})::DOUBLE + {APART}, 6) AS {f.output}")
    joined = "m s JOIN m r ON s.tx_id = r.tx_id AND s.side = 'out' AND r.side = 'in' JOIN t ON t.tx_id = s.tx_id"
    return f"""WITH {SP}, e AS (SELECT tx_id, us, sender AS a, 'out' AS side, amount AS v FROM ev UNION ALL SELECT tx_id, us, receiver, 'in', amount FROM ev),
    l AS (SELECT *, {", ".join(one)} FROM e), m AS (SELECT *, {", ".join(two)} FROM l), c AS (SELECT {caps} FROM {joined}) SELECT s.tx_id, s.us, {", ".join(columns)} FROM {joined}, c"""


@query(_stage4_sql())
def stage4_features(spark, sf_dir):
    """All 48 flow columns: one stream over accounts' events, one exchange back, one fit of eight thresholds."""
    return rounded(build_features(_split(spark, sf_dir), catalog.stage4()), apart=APART)


@query(_stage_sql(catalog.stage0()))
def stage0_features(spark, sf_dir):
    """All 62 columns of the first history stage: two shuffles, one per account role."""
    return rounded(build_features(_events(spark, sf_dir).withColumn("amount_received", F.col("amount") / 3), catalog.stage0()), apart=APART)


@query(_stage_sql(catalog.stage1_stats()))
def stage1_stats(spark, sf_dir):
    return rounded(build_features(_events(spark, sf_dir).withColumn("amount_received", F.col("amount") / 3), catalog.stage1_stats()), apart=APART)


def _flow_sql() -> str:
    sums = ", ".join(f"greatest(coalesce(sum(v) FILTER (side = '{way}') {_w(parse_window(w), 'a')}, 0), 0) AS {way}_{w}" for way in ("out", "in") for w in ("h6", "d1", "d3", "d7") for w in [f"{w[1:]}{w[0]}"])
    names = [f"{way}_{w}" for way in ("out", "in") for w in catalog.FLOW_WINDOWS]
    picked = ", ".join(f"round(max({n}) FILTER (side = '{s}'), 4) AS accountstats__{role}__{n.split('_')[0]}__amount__sum__w{n.split('_')[1]}" for role, s in (("sender", "out"), ("receiver", "in")) for n in names)
    return f"WITH {EV}, e AS (SELECT tx_id, us, sender AS a, 'out' AS side, amount AS v FROM ev UNION ALL SELECT tx_id, us, receiver, 'in', amount / 3.0 FROM ev), g AS (SELECT tx_id, side, {sums} FROM e) SELECT tx_id, {picked} FROM g GROUP BY tx_id"


@query(_flow_sql())
def stage1_flows(spark, sf_dir):
    tx = _events(spark, sf_dir).withColumn("amount_received", F.col("amount") / 3)
    return rounded(flows.account_flow_sums(tx, {w: parse_window(w) for w in catalog.FLOW_WINDOWS}, "amount_received"), 4)


@query(f"WITH {_LONG} SELECT feature, label, split, count(*) AS n, round(avg((value IS NULL)::INT), 6) AS missing_rate, round(avg((value = 0)::INT), 6) AS zero_rate, round(avg((value <> 0)::INT), 6) AS nonzero_rate FROM l GROUP BY 1, 2, 3")
def cell_rates(spark, sf_dir):
    return rounded(review.cell_rates(_features(spark, sf_dir), _COLS))


@query(f"WITH {_CONF} SELECT grp, count(*) AS n, round(sum(amount), 3) AS total, round(avg(amount), 6) AS mean FROM c GROUP BY 1")
def confusion_groups(spark, sf_dir):
    return rounded(review.group_summary(_grouped(spark, sf_dir))).withColumn("total", F.round("total", 3))


@query(f"WITH {EV} SELECT hour(make_timestamp(us))::INT AS hour, count(*) AS n, round(avg(label), 6) AS positive_rate FROM ev GROUP BY 1")
def hourly_review(spark, sf_dir):
    return rounded(review.hourly(_events(spark, sf_dir)))


@query(f"WITH {_LONG}, g AS (SELECT feature, label, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, [0.05, 0.5, 0.95]) AS q FROM l GROUP BY 1, 2), p AS (SELECT unnest([1, 2, 3]) AS i, unnest([0.05, 0.5, 0.95]) AS quantile) SELECT feature, label, n, round(mean, 6) AS mean, round(std, 6) AS std, quantile::DOUBLE AS quantile, round(q[i], 6) AS value FROM g, p")
def label_quantiles(spark, sf_dir):
    return rounded(review.quantiles_by(_features(spark, sf_dir), _COLS, "label", [0.05, 0.5, 0.95]))


@query(f"WITH {EV} SELECT tx_id, label FROM (SELECT tx_id, label, row_number() OVER (PARTITION BY label ORDER BY tx_id) AS r FROM ev) WHERE r <= 50")
def first_per_label(spark, sf_dir):
    return review.first_per_label(_events(spark, sf_dir), 50).select("tx_id", "label")


@query(f"WITH {EV}, o AS (SELECT tx_id, row_number() OVER (ORDER BY us, tx_id) - 1 AS r, count(*) OVER () AS n FROM ev), k AS (SELECT DISTINCT floor(k * ((SELECT max(n) FROM o) - 1) / 99.0 + 1e-9)::BIGINT AS r FROM range(100) x(k)) SELECT tx_id FROM o JOIN k USING (r)")
def evenly_spaced(spark, sf_dir):
    return review.evenly_spaced(spark, _events(spark, sf_dir), 100, ["us", "tx_id"]).select("tx_id")


@query(f"WITH {_CONF} SELECT tx_id, grp FROM (SELECT tx_id, grp, row_number() OVER (PARTITION BY grp ORDER BY md5(tx_id::VARCHAR || '-7'), tx_id) AS r FROM c) WHERE r <= 40")
def group_sample(spark, sf_dir):
    return review.group_sample(_grouped(spark, sf_dir), 40, 7).select("tx_id", "grp")


@query(f"WITH {EV} SELECT tx_id, round(1.0::DOUBLE / count(*) OVER (PARTITION BY label), 9) AS weight FROM ev")
def class_weights(spark, sf_dir):
    return rounded(review.class_weights(_events(spark, sf_dir)).select("tx_id", "weight"), 9)


@query(f"WITH {EV}, o AS (SELECT tx_id, row_number() OVER (ORDER BY us, tx_id) - 1 AS r FROM ev), b AS (SELECT k AS batch FROM range((SELECT (max(r) // 100 + 1)::BIGINT FROM o)) x(k)) SELECT tx_id, batch FROM o, b WHERE r >= batch * 100 AND r < batch * 100 + 250")
def sliding_batches(spark, sf_dir):
    return review.sliding_batches(spark, _events(spark, sf_dir), 250, 100, ["us", "tx_id"]).select("tx_id", "batch")


@query(f"WITH {FT} SELECT 'amount' AS feature, count(DISTINCT amount) AS n_unique, 'numeric' AS kind FROM f UNION ALL SELECT 'label', count(DISTINCT label), 'categorical' FROM f UNION ALL SELECT 'fmt', count(DISTINCT fmt), 'categorical' FROM f")
def column_kinds(spark, sf_dir):
    return review.typed_columns(_features(spark, sf_dir), ["amount", "label", "fmt"])


_IV = "g AS (SELECT fmt AS level, count(*) FILTER (late = 1) AS pos, count(*) FILTER (late = 0) AS neg FROM (SELECT fmt, (hour(make_timestamp(us)) >= 12)::INT AS late FROM ev) GROUP BY 1)"


@query(f"WITH {EV}, {_IV}, h AS (SELECT *, (pos + 0.5) / (sum(pos) OVER () + 0.5 * count(*) OVER ()) AS pd, (neg + 0.5) / (sum(neg) OVER () + 0.5 * count(*) OVER ()) AS nd FROM g) SELECT level, pos, neg, round(ln(pd / nd), 6) AS woe, round((pd - nd) * ln(pd / nd), 6) AS iv FROM h")
def categorical_woe(spark, sf_dir):
    late = (scalars.hour_of(F.col("us")) >= 12).cast("int")
    return rounded(review.categorical_woe(_events(spark, sf_dir).withColumn("label", late), "fmt"))


@query(_woe_sql(""", tt AS (SELECT feature, count(*) AS bins, sum((pd - nd) * ln(pd / nd)) AS iv FROM h GROUP BY 1)
SELECT (rank() OVER (ORDER BY iv DESC))::INT AS place, feature, bins, round(iv, 6) AS iv, CASE WHEN iv < 0.02 THEN 'useless' WHEN iv < 0.1 THEN 'weak' WHEN iv < 0.3 THEN 'medium' WHEN iv < 0.5 THEN 'strong' ELSE 'suspicious' END AS strength FROM tt"""))
def iv_ranking(spark, sf_dir):
    return rounded(review.iv_ranking(_dirty(spark, sf_dir), _MESS))


_TOP = [*_MESS, "coarse"]


@query(f"WITH {DT}, r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN var_pop({_ZERO.format(a)}) > 0 AND var_pop({_ZERO.format(b)}) > 0 THEN corr({_ZERO.format(a)}, {_ZERO.format(b)}) ELSE 0 END AS r FROM d" for i, a in enumerate(_TOP) for b in _TOP[i + 1 :]) + ") SELECT a, b, round(r, 6) AS r FROM r ORDER BY abs(r) DESC, a, b LIMIT 5")
def top_correlated_pairs(spark, sf_dir):
    return rounded(review.top_pairs(_dirty(spark, sf_dir), _TOP, 5))


_KINDS = {"amount": "numeric", "kind": "categorical", "few": "numeric", "hour": "categorical"}


@query(f"""WITH {DT}, c AS (SELECT kind AS a, hour AS b, count(*) AS o FROM d WHERE kind IS NOT NULL AND hour IS NOT NULL GROUP BY 1, 2), r AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY 1)
SELECT 'amount' AS a, 'few' AS b, 'pearson' AS measure, round({_pairwise('amount', 'few')}, 6) + 0.0::DOUBLE AS value FROM d
UNION ALL SELECT 'amount', 'kind', 'eta', {_eta('kind', 'amount')} UNION ALL SELECT 'kind', 'few', 'eta', {_eta('kind', 'few')} UNION ALL SELECT 'amount', 'hour', 'eta', {_eta('hour', 'amount')} UNION ALL SELECT 'few', 'hour', 'eta', {_eta('hour', 'few')}
UNION ALL SELECT 'kind', 'hour', 'cramers_v', * FROM ({_CRAMER})""")
def mixed_association(spark, sf_dir):
    return rounded(review.mixed_association(_dirty(spark, sf_dir), _KINDS)).withColumn("value", F.col("value") + 0.0)


_SLOG = "(sign({0}) * ln(1 + abs({0})))"


@query(f"""WITH {_DLONG}, m AS (SELECT feature, avg(coalesce(value = 0, false)::INT) AS zero_rate, {", ".join(f"avg(v0) FILTER (split = '{s}') AS {s}, avg((v0 <> 0)::INT) FILTER (split = '{s}') AS nz_{s}" for s in ("train", "val", "test"))},
{", ".join(f"avg(v0) FILTER (label = {k}) AS m{k}, var_pop(v0) FILTER (label = {k}) AS v{k}, avg((v0 <> 0)::INT) FILTER (label = {k}) AS z{k}" for k in (0, 1))} FROM l GROUP BY feature),
i AS (SELECT feature, zero_rate, greatest(abs({_SLOG.format("val")} - {_SLOG.format("train")}), abs({_SLOG.format("test")} - {_SLOG.format("train")})) AS log_gap, greatest(nz_val, nz_train, nz_test) - least(nz_val, nz_train, nz_test) AS nonzero_gap, (m1 - m0) / nullif(sqrt((v0 + v1) / 2), 0) AS smd, z1 - z0 AS nonzero_diff FROM m)
SELECT feature, round(zero_rate, 6) AS zero_rate, round(log_gap, 6) AS log_gap, round(nonzero_gap, 6) AS nonzero_gap, round(smd, 6) + 0.0::DOUBLE AS smd, round(nonzero_diff, 6) + 0.0::DOUBLE AS nonzero_diff, round(zero_rate + abs(coalesce(log_gap, 0)) + abs(coalesce(nonzero_gap, 0)) + abs(coalesce(smd, 0)) + abs(coalesce(nonzero_diff, 0)), 6) AS review_score FROM i""")
def review_priority(spark, sf_dir):
    return rounded(review.review_scores(_dirty(spark, sf_dir), _MESS)).withColumns({c: F.col(c) + 0.0 for c in ("smd", "nonzero_diff")})


_SIDES = "SELECT unnest(['TP', 'TP', 'TP', 'FP', 'FP', 'FN']) AS a, unnest(['FP', 'FN', 'TN', 'FN', 'TN', 'TN']) AS b"


@query(f"""WITH {_DLONG}, {_ranks_sql(f"SELECT a, b, feature, (grp = a)::INT AS one, value AS v FROM ({_SIDES}) JOIN l ON grp IN (a, b) WHERE value IS NOT NULL", "a, b, feature")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY p, feature) AS i, count(*) OVER (PARTITION BY a, b) AS m FROM tests WHERE n1 >= 5 AND n2 >= 5)
SELECT a AS first, b AS second, feature, n1::BIGINT AS n1, n2::BIGINT AS n2, u, round(2 * u / (n1 * n2) - 1, 6) + 0.0::DOUBLE AS rank_biserial, round(p, 6) AS p, round(least(min(p * m / i) OVER (PARTITION BY a, b ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS p_adjusted FROM ranked""")
def group_tests(spark, sf_dir):
    """Six columns between all pairs of groups; p adjusted over the columns of a pair."""
    df = _dirty(spark, sf_dir)
    score = ((F.col("tx_id") * 7919 + F.col("label") * 211) % 1000) / 1000.0
    return rounded(review.compare_groups(spark, df.withColumn("grp", review.confusion_group(score, F.col("label"), 0.5)), _MESS)).withColumn("rank_biserial", F.col("rank_biserial") + 0.0)


_CAT = f"x AS (SELECT tx_id, split, label, amount, fmt, sender::VARCHAR || '>' || receiver::VARCHAR AS pair, receiver::VARCHAR AS r FROM t)"
_VOC = ", ".join(f"v_{c} AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS code FROM (SELECT DISTINCT {c} AS c FROM x WHERE split = 'train'))" for c in ("fmt", "pair", "r"))


def _categories(spark, sf_dir):
    tx = _split(spark, sf_dir)
    pair = F.concat(F.col("sender").cast("string"), F.lit(">"), F.col("receiver").cast("string"))
    return tx.select("tx_id", "split", "label", "amount", "fmt", pair.alias("pair"), F.col("receiver").cast("string").alias("r"))


_ENCODINGS = [encoding.EncodingSpec("", "amount"), encoding.EncodingSpec("fmt", "fmt_code", "label_code"), encoding.EncodingSpec("pair", "pair_native", "xgb_native"), encoding.EncodingSpec("pair", "pair_code", "label_code"), encoding.EncodingSpec("r", "r_code", "label_code")]


@query(f"""WITH {SP}, {_CAT}, {_VOC} SELECT tx_id, split, label, amount, coalesce(v_fmt.code, -1)::INT AS fmt_code, coalesce(v_pair.c, '__UNKNOWN__') AS pair_native, coalesce(v_pair.code, -1)::INT AS pair_code, coalesce(v_r.code, -1)::INT AS r_code
  FROM x LEFT JOIN v_fmt ON v_fmt.c = fmt LEFT JOIN v_pair ON v_pair.c = pair LEFT JOIN v_r ON v_r.c = r""")
def stored_encodings(spark, sf_dir):
    """Fitted, stored, checked and replayed from the store."""
    path, df = _new_path(spark, "encodings"), _categories(spark, sf_dir)
    encoding.store(spark, df, _ENCODINGS, path)
    return encoding.encode_stored(spark, df, path)


@query(f"""WITH {SP}, {_CAT}, {_VOC} SELECT 'fmt_code' AS output, 'fmt' AS source, 'label_code' AS encoding, c AS category, code::INT AS code FROM v_fmt UNION ALL SELECT 'pair_code', 'pair', 'label_code', c, code::INT FROM v_pair
  UNION ALL SELECT 'pair_native', 'pair', 'xgb_native', c, NULL FROM v_pair UNION ALL SELECT 'r_code', 'r', 'label_code', c, code::INT FROM v_r UNION ALL SELECT 'pair_native', 'pair', 'xgb_native', '__UNKNOWN__', NULL""")
def encoding_mappings(spark, sf_dir):
    specs = encoding.normalize_specs(_ENCODINGS)
    return encoding.mapping_rows(specs, encoding.fit(_categories(spark, sf_dir), specs))


_MAP = "mp AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT sender AS node FROM ev UNION SELECT receiver FROM ev))"


@query(f"WITH {SP}, {_MAP} SELECT tx_id, sender AS from_id, receiver AS to_id, a.idx AS from_idx, b.idx AS to_idx, amount, us, split, label FROM t JOIN mp a ON a.node = sender JOIN mp b ON b.node = receiver")
def formatted_edges(spark, sf_dir):
    tx = _split(spark, sf_dir)
    return graph.formatted_edges(tx, graph.node_map(tx))


#: Edges and nodes with one kind of fault each, by their ids; ``early`` edges of val have a time before train's end.
_BROKEN = f"""WITH {SP}, {_MAP}, e0 AS (SELECT tx_id, a.idx AS fi, b.idx AS ti, us, split, label FROM t JOIN mp a ON a.node = sender JOIN mp b ON b.node = receiver),
e AS (SELECT CASE WHEN tx_id % 101 = 1 THEN NULL ELSE tx_id END AS id, CASE WHEN tx_id % 103 = 2 THEN NULL ELSE fi END AS fi, ti, CASE WHEN tx_id % 107 = 3 THEN NULL WHEN tx_id % 97 = 5 THEN 0 ELSE us END AS us,
  CASE WHEN tx_id % 109 = 4 THEN 'holdout' WHEN tx_id % 109 = 5 THEN NULL ELSE split END AS split, CASE WHEN tx_id % 113 = 6 THEN 7 WHEN tx_id % 113 = 7 THEN NULL ELSE label END AS label FROM e0 UNION ALL SELECT tx_id, fi, ti, us, split, label FROM e0 WHERE tx_id % 127 = 8),
m AS (SELECT CASE WHEN idx % 29 = 1 THEN node + 1 ELSE node END AS node, CASE WHEN idx % 31 = 2 THEN NULL WHEN idx % 37 = 3 THEN idx + 1 ELSE idx END AS idx FROM mp)"""


@query(f"""{_BROKEN} SELECT 'edge without node' AS "check", count(*) FILTER (fi IS NULL OR ti IS NULL) AS violations FROM e UNION ALL SELECT 'edge without id', count(*) FILTER (id IS NULL) FROM e UNION ALL SELECT 'repeated edge id', count(id) - count(DISTINCT id) FROM e
UNION ALL SELECT 'label that is not 0 or 1', count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) FROM e UNION ALL SELECT 'unknown split', count(*) FILTER (split IS NULL OR split NOT IN ('train', 'val', 'test')) FROM e UNION ALL SELECT 'edge without time', count(*) FILTER (us IS NULL) FROM e
UNION ALL SELECT 'edge before an earlier split ends', (SELECT count(*) FROM e, (SELECT max(us) FILTER (split = 'train') AS a, max(us) FILTER (split = 'val') AS b FROM e) WHERE (split = 'val' AND us <= a) OR (split = 'test' AND us <= greatest(a, b)))
UNION ALL SELECT 'repeated node', count(*) - count(DISTINCT node) FROM m UNION ALL SELECT 'repeated index', count(idx) - count(DISTINCT idx) FROM m UNION ALL SELECT 'node without index', count(*) FILTER (idx IS NULL) FROM m""")
def graph_checks(spark, sf_dir):
    tx = _split(spark, sf_dir)
    mapping = graph.node_map(tx)
    e, k, i = graph.formatted_edges(tx, mapping), F.col("tx_id"), F.col("idx")
    unless = lambda bad, c, other=None: F.when(bad, other).otherwise(F.col(c)).alias(c)
    broken = e.select(
        unless(k % 101 == 1, "tx_id"), unless(k % 103 == 2, "from_idx"), "to_idx", F.when(k % 107 == 3, None).when(k % 97 == 5, 0).otherwise(F.col("us")).alias("us"),
        F.when(k % 109 == 4, "holdout").when(k % 109 == 5, None).otherwise(F.col("split")).alias("split"), F.when(k % 113 == 6, 7).when(k % 113 == 7, None).otherwise(F.col("label")).alias("label"),
    )
    nodes = mapping.select(F.when(i % 29 == 1, F.col("node") + 1).otherwise(F.col("node")).alias("node"), F.when(i % 31 == 2, None).when(i % 37 == 3, i + 1).otherwise(i).alias("idx"))
    return graph.graph_checks(broken.unionByName(e.where(k % 127 == 8).select(*broken.columns)), nodes)


@query(f"""WITH {EV}, c AS (SELECT sender, receiver, min((us, tx_id)) AS m FROM ev GROUP BY 1, 2), p AS (SELECT sender, receiver, (row_number() OVER (PARTITION BY receiver ORDER BY m) - 1)::INT AS i, (row_number() OVER (PARTITION BY sender ORDER BY m) - 1)::INT AS o FROM c),
d AS (SELECT tx_id, sender, receiver, coalesce((us - lag(us) OVER (PARTITION BY receiver ORDER BY us, tx_id)) // 1000000, 0) AS di, coalesce((us - lag(us) OVER (PARTITION BY sender ORDER BY us, tx_id)) // 1000000, 0) AS dou FROM ev)
SELECT tx_id, sender AS src, receiver AS dst, i AS in_port, o AS out_port, di AS in_delta, dou AS out_delta, 0 AS reversed FROM d JOIN p USING (sender, receiver) UNION ALL SELECT tx_id, receiver, sender, o, i, dou, di, 1 FROM d JOIN p USING (sender, receiver)""")
def graph_reverse_ports(spark, sf_dir):
    return graph.edges_with_ports(_events(spark, sf_dir))


@query(f"WITH {EV}, z AS (SELECT sender AS node FROM ev WHERE tx_id % 50 = 7 UNION SELECT receiver FROM ev WHERE tx_id % 50 = 7) SELECT node, (node IN (SELECT node FROM z))::INT AS ego FROM (SELECT sender AS node FROM ev UNION SELECT receiver FROM ev)")
def graph_ego(spark, sf_dir):
    tx = _events(spark, sf_dir)
    return graph.ego_flags(tx, tx.where("tx_id % 50 = 7").select("tx_id"))  # the seed edges of a batch



@query()
def boosted_trees(spark, sf_dir):
    """Trained on train, threshold fixed on val, both reported: seeded, but no SQL form."""
    f = _features(spark, sf_dir).withColumn("label", (F.col("amount") + 3 * F.col("hour") > 60).cast("int"))
    columns = ["amount", "hour", "n_1d"]
    f = table(spark, f.select("tx_id", "split", "label", *columns), "features")  # training reads them once per pass
    return model.evaluate(spark, model.score(f, model.train(f, columns, maxIter=5, maxDepth=3), columns))


def _hex(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


@query(f"""WITH {EV}, u AS (SELECT tx_id, 1000000000000 // count(*) OVER (PARTITION BY label) AS units FROM ev), c AS (SELECT tx_id, units, sum(units) OVER (ORDER BY tx_id) - units AS at, sum(units) OVER () AS total FROM u),
d AS (SELECT k AS draw, {_hex("'7-' || k")} % (SELECT max(total) FROM c)::BIGINT AS at FROM range(2000) x(k)) SELECT draw, tx_id FROM d JOIN c ON d.at >= c.at AND d.at < c.at + units""")
def weighted_draws(spark, sf_dir):
    """2,000 draws with replacement, both labels with equal shares in all."""
    tx = _events(spark, sf_dir)
    sizes = F.broadcast(tx.groupBy("label").agg(F.count("*").alias("n")))
    return review.weighted_draws(spark, tx.join(sizes, "label").withColumn("units", F.expr("1000000000000 div n")), 2000, 7, "units")


_LINKS = "lk AS (SELECT DISTINCT node, nx FROM (SELECT sender AS node, receiver AS nx FROM ev UNION ALL SELECT receiver, sender FROM ev) WHERE node <> nx)"


def _walk_sql(length: int) -> str:
    out = f"WITH {EV}, {_LINKS}, p AS (SELECT node, nx, row_number() OVER (PARTITION BY node ORDER BY nx) - 1 AS place, count(*) OVER (PARTITION BY node) AS degree FROM lk), w0 AS (SELECT DISTINCT sender AS root, k::INT AS walk, sender AS node FROM ev, range(2) x(k) WHERE tx_id % 10 = 3)"
    for k in range(1, length + 1):
        draw = _hex(f"concat_ws('-', 7, root, walk, {k})")
        out += f", w{k} AS (SELECT root, walk, p.nx AS node FROM w{k - 1} w JOIN p ON p.node = w.node AND p.place = {draw} % p.degree)"
    return out + " " + " UNION ALL ".join(f"SELECT root, walk, {k} AS step, node FROM w{k}" for k in range(length + 1))


@query(_walk_sql(4))
def graph_walks(spark, sf_dir):
    tx = _events(spark, sf_dir)
    return graph.random_walks(spark, tx, tx.where("tx_id % 10 = 3").select(F.col("sender").alias("node")).distinct(), 4, 2)


def _sample_sql(fanouts: list[int]) -> str:
    out = f"WITH {EV}, {_LINKS}, f0 AS (SELECT DISTINCT sender AS root, sender AS node FROM ev WHERE tx_id % 50 = 3)"
    for hop, k in enumerate(fanouts, 1):
        draw = _hex(f"concat_ws('-', 7, root, {hop}, f.node, nx)")
        out += f", s{hop} AS (SELECT root, node, nx FROM (SELECT root, f.node, nx, row_number() OVER (PARTITION BY root, f.node ORDER BY {draw}, nx) AS r FROM f{hop - 1} f JOIN lk ON lk.node = f.node) WHERE r <= {k}), f{hop} AS (SELECT DISTINCT root, nx AS node FROM s{hop})"
    return out + " " + " UNION ALL ".join(f"SELECT root, {h} AS hop, node, nx AS next FROM s{h}" for h in range(1, len(fanouts) + 1))


@query(_sample_sql([5, 3]))
def graph_sampled_neighbours(spark, sf_dir):
    tx = _events(spark, sf_dir)
    return graph.sampled_neighbours(spark, tx, tx.where("tx_id % 50 = 3").select(F.col("sender").alias("node")).distinct(), [5, 3])


def _profile_sql() -> str:
    parts = []
    for c, kind in (("few", "double"), ("tx_id", "bigint"), ("kind", "string"), ("split", "string")):
        number = kind != "string"
        known = f"NOT coalesce(isnan({c}), true)" if kind == "double" else f"{c} IS NOT NULL"
        stats = f"min({c}) FILTER ({known})::DOUBLE AS low, max({c}) FILTER ({known})::DOUBLE AS high, round(avg({c}) FILTER ({known}), 6) AS mean, NULL::VARCHAR AS top_values" if number else f"NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS mean, (SELECT '{{' || string_agg('\"' || v || '\":' || n, ',' ORDER BY n DESC, v) || '}}' FROM (SELECT {c} AS v, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) AS top_values"
        parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) FILTER ({known}) AS non_null, count(*) - count(*) FILTER ({known}) AS missing, round((count(*) - count(*) FILTER ({known})) / count(*), 6) AS missing_rate, count(DISTINCT {c}) FILTER ({known}) AS n_unique, {stats} FROM d")
    return f"WITH {DT} " + " UNION ALL ".join(parts)


@query(_profile_sql())
def column_profile(spark, sf_dir):
    p = review.column_profile(_dirty(spark, sf_dir), ["few", "tx_id", "kind", "split"])
    return rounded(p.withColumns({"low": F.col("low").cast("double"), "high": F.col("high").cast("double")}))


_BASE = ("fmt", "sender_bank", "receiver_bank", "sender", "receiver")


@query(f"""WITH {SP}, {", ".join(f"v_{c} AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS code FROM (SELECT DISTINCT {c}::VARCHAR AS c FROM t WHERE split = 'train'))" for c in _BASE)}
SELECT tx_id, round(ln(1 + amount), 6) AS base__amount_log1p, round(amount::DOUBLE, 6) AS base__amount, {", ".join(f"coalesce(v_{c}.code, -1)::INT AS base__{c}__code" for c in _BASE)}, (isodow(make_timestamp(us)) - 1)::INT AS base__dayofweek, hour(make_timestamp(us))::INT AS base__hour, (isodow(make_timestamp(us)) >= 6)::INT AS base__is_weekend
FROM t {" ".join(f"LEFT JOIN v_{c} ON v_{c}.c = t.{c}::VARCHAR" for c in _BASE)}""")
def baseline_features(spark, sf_dir):
    """The ten current-row columns."""
    return rounded(build_features(_split(spark, sf_dir), catalog.baseline(categories=_BASE), ("tx_id",)))


_POST = f"""{SP}, a AS (SELECT tx_id, split, coalesce((us - max(us) {_h("sender")}) / 1e6, -1)::DOUBLE AS rec, (count(*) {_h("sender")} = 0)::INT AS first, coalesce(amount / nullif(avg(amount) {_w(86_400_000_000)}, 0), 0)::DOUBLE AS ratio, coalesce(amount / nullif(avg(amount) {_w(86_400_000_000, "receiver")}, 0), 0)::DOUBLE AS back FROM t),
c AS (SELECT quantile_cont(ratio, 0.9999) AS c1, quantile_cont(back, 0.9999) AS c2 FROM a WHERE split = 'train')"""


def _posted(spark, sf_dir):
    value = lambda e: {"entity": e, "value": "amount"}
    specs = [
        FeatureSpec("recency_seconds_since_last", "rec", {"entity": "sender"}), FeatureSpec("is_first_by_entity", "first", {"entity": "sender"}),
        FeatureSpec("cur_vs_mean_ratio", "out__ratio__w1d", value("sender"), {"window": "1d"}), FeatureSpec("cur_vs_mean_ratio", "in__ratio__w1d", value("receiver"), {"window": "1d"}),
    ]
    f = table(spark, build_features(_split(spark, sf_dir), specs, ("tx_id", "split")), "features")
    return fitted.post_stage(f, f.columns, {"rec": "first"})


@query(f"""WITH {_POST} SELECT tx_id, split, CASE WHEN rec = -1 THEN 0 ELSE rec END AS rec, first, round(ratio + {APART}, 6) AS out__ratio__w1d, round(back + {APART}, 6) AS in__ratio__w1d, round(ln(1 + ratio) + {APART}, 6) AS out__ratio__log1p__w1d,
  round(least(ratio, c1) + {APART}, 6) AS out__ratio__clip_train_p9999__w1d, round(ln(1 + back) + {APART}, 6) AS in__ratio__log1p__w1d, round(least(back, c2) + {APART}, 6) AS in__ratio__clip_train_p9999__w1d FROM a, c""")
def post_features(spark, sf_dir):
    return rounded(_posted(spark, sf_dir), apart=APART)


@query(f"WITH {_POST} SELECT 'out__ratio__w1d' AS feature, split, count(*) FILTER (ratio > c1) AS clipped FROM a, c GROUP BY 2 UNION ALL SELECT 'in__ratio__w1d', split, count(*) FILTER (back > c2) FROM a, c GROUP BY 2")
def clip_summary(spark, sf_dir):
    posted = _posted(spark, sf_dir)
    return fitted.clip_summary(posted, ["out__ratio__w1d", "in__ratio__w1d"])


@query(f"WITH {SP}, {_MAP}, d AS (SELECT node, count(*) AS n FROM (SELECT DISTINCT sender AS node, receiver FROM t WHERE split = 'train') GROUP BY 1) SELECT tx_id, a.idx AS from_idx, b.idx AS to_idx, coalesce(x.n, 0)::DOUBLE AS from_out_degree, coalesce(y.n, 0)::DOUBLE AS to_out_degree FROM t JOIN mp a ON a.node = sender JOIN mp b ON b.node = receiver LEFT JOIN d x ON x.node = sender LEFT JOIN d y ON y.node = receiver")
def graph_node_features(spark, sf_dir):
    tx = _split(spark, sf_dir)
    mapping = table(spark, graph.node_map(tx), "nodes")
    edges = graph.formatted_edges(tx, mapping).select("tx_id", "from_idx", "to_idx")
    features = graph.degrees(tx).join(mapping, "node").where("out_degree > 0").select(F.col("idx").alias("node_idx"), "out_degree")  # the others have no row
    return graph.with_node_features(edges, features, ["out_degree"])


@query(f"WITH {SP} SELECT tx_id, split, label, round(amount * 2, 6) AS twice FROM t")
def aligned_parts(spark, sf_dir):
    """Two files of the same rows, joined by id after their metadata were found equal."""
    tx = _split(spark, sf_dir)
    return rounded(validation.align_by_key(tx.select("tx_id", "split", "label"), tx.select("tx_id", "label", "split", (F.col("amount") * 2).alias("twice")), "tx_id", ["split", "label"]))
