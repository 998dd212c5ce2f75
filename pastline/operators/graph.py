"""Account graph: edges, degrees, amounts, PageRank, ports, time deltas, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastline.operators import draws
from pastline.plans.checkpoint import drop, table
from pastline.plans.ordered import numbered, numbered_within, previous
from pastline.sources.tables import InputError


def nodes(tx: DataFrame) -> DataFrame:
    return tx.select(F.col("sender").alias("node")).unionByName(tx.select(F.col("receiver").alias("node"))).distinct()


def degrees(tx: DataFrame) -> DataFrame:
    """In and out degree over distinct directed pairs of the train split; every node has a row."""
    pairs = tx.where(F.col("split") == "train").select("sender", "receiver").distinct()
    out, into = pairs.groupBy(F.col("sender").alias("node")).agg(F.count("*").alias("out_degree")), pairs.groupBy(F.col("receiver").alias("node")).agg(F.count("*").alias("in_degree"))
    return nodes(tx).join(out, "node", "left").join(into, "node", "left").na.fill(0, ["out_degree", "in_degree"])


def amounts(tx: DataFrame) -> DataFrame:
    """log1p of the sums each node sent and received in the train split."""
    t = tx.where(F.col("split") == "train")
    out, into = t.groupBy(F.col("sender").alias("node")).agg(F.sum("amount").alias("o")), t.groupBy(F.col("receiver").alias("node")).agg(F.sum("amount").alias("i"))
    log = lambda c: F.log1p(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)))
    return nodes(tx).join(out, "node", "left").join(into, "node", "left").select("node", log("o").alias("out_amount_log1p"), log("i").alias("in_amount_log1p"))


def pagerank(spark: SparkSession, tx: DataFrame, damping: float = 0.85, iterations: int = 100, tol: float = 1e-6) -> DataFrame:
    """Unweighted, over distinct train pairs; rank of nodes without out-links is spread evenly. Stops at the first step whose total change is
    below ``nodes * tol`` (0: never). Each step is stored, so a step's plan reads the last one and no more."""
    pairs = tx.where(F.col("split") == "train").select("sender", "receiver").distinct()
    edges = table(spark, pairs.join(pairs.groupBy("sender").agg(F.count("*").alias("n")), "sender"), "edges")
    rank = nodes(tx).join(edges.select(F.col("sender").alias("node")).distinct().withColumn("links", F.lit(True)), "node", "left")
    rank = table(spark, rank, "nodes")
    n = rank.count()
    rank, stored = rank.withColumn("rank", F.lit(1.0 / n)), rank
    for _ in range(iterations):
        given = edges.join(rank.select(F.col("node").alias("sender"), "rank"), "sender").groupBy(F.col("receiver").alias("node")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        loose = F.broadcast(rank.agg(F.coalesce(F.sum(F.when(F.col("links").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose")))  # one row
        after = rank.join(given, "node", "left").join(loose).select("node", "links", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"), F.col("rank").alias("was"))
        after = table(spark, after, "rank")
        drop(spark, stored)  # the step before is read no more
        rank, stored = after.drop("was"), after
        if tol and after.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < n * tol:
            break
    return rank.select("node", "rank")


def node_map(tx: DataFrame) -> DataFrame:
    """``node, idx``: all accounts, senders and receivers, in order from 0."""
    return numbered(tx.sparkSession, nodes(tx), ["node"], "idx")


def formatted_edges(tx: DataFrame, mapping: DataFrame) -> DataFrame:
    """``tx_id, from_id, to_id, from_idx, to_idx, amount, us, split, label`` with both accounts looked up; sort at the sink."""
    one, two = mapping.toDF("from_id", "from_idx"), mapping.toDF("to_id", "to_idx")
    e = tx.select("tx_id", F.col("sender").alias("from_id"), F.col("receiver").alias("to_id"), "amount", "us", "split", "label")
    return e.join(one, "from_id", "left").join(two, "to_id", "left").select("tx_id", "from_id", "to_id", "from_idx", "to_idx", "amount", "us", "split", "label")


def with_node_features(edges: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """``edges`` (``from_idx, to_idx`` ...) with both nodes' ``columns`` of ``features`` (``node_idx``), as ``from_*`` and ``to_*``; 0 for a node without a
    row or a value. Column names may not hide those of the edges. A repeated ``node_idx`` is an error."""
    made = [f"{side}_{c}" for side in ("from", "to") for c in columns]
    if set(made) & set(edges.columns):
        raise InputError(f"{', '.join(sorted(set(made) & set(edges.columns)))} would be hidden")
    once = features.groupBy("node_idx").agg(F.count("*").alias("_n"), *[F.max(F.col(c).cast("double")).alias(c) for c in columns])
    once = once.select("node_idx", *[F.when(F.col("_n") > 1, F.raise_error(F.lit("a node has several rows of features")).cast("double")).otherwise(F.coalesce(c, F.lit(0.0))).alias(c) for c in columns])
    out = edges
    for side in ("from", "to"):
        mine = once.select(F.col("node_idx").alias("_node"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        out = out.join(mine, F.col(f"{side}_idx") == F.col("_node"), "left").drop("_node")
    return out.na.fill(0.0, made).select(*edges.columns, *made)


def feature_metadata(columns: list[tuple[str, str]], kind: str) -> list[dict]:
    """For each (name, type) of an ``edge`` or ``node`` table: is it a feature, where it comes from, how it could leak, what a null becomes. By names
    (fixed values)."""
    node = {
        **dict.fromkeys(("train_only_pagerank",), ("unweighted_pagerank", "fit_on_train_split_edges_only", "fill_0_for_val_test_only_node")), **dict.fromkeys(("train_only_in_degree", "train_only_out_degree"), ("train_edge_graph", "train_split_edges_only", "fill_0_for_val_test_only_node")),
        **dict.fromkeys(("train_only_in_amount_sum_log1p", "train_only_out_amount_sum_log1p"), ("train_edge_aggregation", "train_split_edges_only", "fill_0_for_val_test_only_node")),
    }
    row = ("current_transaction_row", "low", "as_is_or_current_row_transform")
    current = ("amount", "amount__current__log1p", "amount_received__current__value", "amount_received__current__log1p", "cat__payment_currency__code", "cat__receiving_currency__code", "cat__payment_format__code")
    time = ("time__row__hour", "time__row__dayofweek", "time__row__is_weekend")
    out = []
    for name, dtype in columns:
        if kind == "node":
            used = name not in ("node_idx", "account_id")
            source, risk, null = node.get(name, ("identifier_or_status", "review" if used else "not_model_feature", "not_applicable"))
        else:
            used = name not in ("from_id", "to_id", "split", "label")
            if not used:
                source, risk, null = "metadata_or_edge_endpoint", "not_model_feature", "must_not_null" if name in ("from_id", "to_id") else "not_applicable"
            elif name.startswith("pair_"):
                source, risk, null = "safe_pair_history", "low_if_past_timestamp_only", "fill_0_when_no_past_pair_history"
            else:
                source, risk, null = ("timestamp_derived", "low", "not_null") if name in time else row if name in current else ("edge_feature_candidate", "review", "review")
        out.append({"column_name": name, "dtype": dtype, "used": used, "source": source, "leakage": risk, "null_policy": null})
    return out


def graph_checks(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """``check, violations`` of a formatted edge list and its account mapping; every check has a row. An edge of val or test must come after all
    edges of the splits before it."""
    split, us = F.col("split"), F.col("us")
    ends = edges.agg(F.max(F.when(split == "train", us)).alias("train_end"), F.max(F.when(split.isin("train", "val"), us)).alias("val_end"))
    e = edges.join(F.broadcast(ends)).agg(  # one row
        F.count_if(F.col("from_idx").isNull() | F.col("to_idx").isNull()).alias("edge without node"), F.count_if(F.col("tx_id").isNull()).alias("edge without id"),
        (F.count("tx_id") - F.countDistinct("tx_id")).alias("repeated edge id"), F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("label that is not 0 or 1"),
        F.count_if(split.isNull() | ~split.isin("train", "val", "test")).alias("unknown split"), F.count_if(us.isNull()).alias("edge without time"),
        F.count_if(((split == "val") & (us <= F.col("train_end"))) | ((split == "test") & (us <= F.col("val_end")))).alias("edge before an earlier split ends"),
    )
    m = mapping.agg((F.count("*") - F.countDistinct("node")).alias("repeated node"), (F.count("idx") - F.countDistinct("idx")).alias("repeated index"), F.count_if(F.col("idx").isNull()).alias("node without index"))
    both = e.join(m)  # one row each
    pairs = ", ".join(f"'{c}', `{c}`" for c in both.columns)
    return both.select(F.expr(f"stack({len(both.columns)}, {pairs}) as (check, violations)"))


def edges_with_ports(tx: DataFrame) -> DataFrame:
    """Edges with ports and time deltas, and their reversed copies, in which in and out change places."""
    e = tx.select("tx_id", "sender", "receiver").join(ports(tx), "tx_id").join(time_deltas(tx), "tx_id")
    names = ("tx_id", "src", "dst", "in_port", "out_port", "in_delta", "out_delta", "reversed")
    forward = e.select("tx_id", "sender", "receiver", "in_port", "out_port", "in_delta", "out_delta", F.lit(0)).toDF(*names)
    return forward.unionByName(e.select("tx_id", "receiver", "sender", "out_port", "in_port", "out_delta", "in_delta", F.lit(1)).toDF(*names))


def ego_flags(tx: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node, ego`` of all nodes: 1 for both ends of the seed edges (``tx_id``)."""
    ends = nodes(tx.join(seeds.select("tx_id").distinct(), "tx_id", "left_semi")).withColumn("ego", F.lit(1))
    return nodes(tx).join(ends, "node", "left").na.fill(0, ["ego"])


def ports(tx: DataFrame) -> DataFrame:
    """Each edge's place of its sender among the receiver's senders by first contact (ties by edge id), and the other way round. Places are counted
    over ranges, so a hub is in many tasks."""
    spark = tx.sparkSession
    contact = tx.groupBy("sender", "receiver").agg(F.min(F.struct("us", "tx_id")).alias("first"))
    contact = table(spark, contact.select("sender", "receiver", F.col("first.us").alias("us"), F.col("first.tx_id").alias("tx_id")), "contacts")
    into = numbered_within(spark, contact, "receiver", ["us", "tx_id"], "in_port").select("sender", "receiver", F.col("in_port").cast("int"))
    out = numbered_within(spark, contact, "sender", ["us", "tx_id"], "out_port").select("sender", "receiver", F.col("out_port").cast("int"))
    return tx.join(into.join(out, ["sender", "receiver"]), ["sender", "receiver"]).select("tx_id", "in_port", "out_port")


def time_deltas(tx: DataFrame) -> DataFrame:
    """Whole seconds since the previous edge of the receiver and of the sender; 0 for the first. The edge before comes from ranges of node, time and
    id, so a hub is in many tasks."""
    out = []
    for node, name in (("receiver", "in_delta"), ("sender", "out_delta")):
        found = previous(tx.sparkSession, tx.select("tx_id", node, "us"), [node, "us", "tx_id"], {"_node": F.col(node), "_us": F.col("us")})
        gap = F.when(F.col("_node").eqNullSafe(F.col(node)), F.floor((F.col("us") - F.col("_us")) / 1e6)).otherwise(0)
        out.append(found.select("tx_id", F.coalesce(gap, F.lit(0)).cast("long").alias(name)))
    return out[0].join(out[1], "tx_id")


def with_reverse(tx: DataFrame) -> DataFrame:
    """Edges and their reversed copies."""
    forward = tx.select("tx_id", F.col("sender").alias("src"), F.col("receiver").alias("dst"), F.lit(0).alias("reversed"))
    return forward.unionByName(tx.select("tx_id", F.col("receiver").alias("src"), F.col("sender").alias("dst"), F.lit(1).alias("reversed")))


def khop(tx: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` undirected steps of ``seeds`` (``node``) and their distance. The links and each step are stored."""
    spark = tx.sparkSession
    links = tx.select(F.col("sender").alias("node"), F.col("receiver").alias("next")).unionByName(tx.select(F.col("receiver").alias("node"), F.col("sender").alias("next"))).distinct()
    links = table(spark, links, "links")
    seen = table(spark, seeds.select("node").distinct().withColumn("hop", F.lit(0)), "seen")
    for h in range(1, hops + 1):
        fresh = seen.where(F.col("hop") == h - 1).join(links, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(h))
        seen = table(spark, seen.unionByName(fresh), "seen")
    return seen


def last_neighbours(tx: DataFrame, k: int) -> DataFrame:
    """The ``k`` latest edges of each receiver."""
    return tx.select("tx_id", "receiver", F.row_number().over(Window.partitionBy("receiver").orderBy(F.desc("us"), F.desc("tx_id"))).alias("place")).where(F.col("place") <= k)


#: Links of a node, and roots that have reached it, that meet at once, about.
LINK_BLOCK, ROOT_BLOCK = 1 << 14, 1 << 10
#: Neighbours whose hash is below the limit that a sample is first sought under, about: for each one wanted, and besides.
HITS = (4.0, 16.0)


def _hash(*parts: object) -> Column:
    """The first 60 bits of the MD5 of the parts joined by ``-``, as 15 hex digits: they sort as the number does."""
    text = F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.substring(F.md5(text), 1, 15)


def _draw(*parts: object) -> Column:
    """60 bits of the MD5 of the parts joined by ``-``: the same in any engine."""
    return F.conv(_hash(*parts), 16, 10).cast("long")


def links(tx: DataFrame) -> DataFrame:
    """``node, next``: distinct undirected links, in both directions, without loops."""
    both = tx.select(F.col("sender").alias("node"), F.col("receiver").alias("next")).unionByName(tx.select(F.col("receiver").alias("node"), F.col("sender").alias("next")))
    return both.where("node <> next").distinct()


def random_walks(spark: SparkSession, tx: DataFrame, seeds: DataFrame, length: int, walks: int = 1, seed: int = 7) -> DataFrame:
    """``root, walk, step, node``: ``walks`` walks over undirected links from each of ``seeds`` (``node``), of ``length`` steps; one ends early at a node
    without links.

    Links are numbered within their node over ranges; a step draws a number below the node's degree by a seeded hash of (root, walk, step)
    and joins on (node, number), so a hub's walks meet as many keys as it has links. Equal seeds give equal walks at any partitioning.
    """
    placed = table(spark, numbered_within(spark, links(tx), "node", ["next"], "place"), "links")
    degree = table(spark, placed.groupBy("node").agg(F.count("*").alias("degree")), "degrees")
    each = F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk")
    now = table(spark, seeds.select(F.col("node").alias("root"), each).select("root", "walk", F.lit(0).alias("step"), F.col("root").alias("node")), "walks")
    every = now
    for k in range(1, length + 1):
        drawn = now.join(degree, "node").select("root", "walk", "node", F.pmod(_draw(seed, F.col("root"), F.col("walk"), k), F.col("degree")).alias("place"))
        now = table(spark, drawn.join(placed, ["node", "place"]).select("root", "walk", F.lit(k).alias("step"), F.col("next").alias("node")), "walks")
        every = every.unionByName(now)
    return every


def sampled_neighbours(spark: SparkSession, tx: DataFrame, seeds: DataFrame, fanouts: list[int], seed: int = 7) -> DataFrame:
    """``root, hop, node, next``: from each of ``seeds`` (``node``), per hop and reached node as many of its undirected neighbours as ``fanouts`` says,
    those with the least seeded hash of (root, hop, node, neighbour). A node reached twice in a hop is sampled once. Accounts are numbers or text."""
    around = table(spark, links(tx), "links")
    degree = table(spark, around.groupBy("node").agg(F.count("*").alias("degree")), "degrees")
    block = lambda column, n, size: F.pmod(F.xxhash64(column), F.ceil(F.col(n) / size)).alias("block")
    dealt = around.join(degree, "node").groupBy("node", block("next", "degree", LINK_BLOCK)).agg(F.collect_list(F.col("next").cast("string")).alias("nexts"))
    dealt = table(spark, dealt.drop("block"), "blocks")  # lists of LINK_BLOCK, about
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now = seeds.select(F.col("node").alias("root"), F.col("node")).distinct()
    every = None
    for hop, k in enumerate(fanouts, 1):
        now = table(spark, now.join(degree, "node"), "reached")
        order = Window.partitionBy("root", "node").orderBy("draw", "next")
        kinds = {"root": now.schema["root"].dataType, "node": now.schema["node"].dataType, "next": around.schema["next"].dataType}

        def least(rows: DataFrame, hits: float | None, hop=hop, k=k, order=order, kinds=kinds) -> DataFrame:
            share = F.lit(None).cast("double") if hits is None else F.when(F.col("degree") > hits, F.lit(hits) / F.col("degree"))
            reached = rows.groupBy("node").agg(F.count("*").alias("reached"))
            roots = rows.join(reached, "node").groupBy("node", "degree", block("root", "reached", ROOT_BLOCK)).agg(F.collect_list(F.col("root").cast("string")).alias("roots"))
            # So few rows bear so much work that Spark would join their partitions to one.
            meet = roots.join(dealt, "node").select(F.col("node").cast("string").alias("node"), share.alias("share"), "roots", "nexts").repartition(parts)
            met = draws.drawn(meet, seed, hop, k).select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()], "draw")
            return met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")

        # Hashes below a limit, ``HITS`` for each, are dealt out; whoever finds fewer than k is met again, for the k least of each block.
        with draws.small_batches(spark):
            first = table(spark, least(now, HITS[0] * k + HITS[1]), "sampled")
        done = first.groupBy("root", "node").agg(F.count("*").alias("found"))
        short = now.join(done, ["root", "node"], "left").where(F.coalesce("found", F.lit(0)) < F.least(F.lit(k), F.col("degree"))).select("root", "node", "degree")
        with draws.small_batches(spark):
            again = table(spark, least(short, None), "sampled")
        found = first.join(short, ["root", "node"], "left_anti").unionByName(again).select("root", F.lit(hop).alias("hop"), "node", "next")
        every = found if every is None else every.unionByName(found)
        now = found.select("root", F.col("next").alias("node")).distinct()
    return every
