"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct word shingles (as 64-bit hashes). Documents with equal sets form a class and join once, by the least doc_id.
Shingles are ordered rare first by counts over all documents, kept in a fixed number of hash buckets (any one order is right; a rare-first
one keeps lists short; a shingle stands out once its count is a few times the root of its bucket's). Two sets that are similar enough share
a shingle among their first few (the prefix), so only those are joined:

1. star: every member of a prefix shingle's list is verified against the list's least member, so a group of near copies costs one
   verification per member, not per pair; verified links give components.
2. rest: lists that still span several components are joined with their members outside the list's main component. A pair inside one
   component needs no check, for the result is components; a pair across them is verified unless a filter proves that it can't link.

Pairs go through the length filter, the positional filter and the suffix filter (the sets' parities by hash slot differ in at most as many
slots as the sets differ in shingles, which bounds the overlap; a set has at least as many slots as shingles, so the filter keeps its force
at any length), are made distinct, and each is then verified once on the whole sets. Where pairs meet, the frequent side (the hub) is sent
once to each of the tasks that share its pairs. Lists, classes and hubs with very many rows are salted or joined by a counted, bounded table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.llm import store
from pastline.llm import textkernel as K
from pastline.llm.components import components

ORDER_BITS = 18
#: Slots of the small sketch that joins carry; the whole one has as many slots as the set has shingles, or up to twice as many.
SLOTS = 512
#: A bucket with this share of all shingles, or more, may hold a list that no single task should get; there are ``1 / HOT_SHARE`` at most.
HOT_SHARE, HOT_LEAST = 1 / (1 << 14), 2000
#: Pairs of one hub, and members of one list, in a task.
HUB_PAIRS = 2000
#: Bytes of text that a kernel takes at once.
SLICE = 1 << 20


@dataclass(frozen=True)
class Params:
    """``words`` per shingle; sets link when ``100 * intersection >= percent * union``."""

    words: int = 5
    percent: int = 80


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, and the shingles before each row. A row of fewer words has its whole sequence as one."""
    lower = K.LOWER[data]
    starts, ends, before = K.word_spans(lower, offsets)
    hashes = K.span_hash(lower, starts, ends)
    full, at = K.window_hash(hashes, before, words)
    row = np.searchsorted(before, at, "right") - 1
    n_words = np.diff(before)
    for n in range(1, words):
        short = np.flatnonzero(n_words == n)
        if len(short):
            h = hashes[before[short]].copy()
            for j in range(1, n):
                h = h * np.uint64(0xE7037ED1A0B428DB) + hashes[before[short] + j]
            full, row = np.append(full, K.mix(h + np.uint64(n))), np.append(row, short)
    order = np.argsort(row, kind="stable") if len(row) and (np.diff(row) < 0).any() else slice(None)
    full, row = full[order], row[order]
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    parts = [np.unique(full[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else full), np.concatenate([[0], np.cumsum(sizes)])


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def _batches(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shingle_counts(docs: DataFrame, params: Params) -> np.ndarray:
    """How many documents have a shingle of each bucket, over all documents: a fixed number of buckets whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for at, to in K.slices(offsets, SLICE):
                lower = K.LOWER[data[offsets[at] : offsets[to]]]
                starts, ends, before = K.word_spans(lower, offsets[at : to + 1] - offsets[at])
                shingles, _ = K.window_hash(K.span_hash(lower, starts, ends), before, params.words)
                total += np.bincount(_bucket(shingles), minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    rows = _batches(docs).select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << ORDER_BITS, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer slots: parities of slots that become one are added."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def profiles(docs: DataFrame, params: Params, counts) -> DataFrame:
    """Per row: set size, a 128-bit key of the set, its rare-first prefix (from ``cold`` on: in hot buckets), the parities of its shingles
    by hash slot, and those of ``SLOTS`` slots. ``counts``: a broadcast."""
    schema = "doc_id long, n long, ka long, kb long, prefix array<long>, cold int, sketch binary, small array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = counts.value
        hot = max(HOT_LEAST, HOT_SHARE * rare.sum())
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for at, to in K.slices(offsets, SLICE):
                flat, bounds = _sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], params.words)
                frequency = rare[_bucket(flat)]
                keys = [K.mix(flat ^ np.uint64(c)) for c in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)]
                prefixes, cold, whole, sums, small = [], [], [], [[], []], np.zeros((to - at, SLOTS // 8), np.uint8)
                for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    n = b - a
                    for k in range(2):
                        sums[k].append(int(np.bitwise_xor.reduce(keys[k][a:b] * np.uint64(2 * n + 1)).view(np.int64)) if n else 0)
                    take = n - -(-params.percent * n // 100) + 1 if n else 0
                    order = np.argsort(frequency[a:b] * 1.0 + flat[a:b].astype(np.float64) / 2.0**65, kind="stable")[:take] if n else np.zeros(0, int)
                    prefixes.append(flat[a:b][order].view(np.int64))
                    cold.append(int(np.searchsorted(frequency[a:b][order], hot, "right")))
                    slots = 1 << max(9, (n - 1).bit_length())
                    odd = np.bincount((flat[a:b] & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
                    bits = np.packbits(odd.astype(np.uint8))
                    whole.append(bits.tobytes())
                    small[row] = _fold(bits, SLOTS // 8)
                lengths = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                width = np.arange(0, SLOTS // 64 * (to - at) + 1, SLOTS // 64, dtype=np.int32)
                arrays = [batch.column("doc_id").slice(at, to - at), pa.array(np.diff(bounds)), *(pa.array(s, pa.int64()) for s in sums), pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(prefixes)))]
                arrays += [pa.array(cold, pa.int32()), pa.array(whole, pa.binary()), pa.ListArray.from_arrays(pa.array(width), pa.array(small.reshape(-1).view(np.int64)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "ka", "kb", "prefix", "cold", "sketch", "small"])

    return _batches(docs).mapInArrow(run, schema)


def _least_overlap(params: Params, a: int, b: int) -> int:
    """The least intersection of linked sets of sizes ``a`` and ``b``."""
    return -(-params.percent * (a + b) // (100 + params.percent))


def _needed(params: Params, a: Column, b: Column) -> Column:
    return F.ceil(params.percent * (a + b) / F.lit(100.0 + params.percent) - 1e-9)


def _may_link(params: Params, an: Column, ai: Column, bn: Column, bi: Column) -> Column:
    """Length and positional filters for sets that share the shingle at places ``ai`` and ``bi`` of their orders."""
    length = (100 * F.least(an, bn)) >= params.percent * F.greatest(an, bn)
    place = F.least(ai, bi) + 1 + F.least(an - ai, bn - bi) - 1
    return length & (place >= _needed(params, an, bn))


def _small_filter(params: Params, an: Column, asketch: Column, bn: Column, bsketch: Column) -> Column:
    """Slots with different parities hold a shingle of one set alone, so too many of them leave no room for a link."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(asketch[k].bitwiseXOR(bsketch[k])) for k in range(SLOTS // 64)])
    return apart <= an + bn - 2 * _needed(params, an, bn)


def _by_sketch(params: Params) -> Callable[[bytes, bytes], bool]:
    """The suffix filter on whole sketches (8 bytes of set size, then the parities)."""

    def near(x: bytes, y: bytes) -> bool:
        n = int.from_bytes(x[:8], "big") + int.from_bytes(y[:8], "big")
        p, q = np.frombuffer(x, np.uint8, offset=8), np.frombuffer(y, np.uint8, offset=8)
        apart = int(np.bitwise_count(_fold(p, len(q)) ^ _fold(q, len(p))).sum())
        return apart <= n - 2 * _least_overlap(params, n, 0)

    return near


def _by_set(params: Params) -> Callable[[bytes, bytes], bool]:
    def linked(x: bytes, y: bytes) -> bool:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if not len(p) or not len(q):
            return False
        at = np.minimum(np.searchsorted(q, p), len(q) - 1)
        return int((q[at] == p).sum()) >= _least_overlap(params, len(p), len(q))

    return linked


def _meet(spark: SparkSession, pairs: DataFrame, what: DataFrame, same: Callable[[bytes, bytes], bool], name: str) -> DataFrame:
    """The ``pairs`` (``a, b``, stored) for whose values in ``what`` (``rep, value``, stored) ``same`` holds, stored.

    The value of ``a`` is sent with each pair, that of ``b`` once for all pairs of a task; a ``b`` with many pairs is salted. A rep with
    several values (rows of one doc_id with different texts) holds if any of them does.
    """
    heavy = store.table(spark, pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > max(HUB_PAIRS, pairs.count() // store.HEAVY_KEYS)), "hubs")  # HEAVY_KEYS at most
    sends = heavy.select("b", F.ceil(F.col("n") / HUB_PAIRS).cast("int").alias("salts"))
    left = pairs.join(F.broadcast(sends), "b", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"), F.lit(0))).select("a", "b", "salt")
    right = left.select("b", "salt").distinct().join(what.select(F.col("rep").alias("b"), "value"), "b")
    rows = left.join(what.select(F.col("rep").alias("a"), "value"), "a").select("b", "salt", "a", "value").unionByName(right.select("b", "salt", F.lit(None).cast("long").alias("a"), "value"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, values = None, []
        for batch in batches:
            b, a, value = batch.column("b").to_pylist(), batch.column("a").to_pylist(), batch.column("value")
            ok = np.zeros(len(b), bool)
            for i in range(len(b)):
                now = value[i].as_py()
                if b[i] != hub:
                    hub, values = b[i], []
                if a[i] is None:
                    if now not in values:
                        values.append(now)
                else:
                    ok[i] = any(same(now, v) for v in values)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    met = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first()).mapInArrow(check, "a long, b long")
    out = store.table(spark, met.distinct(), name)
    store.drop(spark, heavy)
    return out


def _verify(spark: SparkSession, docs: DataFrame, pairs: DataFrame, params: Params) -> DataFrame:
    """The ``pairs`` that link, on their whole sets. Only texts in some pair get their set built, once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for at, to in K.slices(offsets, SLICE):
                flat, bounds = _sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], params.words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array([flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["rep", "value"])

    wanted = store.few(spark, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    sets = store.table(spark, _batches(docs).join(wanted, "doc_id", "left_semi").mapInArrow(build, "rep long, value binary"), "sets")
    links = _meet(spark, pairs, sets, _by_set(params), "links")
    store.drop(spark, sets)
    return links


def _lists(postings: DataFrame) -> DataFrame:
    """Postings of the shingles that two sets or more have in their prefix, each with its list's least member (``least``).

    The postings are dealt and sorted by shingle once and stream by, so a list of any length is never held.
    """
    schema = "shingle long, rep long, n long, i int, least struct<rep: long, n: long, i: int>"
    fields = [pa.field("rep", pa.int64()), pa.field("n", pa.int64()), pa.field("i", pa.int32())]
    names = ("shingle", "rep", "n", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, least, shared = None, None, False  # the last row so far, its list's least member, and whether the list has two rows

        def emit(rows: list[np.ndarray], first: list[np.ndarray]) -> pa.RecordBatch:
            arrays = [pa.array(x) for x in rows]
            return pa.RecordBatch.from_arrays([*arrays, pa.StructArray.from_arrays([pa.array(x) for x in first], fields=fields)], names=[*names, "least"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
            key = rows[0]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            heads = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            size = np.bincount(of)
            many = size > 1
            first = [x[heads].copy() for x in rows[1:]]
            if held is not None:
                many[0] |= shared
                for x, v in zip(first, least, strict=True):
                    x[0] = v
            out = many[of]
            out[-1] = False  # the last row waits for the next batch
            if out.any():
                yield emit([x[out] for x in rows], [x[of[out]] for x in first])
            held, least, shared = [x[-1:] for x in rows], [x[-1] for x in first], bool(many[-1])
        if shared:
            yield emit(held, [np.array([v], h.dtype) for v, h in zip(least, held[1:], strict=True)])

    return postings.select(*names).repartition("shingle").sortWithinPartitions("shingle", "rep").mapInArrow(run, schema)


def _shared(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """Stored postings ``shingle, rep, n, i, least`` of all lists of two sets or more. Lists with very many members are found by counts of the
    hot buckets' postings; their least members are few (``HOT_SHARE``) and go to where the postings are."""
    postings = classes.select("rep", "n", "cold", F.posexplode("prefix").alias("i", "shingle"))
    hot = postings.where(F.col("i") >= F.col("cold")).select("shingle", "rep", "n", "i")
    heads = hot.groupBy("shingle").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n", "i")).alias("least")).where(F.col("size") > HOT_LEAST // 2)
    heads = store.table(spark, heads, "heads")
    most = F.broadcast(heads.select("shingle", "least"))
    streamed = postings.where(F.col("i") < F.col("cold")).select("shingle", "rep", "n", "i").unionByName(hot.join(most, "shingle", "left_anti"))
    live = store.table(spark, _lists(streamed).unionByName(hot.join(most, "shingle").select("shingle", "rep", "n", "i", "least")), "lists")
    store.drop(spark, heads)
    return live


def _across(spark: SparkSession, live: DataFrame, found: DataFrame, small: DataFrame, params: Params) -> DataFrame:
    """Pairs of one list but different components that the filters let through; each has a member outside the list's main component."""
    of = live.select("shingle", "rep", "n", "i").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = of.groupBy("shingle", "component").count()
    mixed = sizes.groupBy("shingle").agg(F.count("*").alias("parts"), F.sum("count").alias("size"), F.max(F.struct("count", "component")).alias("main")).where(F.col("parts") > 1)
    mixed = store.table(spark, mixed.select("shingle", "size", F.col("main.component").alias("main")), "mixed")
    open_ = store.spread_join(of, mixed, ["shingle"], "size", live.count()).withColumn("salts", F.ceil(F.col("size") / HUB_PAIRS).cast("int"))
    open_ = store.table(spark, open_.join(small, "rep"), "open")
    left = open_.where(F.col("component") != F.col("main")).select("shingle", F.col("rep").alias("a"), F.col("n").alias("an"), F.col("i").alias("ai"), F.col("component").alias("ac"), F.col("small").alias("ask"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = open_.select("shingle", F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("i").alias("bi"), F.col("component").alias("bc"), F.col("small").alias("bsk"), "main", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"))
    once = (F.col("bc") == F.col("main")) | (F.col("a") > F.col("b"))
    room = _may_link(params, F.col("an"), F.col("ai"), F.col("bn"), F.col("bi")) & _small_filter(params, F.col("an"), F.col("ask"), F.col("bn"), F.col("bsk"))
    across = left.join(right, ["shingle", "salt"]).where((F.col("ac") != F.col("bc")) & once & room)
    pairs = store.table(spark, across.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "across")
    store.drop(spark, mixed, open_)
    return pairs


def near_duplicates(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id, text``; other columns are not read).

    ``component_id`` is the least doc_id that links lead to. A null text, or one without words, has no set, links with nothing and is its own
    component. Rows of one doc_id, equal or not, are one document: it links by any of its texts, and each row has its own set's size. A row
    without doc_id has a null component. Texts of any length take their whole set; ties (equal sets) form a class by the least doc_id.
    An empty table gives an empty result.
    """
    store.small_batches(spark)
    shared = spark.sparkContext.broadcast(shingle_counts(docs, params))  # 2 ** ORDER_BITS numbers
    all_docs = store.table(spark, profiles(docs, params, shared), "profiles")
    full = all_docs.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    key = ["n", "ka", "kb"]
    keys = store.table(spark, full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")
    reps = full.join(keys.select(F.col("rep").alias("doc_id"), *key), ["doc_id", *key], "left_semi").dropDuplicates(["doc_id", *key])
    classes = store.table(spark, reps.select(F.col("doc_id").alias("rep"), "n", "prefix", "cold", "sketch", "small"), "sets")
    live = _shared(spark, classes)
    in_lists = store.table(spark, classes.select("rep", "n", "sketch", "small").join(live.select("rep").distinct(), "rep", "left_semi"), "sketches")
    store.drop(spark, classes)
    sketches = in_lists.select("rep", F.concat(F.unhex(F.lpad(F.hex("n"), 16, "0")), "sketch").alias("value"))

    star = live.where(F.col("rep") != F.col("least.rep")).where(_may_link(params, F.col("n"), F.col("i"), F.col("least.n"), F.col("least.i")))
    star = store.table(spark, star.select(F.col("rep").alias("a"), F.col("least.rep").alias("b")).distinct(), "star")
    tried = _meet(spark, star, sketches, _by_sketch(params), "pairs")
    links = _verify(spark, docs, tried, params)
    several = full.groupBy("doc_id").agg(F.min("ka").alias("lo"), F.max("ka").alias("hi")).where(F.col("lo") != F.col("hi")).select("doc_id")
    several = store.table(spark, full.select("doc_id", *key).join(several, "doc_id").join(keys.select("rep", *key), key).select("doc_id", "rep"), "several")
    if not several.isEmpty():  # ids with different texts: their classes are one component
        links = links.unionByName(several.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a != b"))
    found = components(spark, links)

    across = _across(spark, live, found, in_lists.select("rep", "small"), params)
    untried = store.table(spark, across.join(star, ["a", "b"], "left_anti"), "untried")
    rest = _meet(spark, untried, sketches, _by_sketch(params), "rest")
    if not rest.isEmpty():
        more = _verify(spark, docs, rest, params)
        if not more.isEmpty():
            found = components(spark, found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    store.drop(spark, live, in_lists, star, tried, across, untried, rest)
    of = keys.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*key, "size", F.coalesce("component", "rep").alias("component_id"))
    named = store.spread_join(full.select("doc_id", *key), store.table(spark, of, "classes"), key, "size", all_docs.count()).select("doc_id", "n", "component_id")
    alone = all_docs.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
