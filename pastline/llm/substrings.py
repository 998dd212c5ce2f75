"""Substring dedup by prefix-partitioned suffix trees, cut below the window length.

Every word position begins a suffix. A tree node of depth ``WINDOW`` holds the suffixes that begin with the same ``WINDOW`` words; its first
leaf in the order of documents is where they come from. Four steps keep this within memory and disk at any size, and none loses a repeat:

1. candidates: each window is named by its least 6-word hash (a window equal to it has the same). Names that occur in one text only
   belong to windows that don't repeat; the others' suffixes go on. Equal texts share one entry throughout.
2. groups: a candidate suffix is dealt by its first 3 words; prefixes with too many suffixes are split by their first 6 words, and those
   by the whole window. "Too many" grows with the input, so the lists of split prefixes have a fixed length and can be broadcast.
   Nodes that are too large even so are summed to their first leaf instead.
3. trees: a group is sorted by the words of its suffixes, and the common-prefix lengths of neighbours give its deep nodes. They are read
   in one pass that holds the node in hand alone.
4. repeats: the suffix link of a node (its words without the first) leads to the node of the next position. Where the first leaf moves on
   with it, the repeat goes on: such chains are the maximal repeats, of any length, and the words under them leave the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pastline.llm import store
from pastline.llm import textkernel as K

WINDOW = 13
NAME_WORDS = 6
PREFIXES = (3, 6)
#: Suffixes of a prefix group, at least; above 10,000 times as many suffixes in all, a ten thousandth of them.
GROUP_SUFFIXES = 200_000
SPLIT_LISTS = 10_000

#: ``at`` holds a text's number among the texts of its doc_id (mostly 0) above ``PART`` bits, and the word position below.
PART = 40
NAMES = "doc_id long, part long, names array<long>"
#: ``words``: a big-endian 16-bit name of each word of the window, so bytes sort as names do; ``mark``: 64 bits over the whole window, which
#: parts windows whose words share names. Two windows that differ in one word are taken for one with a chance of 2**-80.
SUFFIXES = "doc_id long, at long, words binary, mark long"
LEAVES = "doc_id long, at long, first_doc long, first_at long"
SPANS = "doc_id long, part long, starts array<long>, lengths array<long>, first_docs array<long>, first_ats array<long>"
CLEANED = "doc_id long, text string, n_words long, n_removed long"


def _plain(docs: DataFrame) -> DataFrame:
    """``doc_id, part, text``; ``part`` numbers the different texts of one doc_id, in the order of their hashes."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = plain.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("t"))
    several = hashed.groupBy("doc_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where(F.col("lo") != F.col("hi")).select("doc_id")
    several = store.table(spark, hashed.join(several, "doc_id").distinct(), "several")
    if several.isEmpty():
        return plain.select("doc_id", F.lit(0).cast("long").alias("part"), "text")
    parts = several.withColumn("part", F.row_number().over(Window.partitionBy("doc_id").orderBy("t")).cast("long") - 1)
    joined = plain.withColumn("t", F.xxhash64("text")).join(store.few(spark, parts), ["doc_id", "t"], "left")
    return joined.select("doc_id", F.coalesce("part", F.lit(0).cast("long")).alias("part"), "text")


def _window_names(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name of each window and the index of its first word."""
    size = len(words) - NAME_WORDS + 1
    _, at = K.window_hash(words, before, WINDOW)
    if not len(at):
        return np.zeros(0, np.uint64), at
    short = words[:size].copy()
    for j in range(1, NAME_WORDS):
        short = short * np.uint64(0x8CB92BA72F3D8DD7) + words[j : j + size]
    short = K.mix(short)
    least, span = short, 1  # least of WINDOW - NAME_WORDS + 1 = 8 neighbours, by doubling
    while span < WINDOW - NAME_WORDS + 1:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    return least[at], at


def _names(plain: DataFrame) -> DataFrame:
    """The distinct window names of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for at, to in K.slices(offsets, 1 << 20):
                piece, part = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                starts, ends, before = K.word_spans(piece, part)
                names, first = _window_names(K.span_hash(piece, starts, ends), before)
                row = np.searchsorted(before, first, "right") - 1
                fresh = np.ones(len(names), bool)  # neighbours mostly share their name
                fresh[1:] = (names[1:] != names[:-1]) | (row[1:] != row[:-1])
                names, row = names[fresh], row[fresh]
                bounds = np.searchsorted(row, np.arange(to - at + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), batch.column("part").slice(at, to - at), pa.ListArray.from_arrays(pa.array(bounds), pa.array(names.view(np.int64)))], names=["doc_id", "part", "names"])

    return plain.mapInArrow(run, NAMES)


def _suffixes(texts: DataFrame) -> DataFrame:
    """Candidate suffixes of ``doc_id, part, text, names``: the names of their first ``WINDOW`` words and the mark of these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            named = batch.column("names")
            for at, to in K.slices(offsets, 1 << 20):
                piece, part = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                starts, ends, before = K.word_spans(piece, part)
                words = K.span_hash(piece, starts, ends)
                names, first = _window_names(words, before)
                row = np.searchsorted(before, first, "right") - 1
                mine = named.slice(at, to - at)
                salt = np.uint64(0x9E3779B97F4A7C15)
                wanted = mine.flatten().to_numpy().astype(np.int64).view(np.uint64)
                owner = np.repeat(np.arange(to - at), mine.value_lengths().to_numpy())
                keep = np.isin(K.mix(names + row.astype(np.uint64) * salt), K.mix(wanted + owner.astype(np.uint64) * salt))
                first, row = first[keep], row[keep]
                codes = np.empty((len(first), WINDOW), ">u2")
                mark = words[first]
                for j in range(WINDOW):
                    word = words[first + j]
                    codes[:, j] = word >> np.uint64(48)
                    mark = mark * np.uint64(0x2545F4914F6CDD1D) + word
                ends_at = np.arange(len(first) + 1, dtype=np.int32) * codes.itemsize * WINDOW
                keys = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends_at), pa.py_buffer(codes)])
                position = (batch.column("part").slice(at, to - at).to_numpy()[row] << PART) + first - before[row]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at).take(pa.array(row)), pa.array(position), keys, pa.array(K.mix(mark).view(np.int64))], names=["doc_id", "at", "words", "mark"])

    return texts.select("doc_id", "part", "text", "names").mapInArrow(run, SUFFIXES)


def _codes(column: pa.Array) -> np.ndarray:
    """The word names of the suffixes, a row each."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(">u2").reshape(len(column), WINDOW)


def _leaves(sorted_suffixes: DataFrame) -> DataFrame:
    """The leaves of deep nodes that also have a leaf of a lesser document, each with the node's first leaf.

    The input is sorted by words, mark, document and position, so a subtree's leaves are neighbours, and two of them meet at the depth of
    the least common-prefix length between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, mark = _codes(batch.column("words")), batch.column("mark").to_numpy()
            doc, at = batch.column("doc_id").to_numpy(), batch.column("at").to_numpy()
            before_codes, before_mark = last[:2] if last else (np.zeros(WINDOW, ">u2"), np.int64(0))
            depth = np.logical_and.accumulate(codes == np.vstack([before_codes, codes[:-1]]), axis=1).sum(1)
            depth[(depth == WINDOW) & (mark != np.append(before_mark, mark[:-1]))] -= 1
            new = depth < WINDOW
            new[0] |= last is None
            heads = np.flatnonzero(new)
            first_doc, first_at = doc[heads], at[heads]
            if not new[0]:
                first_doc, first_at = np.append(last[2], first_doc), np.append(last[3], first_at)
            node = np.cumsum(new) - (1 if new[0] else 0)
            over = doc > first_doc[node]
            last = (codes[-1].copy(), mark[-1], first_doc[-1], first_at[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[over], at[over], first_doc[node[over]], first_at[node[over]])], names=["doc_id", "at", "first_doc", "first_at"])

    return sorted_suffixes.mapInArrow(run, LEAVES)


def _chains(leaves: DataFrame) -> DataFrame:
    """Leaves joined along suffix links: the repeats of each text, in order of their start and first occurrence."""
    low = F.lit((1 << PART) - 1)
    whole = leaves.groupBy("doc_id", F.shiftright("at", PART).alias("part")).agg(F.collect_list(F.struct(F.col("at").bitwiseAND(low).alias("at"), "first_doc", "first_at")).alias("leaves"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("leaves")
            at, first_doc, first_at = (x.to_numpy().astype(np.int64) for x in lists.flatten().flatten())
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            order = np.lexsort((at, row))
            at, first_doc, first_at, row = at[order], first_doc[order], first_at[order], row[order]
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (first_doc[1:] != first_doc[:-1]) | (first_at[1:] != first_at[:-1] + 1)
            heads = np.flatnonzero(new)
            length = np.diff(np.append(heads, len(at))) + WINDOW - 1
            bounds = pa.array(np.searchsorted(row[heads], np.arange(len(lists) + 1)).astype(np.int32))
            spans = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (at[heads], length, first_doc[heads], first_at[heads])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *spans], names=["doc_id", "part", "starts", "lengths", "first_docs", "first_ats"])

    return whole.mapInArrow(run, SPANS)


def _repeats(spark: SparkSession, plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: the repeats (``SPANS``) of all texts but those that a lesser document has too, and the latter (``doc_id, part, rep,
    rep_part``)."""
    store.small_batches(spark)
    texts = plain.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "part", F.xxhash64("text").alias("ta"), F.xxhash64(F.lit(1), F.reverse("text")).alias("tb"))
    least = texts.groupBy("ta", "tb").agg(F.min(F.struct("doc_id", "part")).alias("least"), F.max("doc_id").alias("other"), F.count("*").alias("size")).where(F.col("least.doc_id") != F.col("other")).select("ta", "tb", F.col("least.doc_id").alias("rep"), F.col("least.part").alias("rep_part"), "size")
    least = store.table(spark, least, "equal-texts")
    copies = store.spread_join(texts, least, ["ta", "tb"], "size", least.agg(F.sum("size")).first()[0] or 0).where(F.col("doc_id") != F.col("rep")).select("doc_id", "part", "rep", "rep_part").distinct()
    copies = store.table(spark, copies, "copies")

    names = _names(plain).join(copies, ["doc_id", "part"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.explode("names").alias("name"))
    shared = names.groupBy("name").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where(F.col("lo") != F.col("hi")).select("name")
    shared = store.table(spark, shared, "names")
    again = _names(plain).join(copies, ["doc_id", "part"], "left_anti").select("doc_id", "part", F.explode("names").alias("name")).join(shared, "name", "left_semi")
    wanted = store.table(spark, again.groupBy("doc_id", "part").agg(F.collect_set("name").alias("names")), "wanted")
    store.drop(spark, shared)

    # Suffixes are many times the texts, so they are made again for each pass and stored in none.
    rows = _suffixes(plain.join(wanted, ["doc_id", "part"]))
    p3, p6 = (F.xxhash64(F.substring("words", 1, 2 * n)).alias(f"p{n}") for n in PREFIXES)
    sizes = store.table(spark, rows.groupBy(p3, p6).agg(F.count("*").alias("size")), "prefix-sizes")
    most = max(GROUP_SUFFIXES, (sizes.agg(F.sum("size")).first()[0] or 0) // SPLIT_LISTS)

    # At most SPLIT_LISTS keys have more than ``most`` suffixes: the lists are small enough to collect and broadcast.
    by3 = spark.createDataFrame(sizes.groupBy("p3").agg(F.sum("size").alias("size")).where(F.col("size") > most).select("p3").collect(), "p3 long")
    by6 = spark.createDataFrame(sizes.where(F.col("size") > most).select("p6").collect(), "p6 long")
    prefixed = rows.select("*", p3, p6)
    heavy = None
    if not by6.isEmpty():
        nodes = prefixed.join(F.broadcast(by6), "p6", "left_semi").groupBy("words", "mark").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "at")).alias("first")).where(F.col("size") > most)
        nodes = spark.createDataFrame(nodes.select("words", "mark", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at")).collect(), "words binary, mark long, first_doc long, first_at long")
        if not nodes.isEmpty():
            heavy = rows.join(F.broadcast(nodes), ["words", "mark"]).where(F.col("doc_id") > F.col("first_doc")).select("doc_id", "at", "first_doc", "first_at")
            prefixed = prefixed.join(F.broadcast(nodes), ["words", "mark"], "left_anti")
    group = prefixed.join(F.broadcast(by3.withColumn("s3", F.lit(True))), "p3", "left").join(F.broadcast(by6.withColumn("s6", F.lit(True))), "p6", "left")
    # The prefix itself isn't shuffled: its level and the words give it.
    level = F.when(F.col("s3").isNull(), 0).when(F.col("s6").isNull(), 1).otherwise(2).alias("level")
    dealt = group.select(level, "words", "mark", "doc_id", "at").repartition(F.when(F.col("level") == 0, p3).when(F.col("level") == 1, p6).otherwise(F.col("mark"))).drop("level")
    leaves = _leaves(dealt.sortWithinPartitions("words", "mark", "doc_id", "at"))
    found = store.table(spark, _chains(leaves if heavy is None else leaves.unionByName(heavy)), "repeats")
    store.drop(spark, wanted, sizes)
    return found, copies


def maximal_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, part, start, length, first_doc_id, first_part, first_start``: the repeats of ``WINDOW`` words or more, one row each.

    ``length`` words of the document from ``start`` on also begin at ``first_start`` of a lesser document, the first one with the window at
    ``start``. A repeat can't go on to either side: there the words differ or an earlier place has the next window. ``part`` numbers
    the different texts of one doc_id (0 for most). A text that a lesser document has too is one repeat from 0 on, if long enough. Null and
    short texts, rows without doc_id and empty tables have none.
    """
    plain = _plain(docs)
    found, copies = _repeats(spark, plain)
    low = F.lit((1 << PART) - 1)
    spans = found.select("doc_id", "part", F.explode(F.arrays_zip("starts", "lengths", "first_docs", "first_ats")).alias("s"))
    spans = spans.select("doc_id", "part", F.col("s.starts").alias("start"), F.col("s.lengths").alias("length"), F.col("s.first_docs").alias("first_doc_id"), F.shiftright("s.first_ats", PART).alias("first_part"), F.col("s.first_ats").bitwiseAND(low).alias("first_start"))
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    zero = F.lit(0).cast("long")
    whole = plain.join(copies, ["doc_id", "part"]).select("doc_id", "part", zero.alias("start"), n.alias("length"), F.col("rep").alias("first_doc_id"), F.col("rep_part").alias("first_part"), zero.alias("first_start"))
    return spans.unionByName(whole.where(F.col("length") >= WINDOW).distinct())


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_words, n_removed``: whole texts without the words of repeated windows, one space between words.

    A word goes if some window of ``WINDOW`` consecutive words over it also starts in a document with a lesser doc_id (as the input has
    it). A null text has no words and gives an empty one; texts shorter than a window stay. Rows of one doc_id are one document: none of
    them makes another's windows repeats, and each row loses its own. A row without doc_id keeps all and removes nothing. Whole texts are
    taken however long; a kernel holds one at least. An empty table gives an empty result.
    """
    plain = _plain(docs)
    found, copies = _repeats(spark, plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            whole = batch.column("copy").to_numpy(zero_copy_only=False)
            starts_of, lengths_of = batch.column("starts"), batch.column("lengths")
            for at, to in K.slices(offsets, 1 << 20):
                piece, part = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                starts, ends, before = K.word_spans(piece, part)
                n = np.diff(before)
                cover = np.zeros(len(starts) + 1, np.int64)
                mine = starts_of.slice(at, to - at)
                lengths = mine.value_lengths().fill_null(0).to_numpy()
                first = mine.flatten().to_numpy().astype(np.int64) + np.repeat(before[:-1], lengths)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + lengths_of.slice(at, to - at).flatten().to_numpy().astype(np.int64), -1)
                keep = np.cumsum(cover[:-1]) == 0
                keep &= ~np.repeat(whole[at:to] & (n >= WINDOW), n)
                kept = K.per_row(keep, before)
                # Kept words with one space after each but a row's last, copied into one buffer.
                s, length = starts[keep], (ends - starts)[keep] + 1
                out_ends = np.cumsum(length)
                out = np.full(int(out_ends[-1]) if len(out_ends) else 0, 32, np.uint8)
                out[K.ragged(out_ends - length, length - 1)] = piece[K.ragged(s, length - 1)]
                bounds = np.concatenate([[0], out_ends])[np.concatenate([[0], np.cumsum(kept)])]
                texts = pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
                texts = pc.ascii_rtrim(texts, " ")  # no word has one
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), texts.cast(pa.string()), pa.array(n), pa.array(n - kept)], names=["doc_id", "text", "n_words", "n_removed"])

    marked = plain.join(found.select("doc_id", "part", "starts", "lengths"), ["doc_id", "part"], "left").join(copies.select("doc_id", "part", F.lit(True).alias("copy")), ["doc_id", "part"], "left")
    return marked.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts", "lengths").mapInArrow(run, CLEANED)
