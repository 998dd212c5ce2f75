"""Token-ID output: documents in doc_id order as range-coded blocks (:mod:`pastline.llm.rangecoder`), and the reader of those files.

The files are a table of blocks (``part, block, n_texts, n_tokens, doc_ids, continues, data``): each row's ``data`` is a self-contained
block. Spark's own writer commits them, so a lost executor or a repeated task leaves no half-written block behind. A text longer than a
block continues in the next ones.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pastline.llm import rangecoder as R
from pastline.llm import store
from pastline.llm import textkernel as K
from pastline.llm.tokenize import tokenizer

BLOCKS = "part long, block long, n_texts long, n_tokens long, doc_ids array<long>, continues boolean, data binary"
_BLOCK_TYPES = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("n_texts", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("continues", pa.bool_()), ("data", pa.binary())])


def blocks(docs: DataFrame, vocabulary: str, block_tokens: int = R.BLOCK_TOKENS) -> DataFrame:
    """Coded blocks of the texts in ascending doc_id order (rows of one doc_id by text); a null text is empty."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        vocab = coder.full.get_vocab_size()
        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        lengths: list[int] = []
        held, continues = 0, False

        def flush(full: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, names, lengths, held, number, continues
            while held >= block_tokens or (full and names):
                flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
                ends = np.cumsum(lengths)
                n = min(len(flat), block_tokens)
                k = int(np.searchsorted(ends, n))  # the text that the block's last id is of
                inside = ends[k] - n
                take = [*lengths[:k], lengths[k] - int(inside)]
                data = R.encode_block(flat[:n], np.array(take), vocab)
                yield pa.RecordBatch.from_pylist([{"part": part, "block": number, "n_texts": k + 1, "n_tokens": n, "doc_ids": names[: k + 1], "continues": continues, "data": data}], schema=_BLOCK_TYPES)
                continues = bool(inside)
                ids, names, lengths = ([flat[n:]], names[k:], [int(inside), *lengths[k + 1 :]]) if inside else ([flat[n:]], names[k + 1 :], lengths[k + 1 :])
                held -= n
                number += 1

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            data, offsets = K.utf8(batch.column("text"))
            for at, to in K.slices(offsets, 8 << 20):
                got, ends = coder.encode(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                ids.append(got)
                names += doc_ids[at:to]
                lengths += np.diff(ends).tolist()
                held += len(got)
                yield from flush(False)
        yield from flush(True)

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")  # rows of one doc_id: by text
    return ordered.mapInArrow(write, BLOCKS)


def write_ids(spark: SparkSession, docs: DataFrame, vocabulary: str, path: str | None = None) -> str:
    """Writes the files under ``path`` (by default in the shared folder) and returns it."""
    store.small_batches(spark)
    path = path or f"{store.shared_dir(spark)}/{spark.sparkContext.applicationId}/ids-{uuid.uuid4().hex}"
    blocks(docs, vocabulary).write.parquet(path)
    return path


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32`` and, ``with_ids``, the ids themselves.

    ``start`` counts the ids of all documents before it in the files' order.
    """
    table = spark.read.schema(BLOCKS).parquet(path)
    # Two levels of running totals: over the parts (as many rows as tasks wrote) and over the blocks of each part.
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    order = Window.partitionBy("part").orderBy("block")
    inside = table.select(
        "part", "block", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("block_start"),
        (F.sum("n_texts").over(order) - F.col("n_texts") - F.sum(F.col("continues").cast("long")).over(order)).alias("first_text"),
    )
    starts = inside.join(parts, "part").select("part", "block", "first_text", (F.col("part_start") + F.col("block_start")).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, part long, text_no long, ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, lengths = R.decode_block(row.column("data")[0].as_py())
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                begin = ends - lengths
                n = len(lengths)
                base = row.column("start")[0].as_py()
                first = np.zeros(n, bool)
                first[:1] = row.column("continues")[0].as_py()
                last = np.zeros(n, bool)
                last[-1:] = True
                spans = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                # A text that may continue in other blocks keeps its ids until its parts are joined.
                keep = [bytes(s) if with_ids or first[j] or last[j] else None for j, s in enumerate(spans)]
                numbers = row.column("first_text")[0].as_py() + np.arange(n)
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_ids")[0].values, pa.array(begin + base), pa.array(lengths), pa.array([zlib.crc32(s) for s in spans], pa.int64()), pa.array(np.full(n, row.column("part")[0].as_py())), pa.array(numbers), pa.array(keep, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "text_no", "ids"],
                )

    rows = table.join(starts, ["part", "block"]).select("doc_ids", "continues", "part", "first_text", "start", "data").mapInArrow(read, schema)
    # A text's number within its part tells the rows of a text that spans blocks; each block is decoded once.
    held = F.when(F.col("ids").isNotNull(), F.struct("start", "ids"))
    out = (
        rows.groupBy("part", "text_no")
        .agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n"), F.min("ids_crc32").alias("crc"), F.array_sort(F.collect_list(held)).alias("parts"))
        .select("doc_id", "start", "n_tokens", "n", "crc", F.expr("aggregate(parts, x'', (a, p) -> concat(a, p.ids))").alias("ids"))
        .select("doc_id", "start", "n_tokens", F.when(F.col("n") == 1, F.col("crc")).otherwise(F.crc32("ids")).alias("ids_crc32"), "ids")
    )
    return out if with_ids else out.drop("ids")
