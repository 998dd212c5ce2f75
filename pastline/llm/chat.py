"""Chat formatting by columnar byte assembly, and the reader of formatted conversations.

Template of a turn: ``### role \\n text </turn> \\n``. Inside roles and texts, ``\\``, ``#`` and ``<`` get a backslash in front (and a role's
line feed becomes ``\\n``), so neither ``###`` nor ``</turn>`` can occur there unescaped, and unescaping gives the text back exactly.
Each Arrow batch is assembled in one preallocated buffer: segment lengths give cumulative offsets, and headers and texts are copied by
scatter indices. The loss mask of an assistant's turn covers its text alone, as byte spans of the formatted chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.llm import store
from pastline.llm import textkernel as K

CHUNKS = "conv_id long, chunk long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TURN = re.compile(r"### ([^\\\n]*(?:\\.[^\\\n]*)*)\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD, _LINE, _TAIL = (np.frombuffer(x, np.uint8) for x in (b"### ", b"\n", b"</turn>\n"))


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column.cast(pa.large_string()).fill_null(""), r"[\\#<]", r"\\\0")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns' formatted bytes in one buffer, each turn's end in it, and where its text starts and ends."""
    role, role_at = K.utf8(pc.replace_substring(escape(roles), "\n", "\\n"))
    text, text_at = K.utf8(escape(texts))
    parts = [np.full(len(roles), len(_HEAD)), np.diff(role_at), np.full(len(roles), 1), np.diff(text_at), np.full(len(roles), len(_TAIL))]
    ends = np.cumsum(sum(parts))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - sum(parts)
    for source, starts, lengths in ((_HEAD, None, parts[0]), (role, role_at[:-1], parts[1]), (_LINE, None, parts[2]), (text, text_at[:-1], parts[3]), (_TAIL, None, parts[4])):
        out[K.ragged(at, lengths)] = source[K.ragged(starts, lengths)] if starts is not None else np.tile(source, len(lengths))
        if source is text:
            spans = at, at + lengths
        at = at + lengths
    return out, ends, *spans


def format_conversations(spark: SparkSession, turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """Formatted conversations of ``turns`` (``conv_id, turn, role, text``; a null role or text is empty).

    One row per conversation, in turn order (equal turns by role and text). One with more turns than an Arrow batch has several rows:
    ``chunk`` numbers them, and their texts one after another are the conversation; so a conversation of any length streams through a
    task and none is held whole.
    """
    store.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            convs = batch.column("conv_id")
            names = convs.to_pylist()
            texts, roles = batch.column("text"), batch.column("role")
            _, text_at = K.utf8(texts)
            for at, to in K.slices(text_at, 16 << 20):
                out, ends, starts, stops = assemble(roles.slice(at, to - at), texts.slice(at, to - at))
                mine = pc.fill_null(pc.equal(roles.slice(at, to - at), assistant), False).to_numpy(zero_copy_only=False)
                new = np.array([i == at or names[i] != names[i - 1] for i in range(at, to)])
                first = np.flatnonzero(new)
                bounds = np.append(first, to - at)
                begin = np.append(0, ends)[bounds].astype(np.int64)
                chunks = []
                for i in first:
                    chunk = chunk + 1 if names[at + i] == last else 0
                    last = names[at + i]
                    chunks.append(chunk)
                base = np.repeat(begin[:-1], np.diff(bounds))
                held = np.append(0, np.cumsum(mine))[bounds].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(held), pa.array((x - base)[mine])) for x in (starts, stops)]
                strings = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(begin), pa.py_buffer(out)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([convs.take(pa.array(at + first)), pa.array(chunks, pa.int64()), pa.array(np.diff(bounds)), strings, *lists], names=["conv_id", "chunk", "n_turns", "formatted", "loss_starts", "loss_ends"])

    columns = turns.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    return columns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, CHUNKS)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Reads formatted chunks back: turns, texts under the loss mask, and their digests. Raises on text that is not of the template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: list | None = None

        def close() -> None:
            if now is not None:
                rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in DIGESTS.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now[0] != row["conv_id"]:
                    close()
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text, at, n = row["formatted"], 0, 0
                for m in _TURN.finditer(text):
                    if m.start() != at:
                        break
                    at, n = m.end(), n + 1
                    now[2].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                if at != len(text) or n != row["n_turns"]:
                    raise ValueError(f"conversation {row['conv_id']} is not in the template's form")
                raw = text.encode()
                for s, e in zip(row["loss_starts"], row["loss_ends"], strict=True):
                    plain = unescape(raw[s:e].decode())
                    now[3] += len(plain)
                    now[4].update(plain.encode())
                now[1] += n
                now[5] += len(text)
            if len(rows) >= 1000:
                yield flush()
                rows.clear()
        close()
        yield flush()

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, DIGESTS)
