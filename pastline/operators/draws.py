"""Least seeded hashes where blocks of roots meet blocks of neighbours: the MD5 of many pairs at once, over whole arrays.

Only the first 32 bits of a pair's hash are computed for all pairs (61 of 64 steps); whoever can be among the least is hashed in full.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pastline.plans.checkpoint import ship

#: Pairs that are hashed at once, and pairs from which arrays are worth their calls.
AT_ONCE, FEW = 1 << 15, 512
#: Digits of a hash that order a sample.
DIGITS = 15
FOUND = "root string, node string, next string, draw string"

_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_first(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """The first 32 bits of the MD5 of ``n`` messages of one block, whose 16 words are numbers or arrays; they sort as the hex digits do."""
    a, b, c, d, f, t = (np.empty(n, np.uint32) for _ in range(6))
    for x, v in zip((a, b, c, d), _START, strict=True):
        x.fill(v)
    for i in range(61):  # the last three change other words
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        word, more = words[_WORD[i]], _ADD[i]
        if isinstance(word, np.ndarray):
            np.add(a, word, out=a)
        else:
            more += word
        np.add(a, np.uint32(more & 0xFFFFFFFF), out=a)
        np.left_shift(a, np.uint32(_TURN[i]), out=t)
        np.right_shift(a, np.uint32(32 - _TURN[i]), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()


class Tails:
    """Ends of messages, as words that begin at any byte of a word."""

    def __init__(self, ends: list[bytes]):
        self.ends, self.n = ends, len(ends)
        self.sizes = np.array([len(x) for x in ends], np.int64)
        self.most = int(self.sizes.max())
        self._words: dict[int, np.ndarray] = {}

    def words(self, skip: int) -> np.ndarray:
        if skip not in self._words:
            raw = np.zeros((self.n, 4 * -(-(skip + self.most + 1) // 4)), np.uint8)
            within = np.arange(self.sizes.sum()) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
            raw[np.repeat(np.arange(self.n), self.sizes), skip + within] = np.frombuffer(b"".join(self.ends), np.uint8)
            raw[np.arange(self.n), skip + self.sizes] = 128
            self._words[skip] = np.ascontiguousarray(raw.view("<u4").T)
        return self._words[skip]


def firsts(begins: list[bytes], tails: Tails) -> np.ndarray:
    """First 32 bits of the MD5 of each of ``begins`` (of one length) with each end, a row for each of ``begins``."""
    size, rows = len(begins[0]), len(begins)
    if rows * tails.n < FEW or size + tails.most > 55:  # few, or of two blocks
        return np.array([[int(hashlib.md5(x + y).hexdigest()[:8], 16) for y in tails.ends] for x in begins], np.uint32).reshape(rows, tails.n)
    head = np.zeros((rows, 64), np.uint8)
    head[:, :size] = np.frombuffer(b"".join(begins), np.uint8).reshape(rows, size)
    head, at, ends = head.view("<u4"), size // 4, tails.words(size % 4)
    words: list[int | np.ndarray] = [0] * 16
    for j in range(at + len(ends)):
        if j >= at:
            words[j] = np.bitwise_or(head[:, j : j + 1], ends[j - at]).ravel()
        else:
            words[j] = int(head[0, j]) if (head[:, j] == head[0, j]).all() else np.repeat(head[:, j], tails.n)
    words[14] = np.tile((8 * (size + tails.sizes)).astype(np.uint32), rows)
    return md5_first(words, rows * tails.n).reshape(rows, tails.n)


def least(begins: list[bytes], tails: Tails, share: float | None, k: int) -> Iterator[tuple[int, int]]:
    """Places of the begins and ends whose hash is below ``share`` of all hashes, or, without one, is among the ``k`` least of its begin; of both kinds
    also those that 32 bits don't tell from them."""
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(begins):
        by_size.setdefault(len(x), []).append(i)
    step = max(1, AT_ONCE // tails.n)
    for mine in by_size.values():
        for some in (mine[i : i + step] for i in range(0, len(mine), step)):
            hashes = firsts([begins[i] for i in some], tails)
            if share is not None:
                limit = np.uint32(min(2**32 - 1, int(share * 2**32)))
            else:
                limit = np.partition(hashes, k - 1, axis=1)[:, k - 1 : k] if k < tails.n else np.uint32(2**32 - 1)
            for i, j in zip(*np.nonzero(hashes <= limit), strict=True):
                yield some[i], int(j)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Lists are long, and what is in an Arrow batch is in memory at once: batches of 4 MB, for what runs meanwhile."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4m")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drawn(meet: DataFrame, seed: int, hop: int, k: int) -> DataFrame:
    """``root, node, next, draw`` of rows ``node, share, roots, nexts`` (text and lists of text, bounded): all that :func:`least` gives, with the first digits of the
    MD5 of seed, root, hop, node and next joined by ``-``."""
    ship(meet.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                node, share, roots, nexts = (batch.column(c)[i].as_py() for c in ("node", "share", "roots", "nexts"))
                begins, tails = [f"{seed}-{root}-{hop}-{node}-".encode() for root in roots], Tails([x.encode() for x in nexts])
                found = list(least(begins, tails, share, k))
                draws = [hashlib.md5(begins[r] + tails.ends[x]).hexdigest()[:DIGITS] for r, x in found]
                yield pa.RecordBatch.from_pydict({"root": pa.array([roots[r] for r, _ in found], pa.string()), "node": pa.array([node] * len(found), pa.string()), "next": pa.array([nexts[x] for _, x in found], pa.string()), "draw": pa.array(draws, pa.string())})

    return meet.select("node", "share", "roots", "nexts").mapInArrow(run, FOUND)
