"""Vectorised text kernels shared by the corpus operators.

All functions work on one Arrow batch of UTF-8 text (``data`` bytes plus row ``offsets``) with numpy,
so a task's Python time is spent in array code and never in a loop over characters or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_P_INV = pow(_P, -1, 1 << 64)
_CHUNK = 1 << 20
_powers: list[np.ndarray] = []

#: Bytes of ``[\x20\x09-\x0D]``.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are neither ASCII letters or digits nor part of a character outside ASCII.
PUNCTUATION = np.array([not (chr(b).isalnum() and b < 128 or b > 127) for b in range(256)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, at least one row each: bounds the memory of the kernels."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, _CHUNK + 1)
        _powers.clear()
        for base in (_P, _P_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans (sorted by start, not nested): a polynomial modulo 2**64, finalised."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + _CHUNK, "right")))
        hi = int(ends[to - 1])
        power, inverse = _power(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = to
    return mix(out)


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words (by default ``[^\\x20\\x09-\\x0D]+``, else runs of bytes not ``outside``) and, per row, the number of
    words before it (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~outside[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < n]
    first[row_starts] = inside[row_starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    row_ends = offsets[1:][offsets[1:] > 0] - 1
    last[row_ends] = inside[row_ends]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def row_of(counts_before: np.ndarray) -> np.ndarray:
    """The row of each item, from the items before each row (n + 1 values)."""
    return np.repeat(np.arange(len(counts_before) - 1), np.diff(counts_before))


def window_hash(words: np.ndarray, before: np.ndarray, n: int, base: int = 0xA0761D6478BD642F) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words inside one row, and the index of each window's first word."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:size].copy()
    for j in range(1, n):
        h *= np.uint64(base | 1)
        h += words[j : j + size]
    ok = np.ones(size, bool)
    bounds = before[1:-1]
    for j in range(1, n):  # windows that begin in the n-1 words before a row's end reach over it
        at = bounds - j
        ok[at[(at >= 0) & (at < size)]] = False
    at = np.flatnonzero(ok)
    return mix(h[at]), at


def per_row(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row."""
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return sums[before[1:]] - sums[before[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start, start + 1, ...`` of each span, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    ends = np.cumsum(lengths)
    return out + np.repeat(starts - (ends - lengths), lengths)
