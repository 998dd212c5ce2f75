"""Counting quotient filters over sorted integer fingerprints, in numpy.

A fingerprint of ``bits`` bits is cut into a quotient (its high ``q`` bits) and a remainder (the other ``r``). Remainders of one quotient form
a run of slots that begins at the slot numbered by the quotient, or where the run before ends; two bits tell which quotients have a run and
which slots end one. A count above one is written behind its remainder, in digits of ``r`` bits whose slots a third bit marks (in place of the
usual escape by order, so that whole arrays can be read at once). Nothing is lost: quotient and remainder give the fingerprint back, so
filters of any size are merged by merging their sorted fingerprints and adding counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pastline.llm import textkernel as K

#: Share of the home slots that are taken.
LOAD = 0.75


@dataclass
class Filter:
    bits: int
    q: int
    #: Per quotient: has it a run? Per slot: does a run end here, is this a digit of a count?
    occupied: np.ndarray
    run_end: np.ndarray
    digit: np.ndarray
    slots: np.ndarray

    @property
    def r(self) -> int:
        return self.bits - self.q


def _starts(quotients: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """First slot of each run: its home, or behind the run before it."""
    before = np.cumsum(lengths) - lengths
    return before + np.maximum.accumulate(quotients - before) if len(quotients) else before


def build(values: np.ndarray, counts: np.ndarray, bits: int) -> Filter:
    """The filter of fingerprints (ascending, different, below ``2 ** bits``; uint64) with their counts (1 or more)."""
    q = min(bits - 1, max(1, int(np.ceil(np.log2(max(1, len(values)) / LOAD)))))
    r = bits - q
    quotient, remainder = (values >> np.uint64(r)).astype(np.int64), values & np.uint64((1 << r) - 1)
    over = counts.astype(np.uint64) - np.uint64(1)
    digits, left = np.zeros(len(values), np.int64), over.copy()
    while left.any():
        digits += left > 0
        left = left >> np.uint64(r)
    size = 1 + digits
    new = np.flatnonzero(np.diff(quotient, prepend=-1))
    before = np.cumsum(size) - size
    length = np.diff(np.append(before[new], size.sum()))
    starts = _starts(quotient[new], length)
    at = before + np.repeat(starts - before[new], np.diff(np.append(new, len(values))))
    total = max(1 << q, int(starts[-1] + length[-1]) if len(new) else 0)
    f = Filter(bits, q, np.zeros(1 << q, bool), np.zeros(total, bool), np.zeros(total, bool), np.zeros(total, np.uint64))
    f.occupied[quotient[new]] = True
    f.run_end[starts + length - 1] = True
    f.slots[at] = remainder
    for k in range(int(digits.max()) if len(digits) else 0):
        mine = digits > k
        f.slots[at[mine] + 1 + k] = (over[mine] >> np.uint64(r * k)) & np.uint64((1 << r) - 1)
        f.digit[at[mine] + 1 + k] = True
    return f


def read(f: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, ascending, and their counts."""
    quotient, ends = np.flatnonzero(f.occupied), np.flatnonzero(f.run_end)
    starts = np.maximum(quotient, np.append(-1, ends[:-1]) + 1) if len(ends) else quotient
    at = K.ragged(starts, ends - starts + 1)
    of = np.repeat(quotient, ends - starts + 1).astype(np.uint64)
    first = ~f.digit[at]
    entry = np.cumsum(first) - 1
    values = (of[first] << np.uint64(f.r)) | f.slots[at[first]]
    counts = np.ones(len(values), np.uint64)
    place = np.arange(len(at)) - np.flatnonzero(first)[entry] - 1 if len(at) else at
    more = ~first
    np.add.at(counts, entry[more], f.slots[at[more]] << (place[more] * f.r).astype(np.uint64))
    return values, counts.astype(np.int64)


def add(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints in sorted stretches, one after another, as one ascending list with the counts of equal ones added."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    new = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[new], np.add.reduceat(counts, new) if len(new) else counts[:0]


def merge(filters: list[Filter]) -> Filter:
    """One filter with the counts of all (of equal ``bits``)."""
    found = [read(f) for f in filters]
    return build(*add(np.concatenate([v for v, _ in found]), np.concatenate([c for _, c in found])), filters[0].bits)


def dump(f: Filter) -> bytes:
    """As bytes: four numbers, the three bit arrays and the slots in whole bytes."""
    width = -(-f.r // 8)
    head = np.array([f.bits, f.q, len(f.slots), width], "<u4").tobytes()
    slots = f.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return b"".join([head, *(np.packbits(x).tobytes() for x in (f.occupied, f.run_end, f.digit)), slots.tobytes()])


def load(raw: bytes) -> Filter:
    bits, q, n, width = (int(x) for x in np.frombuffer(raw, "<u4", 4))
    at, arrays = 16, []
    for size in (1 << q, n, n):
        arrays.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at), count=size).astype(bool))
        at += -(-size // 8)
    slots = np.zeros((n, 8), np.uint8)
    slots[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
    return Filter(bits, q, *arrays, slots.view("<u8").ravel().astype(np.uint64))
