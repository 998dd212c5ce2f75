"""Adaptive context-mixing range coder for token ids.

A block holds up to four million ids and is coded on its own: its model starts empty and its header carries checksums, so any block can be
read, or found damaged, without the others. The block's ids are dealt to lanes (runs of neighbouring ids) that share one model and
advance together, so each step is numpy code over all lanes.

Model: order 2 and order 1 each predict one id with a confidence; what the ids so far say about a hit of either is kept per order and
for both together, and the three views are mixed into one distribution over {order 2 hits, order 1 hits, neither}. A miss is coded by
adaptive order-0 frequencies. The probabilities drive a carry-less range coder per lane (64-bit state, 16-bit words).
All arithmetic is in integers, so any machine decodes what another has encoded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"PLT1"
BLOCK_TOKENS = 1 << 22
LANES = 16384
_HEADER = struct.Struct("<4sIIIIIIIII")
_U = np.uint64
_TOP, _BOT = _U(1 << 48), _U(1 << 40)
_FLAG_BITS, _ID_BITS = 11, 20
_STEP = 32
_TABLE2 = 1 << 18


class CorruptBlock(ValueError):
    """A block whose header or checksum does not fit its bytes."""


class _Model:
    """Tables hold ``id << 3 | confidence``, so an order costs one gather and one scatter a step."""

    def __init__(self, vocab: int):
        if vocab > 1 << (_ID_BITS - 1):
            raise ValueError("the vocabulary is too large for the order-0 resolution")
        self.vocab, self.steps = vocab, 0
        self.freq = np.ones(vocab, np.int64)
        self.order1, self.order2 = np.zeros(vocab + 1, np.int32), np.zeros(_TABLE2, np.int32)
        self.joint = np.ones((2, 8, 8, 3), np.int64)
        self._refresh()

    def _refresh(self) -> None:
        if self.steps < 16 or self.steps % 8 == 0:
            cum = np.zeros(self.vocab + 1, np.int64)
            np.cumsum(self.freq, out=cum[1:])
            self.cum = (cum * ((1 << _ID_BITS) - self.vocab)) // cum[-1] + np.arange(self.vocab + 1)
            self.at_value = None
        if self.steps < 64 or self.steps % 4 == 0:
            views = (self.joint * 2, self.joint.sum((0, 2), keepdims=True), self.joint.sum((0, 1), keepdims=True))
            share = sum((t << 12) // t.sum(3, keepdims=True) for t in views).reshape(-1, 3)
            cum = np.zeros((len(share), 4), np.int64)
            np.cumsum(share, axis=1, out=cum[:, 1:])
            self.flags = (((cum * ((1 << _FLAG_BITS) - 3)) // cum[:, 3:] + np.arange(4)) << _ID_BITS).ravel()

    def predict(self, prev1: np.ndarray, prev2: np.ndarray) -> None:
        self.prev1 = prev1
        self.slot = ((prev1 * np.int32(0x2545F491) + prev2 * np.int32(0x1E3779B1)) >> 13) & np.int32(_TABLE2 - 1)
        self.e1, self.e2 = self.order1.take(prev1), self.order2.take(self.slot)
        self.c1, self.c2 = self.e1 >> 3, self.e2 >> 3
        self.ctx = ((self.c1 == self.c2).astype(np.int32) << 6) | ((self.e2 & 7) << 3) | (self.e1 & 7)

    def interval(self, outcome: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of what was coded, of 2 ** (_FLAG_BITS + _ID_BITS)."""
        at = self.ctx * 4 + outcome
        start, end = self.flags.take(at), self.flags.take(at + 1)
        width = end - start
        lo, hi = self.cum.take(ids), self.cum.take(ids + 1)
        part = width >> _ID_BITS
        miss = outcome == 2
        return (start + np.where(miss, part * lo, 0)).astype(np.uint64), np.where(miss, part * (hi - lo), width).astype(np.uint64)

    def id_at(self, value: np.ndarray) -> np.ndarray:
        """The ids whose order-0 intervals hold the values."""
        if self.at_value is None:
            self.at_value = np.repeat(np.arange(self.vocab, dtype=np.int32), np.diff(self.cum))
        return self.at_value.take(value, mode="clip")

    def update(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        self.joint += np.bincount(self.ctx * 3 + outcome, minlength=384).reshape(2, 8, 8, 3)
        np.add.at(self.freq, ids, _STEP)
        fresh = (ids << 3) | 1
        for table, at, entry, hit in ((self.order1, self.prev1, self.e1, ids == self.c1), (self.order2, self.slot, self.e2, outcome == 0)):
            k = entry & 7
            missed = np.where(k == 0, fresh, entry - k + (k >> 1))
            table[at] = np.where(hit, entry + (k < 7), missed)
        self.steps += 1
        self._refresh()


class _Lanes:
    """The coder's state; ``move`` shifts settled words out of it."""

    def __init__(self, lanes: int):
        self.low, self.range, self.at = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros(lanes, np.int64)

    def narrow(self, live: int, start: np.ndarray, width: np.ndarray) -> None:
        low, rng = self.low[:live], self.range[:live]
        rng >>= _U(_FLAG_BITS + _ID_BITS)
        low += rng * start
        rng *= width
        todo, a, b = None, low, rng
        while True:
            same = (a ^ (a + b)) < _TOP
            move = np.flatnonzero(same | (b < _BOT))
            if not len(move):
                return
            narrow = ~same.take(move)
            a, b = a.take(move), b.take(move)
            if narrow.any():
                b[narrow] = (~a[narrow] + _U(1)) & _U(int(_BOT) - 1)
            todo = move if todo is None else todo.take(move)
            self.shift(todo, a)
            a, b = a << _U(16), b << _U(16)
            low[todo], rng[todo] = a, b


class _Encoder(_Lanes):
    def __init__(self, lanes: int, longest: int):
        super().__init__(lanes)
        self.width = 4 * longest + 8
        self.out = np.zeros(lanes * self.width, np.uint16)
        self.at = np.arange(lanes) * self.width

    def shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.at.take(lanes)
        self.out[at] = low >> _U(48)
        self.at[lanes] = at + 1

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(4):
            self.shift(np.arange(len(self.low)), self.low)
            self.low <<= _U(16)
        counts = self.at - np.arange(len(self.low)) * self.width
        return self.out.reshape(-1, self.width)[np.arange(self.width) < counts[:, None]], counts


class _Decoder(_Lanes):
    def __init__(self, words: np.ndarray, counts: np.ndarray):
        super().__init__(len(counts))
        self.words, self.at = np.append(words, np.zeros(8, np.uint16)).astype(np.uint64), np.cumsum(counts) - counts
        self.code = np.zeros(len(counts), np.uint64)
        for _ in range(4):
            self.shift(np.arange(len(counts)), None)

    def shift(self, lanes: np.ndarray, low: np.ndarray | None) -> None:
        at = self.at.take(lanes)
        self.code[lanes] = (self.code.take(lanes) << _U(16)) | self.words.take(at, mode="clip")
        self.at[lanes] = at + 1

    def value(self, live: int) -> np.ndarray:
        bits = _FLAG_BITS + _ID_BITS
        found = (self.code[:live] - self.low[:live]) // (self.range[:live] >> _U(bits))
        return np.minimum(found, _U((1 << bits) - 1)).astype(np.int64)


def _layout(n: int) -> tuple[int, int]:
    """Lanes and ids in each (the last may have fewer)."""
    longest = max(1, -(-n // max(1, min(LANES, n // 64))))
    return -(-n // longest), longest


def encode_block(ids: np.ndarray, lengths: np.ndarray, vocab: int) -> bytes:
    """One block: ``ids`` of whole texts of ``lengths`` ids each (a text may span blocks; then its length here is its part)."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >= vocab:
        raise ValueError("an id is outside the vocabulary")
    lanes, longest = _layout(len(ids)) if len(ids) else (0, 0)
    words, counts = np.zeros(0, np.uint16), np.zeros(0, np.int64)
    if lanes:
        grid = np.zeros(lanes * longest, np.int32)
        grid[: len(ids)] = ids
        grid = grid.reshape(lanes, longest).T.copy()
        short = len(ids) - (lanes - 1) * longest
        model, coder = _Model(vocab), _Encoder(lanes, longest)
        prev1 = prev2 = np.full(lanes, vocab, np.int32)
        for t in range(longest):
            live = lanes if t < short else lanes - 1
            now = grid[t][:live]
            model.predict(prev1[:live], prev2[:live])
            outcome = np.where(now == model.c2, 0, 2 - (now == model.c1))
            coder.narrow(live, *model.interval(outcome, now))
            model.update(now, outcome)
            prev2, prev1 = prev1, now
        words, counts = coder.finish()
    payload = lengths.astype("<u4").tobytes() + counts.astype("<u4").tobytes() + words.astype("<u2").tobytes()
    return _HEADER.pack(MAGIC, 1, vocab, len(lengths), len(ids), lanes, longest, len(payload), zlib.crc32(payload), zlib.crc32(ids.astype("<u4").tobytes())) + payload


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and text lengths of a block; :class:`CorruptBlock` unless both checksums hold."""
    if len(block) < _HEADER.size:
        raise CorruptBlock("the block is shorter than its header")
    magic, version, vocab, n_texts, n, lanes, longest, size, crc, ids_crc = _HEADER.unpack_from(block)
    payload = block[_HEADER.size :]
    if magic != MAGIC or version != 1 or size != len(payload) or zlib.crc32(payload) != crc:
        raise CorruptBlock("the block's header or bytes are damaged")
    lengths = np.frombuffer(payload, "<u4", n_texts).astype(np.int64)
    counts = np.frombuffer(payload, "<u4", lanes, 4 * n_texts).astype(np.int64)
    words = np.frombuffer(payload, "<u2", int(counts.sum()), 4 * (n_texts + lanes))
    ids = np.zeros(0, np.uint32)
    if lanes:
        grid = np.zeros((longest, lanes), np.int32)
        short = n - (lanes - 1) * longest
        model, coder = _Model(vocab), _Decoder(words, counts)
        prev1 = prev2 = np.full(lanes, vocab, np.int32)
        for t in range(longest):
            live = lanes if t < short else lanes - 1
            model.predict(prev1[:live], prev2[:live])
            value = coder.value(live)
            at = model.ctx * 4
            outcome = (value >= model.flags.take(at + 1)).astype(np.int64) + (value >= model.flags.take(at + 2))
            start, end = model.flags.take(at + 2), model.flags.take(at + 3)
            found = model.id_at(np.maximum(value - start, 0) // ((end - start) >> _ID_BITS))
            now = np.where(outcome == 2, found, np.where(outcome == 0, model.c2, model.c1)).astype(np.int32)
            coder.narrow(live, *model.interval(outcome, now))
            model.update(now, outcome)
            grid[t, :live] = now
            prev2, prev1 = prev1, now
        ids = grid.T.ravel()[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise CorruptBlock("the decoded ids do not fit their checksum")
    return ids, lengths
