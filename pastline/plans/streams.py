"""Moving windows over sorted streams: totals at both ends of a frame, time blocks for very active keys, and sliding multisets.

A table is dealt out once per key set and sorted by key and time; each task reads its stretch in batches and computes every window of that
key set from it. Sums are differences of running totals and extremes come from doubled spans, so the cost does not grow with the width of a
window. A key with a large share of the rows is cut into blocks of time; each block also reads the rows of one ``margin`` before it, marked as
not its own, so that a single account is many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastline.plans.checkpoint import ship

#: Rows of a key from which it is cut into blocks of about so many rows.
HEAVY_ROWS = 200_000
#: Keys that may be cut: their list is broadcast.
HEAVY_KEYS = 100_000
#: Rows that a task computes at once; a key is never parted, so a longer one is taken whole.
CHUNK_ROWS = 50_000


class Chunk:
    """Complete stretches of keys, sorted by time. ``lo`` and ``hi`` are the ends of the frames ``[t - width, t)`` as row numbers."""

    def __init__(self, table: pa.Table, run: np.ndarray, order: str, margin: int):
        self.table, self.run, self.n = table, run, len(run)
        self.us = table.column(order).to_numpy()
        self.begins = np.flatnonzero(np.diff(run, prepend=-1))
        self.ends = np.append(self.begins[1:], self.n)
        # One number per row that orders by key, then time: frames never reach into the key before.
        self._span = (self.us - self.us.min()) + (run - run[0]) * (int(np.ptp(self.us)) + margin + 1)
        self._hi: np.ndarray | None = None
        self._lo: dict[int, np.ndarray] = {}

    def hi(self) -> np.ndarray:
        if self._hi is None:
            self._hi = np.searchsorted(self._span, self._span, "left")
        return self._hi

    def lo(self, width: int) -> np.ndarray:
        if width not in self._lo:
            self._lo[width] = np.searchsorted(self._span, self._span - width, "left")
        return self._lo[width]

    def values(self, name: str, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A column as doubles, and which of its rows are not null (and in ``where``)."""
        column = self.table.column(name).combine_chunks()
        known = column.is_valid().to_numpy(zero_copy_only=False)
        x = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        return x, known if where is None else known & where

    def codes(self, name: str) -> np.ndarray:
        """A column's values as numbers from 0; null is -1."""
        column = self.table.column(name).combine_chunks().dictionary_encode()
        return column.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def before(x: np.ndarray, kind=np.int64) -> np.ndarray:
    """Totals before each row, and before the end."""
    return np.concatenate([np.zeros(1, kind), np.cumsum(x, dtype=kind)])


#: Bits of a part of a value: totals of 2 ** 32 rows fit 64 bits.
LIMB = 30


def _limbs(x: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """Running totals of ``x`` as whole numbers, and the power of two that the first counts in; each further one counts in units less by ``LIMB`` bits.
    Three hold every bit of values down to 2 ** -37 of the largest; what is below 2 ** -90 of it is rounded."""
    most = np.abs(x).max(initial=0.0)
    unit = int(np.frexp(most)[1]) - LIMB
    out, rest = [], x
    for k in range(3):
        scaled = np.ldexp(rest, LIMB * k - unit)
        whole = np.floor(scaled) if k < 2 else np.rint(scaled)
        out.append(before(whole.astype(np.int64)))
        rest = rest - np.ldexp(whole, unit - LIMB * k)
        if not rest.any():
            break
    return unit, out


class Frames:
    """Aggregates of one column over any frames of a chunk, with SQL's treatment of null, NaN and infinity."""

    def __init__(self, chunk: Chunk, x: np.ndarray, known: np.ndarray):
        self.chunk = chunk
        finite = np.isfinite(x)
        ok = known & finite
        self.known, self.x, self.ok = known, x, ok
        self.n = before(known)
        self.unit, self.limbs = _limbs(np.where(ok, x, 0.0))
        self._spread: tuple[np.ndarray, np.ndarray] | None = None
        self.odd = None if finite[known].all() else [before(known & y) for y in (np.isnan(x), x == np.inf, x == -np.inf)]
        self._tables: dict[bool, list[np.ndarray]] = {}

    def count(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.n[hi] - self.n[lo]

    def sum(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """NaN marks an empty frame, like SQL's null."""
        n = self.count(lo, hi)
        out = self._exact(lo, hi)
        if self.odd is not None:
            nan, plus, minus = (p[hi] - p[lo] > 0 for p in self.odd)
            out = np.where(nan | plus & minus, np.nan, np.where(plus, np.inf, np.where(minus, -np.inf, out)))
        return np.where(n > 0, out, np.nan)

    def _exact(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The sum of finite values, rounded once at the end: nothing stays behind of rows outside the frame."""
        parts = [p[hi] - p[lo] for p in self.limbs]
        for k in range(len(parts) - 1, 0, -1):
            parts[k - 1] += parts[k] >> LIMB
            parts[k] &= (1 << LIMB) - 1
        total = np.zeros(len(lo), np.longdouble)
        for k in range(len(parts) - 1, -1, -1):
            total += np.ldexp(parts[k].astype(np.longdouble), self.unit - LIMB * k)
        return total.astype(np.float64)

    def mean(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.sum(lo, hi) / np.maximum(self.count(lo, hi), 1)

    def std(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the sample; NaN with fewer than two values."""
        n = self.count(lo, hi)
        one, two = (p[hi] - p[lo] for p in self._around_mean())
        out = np.sqrt(np.maximum(two - one * one / np.maximum(n, 1), 0) / np.maximum(n - 1, 1)).astype(np.float64)
        same = self.extreme(lo, hi, True) == self.extreme(lo, hi, False)
        out = np.where(same, 0.0, out)  # equal values have no spread, whatever rounding leaves
        if self.odd is not None:
            out = np.where(sum(p[hi] - p[lo] for p in self.odd) > 0, np.nan, out)
        return np.where(n > 1, out, np.nan)

    def _around_mean(self) -> tuple[np.ndarray, np.ndarray]:
        """Running totals of the distance to the key's mean and of its square, so that little is lost in their differences."""
        if self._spread is None:
            begins, ends = self.chunk.begins, self.chunk.ends
            size = np.maximum(np.add.reduceat(self.ok.astype(np.int64), begins), 1)
            mean = np.add.reduceat(np.where(self.ok, self.x, 0.0), begins) / size
            d = np.where(self.ok, self.x, 0.0).astype(np.longdouble)
            d = np.where(self.ok, d - np.repeat(mean, ends - begins), 0)
            self._spread = before(d, np.longdouble), before(d * d, np.longdouble)
        return self._spread

    def extreme(self, lo: np.ndarray, hi: np.ndarray, largest: bool) -> np.ndarray:
        """NaN is above all numbers, and marks an empty frame."""
        pick = np.maximum if largest else np.fmin  # maximum keeps a NaN, fmin passes over it
        if largest not in self._tables:
            self._tables[largest] = [np.where(self.known, self.x, -np.inf if largest else np.inf)]
        spans = self._tables[largest]
        size = hi - lo
        level = np.zeros(len(size), np.int64)
        some = size > 0
        level[some] = np.frexp(size[some])[1] - 1
        while len(spans) <= (level.max() if len(level) else 0):
            half = 1 << (len(spans) - 1)
            spans.append(pick(spans[-1][:-half], spans[-1][half:]) if len(spans[-1]) > half else spans[-1])
        out = np.full(len(size), np.nan)
        for k in range(len(spans)):
            mine = np.flatnonzero(some & (level == k))
            if len(mine):
                out[mine] = pick(spans[k][lo[mine]], spans[k][hi[mine] - (1 << k)])
        return np.where(self.count(lo, hi) > 0, out, np.nan)


#: Amounts are taken in whole units of 2 ** -40, so that what is added and taken away again leaves nothing behind.
UNIT = 1 << 40


def multiset(chunk: Chunk, codes: np.ndarray, width: int, amounts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row and its frame: how many different ``codes`` there are, their effective number and the largest one's share of the amounts.

    The frame slides: rows enter and leave, and counts, sums, the sum of squares and a heap of sums are kept, for the codes of the frame alone.
    Rows of a negative code do not count. Without ``amounts`` only the first result is computed.
    """
    lo, hi = chunk.lo(width), chunk.hi()
    distinct, effective, top = np.zeros(chunk.n), np.zeros(chunk.n), np.zeros(chunk.n)
    whole = None if amounts is None else [int(a) for a in np.round(amounts.astype(np.longdouble) * UNIT)]
    keys, low, high = codes.tolist(), lo.tolist(), hi.tolist()
    for begin, end in zip(chunk.begins.tolist(), chunk.ends.tolist(), strict=True):
        counts: dict[int, int] = {}
        sums: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        total = squares = 0
        out = into = begin
        last, found = None, (0, 0.0, 0.0)
        for i in range(begin, end):
            if (low[i], high[i]) != last:
                last = (low[i], high[i])
                while into < high[i]:
                    k = keys[into]
                    if k >= 0:
                        counts[k] = counts.get(k, 0) + 1
                        if whole is not None:
                            was = sums.get(k, 0)
                            now = sums[k] = was + whole[into]
                            total += now - was
                            squares += now * now - was * was
                            heapq.heappush(heap, (-now, k))
                    into += 1
                while out < low[i]:
                    k = keys[out]
                    if k >= 0:
                        left = counts[k] - 1
                        if whole is not None:
                            was = sums[k]
                            now = sums[k] = was - whole[out]
                            total += now - was
                            squares += now * now - was * was
                        if left:
                            counts[k] = left
                            if whole is not None:
                                heapq.heappush(heap, (-now, k))
                        else:
                            del counts[k]
                            sums.pop(k, None)
                    out += 1
                if whole is not None and len(heap) > 4 * len(sums) + 64:
                    heap = [(-v, k) for k, v in sums.items()]
                    heapq.heapify(heap)
                while heap and sums.get(heap[0][1]) != -heap[0][0]:
                    heapq.heappop(heap)
                if total > 0:
                    found = (len(counts), total * total / squares, min(max(-heap[0][0] / total, 0.0), 1.0))
                else:
                    found = (len(counts), 0.0, 0.0)
            distinct[i], effective[i], top[i] = found
    return distinct, effective, top


def _blocks(df: DataFrame, keys: list[str], order: str, margin: int, heavy_rows: int, source: DataFrame) -> DataFrame:
    """``df`` with ``_block`` and ``_own``; rows of heavy keys come again, not their own, in the blocks whose frames reach them."""
    names = [f"_k{i}" for i in range(len(keys))]
    sizes = source.groupBy(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)]).agg(F.count("*").alias("_n"), F.min(order).alias("_first"), F.max(order).alias("_last"))
    # Blocks of about so many rows, but not so short that a row comes in more than five.
    wide = F.greatest(F.expr(f"(_last - _first) div (_n div {heavy_rows} + 1) + 1"), F.lit(max(1, margin // 4)).cast("long"))
    most = sizes.where(F.col("_n") > heavy_rows).orderBy(F.desc("_n")).limit(HEAVY_KEYS)
    heavy = F.broadcast(most.select(*names, "_first", "_last", wide.alias("_width")))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(keys, names, strict=True)]
    own = F.when(F.col("_width").isNull(), F.lit(0)).otherwise(F.expr(f"({order} - _first) div _width"))
    until = F.when(F.col("_width").isNull(), F.lit(0)).otherwise(F.expr(f"(least({order} + {margin}, _last) - _first) div _width"))
    laid = df.join(heavy, same, "left").select(*[F.col(f"`{c}`") for c in df.columns], own.cast("long").alias("_at"), F.explode(F.sequence(own.cast("long"), until.cast("long"))).alias("_block"))
    return laid.withColumn("_own", F.col("_block") == F.col("_at")).drop("_at")


def stream(
    df: DataFrame, keys: list[str], margin: int, kernel: Callable[[Chunk], dict[str, np.ndarray]], outputs: dict[str, str], order: str = "us",
    ties: tuple[str, ...] = (), heavy_rows: int | None = None, source: DataFrame | None = None,
) -> DataFrame:
    """``df`` with the columns ``outputs`` (name: ``double``, ``int`` or ``long``) that ``kernel`` computes from chunks of rows sorted by ``keys``,
    ``order`` (no nulls) and ``ties``. No frame may reach further back than ``margin``. One exchange, on the keys and the blocks of time.

    The rows of each key are counted in ``source`` (else ``df``): the same rows before other streams, so that those don't run twice. An output
    may come with a second array that is true where it is null.
    """
    spark = df.sparkSession
    ship(spark)
    hidden = [c for c in ("_block", "_own") if c in df.columns]
    if hidden:
        raise ValueError(f"columns {hidden} are used here")
    laid = _blocks(df, keys, order, margin, HEAVY_ROWS if heavy_rows is None else heavy_rows, df if source is None else source)
    sort = [*keys, "_block", order, *ties]
    laid = laid.repartition(*keys, "_block").sortWithinPartitions(*sort)
    names = df.columns
    kinds = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64()}
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *[f"`{n}` {t}" for n, t in outputs.items()]])

    def runs(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in [*keys, "_block"]:
            c = table.column(name).combine_chunks()
            a, b = c.slice(1), c.slice(0, len(c) - 1)
            differ = pc.fill_null(pc.not_equal(a, b), True)
            new[1:] |= pc.and_(differ, pc.invert(pc.and_(a.is_null(), b.is_null()))).to_numpy(zero_copy_only=False)
        return np.cumsum(new) - 1

    def done(table: pa.Table, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        us = table.column(order).to_numpy()
        most = max(1, (1 << 62) // (int(np.ptp(us)) + margin + 1))  # keys whose rows one number each can order
        at = 0
        while at < len(run):
            to = int(np.searchsorted(run, run[at] + most, "left"))
            part = table.slice(at, to - at)
            found = kernel(Chunk(part, run[at:to], order, margin))
            own = part.column("_own").combine_chunks()
            arrays = [part.column(c) for c in names]
            for n, t in outputs.items():
                x, null = found[n] if isinstance(found[n], tuple) else (found[n], None)
                arrays.append(pa.array(np.asarray(x).astype(kinds[t].to_pandas_dtype()), mask=null))
            yield from pa.Table.from_arrays(arrays, names=[*names, *outputs]).filter(own).combine_chunks().to_batches(10_000)
            at = to

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, wait = [], 0, CHUNK_ROWS
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < wait:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            run = runs(table)
            cut = int(np.searchsorted(run, run[-1], "left"))
            if cut:
                yield from done(table.slice(0, cut), run[:cut])
                held, rows, wait = table.slice(cut).to_batches(), table.num_rows - cut, max(CHUNK_ROWS, 2 * (table.num_rows - cut))
            else:
                held, wait = table.to_batches(), 2 * rows
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from done(table, runs(table))

    return laid.mapInArrow(run_all, schema)
