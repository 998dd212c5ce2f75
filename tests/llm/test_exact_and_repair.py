"""Exact dedup and conversation repair against brute force, on rows with nulls, ties, repeats and clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pastline.llm import exactdedup, quotient, repair


@pytest.mark.parametrize("bits", [9, 16, 44, 60])
def test_quotient_filter_is_lossless(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 60, 400):
        values = np.unique(rng.integers(0, 1 << bits, n).astype(np.uint64))
        counts = rng.choice([1, 1, 2, 3, 300, 70_000], len(values))
        f = quotient.build(values, counts, bits)
        for g in (f, quotient.load(quotient.dump(f))):
            v, c = quotient.read(g)
            assert (v == values).all() and (c == counts).all()
    a = np.array([1, 5, 6, 7, 500], np.uint64)
    b = np.array([0, 5, 7, 511], np.uint64)
    merged = quotient.merge([quotient.build(a, np.array([1, 2, 1, 1, 9]), 9), quotient.build(b, np.array([1, 1, 4, 2]), 9), quotient.build(a[:0], np.zeros(0, int), 9)])
    v, c = quotient.read(merged)
    assert dict(zip(v.tolist(), c.tolist(), strict=True)) == {0: 1, 1: 1, 5: 3, 6: 1, 7: 5, 500: 9, 511: 2}


def _copies():
    rng = random.Random(4)
    base = ["", " ", None, "a b", "a\tb", "a \n\x0b b", " a b", "a b ", " a b", "a\x00b", "x" * 300_000, "é", "é"]
    rows = [(i, rng.choice(base), i) for i in range(300)]
    return [*rows, (5, "a b", 1), (5, "a b", 2), (None, "a b", 3), (None, "only", 4), (None, "only", 5), (-7, "é", 6)]


def test_exact_classes(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "HELD", 16)  # many small filters
    rows = _copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(7)
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = []
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        first = ids.index(least)
        want += [(d, least, len(ids), k == first, hashlib.sha256(t.encode()).hexdigest()) for k, d in enumerate(ids)]
    got = [tuple(r) for r in exactdedup.exact_classes(spark, docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    left = exactdedup.drop_copies(spark, docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == sorted((w[0] is None, w[0] or 0) for w in want if w[3])
    none = exactdedup.exact_classes(spark, docs.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """With a table that claims a repeat for every fingerprint, single texts stay single."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, text string")
    every = lambda filters: filters.mapInArrow(lambda batches: (_all(b) for b in batches), "fp long, n long")

    def _all(batch):
        import pyarrow as pa

        found = [(v | np.uint64(s << f.bits), c) for s, f in ((s, quotient.load(x.as_py())) for s, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)) for v, c in zip(*quotient.read(f), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.array([x for x, _ in found], np.uint64).view(np.int64)), pa.array([int(c) + 1 for _, c in found], pa.int64())], names=["fp", "n"])

    monkeypatch.setattr(exactdedup, "repeated", every)
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exactdedup.exact_classes(spark, docs).collect())
    assert got == [(1, 1, 1, True), (2, 2, 2, True), (3, 2, 2, False)]


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _cheapest(rows, faults):
    """All edits of few rows, with up to two insertions in each place; every result is held against the grammar."""
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = [["D"] if f in ("blank", "duplicate") else ["K", "Ruser", "Rassistant", "D"] for f in faults]
    for moves in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, kept = 0, "", []
            for i in range(len(rows) + 1):
                for role in gaps[i]:
                    cost, audit = cost + 2, audit + "I"
                    kept.append((role, ""))
                if i < len(rows):
                    move = moves[i]
                    audit += move[0]
                    cost += {"K": 0, "R": 2, "D": 3}[move[0]] + (move != "D" and faults[i] == "truncated")
                    if move != "D":
                        kept.append((move[1:] or rows[i][2], rows[i][3]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, kept)
    return best


def _plain(rows, faults):
    """The same by a table over rows, for longer conversations: least (cost, audit) per last initial, roles kept along."""
    table = {"": (0, "", ())}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def put(t, key, value):
        if key not in t or value[:2] < t[key][:2]:
            t[key] = value

    def closed(t):
        for _ in range(3):
            for last, (cost, audit, kept) in list(t.items()):
                put(t, after[last], (cost + 2, audit + "I", (kept, (name[after[last]], ""))))
        return t

    table = closed(table)
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for last, (cost, audit, kept) in table.items():
            put(new, last, (cost + 3, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[last] and role[:1]:
                put(new, role[0], (cost + more, audit + "K", (kept, (role, text))))
            put(new, after[last], (cost + 2 + more, audit + "R", (kept, (name[after[last]], text))))
        table = closed(new)
    cost, audit, chain = min((table[k] for k in ("", "a") if k in table), key=lambda x: x[:2])
    kept = []
    while chain:
        chain, last = chain
        kept.append(last)
    return cost, audit, kept[::-1]


def _want(rows, solve, damage=True):
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for conv, *_ in rows}
    convs = defaultdict(list)
    for r in _damaged(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        convs[r[0]].append(r)
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults = _faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, kept = solve(mine, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, cv string"


def _got(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}


def _conversations(n, most):
    rng = random.Random(n)
    rows = []
    for conv in [None, *range(-3, n)]:
        for i in range(rng.randrange(1, most)):
            turn = rng.choice([i, i, i, i, 2 * i, None, 7])
            rows.append((conv, turn, rng.choice(["system", "user", "user", "assistant", "assistant", None, "", "tool", "ursula"]), rng.choice(["A b.", "c", "d!\n ", " \t", "", None, "e?", f"own {i}."])))
    return rows


def test_repair_against_all_edits(spark):
    rows = _conversations(40, 4)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    assert _got(repair.repair(spark, df)) == _want(rows, _cheapest, False)
    assert _got(repair.damaged_and_repaired(spark, df)) == _want(rows, _cheapest)


def test_repair_of_longer_conversations(spark):
    rows = _conversations(150, 14)
    few = _conversations(25, 3)
    assert _want(few, _plain) == _want(few, _cheapest)  # the plain table is right
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert _got(repair.damaged_and_repaired(spark, df)) == _want(rows, _plain)
    assert repair.damaged_and_repaired(spark, df.limit(0)).count() == 0


def test_repair_of_one_long_conversation(spark):
    """A conversation with most rows of the table is cut where the ranges end."""
    rng = random.Random(1)
    rows = [(1, i if i % 11 else None, rng.choice(["user", "user", "assistant", "system"]), rng.choice(["A b.", f"own {i}.", f"cut {i}", ""])) for i in range(3000)]
    rows += [(2, i, "user", f"{i}.") for i in range(700)] + [(3, 0, "user", "same.")] * 500
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = repair.stretches(repair.faults(spark, df)).groupBy("cv").count().collect()
        assert max(r["count"] for r in cut) > 1
        assert _got(repair.repair(spark, df)) == _want(rows, _plain, False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
