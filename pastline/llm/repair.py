"""Repair of conversation structure by a forward Viterbi DP.

A conversation's rows should have role initials ``(s?(ua)+)?``. Four states say what came last (nothing, system, user, assistant), and from
each only one role can be inserted or given, so a row's cheapest edits are found with the least (cost, audit string) per state: after each row
the layer is closed by bounded insertions (at most two in a row help). For equal costs no audit begins with the other, so the least audit of a
state stays least whatever follows. That also makes the layers of consecutive stretches composable: a stretch becomes a matrix from state to
state, so a conversation of any length is cut where the sort's ranges end, and only matrices meet per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.llm import store

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Rows of a stretch that is one matrix; longer stretches are products of such.
BLOCK = 128
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state, the one that an inserted or renamed row leads to, and the states that a row's own initial leads to.
NEXT = (USER, USER, ASSISTANT, USER)
OWN = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FINAL = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
WHITE = " \t\n\x0b\f\r"

Layer = list[tuple[int, str] | None]


def close(layer: Layer) -> Layer:
    """Adds the insertions that follow a row. Going round is never cheaper, so two steps reach every state."""
    for _ in range(2):
        for state, to in enumerate(NEXT):
            if layer[state] is not None:
                cost, audit = layer[state]
                found = (cost + INSERT, audit + "I")
                if layer[to] is None or found < layer[to]:
                    layer[to] = found
    return layer


def step(layer: Layer, initial: str, bad: bool, cut: bool) -> Layer:
    """The layer after one more row: ``bad`` rows must go, ``cut`` ones cost more if they stay."""
    out: Layer = [None] * 4
    own = OWN.get(initial, {})
    for state, held in enumerate(layer):
        if held is None:
            continue
        cost, audit = held
        moves = [(state, DELETE, "D")]
        if not bad:
            moves.append((NEXT[state], REROLE + CUT * cut, "R"))
            if state in own:
                moves.append((own[state], KEEP + CUT * cut, "K"))
        for to, price, letter in moves:
            found = (cost + price, audit + letter)
            if out[to] is None or found < out[to]:
                out[to] = found
    return close(out)


def deleted(layer: Layer, n: int) -> Layer:
    """The layer after ``n`` rows that must go: what is inserted stands behind them, which is least of what costs the same."""
    return close([None if x is None else (x[0] + DELETE * n, x[1] + "D" * n) for x in layer])


def compose(one: list[Layer | None], two: list[Layer | None]) -> list[Layer | None]:
    """The matrix of two stretches, one after the other."""
    out: list[Layer | None] = []
    for layer in one:
        row: Layer = [None] * 4
        for middle, held in enumerate(layer or []):
            if held is None or two[middle] is None:
                continue
            for to, more in enumerate(two[middle]):
                if more is not None and (row[to] is None or held[0] + more[0] <= row[to][0]):
                    found = (held[0] + more[0], held[1] + more[1])
                    row[to] = found if row[to] is None else min(row[to], found)
        out.append(row if layer else None)
    return out


class Stretch:
    """A growing stretch: blocks of rows as matrices, neighbours of equal size multiplied, so no long audit is copied for each row."""

    def __init__(self, entries: tuple[int, ...]):
        self.entries, self.blocks = entries, []
        self.begin()

    def begin(self) -> None:
        fresh = lambda e: close([(0, "") if s == e else None for s in range(4)])
        # Only the first block can be limited to the stretch's entries.
        self.now = [fresh(e) if self.blocks or e in self.entries else None for e in range(4)]
        self.size = 0

    def add(self, initial: str, copies: int, blank: bool, seen: bool, cut: bool) -> None:
        """Equal rows: of these the first may stay unless it is blank or was seen before, the others go."""
        bad = blank or seen
        for e, layer in enumerate(self.now):
            if layer is not None:
                layer = layer if bad else step(layer, initial, False, cut)
                gone = copies if bad else copies - 1
                self.now[e] = deleted(layer, gone) if gone else layer
        self.size += 1
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        self.blocks.append((0, self.now))
        while len(self.blocks) > 1 and self.blocks[-1][0] == self.blocks[-2][0]:
            (level, two), (_, one) = self.blocks.pop(), self.blocks.pop()
            self.blocks.append((level + 1, compose(one, two)))
        self.begin()

    def matrix(self) -> list[Layer | None]:
        parts = [m for _, m in self.blocks] + ([self.now] if self.size or not self.blocks else [])
        out = parts[0]
        for m in parts[1:]:
            out = compose(out, m)
        return out


def _key(df: DataFrame) -> DataFrame:
    """Rows with keys without nulls: ``cn, cv`` of the conversation, ``tn, tv`` of the turn (nulls first), ``role``, ``digest`` of the text."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    return df.select(conv.isNotNull().alias("cn"), F.coalesce(conv, F.lit(0)).alias("cv"), turn.isNotNull().alias("tn"), F.coalesce(turn, F.lit(0)).alias("tv"), one_space("role").alias("role"), one_space("text").alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


CONV, ORDER = ["cn", "cv"], ["tn", "tv", "role", "digest"]


def faults(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One stored row per conversation, turn, role and text: how often it comes (``m``), ``initial``, and whether it is ``blank``, ``seen``
    before in its conversation or ``cut`` off. Texts stay behind: only digests are dealt out."""
    rows = _key(turns)
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    narrow = rows.select(*CONV, *ORDER, (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    units = narrow.groupBy(*CONV, *ORDER).agg(F.count("*").alias("m"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    units = store.table(spark, units, "turns")
    first = F.min(F.struct("tn", "tv")).alias("first")
    again = units.where(~F.col("blank")).groupBy(*CONV, "role", "digest").agg(first, F.count("*").alias("places")).where(F.col("places") > 1)
    joined = store.spread_left(spark, units, store.table(spark, again, "again"), [*CONV, "role", "digest"], "places", units.count())
    seen = F.col("places").isNotNull() & (F.struct("tn", "tv") > F.col("first"))
    return store.table(spark, joined.select(*CONV, *ORDER, "m", F.substring("role", 1, 1).alias("initial"), "blank", seen.alias("seen"), (F.col("cut") & ~F.col("blank") & ~seen).alias("cut")), "faults")


STRETCH = (
    "cn boolean, cv long, tn boolean, tv long, role string, digest binary, last_tn boolean, last_tv long, lo long, turns long, blank long, duplicate long, truncated long, "
    "illegal long, first_initial string, last_initial string, costs array<long>, audits array<string>"
)
AUDIT = "cn boolean, cv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {"su", "ua", "au"}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def stretches(units: DataFrame) -> DataFrame:
    """Per conversation and range of the sort: counts and the matrix of its rows. A conversation over several ranges has several rows."""
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in STRETCH.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, now, count = [], 0, None, 0

        def done() -> None:
            nonlocal held
            flat = [layer[to] if layer is not None else None for layer in now.pop("stretch").matrix() for to in range(4)]
            now["costs"], now["audits"] = [x[0] if x else -1 for x in flat], [x[1] if x else "" for x in flat]
            held += sum(map(len, now["audits"]))
            out.append(now)

        for batch in batches:
            for u in batch.to_pylist():
                if now is None or (now["cn"], now["cv"]) != (u["cn"], u["cv"]):
                    if now is not None:
                        done()
                        if len(out) >= 1000 or held > 4 << 20:
                            yield _batch(out, schema)
                            out, held = [], 0
                    # Only a range's first conversation can have begun before it.
                    now = {k: u[k] for k in ("cn", "cv", "tn", "tv", "role", "digest")} | {k: 0 for k in ("turns", "blank", "duplicate", "truncated", "illegal")}
                    now |= {"stretch": Stretch((0, 1, 2, 3) if not count else (START,)), "first_initial": u["initial"], "last_initial": None, "last_tn": False, "last_tv": None, "lo": None}
                    count += 1
                m, bad = u["m"], u["blank"] or u["seen"]
                now["blank"] += m * u["blank"]
                now["duplicate"] += 0 if u["blank"] else m if u["seen"] else m - 1
                now["truncated"] += u["cut"] and not bad
                now["illegal"] += (m - 1) * (u["initial"] * 2 not in LEGAL) + (now["last_initial"] is not None and now["last_initial"] + u["initial"] not in LEGAL)
                now["turns"] += u["tn"] and (not now["last_tn"] or u["tv"] != now["last_tv"])
                now["lo"] = u["tv"] if u["tn"] and now["lo"] is None else now["lo"]
                now |= {"last_initial": u["initial"], "last_tn": u["tn"], "last_tv": u["tv"]}
                now["stretch"].add(u["initial"], m, u["blank"], u["seen"], u["cut"])
        if now is not None:
            done()
        if out:
            yield _batch(out, schema)

    return units.repartitionByRange(*CONV, *ORDER).sortWithinPartitions(*CONV, *ORDER).mapInArrow(run, STRETCH)


def audits(found: DataFrame) -> DataFrame:
    """Per conversation: counts, cost and audit from its :func:`stretches`, taken in order."""
    schema = pa.schema([(name, {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}[kind]) for name, kind in (x.split() for x in AUDIT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def done() -> dict:
            cost, audit = min(x for s, x in enumerate(now["layer"]) if x is not None and s in FINAL)
            gaps = now["hi"] - now["lo"] + 1 - now["turns"] if now["turns"] else 0
            return {k: now[k] for k in ("cn", "cv", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit}

        for batch in batches:
            for s in batch.to_pylist():
                flat = [(c, a) if c >= 0 else None for c, a in zip(s["costs"], s["audits"], strict=True)]
                matrix = [flat[e : e + 4] if any(flat[e : e + 4]) else None for e in range(0, 16, 4)]
                if now is None or (now["cn"], now["cv"]) != (s["cn"], s["cv"]):
                    if now is not None:
                        out.append(done())
                    now = {k: s[k] for k in ("cn", "cv", "blank", "duplicate", "truncated", "illegal", "turns")} | {"layer": matrix[START], "lo": None, "hi": None}
                else:
                    for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
                        now[k] += s[k]
                    now["illegal"] += now["initial"] + s["first_initial"] not in LEGAL
                    now["turns"] -= s["tn"] and now["hi"] is not None and s["tv"] == now["hi"]
                    now["layer"] = compose([now["layer"]], matrix)[0]
                now["initial"] = s["last_initial"]
                if s["last_tn"]:
                    now["lo"] = s["lo"] if now["lo"] is None else now["lo"]
                    now["hi"] = s["last_tv"]
            yield _batch(out, schema)
            out = []
        yield _batch([*out, *([done()] if now is not None else [])], schema)

    return found.repartition(*CONV).sortWithinPartitions(*CONV, *ORDER).mapInArrow(run, AUDIT)


def edits(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """``cn, cv, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation, stored."""
    store.small_batches(spark)
    return store.table(spark, audits(stretches(faults(spark, turns))), "audits")


REPAIRED = "cn boolean, cv long, place long, role string, text string, edit string"


def repaired_turns(turns: DataFrame, edited: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: ``cn, cv, place`` (from 0), ``role, text, edit`` (K, R or I). Each partition has its conversations
    whole and in order; rows stream through, with one conversation's audit held at a time."""
    schema = pa.schema([(name, {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}[kind]) for name, kind in (x.split() for x in REPAIRED.split(", "))])
    rows = _key(turns).select(*CONV, F.lit(True).alias("row"), *ORDER, "text", F.lit("").alias("audit"))
    heads = edited.select(*CONV, F.lit(False).alias("row"), F.lit(False).alias("tn"), F.lit(0).cast("long").alias("tv"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit("").alias("text"), "audit")
    dealt = heads.unionByName(rows).repartition(*CONV).sortWithinPartitions(*CONV, "row", *ORDER).select(*CONV, "row", "role", "text", "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, place, state, out = None, "", 0, 0, START, []

        def put(role: str, text: str, edit: str) -> None:
            nonlocal place
            out.append((*key, place, role, text, edit))
            place += 1

        def inserted() -> None:
            nonlocal at, state
            while audit[at : at + 1] == "I":
                at, state = at + 1, NEXT[state]
                put(ROLE[state], "", "I")

        for batch in batches:
            for r in batch.to_pylist():
                if not r["row"]:
                    key, audit, at, place, state = (r["cn"], r["cv"]), r["audit"], 0, 0, START
                    inserted()
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = NEXT[state] if edit == "R" else OWN[r["role"][:1]][state]
                    put(ROLE[state] if edit == "R" else r["role"], r["text"], edit)
                inserted()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out = []

    return dealt.mapInArrow(run, REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """``cn, cv, repaired_sha256`` straight from the partitions of :func:`repaired_turns`: ``role:text`` joined by line feeds, UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.string()))], names=[*CONV, "repaired_sha256"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["cn"], r["cv"]) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (r["cn"], r["cv"]), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{r['role']}:{r['text']}".encode())
            yield flush()
            out.clear()
        if key is not None:
            out.append((*key, digest.hexdigest()))
        yield flush()

    return repaired.mapInArrow(run, "cn boolean, cv long, repaired_sha256 string")


def repair(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Per conversation of ``turns`` (``conv_id, turn, role, text``; others may have any name): ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``.

    A null role or text is one space; a null conv_id is a conversation of its own. Rows go by turn (nulls first); those of one turn by role and
    the text's SHA-256, so repeated rows stand together. A row's first fault counts: blank (only white space), duplicate (its role and text
    came before), truncated (the last character that isn't white space is none of ``.!?``). An empty role has no initial and can't be kept. A
    table without rows gives none. Long texts are sent once, to the digest that reads them in order.
    """
    edited = edits(spark, turns)
    hashed = digests(repaired_turns(turns, edited))
    empty = F.lit(hashlib.sha256().hexdigest())
    return edited.join(hashed, CONV, "left").select(
        F.when(F.col("cn"), F.col("cv")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with a fault by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes out
    ``.!?``, 3 repeats it, 4 makes it the user's. Nulls are one space there."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace(one_space("text"), "[.!?]", "")).otherwise(one_space("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(one_space("role"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"), k.alias("k")).where("k <> 0")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def damaged_and_repaired(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """:func:`repair` of the damaged rows, with a row for every conversation of ``turns``: zeros and an empty audit where no row is left."""
    found = repair(spark, damage(turns)).withColumns({"cn": F.col("conv_id").isNotNull(), "cv": F.coalesce("conv_id", F.lit(0).cast("long"))}).drop("conv_id")
    conv = F.col("conv_id").cast("long")
    every = turns.select(conv.isNotNull().alias("cn"), F.coalesce(conv, F.lit(0)).alias("cv")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return every.join(found, CONV, "left").select(F.when(F.col("cn"), F.col("cv")).alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), sha)
