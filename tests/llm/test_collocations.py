"""Collocations against a plain version on small texts, and the counting of phrases with guards and overlaps."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pastline.llm import collocations


def plain(rows, least, top, covered=80):
    f, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: n for p, n in counts.items() if len(p) > 1 and n >= least}
        rows = []
        for p, a in cand.items():
            if any(100 * b >= covered * a for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def _rows():
    rng = random.Random(2)
    words = ["The", "the", "a", "of", "é", "漢字", "x-y", "\x00", "und", "to", "to"]
    rows = []
    for i in range(240):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " !", "\x0b", "\xa0"]) for _ in range(rng.randrange(0, 60)))
        rows.append((text, ["en", "fr", None, "und", "e'n"][i % 5 if i % 3 else 0]))
    return [*rows, (None, "en"), ("", None), (" .", "xx"), ("to " * 400, "en"), ("A B c d E. " * 40, "de"), ("A B c d E. " * 40, "de"), ("lone", "it"), ("the of " * 30_000, "yy")]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("least", "top", "full"), [(30, 2000, False), (5, 7, False), (30, 20, True)])
def test_collocations(spark, monkeypatch, least, top, full):
    """Sketches written in small parts, sketches that are full, and automata of few phrases change nothing."""
    if least < 30 or full:
        for name, value in (("AUTOMATON_BYTES", 4000), ("HELD", 50), ("SEEN", 4)):
            monkeypatch.setattr(collocations, name, value)
    if full:
        monkeypatch.setattr(collocations, "sketch", lambda *_: np.full((2 << collocations.CELL_BITS) // 8, 255, np.uint8))
    rows = _rows()
    df = spark.createDataFrame([(*r, "p") for r in rows], "text string, lang string, phrase string").repartition(5)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(spark, df, least, top).collect())
    assert got == sorted(plain(rows, least, top)) and got


def test_no_rows(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(spark, df).columns == COLUMNS and collocations.collocations(spark, df).count() == 0


def test_scores_do_not_overflow(spark, monkeypatch):
    big = 3_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, big + 7), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 11)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 2 * big)], "lang string, n long")
    monkeypatch.setattr(collocations, "frequent", lambda *_: (counts, totals))
    (row,) = collocations.collocations(spark, counts).collect()
    assert row["score"] == 2_000_000 * (big - 11) // (2 * big + 8)


def test_written_anew():
    words = collocations.split(pa.array(["A b,c\t d", None, "é\nf"]), "en")
    assert words.text.tobytes().decode() == " a b \n c d \n é \n f \n"
    a = collocations.automata("t", ["en"] * 3, ["a b", "b", "to to"])["en"]
    assert sorted(v for _, v in a.iter(" a b \n to to to b \n")) == [0, 1, 1, 2, 2]


def test_texts_are_read_four_times_for_any_number_of_automata(spark, monkeypatch):
    monkeypatch.setattr(collocations, "AUTOMATON_BYTES", 200)
    seen = spark.sparkContext.accumulator(0)

    def text(i):
        seen.add(1)
        return f"the {i % 7} of {i % 5} and {i % 3} to {i % 4}, so"

    docs = spark.range(400, numPartitions=3).select(F.udf(text)("id").alias("text"), F.lit("en").alias("lang"))
    assert collocations.collocations(spark, docs).count() > 10 and seen.value == 4 * 400


def test_one_automaton_for_all_windows(spark, monkeypatch):
    """Phrases that begin inside a window, or in one of another kind, are not counted there, though all meet one automaton."""
    for name, value in (("SHARDS", 1), ("WINDOW_BYTES", 1000)):
        monkeypatch.setattr(collocations, name, value)
    rows = _rows()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(spark, df, 4, 2000).collect())
    assert got == sorted(plain(rows, 4, 2000)) and got
