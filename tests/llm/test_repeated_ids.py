"""Repeated rows of one doc_id, rows without one, and extra columns with clashing names, through operators on documents."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pastline.llm import classifier, decontaminate, langid, linededup, ngramjoin, packing, rules, substrings, tokenfiles
from pastline.llm.tokenize import default_vocabulary
from tests.llm import brute
from tests.llm.test_corpus_ops import _words

CLASHES = ["n_lines", "n_removed", "kind", "bucket", "rank", "offset", "shingle", "rep", "part", "starts", "gone", "doc", "t", "a", "b", "component", "source", "lang"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base, other = _words(rng, 60), _words(rng, 50)
    near = base.replace(base.split()[30], "changed", 1)
    out = [(5, base), (5, base), (5, other), (3, near), (8, other), (8, None), (9, ""), (9, other + " tail"), (9, base), (None, base), (None, None), (2, "x\n\ny"), (2, "x\n\ny")]
    return [(d, t, *[f"c{i % 3}" for i in range(len(CLASHES))]) for d, t in out]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{c} string' for c in CLASHES)}").repartition(3)


def test_substrings_by_document(spark, frame, rows):
    first = defaultdict(lambda: float("inf"))
    for d, t, *_ in rows:
        w = brute.WORD.findall(t or "")
        for i in range(len(w) - 12):
            if d is not None:
                first[tuple(w[i : i + 13])] = min(d, first[tuple(w[i : i + 13])])
    want = Counter()
    for d, t, *_ in rows:
        w = brute.WORD.findall(t or "")
        gone = {k for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        want[d, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)] += 1
    assert Counter(map(tuple, substrings.remove_repeats(spark, frame).collect())) == want


def test_ngram_join_by_document(spark, frame, rows):
    sets = [(d, brute.shingles(t, 5)) for d, t, *_ in rows]
    root = {d: d for d, _ in sets if d is not None}
    for _ in range(9):
        for d, x in sets:
            for e, y in sets:
                if None not in (d, e) and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[d] = root[e] = min(root[d], root[e])
    want = Counter((d, len(x), (root[d] if x else d) if d is not None else None) for d, x in sets)
    assert Counter(map(tuple, ngramjoin.near_duplicates(spark, frame).collect())) == want


def test_line_dedup_by_row(frame, rows):
    got = linededup.remove_boilerplate(frame, 2)
    assert sorted(got.columns) == sorted(frame.columns) and got.count() == len(rows)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(r[:2] for r in rows)  # one site alone
    sites = frame.withColumn("source", F.col("doc_id").cast("string"))
    left = {(r["doc_id"], r["text"]) for r in linededup.remove_boilerplate(sites, 2).collect()}
    assert (8, "") in left and (9, "") in left and (8, None) in left and (2, "x\n\ny") in left and (None, "") in left


def test_rows_in_rows_out(spark, frame, rows):
    ids = Counter(r[0] for r in rows)
    for got in (rules.quality_rules(spark, frame), langid.with_language(spark, frame)):
        assert Counter(r["doc_id"] for r in got.select("doc_id").collect()) == ids
    kept = langid.keep_identified(spark, frame)
    assert kept.columns == frame.columns and kept.count() == sum(1 for r in rows if r[1] and len(r[1]) > 9)  # the others have no n-gram
    bench = spark.createDataFrame([(1, rows[0][1]), (1, None), (None, rows[2][1])], "item_id long, text string")
    clean = decontaminate.decontaminate(spark, frame, bench)
    assert clean.columns == frame.columns
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (8, None), (3, 0)], "doc_id long, label int")
    scored = classifier.score(spark, frame, classifier.fit(frame, labels)).collect()
    assert Counter(r["doc_id"] for r in scored) == ids and all(0 <= r["score"] <= 1 for r in scored)


def test_packing_and_token_files_of_repeated_ids(spark, frame, rows, tmp_path):
    from pastline.llm.tokenize import tokenizer

    t = tokenizer(default_vocabulary()).full
    sizes = Counter((d, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for d, x, *_ in rows)
    got = packing.pack_documents(spark, frame, default_vocabulary())
    assert got.agg(F.sum("length")).first()[0] == sum(n * c for (_, n), c in sizes.items())
    clash = got.select("doc_id", "start", "length", *[F.lit(9).alias(c) for c in ("kind", "bucket", "rank", "before", "local", "offset", "sequence_id", "piece", "tie0")])
    again = packing.pack(spark, clash)
    assert again.columns == ["doc_id", "start", "length", "kind", "bucket", "rank", "before", "local", "piece", "tie0", "sequence_id", "offset"]
    assert {r["kind"] for r in again.collect()} == {9} and again.count() == got.count()
    starts = []
    for k in range(2):
        path = f"file://{tmp_path}/{k}"
        tokenfiles.blocks(frame.repartition(1 + 4 * k), default_vocabulary(), block_tokens=50).write.parquet(path)
        starts.append(sorted(map(tuple, tokenfiles.read_ids(spark, path).collect()), key=lambda r: r[1]))
    assert starts[0] == starts[1] and Counter((r[0], r[2]) for r in starts[0]) == sizes


def test_repeated_items_are_one_item(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    other = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a b {passage} c {other}"), (2, "clean words only")], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (7, passage), (7, other), (8, other)], "item_id long, text string")
    got = decontaminate.contaminated(spark, docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 7), (1, 8)]
    assert all(r["similarity"] == 1.0 for r in got)
