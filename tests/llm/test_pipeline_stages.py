"""Stages of the corpus pipeline on repeated rows and on columns whose names they use themselves."""

import pytest

p = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_removed int, row int"


def test_lines_keeps_columns_of_its_own_names(spark):
    rows = [(i, f"same line\nown {i}", "en", f"s{i}", 5, 77, 78, 79) for i in range(9)]
    got = p.lines(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((r["doc_id"], r["text"], r["n_chars"], r["n_lines"], r["n_removed"], r["row"]) for r in got.collect()) == [(i, f"own {i}", 5, 77, 78, 79) for i in range(9)]


def test_near_duplicates_keeps_one_of_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 5, 1, 1, 1), (1, text, "en", "a", 5, 1, 1, 1), (2, text, "en", "b", 5, 1, 1, 1), (3, "other words", "en", "c", 5, 1, 1, 1), (None, "x", "en", "c", 5, 1, 1, 1)]
    got = p.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "None"]
