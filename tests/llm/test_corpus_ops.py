"""Every corpus operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pastline.llm import chat, classifier, components, decontaminate, langid, linededup, ngramjoin, packing, queries, rangecoder, rules, substrings, tokenfiles
from pastline.llm.tokenize import default_vocabulary, tokenizer
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n long, names string, component long"


def _words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts():
    """Nulls, empty and long texts, ties, repeated passages, near copies in chains, a hub of copies."""
    rng = random.Random(5)
    passage, base = _words(rng, 40), _words(rng, 200)
    texts = [None, "", " \n\t ", "one", "One", "a b", "a b c", "é è ünï 漢字", "x" * 5000, _words(rng, 30_000), "same same " * 60]
    texts += [base] * 5 + [base.upper()]
    words = base.split()
    for step in range(1, 8):  # a chain: each differs from the last by one word
        words = [*words[: step * 20], f"new{step}", *words[step * 20 + 1 :]]
        texts.append(" ".join(words))
    texts += [_words(rng, 60) + "\n" + passage + "\nAll rights reserved.\n" + _words(rng, 50) for _ in range(12)]
    texts += [_words(rng, 12), _words(rng, 13)] * 2
    texts += ["\\### Assistant: </turn> ok", "<|endoftext|> 'S don't İ Σ", "12 13 14!? ... \r\n \x0b x", "emoji 😀😀 ́a"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, ["en", "de", None][i % 3], f"s{i % 11}" if i % 7 else None, i, "x", 1) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def both(docs, table):
    return [[(r["doc_id"], r["text"]) for r in x.select("doc_id", "text").collect()] for x in (docs, table)]


def test_ids_equal_the_library(docs, table):
    t = tokenizer(default_vocabulary())
    for rows in both(docs, table):
        from pastline.llm import textkernel as K

        data, offsets = K.utf8(pa.array([x for _, x in rows]))
        ids, ends = t.encode(data, offsets)
        for i, (_, text) in enumerate(rows):
            assert ids[ends[i] : ends[i + 1]].tolist() == [*t.full.encode(text or "", add_special_tokens=False).ids, 2]


def test_packing(spark, docs, table):
    t = tokenizer(default_vocabulary()).full
    for frame in (docs, table, docs.where("false")):
        got = packing.pack_documents(spark, frame, default_vocabulary()).collect()
        pieces, seqs = defaultdict(list), defaultdict(list)
        for r in got:
            pieces[r["doc_id"]].append(r)
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        rows = frame.select("doc_id", "text").collect()
        assert len(pieces) == len(rows)
        for doc_id, text in rows:
            ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 2], 0
            for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == brute.crc(ids[at : at + r["length"]])
                at += r["length"]
            assert at == len(ids)
        for parts in seqs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096


def test_packing_ranks_over_buckets_and_joins_sequences(spark, docs):
    from pastline.llm import store

    pieces = store.table(spark, packing.cut_documents(docs, default_vocabulary(), 64), "pieces")
    packed = packing.pack(spark, pieces, 64, unit=1, bucket_pieces=3)
    seqs = packing.sequences(packed, 64).collect()
    assert sum(r["n_tokens"] for r in seqs) == pieces.agg(F.sum("length")).first()[0] and all(r["n_tokens"] * 4 == len(r["ids"]) and r["n_tokens"] <= 64 for r in seqs)
    assert len(seqs) == packed.select("sequence_id").distinct().count() == packed.agg(F.max("sequence_id")).first()[0] + 1


def test_patterns_cover_the_demand_with_little_padding():
    rng = np.random.default_rng(1)
    demand = rng.integers(0, 500, 128)
    plan = packing.solve_patterns(demand, 128)
    got = np.zeros(128, np.int64)
    for pattern, times in plan:
        assert sum((c + 1) * n for c, n in pattern.items()) <= 128
        for c, n in pattern.items():
            got[c] += n * times
    assert (got == demand).all()
    assert sum(k for _, k in plan) <= 1.02 * np.ceil((demand * np.arange(1, 129)).sum() / 128) + (demand[64:].sum() > 0) * max(0, 2 * demand[64:].sum() - (demand * np.arange(1, 129)).sum() / 128)
    assert packing.solve_patterns(np.zeros(8, int), 8) == []


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b #### </turn>\n### user\nx"), (2, 0, None, None), (2, 1, "assistant", None), (3, 0, "odd\\role\n#:", "t"), (3, 1, "assistant", "é😀"), (3, 1, "assistant", "é😀")]
    rows += [(-7, i, ["user", "assistant"][i % 2], f"turn {i} <{'#' * (i % 5)}\\") for i in range(2500)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    formatted = chat.format_conversations(spark, turns)
    assert formatted.where("conv_id = -7").count() > 1  # a long conversation streams in chunks
    got = {r["conv_id"]: r for r in chat.digest_conversations(formatted).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        said = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert {r["conv_id"]: r["n"] for r in formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()} == {c: r["formatted_chars"] for c, r in got.items()}
    assert chat.digest_conversations(chat.format_conversations(spark, turns.where("false"))).count() == 0


def test_range_coder_round_trip_and_damage():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0), np.zeros(9), rng.integers(0, 300, 1), rng.integers(0, 49408, 3000), rng.zipf(1.3, 40_000) % 49408, np.tile(rng.integers(0, 500, 50), 400)):
        block = rangecoder.encode_block(ids.astype(np.uint32), np.array([len(ids)]), 49408)
        got, lengths = rangecoder.decode_block(block)
        assert (got == ids).all() and lengths.tolist() == [len(ids)]
    assert len(block) < len(ids)  # repeats are predicted
    damaged = bytearray(block)
    damaged[len(block) // 2] ^= 1
    for bad in (bytes(damaged), block[:-1], block[:10], b"x" + block[1:]):
        with pytest.raises(rangecoder.CorruptBlock):
            rangecoder.decode_block(bad)
    with pytest.raises(ValueError, match="vocabulary"):
        rangecoder.encode_block(np.array([7], np.uint32), np.array([1]), 5)


def test_token_files(spark, docs, table, tmp_path):
    t = tokenizer(default_vocabulary()).full
    for n, frame in enumerate((docs, table, docs.where("false"))):
        path = f"file://{tmp_path}/{n}"
        tokenfiles.blocks(frame, default_vocabulary(), block_tokens=1000).write.parquet(path)  # many texts span blocks
        start = 0
        got = sorted(tokenfiles.read_ids(spark, path, with_ids=True).collect())
        rows = sorted(frame.select("doc_id", "text").collect())
        assert len(got) == len(rows)
        for r, (doc_id, text) in zip(got, rows, strict=True):
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), brute.crc(ids))
            assert r["ids"] is None or np.frombuffer(r["ids"], "<u4").tolist() == ids
            start += len(ids)


def test_substrings(spark, docs, table, monkeypatch):
    for most in (substrings.GROUP_SUFFIXES, 3):  # the second splits prefixes down to single nodes
        monkeypatch.setattr(substrings, "GROUP_SUFFIXES", most)
        for frame, rows in zip((docs, table), both(docs, table), strict=True):
            got = substrings.remove_repeats(spark, frame).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
            assert {r[0]: tuple(r)[1:] for r in got} == brute.removed_repeats(rows) and len(got) == len(rows)
    assert substrings.remove_repeats(spark, docs.where("false")).count() == 0


def test_maximal_repeats(spark, docs, table, monkeypatch):
    for most in (substrings.GROUP_SUFFIXES, 3):
        monkeypatch.setattr(substrings, "GROUP_SUFFIXES", most)
        for frame, rows in zip((docs, table), both(docs, table), strict=True):
            got = substrings.maximal_repeats(spark, frame).drop("part", "first_part").collect()
            assert {tuple(r) for r in got} == brute.maximal_repeats(rows) and len(got) == len(set(got))
    assert substrings.maximal_repeats(spark, docs.where("false")).count() == 0


def test_codes_that_agree_but_for_the_mark(spark):
    """Windows whose word names collide are told apart by their mark, also where a batch ends between them."""
    key = bytes(range(26))
    rows = [(1, 0, key, 5), (2, 7, key, 5), (3, 0, key, 6), (4, 1, key, 6), (9, 2, bytes(26), 6)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = substrings._leaves(spark.createDataFrame(rows, substrings.SUFFIXES).coalesce(1).sortWithinPartitions("words", "mark", "doc_id", "at")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == {(2, 7, 1, 0), (4, 1, 3, 0)}


def test_rules(spark, docs, table):
    for frame, rows in zip((docs, table), both(docs, table), strict=True):
        got = {r["doc_id"]: r for r in rules.quality_rules(spark, frame).collect()}
        assert len(got) == len(rows)
        for doc_id, text in rows:
            r = got[doc_id]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.rule_counts(text)
            assert not (r["base_failed"] and r["kept"])
    assert rules.quality_rules(spark, docs.where("false")).count() == 0


def test_rules_tell_prose_from_junk(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = rules.quality_rules(spark, docs).join(labels, "doc_id").where("not base_failed").collect()
    kept = {q: [r["kept"] for r in rows if r["quality"] == q] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.97
    assert np.mean(kept[0]) < 0.5


def test_jensen_shannon():
    p = np.array([[1.0, 0.0], [1.0, 1.0], [0.0, 0.0]])
    assert np.allclose(rules.jensen_shannon(p, np.array([0.0, 1.0])), [1.0, 0.5579230452841438, 0.0])


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_ngram_join(spark, docs, table, words, percent):
    for frame, rows in zip((docs, table), both(docs, table), strict=True):
        got = ngramjoin.near_duplicates(spark, frame, ngramjoin.Params(words, percent)).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == brute.linked(rows, words, percent) and len(got) == len(rows)
    if words == 5:
        assert ngramjoin.near_duplicates(spark, docs.where("false")).count() == 0


def test_ngram_join_crosses_components_in_one_list(spark):
    """Texts around three bases that share words: links between members, none of which is a list's least."""
    rng = random.Random(2)
    base, rows = _words(rng, 80).split(), []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(80)] = f"z{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in ngramjoin.near_duplicates(spark, frame, ngramjoin.Params(2, 80)).collect()}
    assert got == brute.linked(rows, 2, 80)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (7, 8), (8, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for frame, sites, once in ((docs, 8, False), (docs, 2, True), (docs, 1, False), (big, 8, True), (big, 3, False)):
        got = linededup.remove_boilerplate(frame, sites, once).select("doc_id", "text", "n_lines", "n_removed").collect()
        want = brute.boilerplate_free([(r["doc_id"], r["text"], r["source"]) for r in frame.collect()], sites, once)
        assert sorted(map(tuple, got)) == sorted(want)
    assert linededup.remove_boilerplate(docs.where("false")).count() == 0
    assert set(docs.columns) <= set(linededup.remove_boilerplate(docs).columns)


def test_line_dedup_oracle(spark):
    d = "/root/testdata/sf0.01"
    got = sorted(map(tuple, queries.op7_line_dedup(spark, d).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    assert got == sorted(con.execute(queries.ORACLES["op7_line_dedup"]).fetchall())


def test_contamination(spark, docs, table):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    items += [(900, None), (901, "!?"), (902, "same same same"), (903, "A b, c"), (904, odd_texts()[-10].split("\n")[0] if "\n" in (odd_texts()[-10] or "") else "w1 w2 w3 w4 w5 w6")]
    rng = random.Random(4)
    edited = []
    for i, (_, text) in enumerate(items[:30]):
        w = text.split()
        if len(w) > 20:
            w[rng.randrange(len(w))] = "changed" if i % 2 else w[0]
        edited.append((10_000 + i, f"{_words(rng, 30)} {' '.join(w).upper()} {_words(rng, 30)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for rows in (*both(docs, table), edited):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(spark, frame, bench).collect()}
        want = brute.contaminated(rows, items)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        left = {r["doc_id"] for r in decontaminate.decontaminate(spark, frame, bench).collect()}
        assert left == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.contaminated(spark, docs, bench.where("false")).count() == 0


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 60, 12))) for i in range(40)]
    group = next(iter(decontaminate.build_index(items).sizes[5][4].values()))
    prints = rng.integers(0, 256, (200, 16)).astype(np.uint8)
    prints[:40] = group.prints
    for i in range(40):
        bits = rng.choice(128, 20 + i % 14, replace=False)
        for b in bits:
            prints[i, b // 8] ^= 1 << (b % 8)
    near = np.bitwise_count(prints[:, None] ^ group.prints[None]).sum(2) <= decontaminate.RADIUS
    assert set(zip(*map(list, group.candidates(prints)), strict=True)) == set(zip(*map(list, np.nonzero(near)), strict=True))


def test_language(spark, docs):
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/documents.parquet")
    got = queries.op9_language(spark, d).join(table, "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    odd = {r["doc_id"]: r for r in langid.with_language(spark, docs).collect()}
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd.values())
    assert all(odd[i]["lang_pred"] == "und" for i in (0, 3, 6))
    assert langid.with_language(spark, docs.where("false")).count() == 0
    kept = langid.keep_identified(spark, table)
    assert kept.columns == table.columns and kept.count() >= 0.99 * table.count()


def test_language_ignores_held_out_labels(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    other = table.withColumn("lang", F.when(langid.remainder() == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    rows = [sorted(map(tuple, langid.with_language(spark, x).collect())) for x in (table, other)]
    assert rows[0] == rows[1]


def test_quality_classifier(spark, docs):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op10_quality(spark, d)
    held = got.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
    assert got.count() == 1000
    model = classifier.fit(docs, spark.createDataFrame([(0, None)], "doc_id long, label int"))  # nothing to learn from
    assert all(r["score"] == 0.5 for r in classifier.score(spark, docs, model).collect())
    assert classifier.score(spark, docs.where("false"), model).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r["doc_id"]: r for r in langid.keep_identified(spark, docs).collect()}
    for d, text, _, _ in brute.boilerplate_free([(r["doc_id"], r["text"], r["source"]) for r in rows.values()], distinct_texts=True):
        rows[d] = text
    roots = brute.linked(list(rows.items()), 5, 80)
    rows = {d: t for d, t in rows.items() if roots[d][1] == d}
    bad = brute.contaminated(list(rows.items()), [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()])
    rows = {d: t for d, t in rows.items() if d not in {x for x, _ in bad}}
    t = tokenizer(default_vocabulary()).full
    want = {d: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for d, x in rows.items()}
    got = p.run(spark, DIR).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == want == {r["doc_id"]: r["m"] for r in got}
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns, name
        assert stage(spark, docs.where("false"), DIR).count() == 0, name
    assert p.pack(spark, docs.where("false"), DIR).count() == 0
