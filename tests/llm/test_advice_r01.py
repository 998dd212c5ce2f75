"""Cases of the reviewer's findings of round 1."""

import random
from collections import Counter

from pyspark.sql import functions as F

from pastline.llm import decontaminate, langid, rules


def _text(name, n):
    return [f"{name}{i}" for i in range(n)]


def _found(spark, docs, items):
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(spark, frame, bench).collect()}
    left = {r["doc_id"] for r in decontaminate.decontaminate(spark, frame, bench).collect()}
    assert left == set(range(len(docs))) - {d for d, _ in found}
    return found


def test_contamination_of_documents_shorter_than_the_item(spark):
    item = _text("a", 40)  # 36 shingles
    cut = [*item[:2], *item[3:]]
    docs = [item[:-3], item[3:], cut, item[:30], ["x"], item[:20] + _text("b", 5)]
    found = _found(spark, docs, [item])
    # Exact similarities: 33/36, 33/36, 33 of 35 and 36 shingles (three go, two come), 26/36, none, few.
    assert {d: round(r["similarity"], 9) for (d, _), r in found.items()} == {0: round(33 / 36, 9), 1: round(33 / 36, 9), 2: round(33 / 38, 9)}
    assert (found[0, 0]["word_start"], found[0, 0]["n_words"], found[0, 0]["n_windows"]) == (0, 37, 1)


def _brute(docs, items, bound=0.8):
    """Plain and weighted similarity, the greater of which decides, of every window or shorter document."""
    grams = lambda w, k: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
    bags = [Counter(grams(w, min(5, len(w)))) for w in items]
    df = Counter(g for bag in bags for g in bag)
    found = {}
    for d, words in enumerate(docs):
        for i, bag in enumerate(bags):
            own, n = grams(words, min(5, len(items[i]))), bag.total()
            mean = sum(c / df[g] for g, c in bag.items()) / n
            for s in range(max(1, len(own) - n + 1) if own else 0):
                window = Counter(own[s : s + n])
                weight = {g: 1 / df[g] if g in bag else min(1 / max(1, df[g]), mean) for g in window | bag}
                plain = (window & bag).total() / (window | bag).total()
                value = max(plain, sum(c * weight[g] for g, c in (window & bag).items()) / sum(c * weight[g] for g, c in (window | bag).items()))
                if value >= bound - 1e-12:
                    found[d, i] = max(found.get((d, i), 0), value)
    return found


def _same(got, want):
    assert got.keys() == want.keys() and all(abs(got[k]["similarity"] - want[k]) < 1e-9 for k in got)


def test_contamination_of_items_that_share_text(spark, monkeypatch):
    rng = random.Random(7)
    item, lead, last = _text("a", 50), _text("p", 40), _text("z", 54)
    middle = [*item[:25], "changed", *item[26:]]
    items = [item, item, *([last] * 10), *(lead + _text(f"q{k}x", 20) for k in range(8))]
    docs = [middle, _text("f", 30) + middle + _text("g", 30), [*last[:-1], "changed"], lead + _text("q3x", 20)[:-1], lead + _text("new", 20), lead[:-5] + _text("q5x", 20)]
    for _ in range(40):  # items with up to four words changed, cut or added
        w = list(rng.choice(items))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = ["odd"] * rng.randrange(2)
        docs.append(_text("f", rng.randrange(9)) + w + _text("g", rng.randrange(9)))
    want = _brute(docs, items)
    assert {(0, 0), (0, 1), (1, 0), (2, 2)} <= want.keys() and not any(d == 4 for d, _ in want)
    _same(_found(spark, docs, items), want)
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 5)  # parts count what is shared over the whole benchmark
    _same(_found(spark, docs, items), want)


def test_language_with_near_languages_and_without_labels(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=40)), f"en-{i % 3}") for i in range(300)]
    rows += [(1000 + i, "".join(chr(0x3041 + rng.randrange(80)) for _ in range(60)), None) for i in range(5)] + [(2000, "12 34", None), (2001, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in langid.keep_identified(spark, docs).collect()}
    assert kept == set(range(300))  # three near languages; five texts of a script that no label has
    kept = {r["doc_id"] for r in langid.keep_identified(spark, docs.withColumn("lang", F.lit(None).cast("string"))).collect()}
    assert kept == {r[0] for r in rows} - {2000, 2001}


def test_language_of_more_than_one_slice(spark):
    rng = random.Random(4)
    own = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(20)] for k in range(150)}
    rows = [(i, " ".join(rng.choices(own[f"l{i % 150:03}"], k=30)), f"l{i % 150:03}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.with_language(spark, docs).collect()} == {d: x for d, _, x in rows}
    assert langid.keep_identified(spark, docs).count() == len(rows)


def test_language_references_count_every_word_in_any_layout(spark):
    fill = _text("w", 20)
    long, short = ["rare"] + fill * 1000 + fill[:-1], ["rare"] * 20 + fill * 48  # 21 of 21,000 words: just a thousandth
    rows = [(1, " ".join(long), "en"), (2, " ".join(short), "en")]
    words = Counter(long + short)
    for parts in (1, 2):  # both texts in one batch, or one each
        frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string, lang string")
        _, keys, shares = rules.references(frame)["en"]
        assert len(keys) == 21 and sorted(round(x * words.total()) for x in shares) == sorted([*words.values(), 0])
