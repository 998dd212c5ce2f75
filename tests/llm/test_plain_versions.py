"""The verdicts of quality rules, language ID and the classifier against plain versions without arrays."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from pastline.llm import classifier, langid, rules
from tests.llm import brute


def _texts(n=160):
    rng = random.Random(9)
    own = {x: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 8))) for _ in range(45)] for x, a in (("aa", "abcdefgh"), ("bb", "hijklmnop"), ("cc", "éèüñßö漢字"))}
    out = []
    for i in range(n):
        lang = ["aa", "bb", "cc", None][i % 4]
        words = rng.choices(own[lang or "aa"], k=rng.choice([3, 40, 60, 120]))
        text = " ".join(w.title() if rng.random() < 0.1 else w for w in words)
        if i % 9 == 0:
            text = re.sub(" ", lambda m: rng.choice([" ", "  ", " ## ", "\n", " 123 "]), text)
        if i % 13 == 0:
            text = text.replace(rng.choice(words), "odd" * 9)
        out.append((i, text, lang))
    return [*out, (900, None, "aa"), (901, "", None), (902, " 12 !", "bb"), (903, "  aB", "cc"), (904, "é" * 9, None), (905, "<>|#" * 80, "aa")]


def _distance(p, q):
    total = sum(p)
    if not total:
        return 0.0
    p = [x / total for x in p]
    kl = lambda x, m: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))


def test_rules_verdict(spark):
    rows, r = _texts(), rules.Rules()
    classes = lambda t: [sum(1 for c in t if (rules._CLASS[ord(c)] if ord(c) < 128 else 2) == k) for k in range(len(rules.CLASSES))]
    by_class, by_word = defaultdict(lambda: [0] * len(rules.CLASSES)), defaultdict(Counter)
    for _, t, lang in rows:
        by_class[lang] = [a + b for a, b in zip(by_class[lang], classes(t or ""), strict=True)]
        by_word[lang].update(brute.WORD.findall(t or ""))
    want = {}
    for d, t, lang in rows:
        t, n_all = t or "", by_word[lang].total()
        common = [w for w, n in by_word[lang].items() if n * 1000 >= n_all]
        assert len(common) <= 100
        shares = [by_word[lang][w] / max(1, n_all) for w in common]
        words = brute.WORD.findall(t)
        counts = Counter(words)
        one = _distance(classes(t), [x / max(1, sum(by_class[lang])) for x in by_class[lang]])
        two = _distance([*(counts[w] for w in common), sum(n for w, n in counts.items() if w not in common)], [*shares, max(0.0, 1 - sum(shares))])
        slack = r.short_text / math.sqrt(max(1, len(words)))
        far = (len(t) >= r.min_chars and one > r.max_class_distance + slack / 10) or (len(words) >= r.min_judged_words and two > r.max_word_distance + slack)
        want[d] = (one, two, not brute.rule_counts(t)[-1] and not far)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for parts in (1, 7):
        got = {x["doc_id"]: (x["class_distance"], x["word_distance"], x["kept"]) for x in rules.quality_rules(spark, frame.repartition(parts)).collect()}
        assert got.keys() == want.keys() and {k for _, _, k in want.values()} == {True, False}
        for d in want:
            assert np.allclose(got[d][:2], want[d][:2], atol=1e-6) and got[d][2] == want[d][2], d


def test_language_decision(spark):
    rows = _texts()

    def grams(text):
        folded = [b if b >= 128 or 97 <= b <= 122 else 32 for b in (text or "").lower().encode()]
        s = bytes(b for i, b in enumerate(folded) if b != 32 or i == 0 or folded[i - 1] != 32)
        return [s[i : i + 5] for i in range(len(s) - 4)]

    counts = defaultdict(Counter)
    for d, t, lang in rows:
        if lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            counts[lang].update(grams(t))
    places = lambda g: [int(p[0]) for p in langid._positions(np.array([int.from_bytes(g, "little")], np.uint64))]
    langs = sorted(counts)
    filters = {x: {p for g, n in c.items() if n >= c.total() * langid.MIN_SHARE for p in places(g)} for x, c in counts.items()}
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for parts in (1, 5):
        got = {r["doc_id"]: r for r in langid.with_language(spark, frame.repartition(parts)).collect()}
        assert len(got) == len(rows)
        for d, t, _ in rows:
            if not any(unicodedata.category(c).startswith("L") for c in t or ""):
                assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
                continue
            mine, true = grams(t), []
            for x in langs:
                wrong = (len(filters[x]) / 2**langid.SLOT_BITS) ** langid.HASHES
                rate = sum(all(p in filters[x] for p in places(g)) for g in mine) / max(1, len(mine))
                true.append(min(1, max(0, (rate - wrong) / (1 - wrong))))
            total = sum(v * v for v in true)
            score = max(true) ** 2 / total if total else 1 / len(langs)
            assert got[d]["lang_pred"] == langs[true.index(max(true))] and abs(got[d]["score"] - score) < 1e-9, d


def test_classifier_score(spark):
    rows = _texts(60)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(lang == "aa")) for d, _, lang in rows], "doc_id long, label int")
    model = classifier.fit(frame, labels)
    again = classifier.fit(frame.repartition(7), labels)
    assert np.array_equal(model.log_odds, again.log_odds) and model.bias == again.bias
    # One feature's row is what a text of that feature alone has; a document is the mean over its words and 3- and 4-byte pieces of words.
    row = {}

    def rows_of(word):
        if word not in row:
            row[word] = classifier._features(pa.array([word]))[0].tolist()
        return row[word]

    for d, score in classifier.score(spark, frame, model).collect():
        text = next(t for x, t, _ in rows if x == d) or ""
        ids = [i for w in brute.WORD.findall(text) for i in rows_of(w)]
        mean = sum(float(model.log_odds[i]) for i in ids) / max(1, len(ids))
        assert abs(score - 1 / (1 + math.exp(-(mean + model.bias)))) < 1e-6
    for word in ("abc", "héllo", "x"):
        data, ids = word.encode(), rows_of(word)
        assert len(ids) == 1 + sum(max(0, len(data) - n + 1) for n in classifier.GRAMS)
