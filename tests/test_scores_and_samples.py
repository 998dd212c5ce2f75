"""Work that must not be done again or dealt out row by row: scores of an evaluation, neighbours of a hub."""

import hashlib

from pyspark.sql import functions as F

from pastline.operators import draws, graph, model


def test_evaluate_computes_each_score_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(i):
        seen.add(1)
        return (i * 37 % 100) / 100

    rows = spark.createDataFrame([(i, "val" if i % 2 else "test", i % 3 % 2) for i in range(200)], "tx_id long, split string, label int")
    model.evaluate(spark, rows.withColumn("score", F.udf(score, "double")("tx_id"))).collect()
    assert seen.value == 200


def test_sampled_neighbours_of_a_hub_in_blocks(spark, monkeypatch):
    """Links in blocks; a limit that leaves many with too few, which are met again; nodes of few links."""
    monkeypatch.setattr(graph, "LINK_BLOCK", 16)
    monkeypatch.setattr(graph, "HITS", (0.5, 1.0))
    pairs = [(i, 0) for i in range(1, 90)] + [(i, i + 1) for i in range(1, 20)]
    tx = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "tx_id long, sender long, receiver long")
    got = graph.sampled_neighbours(spark, tx, spark.createDataFrame([(i,) for i in range(1, 30)], "node long"), [4, 3]).collect()
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    now, want = {(r, r) for r in range(1, 30)}, set()
    for hop, k in ((1, 4), (2, 3)):
        kept = {(r, hop, n, x) for r, n in now for x in sorted(around[n], key=lambda x: (hashlib.md5(f"7-{r}-{hop}-{n}-{x}".encode()).hexdigest()[:15], x))[:k]}  # noqa: B023
        want |= kept
        now = {(r, x) for r, _, _, x in kept}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_first_bits_of_many_hashes():
    """Begins and ends of any length, messages of one and of two blocks, few and many."""
    ends = [str(7**i % 10**9).encode() for i in range(300)] + ["é".encode(), b"x" * 20]
    for begins in ([b"7-%d-2-37-" % i for i in range(1000, 1005)], [b"7-1-"], [b"a-much-longer-begin-%d-" % i for i in range(10, 14)], [b"b" * 54 + b"%d" % i for i in range(3)]):
        for tails in (draws.Tails(ends), draws.Tails(ends[:3]), draws.Tails(ends[:300])):
            want = [[int(hashlib.md5(x + y).hexdigest()[:8], 16) for y in tails.ends] for x in begins]
            assert draws.firsts(begins, tails).tolist() == want
    begins, tails = [b"7-%d-" % i for i in range(95, 105)], draws.Tails(ends[:300])
    bits = [[int(hashlib.md5(x + y).hexdigest()[:8], 16) for y in tails.ends] for x in begins]
    assert set(draws.least(begins, tails, 0.1, 3)) == {(i, j) for i, row in enumerate(bits) for j, b in enumerate(row) if b <= int(0.1 * 2**32)}
    assert set(draws.least(begins, tails, None, 3)) == {(i, j) for i, row in enumerate(bits) for j, b in enumerate(row) if b <= sorted(row)[2]}


def test_sampled_neighbours_of_a_large_hub(spark):
    pairs = [(i, 0) for i in range(1, 700)] + [(i, i + 1) for i in range(95, 140)] + [(-5, 0)]
    tx = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "tx_id long, sender long, receiver long")
    roots = [*range(90, 110), -5]
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = graph.sampled_neighbours(spark, tx, spark.createDataFrame([(i,) for i in roots], "node long"), [4, 3])
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before and dict(got.dtypes) == {"root": "bigint", "hop": "int", "node": "bigint", "next": "bigint"}
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    now, want = {(r, r) for r in roots}, set()
    for hop, k in ((1, 4), (2, 3)):
        kept = {(r, hop, n, x) for r, n in now for x in sorted(around[n], key=lambda x: (hashlib.md5(f"7-{r}-{hop}-{n}-{x}".encode()).hexdigest()[:15], x))[:k]}  # noqa: B023
        want |= kept
        now = {(r, x) for r, _, _, x in kept}
    got = got.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
