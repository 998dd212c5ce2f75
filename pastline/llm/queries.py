"""The queries of the corpus operators: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.llm import chat, classifier, collocations, decontaminate, exactdedup, langid, linededup, ngramjoin, packing, repair, rules, substrings, tokenfiles
from pastline.llm.tokenize import default_vocabulary


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out() -> Column:
    """A row without a doc_id is not held out: it teaches."""
    return (F.coalesce(langid.remainder(), F.lit(0)) == 2).alias("held_out")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(spark, _read(spark, sf_dir, "documents"), default_vocabulary())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(chat.format_conversations(spark, turns.unionByName(extra)))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfiles.write_ids(spark, _read(spark, sf_dir, "documents"), default_vocabulary())
    return tokenfiles.read_ids(spark, path)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove_repeats(spark, _read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(spark, _read(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(spark, _read(spark, sf_dir, "documents"), ngramjoin.Params(words=3, percent=90))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.remove_boilerplate(_read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.with_language(spark, _read(spark, sf_dir, "documents"))
    return found.select("doc_id", _held_out(), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    model = classifier.fit(docs, labels.where(langid.remainder() != 2))
    return classifier.score(spark, docs, model).select("doc_id", _held_out(), "score", (F.col("score") >= classifier.CUT).cast("int").alias("predicted"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_classes(spark, _read(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(spark, _read(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, _read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_chat, op3_token_files, op4_substrings, op5_rules, op6_ngram_join, op7_line_dedup, op8_decontamination, op9_language, op10_quality, op11_exact_dedup, op12_repair, op13_collocations)}

_LINES = r"""
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT line FROM l WHERE trim(line, ' ') <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= 8),
bad AS (SELECT coalesce(list(line), []) AS bad FROM b),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(bad, x)) AS kept FROM documents, bad)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END) AS kept_sha256 FROM d
"""

_COPIES = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256 FROM n
"""

_PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k AS words, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 30),
u AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two FROM c, (VALUES (1), (2), (3)) v(k) WHERE k < words),
s AS (SELECT u.lang, u.phrase, u.a, u.k, x.f AS l, y.f AS r, (2000000::HUGEINT * u.a // (x.f + y.f))::BIGINT AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.one JOIN f y ON y.lang = u.lang AND y.phrase = u.two),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
i AS (SELECT lang, a, w, words, unnest(range(2, words)) AS size FROM c WHERE words > 2),
j AS (SELECT lang, a, w, size, unnest(range(1, words - size + 2)) AS p FROM i),
h AS (SELECT lang, array_to_string(w[p:p + size - 1], ' ') AS phrase, max(a) AS cover FROM j GROUP BY ALL),
o AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
      FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE b.cut = 1 AND (h.cover IS NULL OR 100 * h.cover < 80 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op13_collocations": _PHRASES, "op7_line_dedup": _LINES, "op11_exact_dedup": _COPIES}
