"""Language identification by language-bitmask n-gram filters.

Each language's frequent n-grams (five bytes of lower-cased letters and single spaces) go into a Bloom filter. The filters are bit-sliced:
one array position holds a bit per language (in slices of 64), so ANDing an n-gram's few positions gives, in one look-up, every language
that may contain it. A text's hits per language are corrected for that language's false-positive rate and the highest rate decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pastline.llm import store
from pastline.llm import textkernel as K

N = 5
HASHES = 2
SLOT_BITS = 20
#: An n-gram belongs to a language if it makes up this share of its n-grams; so a language has at most ``1 / MIN_SHARE`` of them.
MIN_SHARE = 2e-5
#: Documents that the model is fitted on, chosen by hash: about this many of each language (a documented bound of the fit).
FIT_DOCS = 3000
#: The pipeline keeps a document whose hits in its best language exceed those of chance by so many of chance's standard deviations.
CHANCE_SD = 3.0
#: Languages of one slice of the filters.
SLICE = 64

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
UNDETERMINED = "und"
SCHEMA = "doc_id long, lang_pred string, score double"


@dataclass
class Model:
    langs: list[str]
    #: A row per slice of languages.
    slots: np.ndarray
    false_rate: np.ndarray


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes of the texts' letters (runs of other characters are one space) and the n-grams before each row."""
    data, offsets = K.utf8(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    folded = _FOLD[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True  # a text's n-grams don't depend on the text before it
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    text = folded[keep].astype(np.uint64)
    size = max(0, len(text) - N + 1)
    code = np.zeros(size, np.uint64)
    for j in range(N):
        code |= text[j : j + size] << np.uint64(8 * j)
    whole = np.ones(size, bool)
    for j in range(1, N):
        over = at[1:-1] - j
        whole[over[(over >= 0) & (over < size)]] = False
    before = np.concatenate([[0], np.cumsum(whole)])[np.minimum(at, size)]
    return code[whole], before


def _positions(codes: np.ndarray) -> list[np.ndarray]:
    h = K.mix(codes * np.uint64(0x9E3779B97F4A7C15))
    return [((h >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Learns from ``text`` and ``lang`` (null languages are left out)."""
    known = docs.where(F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    shares = [F.lit(x) for lang in langs for x in (lang, min(1_000_000, max(1, int(1_000_000 * fit_docs / sizes[lang]))))]
    share = F.element_at(F.create_map(*shares), F.col("lang")) if langs else F.lit(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                codes, _ = _grams(batch.column("text").filter(pc.equal(batch.column("lang"), lang)))
                grams, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    chosen = known.where(F.pmod("h", F.lit(1_000_000)) < share).select("text", "lang")
    counted = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    often = counted.withColumn("total", F.sum("n").over(Window.partitionBy("lang"))).where(F.col("n") >= F.col("total") * MIN_SHARE)
    found = often.select("lang", "gram").toPandas()  # at most 1 / MIN_SHARE rows per language
    slots = np.zeros((-(-len(langs) // SLICE), 1 << SLOT_BITS), np.uint64)
    number = {lang: k for k, lang in enumerate(langs)}
    for lang, grams in found.groupby("lang")["gram"]:
        for at in _positions(grams.to_numpy(np.int64).view(np.uint64)):
            slots[number[lang] // SLICE, at] |= np.uint64(1 << number[lang] % SLICE)
    full = np.array([((slots[k // SLICE] >> np.uint64(k % SLICE)) & np.uint64(1)).mean() for k in range(len(langs))])
    return Model(langs, slots, full**HASHES)


def _judge(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and whether the language can be told."""
    n, many = len(column), len(model.langs)
    codes, before = _grams(column)
    total = np.diff(before)
    positions = _positions(codes)
    hits = np.zeros((n, many))
    for part, slots in enumerate(model.slots):
        masks = np.full(len(codes), np.uint64((1 << 64) - 1))
        for at in positions:
            masks &= slots[at]
        for k in range(part * SLICE, min(many, (part + 1) * SLICE)):
            hits[:, k] = K.per_row((masks >> np.uint64(k % SLICE)) & np.uint64(1), before)
    rate = hits / np.maximum(total, 1)[:, None]
    true = np.clip((rate - model.false_rate) / (1 - model.false_rate), 0, 1)
    best = true.argmax(1) if many else np.zeros(n, int)
    # The decision's weight: the best language's rate against the sum of all, each squared. It shrinks with the number of near languages.
    weight = true**2
    score = np.where(weight.sum(1) > 0, weight.max(1) / np.maximum(weight.sum(1), 1e-300), 1.0 / max(1, many)) if many else np.zeros(n)
    letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    names = [model.langs[b] if ok and many else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
    if model.slots.any():
        mine = hits[np.arange(n), best]
        chance = total * model.false_rate[best]
        told = letters & (mine > 0) & (mine - chance >= CHANCE_SD * np.sqrt(chance))
    else:  # nothing was learnt, so nothing speaks against a text
        told = letters
    return names, np.where(letters, score, 0.0), told


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row's whole text; ``und`` and 0 where it is null or has no letter.

    A text shorter than an n-gram gets the first language with the score of a guess; of equally good languages the first in order counts.
    Rows of one doc_id are judged each by its own text; a very long text is taken whole, alone in its kernel call.
    """
    store.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2 ** SLOT_BITS positions for each SLICE languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            _, offsets = K.utf8(text)
            for at, to in K.slices(offsets, 1 << 20):
                names, score, _ = _judge(shared.value, text.slice(at, to - at))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4: 2 marks a held-out document."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def with_language(spark: SparkSession, docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """All documents but those held out teach; every document gets a language."""
    model = fit(docs.where(F.coalesce(remainder(), F.lit(0)) != 2), fit_docs)
    return identify(spark, docs, model)


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language can't be told; fitted on their own ``lang`` labels as in :func:`with_language`.

    Those are texts without a letter, without an n-gram, or with no more hits in their best language than chance gives. Other languages
    that are as near play no part. Without anything to learn from, all texts with a letter stay.
    """
    store.small_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs.where(F.coalesce(remainder(), F.lit(0)) != 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            _, offsets = K.utf8(text)
            for at, to in K.slices(offsets, 1 << 20):
                _, _, told = _judge(shared.value, text.slice(at, to - at))
                yield batch.slice(at, to - at).filter(pa.array(told))

    return docs.mapInArrow(run, docs.schema)
