"""The corpus pipeline: language ID, line dedup, near-duplicate documents, benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.llm import decontaminate as contamination
from pastline.llm import langid, linededup, ngramjoin, packing, store
from pastline.llm.tokenize import default_vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letters, or no more n-grams of any language than by chance."""
    return langid.keep_identified(spark, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts; every document stays, with ``n_chars`` counted again.

    Equal texts count as one page, or no copy of a document that is on many sites would keep its text; the next stage judges copies. Other
    columns stay as they are, whatever their names.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    cleaned = linededup.remove_boilerplate(rows, distinct_texts=True)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cleaned.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id. Of rows with that id and the same text, one stays."""
    found = ngramjoin.near_duplicates(spark, docs)
    copies = store.few(spark, found.where(F.col("doc_id") != F.col("component_id")).select("doc_id"))
    left = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    again = store.table(spark, docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return left
    again = store.few(spark, again)
    several = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(several.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item's passage."""
    return contamination.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences and offsets."""
    packed = packing.pack_documents(spark, docs, default_vocabulary())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]
#: Packing and n-gram filters have no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.table(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
