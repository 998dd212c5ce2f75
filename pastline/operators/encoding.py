"""Category encodings by declaration: fitted on train, applied to all splits in one plan, stored with their vocabulary and replayed later.

A vocabulary is a table (as large as the columns' different values), never a list on the driver. What is stored is that table, and a record of
the declarations, the order of the features and the table's hash; a restore checks both before it encodes anything.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastline.operators.fitted import UNKNOWN
from pastline.operators.validation import normalize_category
from pastline.plans.checkpoint import table
from pastline.plans.ordered import totals_before
from pastline.sources import artifacts
from pastline.sources.tables import InputError
from pastline.specs import check_no_leak

#: What a row of a contract may ask for.
ENCODINGS, CARRIED, ACTIONS = ("label_code", "xgb_native"), ("build", "carry_forward"), ("build", "carry_forward", "encode")
#: Rows of a column's vocabulary that are broadcast to the rows; a longer one is joined by shuffle.
FEW = 1_000_000


@dataclass(frozen=True)
class EncodingSpec:
    """One output: ``source`` encoded as ``label_code`` (numbers in order of the train values, unseen -1) or ``xgb_native`` (the text itself, unseen
    ``__UNKNOWN__``), or carried as it is."""

    source: str
    output: str
    encoding: str = "passthrough"
    action: str = ""
    used: bool = True

    @property
    def kind(self) -> str:
        """``c`` for categories, ``q`` for numbers."""
        return "c" if self.encoding == "xgb_native" else "q"


def normalize_specs(specs: list[EncodingSpec]) -> list[EncodingSpec]:
    """Specs with trimmed names and an action. Carried columns keep their own name and are not encoded; an ``encode`` row without an encoding,
    unknown actions and encodings, blank or repeated names, names that would leak the label, and lists without a selected row are errors."""
    out = []
    for s in specs:
        source, output, encoding, action = (str(x or "").strip() for x in (s.source, s.output, s.encoding, s.action))
        encoding, action = encoding.lower(), action.lower()
        action = action or ("encode" if encoding and encoding != "passthrough" else "carry_forward")
        if action not in ACTIONS:
            raise InputError(f"unknown action {action!r} of {output!r}")
        if action in CARRIED:
            source, encoding = output, "passthrough"
        elif encoding not in ENCODINGS:
            raise InputError(f"{output!r} is to be encoded, but {encoding!r} is none of {', '.join(ENCODINGS)}")
        if not source or not output:
            raise InputError("an encoding has a blank column")
        out.append(replace(s, source=source, output=output, encoding=encoding, action=action))
    names = [s.output for s in out]
    if repeated := sorted({n for n in names if names.count(n) > 1}):
        raise InputError(f"repeated outputs: {', '.join(repeated)}")
    used = [s for s in out if s.used]
    if not used:
        raise InputError("no encoding is selected")
    check_no_leak([x for s in used for x in (s.source, s.output)], "an encoding")
    return out


def fit(df: DataFrame, specs: list[EncodingSpec]) -> DataFrame:
    """``output, category, code``: the train values of all encoded columns in order, numbered from 0 within each, in one pass over ranges."""
    encoded = [s for s in specs if s.action == "encode"]
    spark = df.sparkSession
    if not encoded:
        return spark.createDataFrame([], "output string, category string, code int")
    train = df.where(F.col("split") == "train")
    for c in sorted({s.source for s in encoded}):
        train = normalize_category(train, c)
    each = F.explode(F.array(*[F.struct(F.lit(s.output).alias("output"), F.col(s.source).alias("category")) for s in encoded])).alias("p")
    values = train.select(each).select("p.*").distinct()
    run = totals_before(spark, values, ["output", "category"], {"before": F.lit(1).cast("long")})
    starts = F.broadcast(run.groupBy(F.col("output").alias("o")).agg(F.min("before").alias("start")))  # a row per column
    return run.join(starts, F.col("output") == F.col("o")).select("output", "category", (F.col("before") - F.col("start")).cast("int").alias("code"))


def encode(df: DataFrame, specs: list[EncodingSpec], vocabulary: DataFrame, keep: tuple[str, ...] = ("tx_id", "split", "label")) -> DataFrame:
    """``keep`` and the outputs of all ``specs``, in order, by a stored ``vocabulary``. A null or blank category is an error when the row is read."""
    sizes = {r["output"]: r["n"] for r in vocabulary.groupBy("output").agg(F.count("*").alias("n")).collect()}  # a row per column
    out = df
    for c in sorted({s.source for s in specs if s.action == "encode"}):
        out = normalize_category(out, c)
    out = out.select(*keep, *[F.col(s.source).alias(f"_{i}") for i, s in enumerate(specs)])
    columns = []
    for i, s in enumerate(specs):
        if s.action != "encode":
            columns.append(F.col(f"_{i}").alias(s.output))
            continue
        known = vocabulary.where(F.col("output") == s.output).select(F.col("category").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
        out = out.join(F.broadcast(known) if sizes.get(s.output, 0) <= FEW else known, F.col(f"_{i}") == F.col(f"_v{i}"), "left")
        columns.append((F.coalesce(f"_c{i}", F.lit(-1)) if s.encoding == "label_code" else F.coalesce(f"_v{i}", F.lit(UNKNOWN))).alias(s.output))
    return out.select(*keep, *columns)


def mapping_rows(specs: list[EncodingSpec], vocabulary: DataFrame) -> DataFrame:
    """``output, source, encoding, category, code``: what was fitted, with the unknown category of native columns (which have no codes)."""
    spark = vocabulary.sparkSession
    encoded = [(s.output, s.source, s.encoding) for s in specs if s.action == "encode"]
    said = F.broadcast(spark.createDataFrame(encoded, "output string, source string, encoding string"))
    native = said.where(F.col("encoding") == "xgb_native").select("output", "source", "encoding", F.lit(UNKNOWN).alias("category"), F.lit(None).cast("int").alias("code"))
    code = F.when(F.col("encoding") == "label_code", F.col("code")).alias("code")
    return vocabulary.join(said, "output").select("output", "source", "encoding", "category", code).unionByName(native)


def store(spark: SparkSession, df: DataFrame, specs: list[EncodingSpec], path: str) -> dict:
    """Fits ``specs`` on train and stores the vocabulary and its record under ``path``, which must be new. Returns the record."""
    specs = normalize_specs(specs)
    fit(df, specs).write.parquet(f"{path}/vocabulary")
    vocabulary = spark.read.parquet(f"{path}/vocabulary")
    used = [s for s in specs if s.used]
    record = {
        "specs": [asdict(s) for s in specs], "feature_columns": [s.output for s in used], "feature_order_hash": artifacts.order_hash([s.output for s in used]),
        "feature_types": {s.output: s.kind for s in used}, "unknown_category": UNKNOWN, "fit_split": "train", "vocabulary_hash": artifacts.rows_hash(vocabulary),
    }
    artifacts.write_json(spark, record, f"{path}/manifest")
    return record


def restore(spark: SparkSession, path: str) -> tuple[list[EncodingSpec], DataFrame, dict]:
    """The specs, vocabulary and record stored under ``path``. A vocabulary or an order of features that is not the stored one is refused."""
    record, _ = artifacts.read_json(spark, f"{path}/manifest")
    vocabulary = spark.read.parquet(f"{path}/vocabulary")
    specs = normalize_specs([EncodingSpec(**s) for s in record["specs"]])
    if artifacts.order_hash([s.output for s in specs if s.used]) != record["feature_order_hash"] or [s.output for s in specs if s.used] != record["feature_columns"]:
        raise InputError(f"{path}: the features are not the stored ones, in their order")
    if artifacts.rows_hash(vocabulary) != record["vocabulary_hash"]:
        raise InputError(f"{path}: the vocabulary is not the one that the manifest was written for")
    if record.get("unknown_category") != UNKNOWN and any(s.encoding == "xgb_native" for s in specs):
        raise InputError(f"{path}: the manifest lacks the unknown category {UNKNOWN}")
    lost = {s.output for s in specs if s.action == "encode"} - {r["output"] for r in vocabulary.select("output").distinct().collect()}
    if lost:
        raise InputError(f"{path}: no categories of {', '.join(sorted(lost))}")
    return specs, vocabulary, record


def encode_stored(spark: SparkSession, df: DataFrame, path: str, keep: tuple[str, ...] = ("tx_id", "split", "label")) -> DataFrame:
    """``df`` encoded by what is stored under ``path``."""
    specs, vocabulary, _ = restore(spark, path)
    return encode(df, specs, vocabulary, keep)


def encode_new(spark: SparkSession, df: DataFrame, specs: list[EncodingSpec]) -> tuple[DataFrame, DataFrame]:
    """``df`` encoded by a fit on its own train rows, and the vocabulary."""
    specs = normalize_specs(specs)
    vocabulary = table(spark, fit(df, specs), "vocabulary")
    return encode(df, specs, vocabulary), vocabulary
