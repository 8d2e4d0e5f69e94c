"""A training corpus from raw documents: stages that keep, drop and rewrite rows.

Each stage takes (spark, docs, sf_dir), works on all rows it gets and returns a DataFrame.
All but the last return the columns doc_id, text, lang, source and n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.llm import common, decontaminate, language, minhash, pieces, secrets
from repoloom.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows that (doc_id, row_key) of `gone` don't name; a null id is an id like others."""
    names = gone.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (common.row_key(F.col("text")) == F.col("_key"))
    return rows.join(names, same, "left_anti").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is accepted, and sets lang to it.

    The dictionaries are learned from the rows that the classifier's test split leaves.
    Rejected documents (no letters, or no language clearly ahead of the others) go: null and
    empty texts among them.  Rows are judged one by one, so repeated rows stay or go together; an
    empty table stays one.
    """
    common.ship(spark)
    rows = docs.select(*COLUMNS)
    model = language.fit(rows, ~language.held_out(F.col("doc_id")))
    found = language.identify(rows, model).filter("accepted")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class.

    A row without doc_id counts as the smallest.  Of rows that repeat an id each is judged by its own
    text, and rows equal in both stay together.  Documents without words, null texts among them,
    are in no class and stay; an empty table stays one.
    """
    common.ship(spark)
    rows = docs.select(*COLUMNS)
    return _without(rows, minhash.near_duplicates(rows).filter("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark window.

    Each row is judged by its own text, without doc_id or with a repeated one, too.  Null and
    empty texts hold none and stay, and all do where there are no items; an empty table stays one.
    """
    common.ship(spark)
    rows = docs.select(*COLUMNS)
    items = common.read_table(spark, sf_dir, "benchmark")
    return _without(rows, decontaminate.contamination(rows, items).filter("contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in a text by its kind in brackets; no document goes.

    Null texts stay null and empty ones empty; n_chars follows the new text.  Repeated rows stay as many.
    """
    common.ship(spark)
    found = secrets.scan(docs.select(*COLUMNS))
    text = F.col("redacted")
    return found.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens and ids (packed 32-bit integers).

    A row per row, repeated ones and those without doc_id included; null and empty texts have no ids.
    """
    common.ship(spark)
    encoded = pieces.encode(docs.select(*COLUMNS), tokenizer_path("piece_bpe_32k.model"))
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return encoded.select("doc_id", n_tokens, "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]

#: SQL can't state the stages; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each one's rows are stored for the next."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
