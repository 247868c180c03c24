"""Five stages from raw documents to packed sequences, each by one operator of cubeloom.llm.

Quality rules drop documents, line dedup drops repeated lines, near-duplicate groups keep one
document, secrets are redacted, and what is left is packed. ORACLE_SQL is None: suffix arrays, MinHash,
the forest and the tokenizer aren't SQL; tests hold run() against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import linededup, neardup, packing, repetition, secrets
from cubeloom.llm.common import Scratch, scope, spread, table
from cubeloom.llm.queries import WORD_VOCABULARY, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.rules(docs, list(COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(linededup.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, with the smallest doc_id; of repeated rows of that id, the smallest. Rows without an id all stay."""
    found = Scratch(spark, "near").save(neardup.near_duplicates(docs, k=5), "found")
    gone = found.where("NOT kept").select("doc_id", "text_hash")
    several = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id", "set_id").agg(F.min("text_hash").alias("stays"), F.count("*").alias("rows")).where("rows > 1")
    hashed = docs.withColumn("text_hash", neardup.text_hash())
    if several.limit(1).count() == 0:
        return hashed.join(gone, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)
    others = found.where("kept").join(several, ["doc_id", "set_id"]).where("text_hash <> stays").select("doc_id", "text_hash")
    left = hashed.join(gone.unionAll(others), ["doc_id", "text_hash"], "left_anti")
    repeated = several.select("doc_id", F.col("stays").alias("text_hash"))
    ones = left.join(repeated, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return left.join(repeated, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS).unionByName(ones)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, vocabulary(WORD_VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; a stage's own tables and its input go when it is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spread(table(spark, sf_dir, "documents")), None
    for name, stage in STAGES:
        with scope():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
