"""Documents to packed training sequences: language, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet and
read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import langid, mixing, packing, secrets, simhash, tokens
from docloom.llm.common import delete, scratch, stored, stored_at

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5  # of the predicted language
SEQUENCE = 2048


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: those with a letter whose predicted language has LEAST_SCORE of the evidence.

    The model is learned from the docs' own labels; where lang is null the prediction becomes the document's lang.
    """
    docs = _documents(docs)
    model = langid.train(docs)
    found = langid.identify_rows(docs, model)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near-duplicates; of rows that repeat that id, one.

    Near-duplicates share 0.8 or more of their runs of five words: SimHash proposes pairs, each is compared exactly, and
    pairs that no fingerprint proposes are searched for. Null ids are kept only if their group has no other.
    """
    keyed = stored(_documents(docs).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows", keep=True)
    with scratch(spark):
        groups = simhash.near_copies(keyed.select("row", "text"), key_col="row")
        ranked = keyed.select("row", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "row").alias("id")).join(groups.select(F.col("key").alias("row"), "root"), "row")
        chosen = stored(ranked.groupBy("root").agg(F.min("id").alias("id")).select(F.col("id.row").alias("row")), "pipeline-groups", keep=True)
    return keyed.join(chosen, "row", "left_semi").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; all documents stay, and n_chars follows the text."""
    return secrets.redact_rows(_documents(docs)).withColumn("n_chars", F.when(F.col("changed"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix by source takes it."""
    return mixing.mix(_documents(docs)).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of SEQUENCE tokens."""
    return packing.pack(_documents(docs), tokens.byte_bpe(), SEQUENCE)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mixture), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stored and read again; what a stage has read is deleted then."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, fresh = stored_at(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if path:
            delete(spark, path)
        path = fresh
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # tokenizers and learned models: held against brute force in tests/llm
