"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import langid, mixing, packing, secrets, sharding, simhash, spotsigs, tokens, toxicity, vectors
from docloom.llm.common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=40).select("*", F.lit(None).cast("int").alias("grown_shard"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of ids whose remainder is 0 are never read."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(remainder("doc_id", 5) != 0))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence_ids", "evidence_terms")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents in the public 50k byte-level vocabulary."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), tokens.byte_bpe(), 512)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all documents."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents"), with_text=False))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents by source takes of each."""
    found = mixing.copy_counts(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokens.byte_bpe(), 2048)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; rows whose remainder is 2 are not learned from."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(remainder("doc_id", 4) != 2))
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs, model).select("doc_id", held, "lang_pred", "score")


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    found = vectors.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return vectors.top_k(found, found.where("id % 100 = 0"))


def op10_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return spotsigs.edit_report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_token_counts, op4_simhash, op5_secrets, op6_mixing, op7_packing, op8_language, op9_vector_search, op10_spot_signatures)}
