"""The operators' registered queries: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm import collocations, hilbert, langid, line_dedup, mixing, negatives, packing, phrases, pii, quantised, secrets, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_table(spark, sf_dir, "documents"))


def op5_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93).drop("label")


def op6_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrases.remove_repeats(_table(spark, sf_dir, "documents"), window=20, digest=True)
    return kept.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit(documents)).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(documents, toxicity.fit(documents, _table(spark, sf_dir, "labels")))
    columns = [F.col(f"toxicity.{c}").alias(c) for c in ("score", "predicted", "neighbours")]
    return scored.select("doc_id", _held_out().alias("held_out"), *columns)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(_table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings")
    # every seventh row is given a wrong label; decimals, as the largest long plus one is no long
    wrong = ((F.col("label").cast("decimal(20,0)") + 1) % 10).cast("long")
    labels = F.when(F.col("vec_id") % 7 == 0, wrong).otherwise(F.col("label").cast("long"))
    return negatives.mine(embeddings.select("vec_id", labels.alias("label"), "embedding"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hilbert, op2_packing, op3_pii, op4_line_dedup, op5_quantised, op6_phrases, op7_simhash, op8_mixing, op9_langid, op10_toxicity,
        op11_collocations, op12_secrets, op13_negatives,
    )
}
