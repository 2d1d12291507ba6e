"""A training corpus out of raw documents: five stages, each one operator, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptloom.llm import line_dedup, mixing, packing, simhash, toxicity
from promptloom.llm.common import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that nearest labelled examples call toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one of them; the texts change, no document goes."""
    narrow = docs.select("doc_id", "text")
    return line_dedup.drop_lines(docs, line_dedup.line_keep_bitmaps(narrow))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 3-word shingles, at most 3 differing bits."""
    return simhash.keep_first(docs, words=3, radius=3)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands once for each epoch that takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 4,096 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learned scores, fingerprints and tokens are beyond SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
