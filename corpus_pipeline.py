"""The corpus pipeline: quality, near duplicates, personal data, packing; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import jaccard, packing, pii, resampling
from loglattice.llm.queries import PII_KEY, byte_tokens
from loglattice.llm.runtime import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the resampling rejects go; rows that share an id stay or go together, those without one stay."""
    return resampling.keep_resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more stays: the one with the smallest id. Of rows that share an
    id one stays; null and empty texts, and rows without an id, all stay."""
    return jaccard.keep_one_of_each(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are replaced in the text, row by row; n_chars follows it. A null text stays null."""
    out = pii.replace_pii(docs, PII_KEY, report=None)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences of each document's UTF-8 bytes and end token; a null text is an empty one, rows that share an id are packed each."""
    return packing.pack_sequences(byte_tokens(docs), "ids", 1)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("best-fit packing", packed)]

#: Hashed models, similarity joins and keyed surrogates are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
