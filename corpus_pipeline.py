"""A training corpus in five stages: quality, near copies, repeated passages, secrets, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; what it returns is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``; the last returns a row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import near_dedup, packing, quality_cnn, secrets_crf, substring
from tessera.llm.common import columns, remainder, stored


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, where the table has that column."""
    if "n_chars" not in like.columns:
        return docs
    kind = like.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)).select(*columns(like))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learnable = ~F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return quality_cnn.keep(docs, quality_cnn.learn(docs, labels, learnable))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity of 0.8 or more)."""
    return near_dedup.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that occur elsewhere."""
    return _measured(substring.remove_repeated(docs), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by a mark."""
    return _measured(secrets_crf.redact(docs, secrets_crf.learn(docs)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("secrets", secrets), ("packing", packed)]

#: SQL can't express the learned stages; a test compares every stage with a plain version on the small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
