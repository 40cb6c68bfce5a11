"""The corpus pipeline: language, exact and near duplicates, mixture, packing.

Each stage takes what the one before kept, written as Parquet and read again. Text columns may hold nulls.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakescope.llm import common, exactdedup, langid, mixing, packing, queries, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null texts, texts without letters and longer texts like no language go.

    Where no language can be learned, texts with letters stay. An empty table stays empty, extra columns stay.
    """
    return langid.identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null equals empty), the row with the largest doc_id; null ids are below all. Extra columns stay."""
    return exactdedup.exact_dedup(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints' documents, the one with the smallest doc_id; rows without an id stay. Extra columns stay."""
    return simhash.near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says, null sources a source; a repeated document is a repeated row."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces with their places in training sequences; null text is empty, repeated rows are packed repeatedly."""
    return packing.packed(docs, queries.vocabulary())


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixture), ("packing", sequences)]
#: Hashed profiles, fingerprints and a packing plan are not for SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's output goes when the next one's is written; the last one's stays for its reader."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            common.removed(spark, f"{folder}/{k - 1}")
    return docs
