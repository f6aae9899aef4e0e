"""Training-corpus pipeline over ``documents``: score, deduplicate, mask secrets, pack.

``STAGES`` lists the stages in order; each is written as Parquet and reread
as the next one's documents.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmend.llm import common, packing, quality, queries, secrets_ledger, simhash
from graphmend.session import ship_package


def score_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go; labels come from ``labels``."""
    ship_package(spark)
    return quality.keep_good(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays."""
    ship_package(spark)
    return simhash.keep_one(docs, shingle=4, distance=4)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark, and ``n_chars`` follows; every document stays."""
    ledger = common.stage(secrets_ledger.scan(docs), "pipeline-ledger")
    found = secrets_ledger.masked(docs, ledger)
    return found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, packed into sequences of at most 1024 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, queries.tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality_classifier", score_quality),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Scores, fingerprints and token ids have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each over the written rows of the one before."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
