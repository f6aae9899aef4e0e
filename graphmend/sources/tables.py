"""Parquet scans of the driver tables and of stage outputs.

Projection and filters written after ``load`` reach the Parquet scan
(``ReadSchema`` / ``PushedFilters`` in the plan), so callers select only
the columns they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# Key used to spread each table when its scan has too few splits.
SPREAD_KEYS = {
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "labels": "doc_id",
    "conversations": "conv_id", "pages": "page_id", "benchmark": "item_id",
}


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Hash-repartition a scan that yields fewer splits than the cluster has cores.

    A large input already has many splits and is returned unchanged (no
    shuffle); a file stored as one row group would otherwise run all the
    per-row work of the next stage in a single task.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key and key in df.columns else df.repartition(target)


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one driver table; optional column list prunes the scan."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def load_spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``load``, spread over the cores: for tables stored as one row group, as the test tables are."""
    return spread(load(spark, sf_dir, name, *columns), SPREAD_KEYS.get(name))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Parquet sink, zstd-compressed like the stage files it replaces."""
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
