"""Block-table filters, summaries and reshaping.

A block table is ``(cluster_id, cluster_size, <members array>)``.  Filters on
``cluster_size`` reach the Parquet scan when blocks are read back, which is
why the size is stored instead of recomputed with ``size()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BLOCK = 30  # fixed value: largest block a resolver request carries


def non_singleton(blocks: DataFrame) -> DataFrame:
    """Blocks worth resolving (more than one member)."""
    return blocks.filter(F.col("cluster_size") > 1)


def bounded(blocks: DataFrame, max_size: int = MAX_BLOCK) -> DataFrame:
    return blocks.filter(F.col("cluster_size") <= max_size)


def without_ids(blocks: DataFrame, blacklist: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Drop blacklisted blocks (null-safe anti join, unlike ``NOT IN``)."""
    return blocks.join(blacklist.select(key), key, "left_anti")


def only_ids(blocks: DataFrame, ids: DataFrame, key: str = "cluster_id") -> DataFrame:
    return blocks.join(ids.select(key), key, "left_semi")


def collect_blocks(long_members: DataFrame, member: str = "member", order: str | None = None) -> DataFrame:
    """Long ``(cluster_id, member)`` rows -> wide blocks with sorted members."""
    key = F.struct(F.col(order), F.col(member)) if order else F.struct(F.col(member))
    return long_members.groupBy("cluster_id").agg(
        F.count("*").alias("cluster_size"),
        F.transform(F.array_sort(F.collect_list(key)), lambda s: s[member]).alias("member_ids"),
    )


def explode_blocks(blocks: DataFrame, members: str = "member_ids") -> DataFrame:
    """Wide -> long ``(cluster_id, pos, member)`` for joins on members."""
    return blocks.select("cluster_id", F.posexplode(members).alias("pos", "member"))


def size_histogram(blocks: DataFrame, width: int = 5) -> DataFrame:
    """Block-size histogram in buckets of ``width`` (lower bound, count)."""
    lo = (F.floor(F.col("cluster_size") / width) * width).cast("bigint")
    return blocks.groupBy(lo.alias("size_from")).agg(F.count("*").alias("n_blocks"))
