"""Seeded samples and shuffles that do not depend on partitioning.

Order keys are ``md5("seed:key")``: the same seed gives the same sample on
any cluster layout and in any engine that has MD5.  A limit appears only where the sample size *is* the
feature; ``orderBy(...).limit(n)`` plans as a distributed top-n
(``TakeOrderedAndProject``), so no task sorts the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmend.operators.ordinal import with_chunk


def _h(seed: int, key: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def sample_rows(df: DataFrame, n: int, seed: int, key: str = "cluster_id") -> DataFrame:
    """``n`` rows chosen by seeded hash order."""
    return df.orderBy(_h(seed, key), F.col(key)).limit(n)


def stratified_sample(df: DataFrame, flag: str, n_per_stratum: int, seed: int, key: str = "cluster_id") -> DataFrame:
    """``n_per_stratum`` rows of every ``flag`` value (partitioned window with
    a group limit, which Spark pushes below the shuffle)."""
    w = Window.partitionBy(flag).orderBy(_h(seed, key), F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_per_stratum).drop("_r")


def shuffled_shards(df: DataFrame, shard_size: int, seed: int, key: str = "cluster_id") -> DataFrame:
    """Seeded shuffle, then consecutive slices of ``shard_size`` rows."""
    keyed = df.withColumn("_h", _h(seed, key))
    return with_chunk(keyed, [F.col("_h"), F.col(key)], shard_size, "shard_id").drop("_h")
