"""Global row ordinals without funnelling rows through one task.

``row_number() OVER (ORDER BY ...)`` with no partition moves every row to a
single task.  Instead: range-partition and sort, number rows inside each
partition (the low 33 bits of ``monotonically_increasing_id``), count rows
per partition (one row per partition), turn the counts into offsets and add
them back with a broadcast join whose size is the partition count.  The
sorted, locally numbered data is checkpointed first so both uses see the
same partitioning even if a task is retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmend.session import cut_lineage

_LOW33 = (1 << 33) - 1


def with_ordinal(df: DataFrame, order_cols: list, name: str = "rn", partitions: int | None = None) -> DataFrame:
    """Add a 1-based ordinal ``name`` following ``order_cols`` (must be a total order)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    mid = F.monotonically_increasing_id()
    local = cut_lineage(ranged.withColumn("_pid", F.shiftright(mid, 33)).withColumn("_lrn", mid.bitwiseAND(F.lit(_LOW33))))
    counts = local.groupBy("_pid").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (
        local.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + F.col("_lrn") + 1).cast("bigint"))
        .drop("_pid", "_lrn", "_off")
    )


def with_chunk(df: DataFrame, order_cols: list, size: int, name: str = "chunk_id") -> DataFrame:
    """Consecutive chunks of ``size`` rows in ``order_cols`` order (0-based ids)."""
    out = with_ordinal(df, order_cols, "_rn")
    return out.withColumn(name, F.floor((F.col("_rn") - 1) / F.lit(size)).cast("bigint")).drop("_rn")


def with_running_sum(df: DataFrame, order_cols: list, value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name`` = inclusive running sum of ``value`` in ``order_cols`` order (a total order).

    Same shape as ``with_ordinal``: range-partition and sort, sum inside each
    partition in one ordered pass (Arrow batches of one task, in order),
    then add per-partition offsets through a broadcast of one row per
    partition.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    ranged = ranged.withColumn("_pid", F.shiftright(F.monotonically_increasing_id(), 33))
    schema = StructType(ranged.schema.fields + [StructField("_lsum", LongType())])

    def local_sums(batches):
        run = 0
        for pdf in batches:
            cs = pdf[value].fillna(0).astype("int64").cumsum() + run
            if len(cs):
                run = int(cs.iloc[-1])
            yield pdf.assign(_lsum=cs.astype("int64"))

    local = cut_lineage(ranged.mapInPandas(local_sums, schema))
    sums = local.groupBy("_pid").agg(F.sum(value).alias("_s"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sums.select("_pid", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_off"))
    return (
        local.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + F.col("_lsum")).cast("bigint"))
        .drop("_pid", "_lsum", "_off")
    )
