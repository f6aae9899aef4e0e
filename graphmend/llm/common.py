"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmend.session import scratch_path, ship_package


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def text_of(name: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` (a lost executor costs only a re-read)
    but keeps the data columnar and compressed.  The shuffle files of the
    write are not needed once it ends, so they are dropped then.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before) if before is not None else spark.conf.unset(_DROP_SHUFFLES)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame | None) -> None:
    """Delete a staged table that is no longer read."""
    path = getattr(df, "_staged_path", None)
    if path is None:
        return
    spark = df.sparkSession
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bound Arrow batches by bytes, as single texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` long pairs -> ``(node, root)``, root = smallest node reachable.

    Alternates large-star and small-star steps until the edge set stops
    changing.  Every step sends one row per edge and joins with one row per
    node, so a hub's edges are never gathered in one place; the joins are
    plain inner equi-joins which adaptive execution splits when a hub is hot.
    Nodes without a link do not occur in the result.  Null or equal ends are
    ignored; repeated edges count once; no edges give an empty table.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = stage(e, "cc")
    state = _edge_state(cur)
    while state[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).distinct())
        nxt = stage(small, "cc")
        new_state = _edge_state(nxt)
        unstage(cur)
        cur, old = nxt, state
        state = new_state
        if state == old:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _edge_state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return r[0], r[1], r[2]
