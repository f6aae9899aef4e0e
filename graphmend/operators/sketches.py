"""Mergeable distinct counts: sketches stored per run, with the run's exact figure beside them.

A run's distinct labels are counted exactly once; later questions about
several runs together read one sketch a run and column, never the rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmend.sources.tables import write_parquet

LG_K = 14
#: Three standard errors of a merged sketch (1.04 / sqrt(2**LG_K) each).
STATED_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)


def distinct_sketches(df: DataFrame, columns: list[str], lg_k: int = LG_K) -> DataFrame:
    """``(column, n_exact, sketch)``: exact distinct count of each column and its HLL sketch.

    Values are compared as text; nulls do not count, as in ``count(DISTINCT)``.
    One stacked row a column is reduced to distinct values in every task before the shuffle, so a
    label that holds a third of the rows moves once a task.  A column without
    values has count 0 and an empty sketch.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.inline(cells)).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.lit(1).alias("one"))
    found = values.groupBy("column").agg(F.count("*").alias("n_exact"), F.hll_sketch_agg("value", lg_k).alias("sketch"))
    return _every(df.sparkSession, columns).join(found, "column", "left").select(
        "column", F.coalesce("n_exact", F.lit(0).cast("bigint")).alias("n_exact"), "sketch")


def _every(spark: SparkSession, columns: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))


def store_sketches(df: DataFrame, path: str, run_id: str, columns: list[str], lg_k: int = LG_K) -> None:
    """Write the sketches of one run below ``path``; a repeated run replaces its own rows only."""
    write_parquet(distinct_sketches(df, columns, lg_k), os.path.join(path, f"run_id={run_id}"))


def merged_counts(stored: DataFrame) -> DataFrame:
    """``(column, n_runs, n_most, n_sum, estimate)`` over all stored runs.

    The exact union lies between ``n_most`` (largest run) and ``n_sum``;
    ``estimate`` is kept within these bounds.
    """
    g = stored.groupBy("column").agg(
        F.count_distinct("run_id").alias("n_runs"), F.max("n_exact").alias("n_most"), F.sum("n_exact").alias("n_sum"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("raw"))
    return g.select("column", "n_runs", "n_most", "n_sum",
                    F.greatest(F.col("n_most"), F.least(F.col("n_sum"), F.coalesce("raw", F.lit(0)))).alias("estimate"))
