"""Lookup joins that stay safe at scale.

A lookup side (type map, edge mapping, entity mapping) is broadcast only
after its row count is checked against a bound.  Beyond the bound the join
shuffles; keys that carry more rows than one task should take are salted:
their lookup rows are replicated once per salt and the big side spreads
its rows over the salts, so a key holding a third of the table is cut into
many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmend.session import cut_lineage

# Lookup sides up to this many rows are broadcast (a few hundred MB of
# short string keys at most); larger ones take the shuffled path.
BROADCAST_ROWS = 2_000_000
# Target rows per task for a hot key on the shuffled path.
ROWS_PER_TASK = 2_000_000


def assert_unique(df: DataFrame, keys: list[str], what: str = "lookup") -> None:
    """Raise if a lookup key repeats (a join would silently fan rows out)."""
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"{what} key {keys} is not unique, e.g. {dup[0].asDict()}")


def bounded_rows(df: DataFrame, bound: int) -> bool:
    """True when ``df`` has at most ``bound`` rows (a partial count, one row a partition)."""
    return df.count() <= bound


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
    small_fits: bool | None = None,
) -> DataFrame:
    """Equi-join ``big`` with a lookup table unique on ``keys``.

    Broadcast when the lookup side is proven small; otherwise a shuffled
    join with hot keys of ``big`` salted over ``ceil(rows/rows_per_task)``
    buckets.  The hot-key table holds at most ``rows(big)/rows_per_task``
    rows, so it is itself broadcast.  A derived lookup side is checkpointed
    before its size check, so checking and joining read it once;
    ``small_fits`` passes a check the caller already made.
    """
    if small_fits is None:
        small = cut_lineage(small)
        small_fits = bounded_rows(small, broadcast_rows)
    if small_fits:
        return big.join(F.broadcast(small), keys, how)

    hot = (
        big.groupBy(*keys).count()
        .filter(F.col("count") > rows_per_task)
        .select(*keys, F.ceil(F.col("count") / rows_per_task).cast("int").alias("_salts"))
    )
    big_s = (
        big.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1))).cast("int"))
        .drop("_salts")
    )
    # Any salt value finds its replica, so the result does not depend on
    # which salt a row drew (safe under task retries).
    small_s = (
        small.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return big_s.join(small_s, keys + ["_salt"], how).drop("_salt")
