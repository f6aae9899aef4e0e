"""Connected components of similar members inside blocks of any size.

A block that fits a task is one group.  A larger one is cut into chunks, a
bounded number of them as long as a task can hold two;
every pair of chunks is a task, and only the edges of a spanning forest of
what it found leave it: at most a row a member, never all similar pairs.  The
forests are joined by star contraction, whose steps are equi-joins and
aggregates over the edges that are left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmend.operators.joins import lookup_join
from graphmend.operators.vector_index import stack, unit
from graphmend.session import cut_lineage, ship_package

CHUNK_ROWS = 4096  # members of a block that one task compares whole
SIDES = 12         # chunks of a larger block, so each member goes to as many tasks
SIDE_VALUES = 2_000_000  # doubles (16 MB) a chunk holds at most; blocks beyond SIDES of them have more chunks
ROWS = 512         # members compared with the others at once


def forest(x: np.ndarray, tau: float, split: int | None = None) -> np.ndarray:
    """Smallest row linked to each row, over chains of ``cos >= tau``; with ``split`` only rows on either side of it are compared."""
    low = np.arange(len(x))
    begin, end = (0, len(x)) if split is None else (0, split)
    for a in range(begin, end, ROWS):
        z = min(a + ROWS, end)
        first = a if split is None else split
        with np.errstate(invalid="ignore"):
            i, j = np.nonzero(x[a:z] @ x[first:].T >= tau)  # never true for rows without a direction
        p, q = low[a + i], low[first + j]
        new = p != q
        if not new.any():
            continue
        # Only pairs of groups that are not one yet are joined, each once.
        joined: dict[int, int] = {}

        def root(v, joined=joined):
            while v in joined:
                up = joined[v]
                if up in joined:
                    joined[v] = joined[up]
                v = up
            return v

        for pair in np.unique(np.maximum(p, q)[new] * len(x) + np.minimum(p, q)[new]).tolist():
            u, v = root(pair // len(x)), root(pair % len(x))
            if u != v:
                joined[max(u, v)] = min(u, v)
        to = np.arange(len(x))
        to[list(joined)] = [root(v) for v in list(joined)]
        low = to[low]
    return low


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` of any ordered type -> ``(node, root)``: the smallest node reachable from each that has an edge."""
    cur = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while True:
        n = cur.count()
        signs = cur.agg(F.bit_xor(F.xxhash64("hi", "lo")).alias("s")).first()["s"] if n else None
        if not n or (n, signs) == before:
            return cur.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = (n, signs)
        ways = cur.unionByName(cur.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = ways.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        # Larger neighbours go to the smallest one around; then every node's smaller neighbours do.
        large = ways.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        cur = cut_lineage(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct())


def chunk_counts(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """``(cluster_id, chunks)`` of blocks with rows ``(cluster_id, vec)``.

    All pairs of chunks meet, so a member is copied once a chunk: chunks grow with
    their block, up to what a task holds.
    """
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 1
    side = F.greatest(F.lit(chunk_rows), F.least(F.ceil(F.count("*") / SIDES), F.lit(max(1, SIDE_VALUES // max(longest, 1)))))
    return rows.groupBy("cluster_id").agg(F.ceil(F.count("*") / side).cast("long").alias("chunks"))


def block_components(members: DataFrame, tau: float, member: str = "member", vec: str = "embedding", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(cluster_id, member, component)``: the smallest member linked to each by a chain of ``cos >= tau`` in its block.

    Blocks may be of any size.  Members that repeat in a block count once;
    vectors without a direction are linked with nothing.  ``chunk_rows`` is the
    largest block that is not cut and the least size of a chunk.
    """
    ship_package(members.sparkSession)
    rows = cut_lineage(members.select("cluster_id", F.col(member).cast("string").alias("member"), F.col(vec).cast("array<double>").alias("vec"))
                       .dropDuplicates(["cluster_id", "member"]))
    sizes = chunk_counts(rows, chunk_rows)
    sized = lookup_join(rows, sizes, ["cluster_id"], how="inner")
    block_type = rows.schema["cluster_id"].dataType.simpleString()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member", ignore_index=True)
        low = forest(unit(stack(pdf["vec"])), tau)
        return pd.DataFrame({"cluster_id": pdf["cluster_id"], "member": pdf["member"], "component": pdf["member"].to_numpy()[low]})

    def pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk", "member"], ignore_index=True)
        split = None if key[1] == key[2] else int((pdf["chunk"] == key[1]).sum())
        low = forest(unit(stack(pdf["vec"])), tau, split)
        on = np.flatnonzero(low != np.arange(len(low)))
        names = pdf["member"].to_numpy()
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].to_numpy()[on], "a": names[on], "b": names[low[on]]})

    small = sized.where("chunks = 1").drop("chunks").groupBy("cluster_id").applyInPandas(whole, f"cluster_id {block_type}, member string, component string")
    chunked = sized.where("chunks > 1").withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("chunks")))
    # A chunk meets itself and every other one of its block, the smaller number first.
    met = chunked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(
        "cluster_id", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "member", "vec")
    found = met.groupBy("cluster_id", "i", "j").applyInPandas(pair, f"cluster_id {block_type}, a string, b string")
    node = lambda c: F.struct("cluster_id", F.col(c).alias("member"))
    roots = smallest_reachable(found.select(node("a").alias("a"), node("b").alias("b")))
    roots = roots.select("node.cluster_id", "node.member", F.col("root.member").alias("component"))
    large = chunked.select("cluster_id", "member").join(roots, ["cluster_id", "member"], "left").select(
        "cluster_id", "member", F.coalesce("component", "member").alias("component"))
    return small.unionByName(large).withColumnRenamed("member", member)
