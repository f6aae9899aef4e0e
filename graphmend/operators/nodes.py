"""Node-type remapping of triples and node-table construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmend.functions.text import node_id
from graphmend.operators.joins import BROADCAST_ROWS, assert_unique, bounded_rows, lookup_join
from graphmend.session import cut_lineage

OTHER = "other"  # fixed value: parent type of every unmapped node type


def remap_types(
    kg: DataFrame,
    type_map: DataFrame,
    source_type: str = "source_type",
    target_type: str = "target_type",
    default: str = OTHER,
    check_unique: bool = True,
) -> DataFrame:
    """Add ``mapped_source_type`` / ``mapped_target_type`` (originals kept).

    ``type_map`` is ``(id, parent_node)``; types not in it map to
    ``default``.  A repeated ``id`` is an error, as a fan-out would be.
    """
    type_map = cut_lineage(type_map.select("id", "parent_node"))
    if check_unique:
        assert_unique(type_map, ["id"], "type map")
    fits = bounded_rows(type_map, BROADCAST_ROWS)  # one size check for both endpoint lookups
    src = type_map.select(F.col("id").alias("_st"), F.col("parent_node").alias("_sp"))
    tgt = type_map.select(F.col("id").alias("_tt"), F.col("parent_node").alias("_tp"))
    out = lookup_join(kg.withColumn("_st", F.col(source_type)), src, ["_st"], small_fits=fits)
    out = lookup_join(out.withColumn("_tt", F.col(target_type)), tgt, ["_tt"], small_fits=fits)
    return (
        out.withColumn("mapped_source_type", F.coalesce("_sp", F.lit(default)))
        .withColumn("mapped_target_type", F.coalesce("_tp", F.lit(default)))
        .drop("_st", "_sp", "_tt", "_tp")
    )


def build_nodes(
    remapped: DataFrame,
    order_col: str = "row_id",
    definitions: tuple[str, ...] = ("extracted_definition",),
) -> DataFrame:
    """Unique nodes of both triple endpoints, keeping the first occurrence.

    Rows with a null source or target name are skipped.  "First" is all
    source endpoints in ``order_col`` order, then all target endpoints —
    carried as an explicit ``(side, order)`` key, so it does not depend on
    partitioning.  The dedupe is a partial (map-side) ``min_by`` aggregate:
    a node id holding a large share of rows is collapsed per task before the
    shuffle.
    """
    base = remapped.filter(F.col("source").isNotNull() & F.col("target").isNotNull())

    def side(prefix: str, type_col: str, tag: int):
        return F.struct(
            node_id(F.col(prefix), F.col(type_col)).alias("id"),
            F.col(prefix).alias("name"),
            F.col(type_col).alias("node_type"),
            *[F.col(f"{prefix}_{d}").alias(d) for d in definitions],
            F.lit(tag).alias("_side"),
            F.col(order_col).alias("_ord"),
        )

    # Both endpoints of a triple come out of one pass over the table.
    both = base.select(F.inline(F.array(side("source", "mapped_source_type", 0), side("target", "mapped_target_type", 1))))
    payload = F.struct("name", "node_type", *definitions)
    first = both.groupBy("id").agg(F.min_by(payload, F.struct("_side", "_ord")).alias("_n"))
    return first.select("id", "_n.*")
