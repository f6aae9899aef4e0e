"""Fine-tuning data assembly from resolver runs, judge verdicts and corrections.

Run outputs, verdicts and corrections are tables keyed by block id; the
steps are joins (semi / anti / lookup), set operations and per-row array
expressions, so whole runs are processed as Spark jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmend.functions import text as T


def _key_json(id_col: str, value: Column) -> Column:
    """``{"<id>": value}`` as compact JSON text."""
    return F.to_json(F.create_map(F.col(id_col).cast("string"), value))


def run_frame(outputs: DataFrame, id_col: str = "cluster_id", output_col: str = "output", shuffle_seed: int | None = None) -> DataFrame:
    """Input / Output / Output>1 / one_item frame of one resolver run.

    ``output`` is list-literal text of groups.  Input = all output members
    with ``*`` trimmed, in output order, or — with ``shuffle_seed`` — in a
    seeded hash order that does not depend on partitioning.  Each list is
    wrapped as ``{"<id>": list}`` JSON text.
    """
    groups = T.parse_groups(F.col(output_col), lenient_flat=False)
    flat = F.transform(F.flatten(groups), lambda m: F.btrim(m, F.lit("*")))
    if shuffle_seed is not None:
        keyed = F.transform(flat, lambda m: F.struct(F.md5(F.concat(F.lit(f"{shuffle_seed}:"), F.col(id_col).cast("string"), F.lit(":"), m).cast("binary")).alias("h"), m.alias("m")))
        flat = F.transform(F.array_sort(keyed), lambda s: s["m"])
    multi = T.multi_member_groups(groups)
    return outputs.select(
        F.col(id_col),
        _key_json(id_col, flat).alias("input"),
        _key_json(id_col, groups).alias("output"),
        _key_json(id_col, multi).alias("output_multi"),
        (F.size(multi) == 0).alias("one_item"),
    )


def common_ids(a: DataFrame, b: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Ids present in both runs (set intersection)."""
    return a.select(key).intersect(b.select(key))


def combine_runs(a: DataFrame, b: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Both runs without the blocks they share, stacked (``run`` = a / b)."""
    common = common_ids(a, b, key)
    only_a = a.join(common, key, "left_anti").withColumn("run", F.lit("a"))
    only_b = b.join(common, key, "left_anti").withColumn("run", F.lit("b"))
    return only_a.unionByName(only_b, allowMissingColumns=True)


def leakage(train: DataFrame, test: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Ids in both splits — must be empty."""
    return train.select(key).intersect(test.select(key))


def attach_inputs(frame: DataFrame, blocks: DataFrame, key: str = "cluster_id", members: str = "member_ids", strict: bool = False) -> DataFrame:
    """Block members of every framed id (left join; ``strict`` raises on a miss)."""
    out = frame.join(blocks.select(key, F.col(members).alias("input_members")), key, "left")
    if strict and out.filter(F.col("input_members").isNull()).limit(1).count():
        raise KeyError("a framed block id has no input block")
    return out


def latest_corrections(corrections: DataFrame, key: str = "cluster_id", value: str = "groups", order: str = "ord") -> DataFrame:
    """One correction per id; a later entry wins (``max_by``, partial aggregate)."""
    return corrections.groupBy(key).agg(F.max_by(value, F.col(order)).alias(value))


def attach_corrections(frame: DataFrame, corrections: DataFrame, key: str = "cluster_id") -> DataFrame:
    return frame.join(latest_corrections(corrections, key), key, "left")


def restore_missing(input_members, groups) -> Column:
    """Corrected groups plus every input member they lost, as singletons.

    Missing members keep input order and duplicates (not a set difference).
    """
    present = F.transform(F.flatten(groups), lambda m: F.btrim(m, F.lit("*")))
    missing = F.filter(input_members, lambda x: ~F.array_contains(present, x))
    return F.concat(groups, F.transform(missing, lambda x: F.array(x)))


def test_split(blocks: DataFrame, test_ids: DataFrame, key: str = "cluster_id", max_size: int = 30) -> DataFrame:
    """Test blocks: listed ids, at most ``max_size`` members, inputs attached."""
    return blocks.join(test_ids.select(key), key, "left_semi").filter(F.col("cluster_size") <= max_size)
