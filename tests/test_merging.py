"""Abbreviations, mergeable distinct counts and counters of written stages."""

import os
import tempfile

from pyspark.sql import functions as F

from graphmend.operators import resolvers, sketches
from graphmend.plans import flows


def _groups(spark, rows):
    members = spark.createDataFrame(rows, "cluster_id long, member string, freq long")
    merged = resolvers.merge_abbreviations(resolvers.surface_groups(members, "member", "freq"))
    return {(r.cluster_id, r.representative): r.group for r in merged.collect()}


def test_abbreviations_join_their_long_form(spark):
    got = _groups(spark, [
        (1, "transcription factor", 1), (1, "TF", 50), (1, "Transcription Factors", 1), (1, "QZ", 9),
        (1, "binding of calcium", 2), (1, "BC", 1), (1, "BOC", 1),       # small words count or not
        (2, "TF", 3), (2, "tf", 1),                                         # no long form in this block
        (3, "gene map", 1), (3, "green moss", 1), (3, "GM", 7),             # two long forms fit
        (4, "[gene] cell wall [tool]", 1), (4, "[gene] CW [tool]", 2), (4, "[gene] CW [gene]", 2),
        (5, "rapid gene base sequence", 1), (5, "RGBS", 1), (5, "cw", 1), (5, "cell wall", 1),  # lower case is no abbreviation
    ])
    assert got == {
        (1, "Transcription Factors"): ["TF", "Transcription Factors", "transcription factor"], (1, "QZ"): ["QZ"],
        (1, "binding of calcium"): ["BC", "BOC", "binding of calcium"],
        (2, "TF"): ["TF", "tf"],
        (3, "gene map"): ["gene map"], (3, "green moss"): ["green moss"], (3, "GM"): ["GM"],
        (4, "[gene] cell wall [tool]"): ["[gene] CW [tool]", "[gene] cell wall [tool]"], (4, "[gene] CW [gene]"): ["[gene] CW [gene]"],
        (5, "rapid gene base sequence"): ["RGBS", "rapid gene base sequence"], (5, "cw"): ["cw"], (5, "cell wall"): ["cell wall"],
    }


def test_merged_sketches_near_the_exact_union(spark):
    path = tempfile.mkdtemp(prefix="graphmend-sketch-", dir="/tmp")
    one = spark.range(0, 60_000).select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))
    two = spark.range(40_000, 100_000).select(F.col("id").alias("a"), F.when(F.col("id") < 40_003, F.col("id")).cast("string").alias("b"))
    for _ in range(2):  # a repeated run replaces its rows
        sketches.store_sketches(one, path, "x", ["a", "b"])
    sketches.store_sketches(two, path, "y", ["a", "b"])
    got = {r.column: r for r in sketches.merged_counts(spark.read.parquet(path)).collect()}
    assert (got["a"].n_runs, got["a"].n_most, got["a"].n_sum) == (2, 60_000, 120_000)
    assert abs(got["a"].estimate - 100_000) <= sketches.STATED_ERROR * 100_000
    assert (got["b"].n_most, got["b"].estimate) == (3, 3)


def test_counted_stage(spark):
    work = tempfile.mkdtemp(prefix="graphmend-counted-", dir="/tmp")
    def build():
        return spark.range(1000).repartition(7).withColumn("odd", F.expr("id % 2 = 1"))

    counters = {"rows": F.count(F.lit(1)), "odd": F.count_if("odd"), "none": F.sum(F.when(F.col("id") < 0, 1))}
    for _ in range(2):  # written, then read back
        table, counts = flows.counted_stage(spark, work, "t", build, counters)
        assert table.count() == 1000
        assert {r.counter: r.value for r in counts.collect()} == {"rows": 1000, "odd": 500, "none": 0}
        assert counts.columns == ["stage", "counter", "value"]
    other = os.path.join(work, "late")
    build().write.parquet(other)  # a table whose counts were lost
    _, counts = flows.counted_stage(spark, work, "late", build, counters)
    assert {r.counter: r.value for r in counts.collect()} == {"rows": 1000, "odd": 500, "none": 0}
