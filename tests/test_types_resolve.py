"""Parallel type resolution equals the sequential rule; curation order."""

import numpy as np
from pyspark.sql import functions as F

from graphmend.operators import types
from graphmend.operators.ordinal import with_ordinal
from graphmend.sources import fixtures as fx
from tests.conftest import SF01


def _sequential(ids, x, tau, n_seeds):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    parents, out = [], {}
    for i, name in enumerate(ids):
        if i < n_seeds:
            parents.append(i)
            out[name] = name
            continue
        sims = [(x[i] @ x[p], -p) for p in parents]
        best = max(sims) if sims else None
        if best is not None and best[0] >= tau:
            out[name] = ids[-best[1]]
        else:
            parents.append(i)
            out[name] = name
    return out


def test_resolve_types_matches_sequential(spark):
    ranked = with_ordinal(fx.vectors(spark, SF01), [F.col("vec_id")], "rank")
    got = {r["id"]: r["parent_node"] for r in types.resolve_types(ranked, tau=0.3, n_seeds=30).collect()}
    pdf = ranked.orderBy("rank").toPandas()
    want = _sequential(list(pdf["id"]), np.stack(pdf["embedding"].map(np.asarray)).astype(float), 0.3, 30)
    assert got == want


def test_curation_is_sequential(spark):
    m = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, parent_node string")
    out = {r["id"]: r["parent_node"] for r in types.curate_mapping(m, [("x", "y"), ("y", "w"), ("z", "z2")]).collect()}
    assert out == {"a": "w", "b": "w", "c": "z2"}


def test_fold_rare(spark):
    nodes = spark.createDataFrame([(f"n{i}", "big") for i in range(5)] + [("m", "small"), ("u", "unmapped")], "name string, label string")
    mapping = spark.createDataFrame([("big", "big"), ("small", "small")], "id string, parent_node string")
    out = {r["id"]: r["parent_node"] for r in types.fold_rare_types(nodes, mapping, "label", min_count=3).collect()}
    assert out == {"big": "big", "small": "other"}


def test_resolve_types_in_blocks_of_ranks(spark, monkeypatch):
    from graphmend.operators import similarity

    ranked = with_ordinal(fx.vectors(spark, SF01), [F.col("vec_id")], "rank")
    a = {r["id"]: r["parent_node"] for r in types.resolve_types(ranked, tau=0.3).collect()}
    monkeypatch.setattr(similarity, "TILE", (50, 33))
    out = similarity.follow_by_rank(ranked, 0.3, types.N_SEEDS, block_rows=28)  # 18 blocks
    rows = out.collect()
    assert {r["id"]: r["parent_node"] for r in rows} == a and len(rows) == 500


def test_resolve_types_odd_vectors(spark):
    rows = [("a", 1, [1.0, 0.0]), ("zero", 2, [0.0, 0.0]), ("same", 3, [2.0, 0.0]), ("other", 4, [0.0, 1.0]), ("again", 5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, rank long, embedding array<double>")
    want = {"a": "a", "zero": "zero", "same": "a", "other": "other", "again": "again"}
    for size in (1, 2, 100):
        from graphmend.operators.similarity import follow_by_rank

        assert {r.id: r.parent_node for r in follow_by_rank(df, 0.9, 0, block_rows=size).collect()} == want
    assert types.resolve_types(df.filter("rank > 9")).count() == 0


def test_decision_mapping_resume_and_pending(spark):
    from graphmend.operators import types as T

    base = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "a")], "id string, parent_node string")
    dec = spark.createDataFrame(
        [
            ("c", '{"map": "b"}', 1),     # already mapped: the existing row wins
            ("d", "{'map': 'a'}", 2),     # single quotes, as a literal eval reads them
            ("e", '{"map": "e"}', 3),     # itself -> new reference
            ("f", '{"map": "a"', 4),      # truncated -> pending
            ("g", '{"map": "b"}', 6),
            ("g", '{"map": "a"}', 5),     # repeated answer: first by order wins
        ],
        "id string, content string, seq int",
    )
    got = {r["id"]: r["parent_node"] for r in T.decision_mapping(dec, base, order_col="seq").collect()}
    assert got == {"a": "a", "b": "b", "c": "a", "d": "a", "e": "e", "g": "a"}
    pending = T.pending_types(spark.createDataFrame([("f",), ("g",)], "id string"), T.decision_mapping(dec, base))
    assert [r["id"] for r in pending.collect()] == ["f"]
