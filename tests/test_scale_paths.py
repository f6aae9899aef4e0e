"""The paths taken beyond broadcast bounds give the same answers."""

import numpy as np
from pyspark.sql import functions as F

from graphmend.operators import joins, similarity, vector_index
from graphmend.sources import fixtures as fx
from tests.conftest import SF01


def test_salted_lookup_equals_broadcast(spark):
    big = spark.range(0, 20000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k")
    )
    small = spark.createDataFrame([("hot", "H")] + [(str(i), f"v{i}") for i in range(40)], "k string, v string")
    a = joins.lookup_join(big, small, ["k"]).select("row", "v")
    b = joins.lookup_join(big, small, ["k"], broadcast_rows=0, rows_per_task=500).select("row", "v")
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.count() == 20000


def test_topk_cells_equal_broadcast(spark, monkeypatch):
    v = fx.vectors(spark, SF01)
    refs, queries = v.filter("vec_id < 60"), v.filter("vec_id >= 60")
    a = similarity.topk_cosine(queries, refs, k=5).select("query_id", "rank", "ref_id")
    monkeypatch.setattr(similarity, "BROADCAST_VALUES", 0)
    monkeypatch.setattr(vector_index, "GROUP_VALUES", 64 * 9)  # cells of several chunks, queries of several buckets
    b = similarity.topk_cosine(queries, refs, k=5).select("query_id", "rank", "ref_id")
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.count() == 440 * 5


def _groups(rng, n, dim, groups, spread):
    centre = rng.normal(size=(groups, dim))
    return vector_index.unit(centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim)))


def _plain(q, r, k):
    cos = np.round(q @ r.T, vector_index.DECIMALS)
    return [list(np.lexsort((np.arange(len(r)), -c))[:k]) for c in cos]


def _found(best):
    q, _, ref, _ = best.ranked()
    out = {}
    for i, j in zip(q.tolist(), ref.tolist()):
        out.setdefault(i, []).append(j)
    return out


def test_cell_index_is_exact_and_prunes_related_vectors():
    rng = np.random.default_rng(0)
    both = _groups(rng, 26_000, 32, 100, 0.25)
    refs, queries = both[:6000], both[6000:]
    index = vector_index.CellIndex(refs)
    best = index.topk(queries, 20)
    assert index.scored < 0.1 * len(refs) * len(queries)
    some = rng.choice(len(queries), 400, replace=False)
    got = _found(best)
    assert [got[i] for i in some] == _plain(queries[some], refs, 20)


def test_cell_index_odd_vectors_ties_and_few_references():
    rng = np.random.default_rng(1)
    refs = _groups(rng, 300, 8, 3, 0.5)
    refs = np.concatenate([refs, refs[:50], refs[:50], np.full((2, 8), np.nan)])
    queries = np.concatenate([_groups(rng, 40, 8, 5, 1.0), refs[:5], np.full((1, 8), np.nan)])
    for k in (1, 7, 500):
        got = _found(vector_index.CellIndex(refs).topk(queries, k))
        assert len(queries) - 1 not in got
        assert [got[i] for i in range(len(queries) - 1)] == _plain(queries[:-1], refs[:400], k)
    assert not _found(vector_index.CellIndex(np.zeros((0, 8))).topk(queries, 3))


def test_topk_cells_with_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = _groups(rng, 120, 6, 2, 0.3)
    rows = [(f"v{i:03d}", x[i].tolist()) for i in range(120)] + [(f"w{i:03d}", x[3].tolist()) for i in range(60)] + [("zero", [0.0] * 6)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    a = similarity.topk_cosine(df, df, k=4)
    monkeypatch.setattr(similarity, "BROADCAST_VALUES", 0)
    monkeypatch.setattr(vector_index, "GROUP_VALUES", 6 * 13)
    b = similarity.topk_cosine(df, df, k=4)
    assert a.columns == b.columns and sorted(a.collect()) == sorted(b.collect()) and a.count() == 180 * 4
    none = df.filter("id = 'none'")
    assert similarity.topk_cosine(df, none, k=4).count() == 0 and similarity.topk_cosine(none, df, k=4).count() == 0


def test_topk_matches_numpy(spark):
    v = fx.vectors(spark, SF01).toPandas()
    x = np.stack(v["embedding"].map(np.asarray)).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    refs = v["vec_id"].to_numpy() < 30
    got = similarity.topk_cosine(
        fx.vectors(spark, SF01).filter("vec_id >= 30"), fx.vectors(spark, SF01).filter("vec_id < 30"), k=3
    ).collect()
    ids = v["id"].to_numpy()
    best = {}
    for i in np.nonzero(~refs)[0]:
        s = x[refs] @ x[i]
        best[ids[i]] = list(ids[refs][np.argsort(-s, kind="stable")[:3]])
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["query_id"], []).append(r["ref_id"])
    assert mine == best
