"""Chunks of a block and the forest inside a task."""

import numpy as np

from graphmend.operators import components


def test_chunks_of_a_large_block_are_bounded(spark):
    rows = spark.range(3000).selectExpr("id % 2 * (id % 20) as cluster_id", "array(1d, 2d) as vec")
    counts = {r.cluster_id: r.chunks for r in components.chunk_counts(rows, 4).collect()}
    assert counts[0] == components.SIDES and all(1 < n <= components.SIDES for n in counts.values())
    assert {r.chunks for r in components.chunk_counts(rows.limit(0).unionAll(rows.where("cluster_id = 3")), 4096).collect()} == {1}


def test_forest_of_many_copies_and_chains():
    rng = np.random.default_rng(1)
    angle = rng.uniform(0, 2 * np.pi, 700)
    x = np.c_[np.cos(angle), np.sin(angle)]
    x = np.concatenate([x, np.repeat(x[:3], 300, axis=0), [[np.nan, np.nan]]])
    for tau in (0.99999, 0.999):
        close, low = x @ x.T >= tau, np.arange(len(x))
        while True:
            new = np.minimum(low, np.where(close, low[None, :], len(x)).min(axis=1))
            if (new == low).all():
                break
            low = new
        assert np.array_equal(components.forest(x, tau), low)
