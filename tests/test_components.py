"""Components of similar members in blocks cut into chunks."""

import numpy as np

from graphmend.operators import components, resolvers


def plain(rows, tau):
    out = {}
    for block in {r[0] for r in rows}:
        mine = sorted({r[1]: r[2] for r in rows if r[0] == block}.items())
        x = components.unit(np.array([v for _, v in mine], float))
        low = list(range(len(mine)))
        changed = True
        while changed:
            changed = False
            for i in range(len(mine)):
                for j in range(len(mine)):
                    if i != j and x[i] @ x[j] >= tau and low[i] != low[j]:
                        low[i] = low[j] = min(low[i], low[j])
                        changed = True
        out.update({(block, mine[i][0]): mine[low[i]][0] for i in range(len(mine))})
    return out


def test_blocks_of_any_size(spark):
    rng = np.random.default_rng(0)
    rows = []
    for block, n in ((1, 90), (2, 5), (3, 1), (4, 40)):
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))  # chains along a circle
        rows += [(block, f"m{rng.integers(10**9)}", [float(np.cos(a)), float(np.sin(a))]) for a in angle]
    rows += [(4, "zero", [0.0, 0.0]), (2, rows[91][1], rows[91][2])]
    df = spark.createDataFrame(rows, "cluster_id long, member string, embedding array<double>")
    for tau in (0.999, 0.95):
        want = plain(rows, tau)
        for chunk in (7, 64, 4096):
            got = resolvers.similarity_groups(df, tau, chunk_rows=chunk).collect()
            assert {(r.cluster_id, r.member): r.component for r in got} == want and len(got) == len(want)


def test_smallest_reachable(spark):
    edges = [("b", "a"), ("b", "c"), ("c", "d"), ("x", "y"), ("z", "z")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    got = {r.node: r.root for r in components.smallest_reachable(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {"b": "a", "c": "a", "d": "a", "y": "x", **{f"n{i:03d}": "n000" for i in range(1, 61)}}
    assert components.smallest_reachable(spark.createDataFrame([], "a string, b string")).count() == 0
