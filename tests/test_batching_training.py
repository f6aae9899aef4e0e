"""Ordinals, token batches, shards and training helpers."""

import numpy as np
from pyspark.sql import functions as F

from graphmend.operators import batching, training
from graphmend.operators.ordinal import with_ordinal


def test_ordinal_is_global_row_number(spark):
    df = spark.range(0, 5000).select(F.pmod(F.col("id") * 7919, F.lit(5003)).alias("v")).repartition(13)
    got = sorted((r["rn"], r["v"]) for r in with_ordinal(df, [F.col("v")], "rn", partitions=5).collect())
    assert [v for _, v in got] == sorted(v for _, v in got)
    assert [rn for rn, _ in got] == list(range(1, 5001))


def test_running_sum_is_global(spark):
    from graphmend.operators.ordinal import with_running_sum

    df = spark.range(0, 5000).select(
        F.pmod(F.col("id") * 7919, F.lit(5003)).alias("v"), F.pmod(F.col("id"), F.lit(7)).alias("x")
    ).repartition(13)
    got = sorted((r["v"], r["x"], r["s"]) for r in with_running_sum(df, [F.col("v")], "x", "s", partitions=5).collect())
    assert [s for _, _, s in got] == np.cumsum([x for _, x, _ in got]).tolist()


def test_token_batches_greedy_and_shards(spark):
    rng = np.random.default_rng(1)
    toks = rng.integers(1, 3000, size=400)
    df = spark.createDataFrame([(int(i), int(t)) for i, t in enumerate(toks)], "doc_id long, n_tokens long")
    one = {r["doc_id"]: r["batch_id"] for r in batching.token_batches(df, "doc_id", "doc_id", cap=8192).collect()}
    want, b, used = {}, 0, 0
    for i, t in enumerate(toks):
        if used + t > 8192:
            b, used = b + 1, 0
        used += t
        want[i] = b
    assert one == want
    many = {r["doc_id"]: r["batch_id"] for r in batching.token_batches(df, "doc_id", "doc_id", cap=8192, shard_rows=50).collect()}
    assert many == want


def _sequential(toks, cap):
    out, b, used = [], 0, 0
    for t in toks:
        if used + t > cap and used > 0:
            b, used = b + 1, 0
        used += t
        out.append(b)
    return out


def test_token_batches_exact_across_segments(spark):
    """Segments + pointer jumping give the sequential pass, empty items and a hot empty run included."""
    rng = np.random.default_rng(7)
    toks = rng.integers(0, 41, size=2500)
    toks[-3:] = 0            # empties before the first item with tokens (pos order is reversed)
    toks[900:1500] = 0       # one long empty run (hot key of the empty-item join)
    order = np.arange(len(toks))[::-1]  # ordered by a column other than the id
    rows = [(f"d{i}", int(order[i]), int(toks[i])) for i in range(len(toks))]
    df = spark.createDataFrame(rows, "doc_id string, pos long, n_tokens long")
    got = batching.token_batches(df, "doc_id", "pos", cap=100, shard_rows=1)  # 101-item segments, ~19 of them
    by_pos = sorted(rows, key=lambda r: r[1])
    want = dict(zip((r[0] for r in by_pos), _sequential([r[2] for r in by_pos], 100)))
    res = got.collect()
    assert len(res) == len(rows)
    assert {r["doc_id"]: r["batch_id"] for r in res} == want
    shards = {}
    for r in res:
        shards.setdefault(r["shard"], []).append(r["batch_in_shard"])
    assert len(shards) > 10 and all(min(v) == 0 for v in shards.values())


def test_request_shards(spark):
    reqs = spark.range(0, 23).select(F.col("id").cast("string").alias("custom_id"), F.col("id").alias("o"))
    sharded, ledger = batching.request_shards(reqs, [F.col("o")], 5)
    assert sorted(r["n_requests"] for r in ledger.collect()) == [3, 5, 5, 5, 5]


def test_restore_missing_keeps_order_and_duplicates(spark):
    df = spark.createDataFrame([(["a", "b", "c", "b", "d"], [["**a**", "c"]])], "inp array<string>, g array<array<string>>")
    out = df.select(training.restore_missing(F.col("inp"), F.col("g")).alias("r")).first()["r"]
    assert out == [["**a**", "c"], ["b"], ["b"], ["d"]]


def test_pretty_payload_matches_indent2(spark):
    import json

    from graphmend.operators.requests import pretty_payload

    rows = [(7, [["**a**", 'q"b'], ["c"]]), (8, []), (9, [[]])]
    df = spark.createDataFrame(rows, "cid long, g array<array<string>>")
    got = {r["cid"]: r["p"] for r in df.select("cid", pretty_payload("cid", "g").alias("p")).collect()}
    for cid, g in rows:
        assert got[cid] == json.dumps({str(cid): g}, indent=2, ensure_ascii=False)


def test_token_batches_last_segment_without_a_start(spark):
    """The last segment lies wholly inside a batch started before it (101-item segments;
    3, 5 and 6 segments hit different pointer-jumping rounds), plus a random case."""
    cases = [[1] * 210, [1] * 415, [1] * 520, [int(x) for x in np.random.default_rng(3).integers(1, 4, size=700)]]
    for toks in cases:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(toks)], "doc_id long, n_tokens long")
        res = batching.token_batches(df, "doc_id", "doc_id", cap=100, shard_rows=1).collect()
        assert len(res) == len(toks)
        assert {r["doc_id"]: r["batch_id"] for r in res} == dict(enumerate(_sequential(toks, 100)))


def test_exact_batches_plan_has_no_pair_joins(spark):
    df = spark.createDataFrame([(i, (i % 5)) for i in range(400)], "doc_id long, n_tokens long")
    out = batching.token_batches(df, "doc_id", "doc_id", cap=100, shard_rows=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert out.count() == 400


def test_batches_and_rejects_keep_every_input(spark):
    rows = [(0, 5), (1, 9), (2, 0), (3, 11), (4, None), (5, 3), (5, 40), (None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = sorted(((r.doc_id, r.batch_id, r.status) for r in batching.batches_and_rejects(df, "doc_id", "doc_id", cap=10).collect()), key=str)
    want = [(None, 0, "batched"), (0, 0, "batched"), (1, 1, "batched"), (2, 1, "batched"), (5, 2, "batched"),
            (3, None, "oversized"), (4, None, "oversized"), (5, None, "oversized")]
    assert got == sorted(want, key=str)
