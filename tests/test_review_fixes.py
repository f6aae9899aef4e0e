"""Inputs on which operators were once wrong."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmend.functions import text as T
from graphmend.operators import batching, blocking, edges, resolvers, responses, types
from graphmend.streaming import ingest


def groups_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.g for r in df.select("i", T.parse_groups("t").alias("g")).orderBy("i").collect()]


def test_list_text_is_read_strictly(spark):
    got = groups_of(spark, ['[["**a**", "b"]]', "[['a'], ['b']]", '[["a"]] and more', '[["a"]', '[["a",]]', '["ab"]', '[["x"], "yz"]',
                            '[["a", ["b", "c"]]]', "[]", None, '{"a": 1}', "[1, 2]"])
    assert got == [[["**a**", "b"]], [["a"], ["b"]], None, None, None, [["a", "b"]], [["x"], ["y", "z"]],
                   [["a", '["b","c"]']], [], None, None, None]


def test_lists_nested_to_any_depth_flatten(spark):
    df = spark.createDataFrame([(["a", '["b",["c \\"q\\"",["d"]]]', "[gene] x [tf]"],)], "m array<string>")
    assert df.select(T.leaf_members("m")).first()[0] == ["a", "b", 'c "q"', "d", "[gene] x [tf]"]


def test_nested_response_is_rerun_and_never_mapped(spark):
    sig = ["[gene] binds [protein]", "[gene] bind [protein]"]
    blocks = spark.createDataFrame([(i, 2, sig) for i in range(4)], "cluster_id long, cluster_size long, ids_in_cluster array<string>")
    lists = [[[["**" + sig[0] + "**", sig[1]]]], [["**" + sig[0] + "**", [sig[1]]]], [["**" + sig[0] + "**", sig[1]]]]
    out = [(str(i), json.dumps({str(i): json.dumps(g)})) for i, g in enumerate(lists)]
    out.append(("3", json.dumps({"3": json.dumps(lists[2]) + " trailing"})))
    v = edges.validate_outputs(spark.createDataFrame(out, "id string, output_string string"), blocks)
    assert {r.id: (r.status, r.output_matches_input) for r in v.collect()} == {
        "0": ("no_representative", True), "1": ("ok", True), "2": ("ok", True), "3": ("no_list", False)}
    mapped = edges.extract_mapping(v).select("id", "signature", "representative").collect()
    assert sorted(map(tuple, mapped)) == [("1", sig[0], sig[0]), ("2", sig[1], sig[0]), ("2", sig[0], sig[0])]


def test_surface_keys_keep_names_apart(spark):
    names = ["α-amylase", "β-amylase", "水稻", "玉米", "H+", "H-", "++", "--", "Café", "cafe", "Wheat", "wheats", "Na+ channel", "Na channel"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", resolvers.surface_key("n").alias("k"))
    keys = {r.n: r.k for r in df.collect()}
    same = [{n for n in names if keys[n] == k} for k in set(keys.values())]
    assert sorted(map(sorted, (s for s in same if len(s) > 1))) == [["Na channel", "Na+ channel"], ["Wheat", "wheats"]]


def completion(cid, content):
    return json.dumps({"custom_id": cid, "response": {"status_code": 200, "body": {"choices": [
        {"index": 0, "message": {"role": "assistant", "content": content}}]}}})


def test_last_line_of_a_file_wins(spark):
    for order in (("first", "second"), ("second", "first")):
        folder = tempfile.mkdtemp()
        with open(os.path.join(folder, "out.jsonl"), "w") as f:
            for v in order:
                f.write(completion("7", json.dumps({"7": v})) + "\n")
        got = responses.completion_entries(responses.parse_completion_lines(responses.read_lines(spark, folder)))
        assert [(r.custom_id, r["key"], r.value) for r in got.collect()] == [("7", "7", order[1])]


def test_stream_reads_jsonl_from_any_folder_and_only_once(spark):
    base = tempfile.mkdtemp()
    src, sink, state = (os.path.join(base, x) for x in ("in", "out", "state"))
    os.makedirs(os.path.join(src, "deep", "er"))
    assert ingest.stream_completions(spark, src, sink, state).count() == 0
    for i, place in enumerate(("deep", os.path.join("deep", "er"))):
        with open(os.path.join(src, place, f"answers{i}.jsonl"), "w") as f:
            f.write(completion(str(i), json.dumps({str(i): "old"})) + "\n" + completion(str(i), json.dumps({str(i): "new"})) + "\n")
        parsed = ingest.stream_completions(spark, src, sink, state)
        assert parsed.count() == 2 * (i + 1)
    assert {r.source_file for r in parsed.collect()} == {"answers0.jsonl", "answers1.jsonl"}
    assert {r.value for r in responses.completion_entries(parsed).collect()} == {"new"}


def test_equal_vectors_above_the_local_size_end_in_bounded_blocks(spark):
    """Far more equal points than one task takes times the branching; repeated ids too."""
    rows = [(str(i % 700), [1.0, 2.0, 3.0]) for i in range(1000)] + [(f"x{i}", [9.0, float(i), 0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    blocks, metrics, _ = blocking.multisect_kmeans(df, max_cluster_size=30, k_split=3, local_max=100)
    got = blocks.collect()
    assert max(r.cluster_size for r in got) <= 30
    assert sorted(m for r in got for m in r.member_ids) == sorted(r[0] for r in rows)
    assert any(r.forced for r in got)
    assert metrics.count() < 12


@pytest.mark.parametrize("max_iter", [1, 2, 100])
def test_inertia_is_the_same_on_both_paths(spark, max_iter):
    rng = np.random.default_rng(4)
    rows = [(f"p{i}", rng.integers(-8, 9, 4).astype(float).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    local = blocking.multisect_kmeans(df, max_cluster_size=30, k_split=4, max_iter=max_iter)
    spread = blocking.multisect_kmeans(df, max_cluster_size=30, k_split=4, max_iter=max_iter, local_max=60)
    assert abs(local[2] - spread[2]) < 1e-6 * local[2]
    blocks = lambda b: sorted(tuple(r.member_ids) for r in b.collect())
    assert blocks(local[0]) == blocks(spread[0])


def test_oversized_inputs_raise(spark):
    df = spark.createDataFrame([(1, 10), (2, 101)], "doc_id long, n_tokens long")
    with pytest.raises(ValueError):
        batching.token_batches(df, "doc_id", "doc_id", cap=100)
    assert batching.oversized(df, 100).count() == 1
    assert batching.token_batches(df, "doc_id", "doc_id", cap=100, strict=False).count() == 1


def test_long_type_chains_leave_no_type_open(spark):
    """Each type is close to its neighbours only, so every other one becomes a parent, a round at a time."""
    angle = np.cumsum(np.full(40, 0.4))
    rows = [(f"t{i:02d}", i + 1, [float(np.cos(a / 8)), float(np.sin(a / 8))]) for i, a in enumerate(angle)]
    df = spark.createDataFrame(rows, "id string, rank long, embedding array<double>")
    got = types.resolve_types(df, tau=float(np.cos(0.06)), n_seeds=1).collect()
    assert len(got) == 40 and all(r.parent_node for r in got)


def test_chunks_of_several_blocks_keep_their_order(spark):
    df = spark.createDataFrame([(i, [f"m{i}"]) for i in range(10)], "cluster_id long, member_ids array<string>").repartition(5)
    chunks = batching.chunk_blocks(df, 3).select("chunk_id", F.map_keys("payload").alias("keys"))
    got = {r.chunk_id: r["keys"] for r in chunks.collect()}
    assert got == {0: ["0", "1", "2"], 1: ["3", "4", "5"], 2: ["6", "7", "8"], 3: ["9"]}


def test_rare_types_by_label_counts(spark):
    nodes = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)] + [(None,)] * 9, "label string")
    mapping = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("unused", "z"), ("n", None)], "id string, parent_node string")
    got = {r.id: r.parent_node for r in types.fold_rare_types(nodes, mapping, min_count=5).collect()}
    assert got == {"a": "x", "b": "x", "c": "other", "unused": "z", "n": None}


def test_raw_and_stripped_signatures(spark):
    df = spark.createDataFrame([("g", "binds: ", "p"), ("g", "binds", "p")], "mapped_source_type string, interaction string, mapped_target_type string")
    assert sorted(r.signature for r in edges.edge_signatures(df).collect()) == ["[g] binds [p]", "[g] binds:  [p]"]
    assert edges.edge_signatures(df, strip=True).agg(F.sum("freq")).first()[0] == 2 == edges.edge_signatures(df).count()
