"""Response validation, mapping and apply on hand-made cases."""

import json

from pyspark.sql import functions as F

from graphmend.operators import edges


def _blocks(spark, rows):
    return spark.createDataFrame(rows, "cluster_id long, cluster_size long, ids_in_cluster array<string>")


def _val(spark, outputs, blocks):
    out = spark.createDataFrame(outputs, "id string, output_string string")
    return {r["id"]: r for r in edges.validate_outputs(out, _blocks(spark, blocks)).collect()}


BLOCK = ["[gene] binds [protein]", "[gene] bind [protein]", "[gene] activates [protein]"]


def test_statuses(spark):
    good = json.dumps({"1": json.dumps([["**[gene] binds [protein]**", "[gene] bind [protein]"], ["**[gene] activates [protein]**"]])})
    unmarked = json.dumps({"2": json.dumps([["[gene] binds [protein]", "[gene] bind [protein]"]])})
    native = json.dumps({"3": [["**[gene] binds [protein]**"]]})
    flat = json.dumps({"4": json.dumps(["a", "b"])})
    rows = [("1", good), ("2", unmarked), ("3", native), ("4", flat), ("5", '{"5": [['), ("6", "[1, 2]"), ("7", "{}")]
    blocks = [(i, 3, BLOCK) for i in range(1, 8)]
    v = _val(spark, rows, blocks)
    assert v["1"]["status"] == "ok" and v["1"]["output_matches_input"] and v["1"]["all_edges_same_type"]
    assert v["2"]["status"] == "no_representative"
    assert v["3"]["status"] == "no_list"  # native array refused, like a string-only literal reader
    assert v["4"]["status"] == "no_representative" and v["4"]["list_ok"]  # flat list read as characters
    assert v["5"]["status"] == "unparsed" and v["6"]["status"] == "unparsed"
    assert v["7"]["status"] == "no_list"


def test_singleton_blocks_and_missing_responses_are_dropped(spark):
    good = json.dumps({"1": json.dumps([["**[gene] binds [protein]**"]])})
    v = _val(spark, [("1", good), ("9", good)], [(1, 1, BLOCK[:1]), (2, 3, BLOCK)])
    assert v == {}


def test_type_check_and_invented_member_are_report_only(spark):
    mixed = json.dumps({"1": json.dumps([["**[gene] binds [protein]**", "[tf] binds [gene]", "[x] made up [y]"]])})
    v = _val(spark, [("1", mixed)], [(1, 3, BLOCK)])["1"]
    assert v["status"] == "ok" and not v["all_edges_same_type"] and not v["output_matches_input"]


def test_mapping_last_wins_and_apply(spark):
    p1 = json.dumps({"1": json.dumps([["**[gene] binds [protein]**", "[gene] bind [protein]"]])})
    p2 = json.dumps({"2": json.dumps([["[gene] bind [protein]", "**[gene] attaches to [protein]**"],
                                      ["**[gene] shifts [tf]**", "[gene] activates [protein]"]])})
    v = edges.validate_outputs(
        spark.createDataFrame([("1", p1), ("2", p2)], "id string, output_string string"),
        _blocks(spark, [(1, 2, BLOCK), (2, 3, BLOCK)]),
    )
    mapping = {r["signature"]: r["representative"] for r in edges.merge_mapping(edges.extract_mapping(v)).collect()}
    assert mapping["[gene] bind [protein]"] == "[gene] attaches to [protein]"  # later response wins
    kg = spark.createDataFrame(
        [(1, "gene", "bind", "protein"), (2, "gene", "**binds: ", "protein"), (3, "gene", "activates", "protein"),
         (4, "gene", "other", "protein"), (5, "a", "x [y] z", "c")],
        "row_id long, mapped_source_type string, interaction string, mapped_target_type string",
    )
    out = {r["row_id"]: r["mapped_edge"] for r in edges.apply_edge_mapping(kg, spark.createDataFrame(
        list(mapping.items()), "signature string, representative string")).collect()}
    assert out[1] == "attaches to"
    assert out[2] == "binds"  # key is built from the trimmed edge text
    assert out[3] == "activates"  # representative has other endpoint types: raw edge kept
    assert out[4] == "other"
    assert out[5] == "x [y] z"  # interior brackets: parts do not match, raw kept
    assert edges.apply_edge_mapping(kg, spark.createDataFrame([], "signature string, representative string")).count() == 5
