"""The three end-to-end flows on the smallest scale, with stage reuse."""

import tempfile

from pyspark.sql import functions as F

from graphmend.plans import flows
from graphmend.sources import fixtures as fx
from tests.conftest import SF001


def test_edge_flow(spark):
    work = tempfile.mkdtemp(prefix="graphmend-flow-", dir="/tmp")
    kg, tm = fx.kg(spark, SF001), fx.type_map(spark)
    out = flows.resolve_edges(kg, tm, work)
    assert out["kg"].count() == kg.count()
    sigs = {r["signature"] for r in out["signatures"].collect()}
    members = [m for r in out["blocks"].collect() for m in r["ids_in_cluster"]]
    assert sorted(members) == sorted(sigs) and max(r["cluster_size"] for r in out["blocks"].collect()) <= 30
    assert out["mapping"].groupBy("signature").count().filter("count > 1").count() == 0
    assert out["validated"].filter(F.col("status") != "ok").count() == 0  # surface resolver always marks
    stats = out["stats"].first()
    assert stats["n_rows"] == kg.count() and stats["n_edges_after"] <= stats["n_edges_before"]
    counts = {(r["stage"], r["counter"]): r["value"] for r in out["counts"].collect()}
    assert counts["remapped", "rows"] == counts["kg_resolved", "rows"] == stats["n_rows"]
    assert counts["kg_resolved", "changed"] == stats["n_changed"] and counts["validated", "rerun"] == 0
    assert counts["signatures", "rows"] == len(sigs)
    again = flows.resolve_edges(kg, tm, work)  # every stage is read back, not rebuilt
    assert sorted(again["mapping"].collect()) == sorted(out["mapping"].collect())


def test_entity_and_type_flows(spark):
    work = tempfile.mkdtemp(prefix="graphmend-flow-", dir="/tmp")
    kg, tm = fx.kg(spark, SF001), fx.type_map(spark)
    ent = flows.resolve_entities(kg, tm, work)
    kept = kg.filter(F.col("source").isNotNull() & F.col("target").isNotNull()).count()
    assert ent["kg"].agg(F.sum("weight")).first()[0] == kept
    typ = flows.resolve_node_types(kg, work, tau=0.5, n_seeds=3)
    m = {r["id"]: r["parent_node"] for r in typ["mapping"].collect()}
    assert set(m) == {r["type"] for r in typ["rank"].collect()}
    parents = set(m.values())
    assert all(m.get(p, p) in parents for p in parents)


def test_type_flow_from_decisions(spark):
    work = tempfile.mkdtemp(prefix="graphmend-flow-", dir="/tmp")
    kg = fx.kg(spark, SF001)
    ranked = flows.types.type_frequency_rank(kg).collect()
    first = ranked[0]["type"]
    # every other non-seed type follows the most frequent type; the last answer is unusable
    rows = [(r["type"], '{"map": "%s"}' % (first if i % 2 else r["type"])) for i, r in enumerate(ranked[3:-1])]
    rows.append((ranked[-1]["type"], "not json"))
    dec = spark.createDataFrame(rows, "id string, content string")
    out = flows.resolve_node_types(kg, work, n_seeds=3, decisions=dec)
    raw = {r["id"]: r["parent_node"] for r in out["raw"].collect()}
    assert [r["id"] for r in out["pending"].collect()] == [ranked[-1]["type"]]
    assert all(raw[r["type"]] == r["type"] for r in ranked[:3]) and len(raw) == len(ranked) - 1
