"""End-to-end resolution flows: the three workflows as chains of stage tables.

Each stage is written as Parquet under ``workdir`` (shared storage) and read
back, so lineage is cut between stages and a rerun after a lost driver or
executor resumes at the first missing stage.  The resolver step is either the
built-in surface resolver or an external one: ``request_files`` writes the
sharded request JSONL, and the caller passes the ingested responses back in.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from graphmend.functions.text import embedding_input, node_id
from graphmend.sources.tables import write_parquet
from graphmend.operators import batching, blocking, blocks as blocks_ops, edges, embed, nodes, requests, resolvers, types


def stage(spark: SparkSession, workdir: str, name: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """Stage table ``workdir/name``: reuse it when present, else build and write it."""
    path = os.path.join(workdir, name)
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    write_parquet(build(), path)
    return spark.read.parquet(path)


def counted_stage(spark: SparkSession, workdir: str, name: str, build: Callable[[], DataFrame],
                  counters: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``stage`` and its counters ``(stage, counter, value)``, gathered by the job that writes the table.

    ``counters`` are aggregates such as ``F.count_if(...)``; an ``Observation`` on the written rows collects them, so no
    second scan is made.  They are stored beside the table.  If a run was lost between the two writes, they are
    counted from the table.
    """
    path, beside = os.path.join(workdir, name), os.path.join(workdir, f"{name}.counts")
    wanted = [c.cast("bigint").alias(n) for n, c in counters.items()]
    try:
        done = spark.read.parquet(path)
    except AnalysisException:
        seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
        write_parquet(build().observe(seen, *wanted), path)
        _write_counts(spark, name, seen.get, beside)
        return spark.read.parquet(path), spark.read.parquet(beside)
    try:
        return done, spark.read.parquet(beside)
    except AnalysisException:
        _write_counts(spark, name, done.agg(*wanted).first().asDict(), beside)
        return done, spark.read.parquet(beside)


def _write_counts(spark: SparkSession, name: str, values: dict, path: str) -> None:
    rows = [(name, counter, int(value or 0)) for counter, value in values.items()]
    write_parquet(spark.createDataFrame(rows, "stage string, counter string, value bigint").coalesce(1), path)


def per_status(column: str, values: tuple[str, ...]) -> dict[str, Column]:
    """Counters: all rows, and the rows of each status."""
    return {"rows": F.count(F.lit(1)), **{v: F.count_if(F.col(column) == v) for v in values}}


def _named(flow: str, *parameters) -> str:
    """Folder of a flow's stages: its name and a digest of the parameters that shape them.

    Tables handed in (responses, vectors, decisions) count by their content.
    """
    def mark(p):
        if isinstance(p, DataFrame):
            r = p.agg(F.count("*"), F.bit_xor(F.xxhash64(*p.columns))).first()
            return f"{p.columns}:{r[0]}:{r[1]}"
        return repr(p)
    return f"{flow}-{hashlib.sha256('|'.join(map(mark, parameters)).encode()).hexdigest()[:12]}"


def _blocks_for(vectors: DataFrame, max_cluster_size: int, k_split: int, seed: int) -> DataFrame:
    b, _, _ = blocking.multisect_kmeans(vectors, "id", "embedding", max_cluster_size, k_split, seed=seed)
    return b.select("cluster_id", "cluster_size", F.col("member_ids").alias("ids_in_cluster"))


def _surface_responses(blocks: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    members = blocks_ops.explode_blocks(blocks, "ids_in_cluster")
    if freq is not None:
        members = members.join(freq, "member", "left")
    groups = resolvers.surface_groups(members, "member", "freq" if freq is not None else None)
    return resolvers.marked_payload(resolvers.merge_abbreviations(groups))


def request_files(blocks: DataFrame, path: str, system_prompt: str, max_batch_size: int = 50_000) -> DataFrame:
    """Write one chat request per non-singleton block into shard folders; returns the ledger."""
    nb = blocks_ops.non_singleton(blocks)
    reqs = requests.completion_requests(
        nb, "cluster_id", requests.block_payload("cluster_id", "ids_in_cluster"),
        system_prompt=system_prompt, options=requests.REASONING,
    ).withColumn("_o", F.col("custom_id").cast("bigint"))
    sharded, ledger = batching.request_shards(reqs, [F.col("_o")], max_batch_size)
    requests.write_requests(sharded, path)
    return ledger


def resolve_edges(
    kg: DataFrame,
    type_map: DataFrame,
    workdir: str,
    responses: DataFrame | None = None,
    vectors: DataFrame | None = None,
    max_cluster_size: int = 30,
    k_split: int = 6,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Relationship resolution: remap -> signatures -> blocks -> groups -> mapping -> applied KG.

    ``vectors`` (id = signature, embedding) come from an embedding service
    (``responses.ingest_embeddings``); without them signatures are embedded
    with ``hash_embed``.  ``responses`` (id, output_string) come from an
    external resolver; without them the surface resolver is used.  ``counts``
    holds rows, changed rows and responses to ask again, counted while the
    stages were written; ``remapped`` and ``kg_resolved`` have equal rows.
    """
    spark = kg.sparkSession
    folder = os.path.join(workdir, _named("edges", kg, type_map, responses, vectors, max_cluster_size, k_split, seed))
    st = lambda n, f: stage(spark, folder, n, f)
    counts = []

    def counted(n, f, counters):
        table, c = counted_stage(spark, folder, n, f, counters)
        counts.append(c)
        return table

    remapped = counted("remapped", lambda: nodes.remap_types(kg, type_map), {"rows": F.count(F.lit(1))})
    sigs = counted("signatures", lambda: edges.edge_signatures(remapped, strip=True),
                   {"rows": F.count(F.lit(1)), "triples": F.sum("freq")})
    vecs = vectors if vectors is not None else st("signature_vectors", lambda: embed.hash_embed(sigs, "signature", "signature"))
    blocks = st("blocks", lambda: _blocks_for(vecs, max_cluster_size, k_split, seed))
    freq = sigs.select(F.col("signature").alias("member"), "freq")
    resp = responses if responses is not None else st("responses", lambda: _surface_responses(blocks, freq))
    validated = counted("validated", lambda: edges.validate_outputs(resp, blocks),
                        {"rows": F.count(F.lit(1)), "rerun": F.count_if(F.col("status") != "ok")})
    mapping = st("mapping", lambda: edges.merge_mapping(edges.extract_mapping(validated)))
    applied = counted("kg_resolved", lambda: edges.apply_edge_mapping(remapped, mapping),
                      {"rows": F.count(F.lit(1)), "changed": F.count_if(F.col("mapped_edge") != F.col("interaction"))})
    return {
        "remapped": remapped, "signatures": sigs, "blocks": blocks, "validated": validated,
        "rerun": edges.rerun_set(validated), "mapping": mapping, "kg": applied,
        "stats": edges.compression_stats(applied), "counts": reduce(DataFrame.unionByName, counts),
    }


def resolve_entities(
    kg: DataFrame,
    type_map: DataFrame,
    workdir: str,
    responses: DataFrame | None = None,
    vectors: DataFrame | None = None,
    max_cluster_size: int = 30,
    k_split: int = 10,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Entity resolution: nodes -> embedding inputs -> blocks -> groups -> mapping -> collapsed KG."""
    spark = kg.sparkSession
    folder = os.path.join(workdir, _named("entities", kg, type_map, responses, vectors, max_cluster_size, k_split, seed))
    st = lambda n, f: stage(spark, folder, n, f)
    remapped = st("remapped", lambda: nodes.remap_types(kg, type_map))
    node_table = st("nodes", lambda: nodes.build_nodes(remapped))
    inputs = node_table.select("id", embedding_input("id", "extracted_definition").alias("text"))
    vecs = vectors if vectors is not None else st("node_vectors", lambda: embed.hash_embed(inputs, "id", "text"))
    blocks = st("blocks", lambda: _blocks_for(vecs, max_cluster_size, k_split, seed))
    resp = responses if responses is not None else st("responses", lambda: _surface_responses(blocks))
    validated = st("validated", lambda: edges.validate_outputs(resp, blocks))
    mapping = st("mapping", lambda: edges.merge_mapping(edges.extract_mapping(validated)).select(
        F.col("signature").alias("node_id"), "representative"))
    triples = remapped.filter(F.col("source").isNotNull() & F.col("target").isNotNull()).select(
        node_id("source", "mapped_source_type").alias("source"),
        F.col("interaction").alias("relation"),
        node_id("target", "mapped_target_type").alias("target"),
    )
    collapsed = st("kg_collapsed", lambda: resolvers.collapse_entities(triples, mapping))
    return {"nodes": node_table, "blocks": blocks, "validated": validated, "mapping": mapping, "kg": collapsed}


def resolve_node_types(
    kg: DataFrame,
    workdir: str,
    vectors: DataFrame | None = None,
    tau: float = 0.9,
    n_seeds: int = types.N_SEEDS,
    nodes_with_labels: DataFrame | None = None,
    decisions: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Node-type resolution: frequency rank -> parents -> curated renames -> rare fold.

    Parents come from the threshold rule, or, given ``decisions`` (id, content)
    answers of an external resolver, from those answers on top of the
    ``n_seeds`` most frequent types; types without a usable answer are
    returned as ``pending``.
    """
    spark = kg.sparkSession
    folder = os.path.join(workdir, _named("types", kg, vectors, tau, n_seeds, nodes_with_labels, decisions))
    st = lambda n, f: stage(spark, folder, n, f)
    ranked = st("type_rank", lambda: types.type_frequency_rank(kg))
    if vectors is None:
        vecs = st("type_vectors", lambda: embed.hash_embed(ranked, "type", "type"))
    else:
        vecs = vectors
    ranked_vecs = vecs.join(ranked.select(F.col("type").alias("id"), "rank"), "id")
    out = {"rank": ranked}
    if decisions is None:
        raw = st("type_mapping_raw", lambda: types.resolve_types(ranked_vecs, tau=tau, n_seeds=n_seeds).select("id", "parent_node"))
    else:
        seeds = types.seed_parents(ranked.select("type", "rank"), n_seeds)
        raw = st("type_mapping_raw", lambda: types.decision_mapping(decisions, seeds))
        out["pending"] = types.pending_types(ranked.select(F.col("type").alias("id")), raw)
    curated = st("type_mapping", lambda: types.curate_mapping(raw))
    out.update({"raw": raw, "mapping": curated})
    if nodes_with_labels is not None:
        out["mapping_folded"] = st("type_mapping_folded", lambda: types.fold_rare_types(nodes_with_labels, curated, "label"))
    return out
