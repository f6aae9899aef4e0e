"""Registered queries: one per operator of the resolution workflow.

Each query takes ``(spark, sf_dir)``, derives its input from the driver
tables with Spark and returns a DataFrame whose columns match the oracle
SQL of the same name (``graphmend.plans.oracle``).  Array results are
rendered as JSON text so both engines compare scalars.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmend.operators import blocks as blocks_ops
from graphmend.functions import text as T
from graphmend.operators import (
    batching, blocking, edges, embed, kmeans, nodes, requests, resolvers, responses, sampling, similarity, sketches, training, types,
)
from graphmend.sources import files, fixtures as fx
from graphmend.session import cut_lineage, scratch_path
from graphmend.sources.tables import load_spread as load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ----------------------------------------------------------- nodes & types

def remapped_kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.remap_types(fx.kg(spark, sf_dir), fx.type_map(spark))


@query("remap_types")
def q_remap_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remapped_kg(spark, sf_dir).select(
        "row_id", "source", "source_type", "interaction", "target", "target_type",
        "mapped_source_type", "mapped_target_type",
    )


@query("build_nodes")
def q_build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.build_nodes(remapped_kg(spark, sf_dir))


# --------------------------------------------------------------- edge path

def _json(c):
    return F.to_json(F.col(c)).alias(c)


def edge_stage(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Signatures -> blocks -> resolver responses -> validation, as DataFrames."""
    rk = remapped_kg(spark, sf_dir)
    sig = edges.edge_signatures(rk, strip=True)
    members = fx.edge_block_members(sig)
    blocks = fx.edge_blocks(members)
    resp = fx.edge_responses(members)
    validated = edges.validate_outputs(resp.select("id", "output_string"), blocks)
    return {"kg": rk, "sig": sig, "members": members, "blocks": blocks, "resp": resp, "validated": validated}


@query("edge_signatures")
def q_edge_signatures(spark, sf_dir):
    return edge_stage(spark, sf_dir)["sig"]


@query("edge_blocks")
def q_edge_blocks(spark, sf_dir):
    return edge_stage(spark, sf_dir)["blocks"].select("cluster_id", "cluster_size", _json("ids_in_cluster"))


@query("non_singleton_blocks")
def q_non_singleton_blocks(spark, sf_dir):
    b = edge_stage(spark, sf_dir)["blocks"]
    return blocks_ops.non_singleton(b).select("cluster_id", "cluster_size")


@query("join_outputs")
def q_join_outputs(spark, sf_dir):
    st = edge_stage(spark, sf_dir)
    return edges.join_outputs(st["resp"].select("id", "output_string"), st["blocks"]).select(
        "id", "output_string", "cluster_size"
    )


VALIDATION_COLS = [
    "id", "status", "output_parsed", "list_ok", "output_matches_input",
    "representative_in_list", "all_edges_same_type", "n_groups",
]


@query("validate_outputs")
def q_validate_outputs(spark, sf_dir):
    return edge_stage(spark, sf_dir)["validated"].select(*VALIDATION_COLS)


@query("rerun_set")
def q_rerun_set(spark, sf_dir):
    return edges.rerun_set(edge_stage(spark, sf_dir)["validated"]).select("id", "status")


@query("type_mismatch_rows")
def q_type_mismatch_rows(spark, sf_dir):
    v = edge_stage(spark, sf_dir)["validated"]
    return edges.type_mismatch_rows(v).select("id", F.to_json("groups").alias("groups"))


@query("output_matches_input")
def q_output_matches_input(spark, sf_dir):
    v = edge_stage(spark, sf_dir)["validated"]
    return v.filter(F.col("list_ok")).select("id", "output_matches_input")


@query("validation_report")
def q_validation_report(spark, sf_dir):
    return edges.validation_report(edge_stage(spark, sf_dir)["validated"])


@query("extract_edge_mapping")
def q_extract_edge_mapping(spark, sf_dir):
    return edges.extract_mapping(edge_stage(spark, sf_dir)["validated"]).select(
        "id", "group_pos", "member_pos", "signature", "representative"
    )


def edge_mapping(spark, sf_dir):
    st = edge_stage(spark, sf_dir)
    return st, edges.merge_mapping(edges.extract_mapping(st["validated"]))


@query("merge_edge_mapping")
def q_merge_edge_mapping(spark, sf_dir):
    return edge_mapping(spark, sf_dir)[1]


def applied_kg(spark, sf_dir):
    st, mapping = edge_mapping(spark, sf_dir)
    return edges.apply_edge_mapping(st["kg"], mapping)


@query("apply_edge_mapping")
def q_apply_edge_mapping(spark, sf_dir):
    return applied_kg(spark, sf_dir).select(
        "row_id", "mapped_source_type", "interaction", "mapped_target_type", "mapped_edge"
    )


@query("compression_stats")
def q_compression_stats(spark, sf_dir):
    return edges.compression_stats(applied_kg(spark, sf_dir))


@query("merged_distinct")
def q_merged_distinct(spark, sf_dir):
    """Labels before and after over two runs: stored sketches merged, held against the exact union."""
    applied = cut_lineage(applied_kg(spark, sf_dir))
    path, columns = scratch_path(spark, "sketches"), ["interaction", "mapped_edge"]
    for run in (0, 1):
        sketches.store_sketches(applied.where(F.col("row_id") % 2 == run), path, f"run-{run}", columns)
    merged = sketches.merged_counts(spark.read.parquet(path))
    exact = sketches.distinct_sketches(applied, columns).select("column", F.col("n_exact").alias("n_union"))
    near = F.abs(F.col("estimate") - F.col("n_union")) <= sketches.STATED_ERROR * F.col("n_union")
    return merged.join(exact, "column").select("column", "n_runs", "n_most", "n_sum", "n_union", near.alias("within_error"))


@query("stage_counters")
def q_stage_counters(spark, sf_dir):
    """Rows, changed rows and skipped lines, counted by the jobs that write the stages."""
    from graphmend.plans import flows

    work, rows = scratch_path(spark, "counted"), F.count(F.lit(1))
    remapped, first = flows.counted_stage(spark, work, "remapped", lambda: remapped_kg(spark, sf_dir), {"rows": rows})
    applied, last = flows.counted_stage(spark, work, "kg_resolved", lambda: applied_kg(spark, sf_dir), {
        "rows": rows, "changed": F.count_if(F.col("mapped_edge") != F.col("interaction"))})
    lines, read = flows.counted_stage(spark, work, "lines", lambda: parsed_completions(spark, sf_dir), flows.per_status(
        "status", (responses.OK, responses.CORRUPT, responses.NO_CONTENT, responses.BAD_PAYLOAD)))
    return first.unionByName(last).unionByName(read)


# --------------------------------------------------------------- node types

def ranked_vectors(spark, sf_dir):
    """Type vectors with a frequency rank (table order = rank order)."""
    from graphmend.operators.ordinal import with_ordinal

    return with_ordinal(fx.vectors(spark, sf_dir), [F.col("vec_id")], "rank")


def seed_and_query_vectors(spark, sf_dir):
    rv = ranked_vectors(spark, sf_dir)
    return rv.filter(F.col("rank") <= types.N_SEEDS), rv.filter(F.col("rank") > types.N_SEEDS)


@query("type_universe")
def q_type_universe(spark, sf_dir):
    return types.type_universe(fx.kg(spark, sf_dir))


@query("type_frequency_rank")
def q_type_frequency_rank(spark, sf_dir):
    return types.type_frequency_rank(fx.kg(spark, sf_dir))


@query("seed_parents")
def q_seed_parents(spark, sf_dir):
    ranked = ranked_vectors(spark, sf_dir).select(F.col("id").alias("type"), "rank")
    return types.seed_parents(ranked)


@query("topk_similar_types")
def q_topk_similar_types(spark, sf_dir):
    seeds, rest = seed_and_query_vectors(spark, sf_dir)
    return types.topk_similar_types(rest, seeds).select("query_id", "rank", "ref_id")


@query("type_prompts")
def q_type_prompts(spark, sf_dir):
    seeds, rest = seed_and_query_vectors(spark, sf_dir)
    topk = types.topk_similar_types(rest, seeds)
    qrank = rest.select("id", (F.col("rank") - types.N_SEEDS - 1).alias("query_index"))
    return types.type_prompts(topk, qrank)


@query("type_prompts_resumed")
def q_type_prompts_resumed(spark, sf_dir):
    """Second round of the type loop: after a first answer batch its own parents are references too."""
    rv = cut_lineage(ranked_vectors(spark, sf_dir))
    seeds = types.seed_parents(rv.select(F.col("id").alias("type"), "rank"))
    first = rv.filter(F.col("rank") <= 200).select("id")
    answers = type_decisions(spark, sf_dir, rv).join(first, "id", "left_semi")
    return types.resumed_prompts(rv, types.decision_mapping(answers, seeds))


def type_decisions(spark, sf_dir, ranked=None):
    """Resolver answers for the non-seed types (FIXTURES.md): even rank -> best seed, odd -> itself,
    rank divisible by 7 -> unparseable text."""
    rv = ranked if ranked is not None else ranked_vectors(spark, sf_dir)
    seeds, rest = rv.filter(F.col("rank") <= types.N_SEEDS), rv.filter(F.col("rank") > types.N_SEEDS)
    top1 = types.topk_similar_types(rest, seeds).filter(F.col("rank") == 1).select(F.col("query_id").alias("id"), "ref_id")
    r = rest.select("id", "rank").join(top1, "id", "left")
    content = (
        F.when(F.col("rank") % 7 == 0, F.lit("not json"))
        .when(F.col("rank") % 2 == 0, F.to_json(F.struct(F.col("ref_id").alias("map"))))
        .otherwise(F.to_json(F.struct(F.col("id").alias("map"))))
    )
    return r.select("id", content.alias("content"))


@query("type_decisions")
def q_type_decisions(spark, sf_dir):
    rv = ranked_vectors(spark, sf_dir)
    seeds = types.seed_parents(rv.select(F.col("id").alias("type"), "rank"))
    return types.decision_mapping(type_decisions(spark, sf_dir, rv), seeds)


def identity_type_mapping(spark, sf_dir):
    u = types.type_universe(fx.kg(spark, sf_dir), null_text=None)
    return u.select(F.col("type").alias("id"), F.col("type").alias("parent_node"))


@query("curate_mapping")
def q_curate_mapping(spark, sf_dir):
    return types.curate_mapping(identity_type_mapping(spark, sf_dir))


def labelled_nodes(spark, sf_dir):
    kg = fx.kg(spark, sf_dir)
    src = kg.select(F.col("source").alias("name"), F.col("source_type").alias("label"))
    tgt = kg.select(F.col("target").alias("name"), F.col("target_type").alias("label"))
    return src.unionByName(tgt).filter(F.col("name").isNotNull() & F.col("label").isNotNull()).distinct()


@query("label_remap")
def q_label_remap(spark, sf_dir):
    mapping = types.curate_mapping(identity_type_mapping(spark, sf_dir))
    return types.label_remap(labelled_nodes(spark, sf_dir), mapping, "label").select("name", "label", "remapped_label")


@query("fold_rare_types")
def q_fold_rare_types(spark, sf_dir):
    mapping = types.curate_mapping(identity_type_mapping(spark, sf_dir))
    return types.fold_rare_types(labelled_nodes(spark, sf_dir), mapping, "label").select("id", "parent_node")


# ----------------------------------------------------------------- blocking

N_INIT = 10  # centroids for the single-step queries: the 10 lowest-ranked vectors


def initial_centroids(spark, sf_dir):
    rv = ranked_vectors(spark, sf_dir)
    return rv.filter(F.col("rank") <= N_INIT).select((F.col("rank") - 1).alias("label"), F.col("embedding").alias("centroid"))


@query("assign_nearest")
def q_assign_nearest(spark, sf_dir):
    cent = initial_centroids(spark, sf_dir).toPandas()  # k rows
    return similarity.nearest(fx.vectors(spark, sf_dir), cent).select("id", "label")


@query("lloyd_step")
def q_lloyd_step(spark, sf_dir):
    vec = fx.vectors(spark, sf_dir)
    first = similarity.nearest(vec, initial_centroids(spark, sf_dir).toPandas())
    assigned = vec.drop("label").join(first.select("id", "label"), "id")
    cent = blocking.lloyd_update(assigned).toPandas()  # k rows
    return similarity.nearest(vec, cent).select("id", "label")


@query("multisect_kmeans")
def q_multisect_kmeans(spark, sf_dir):
    blocks, _, _ = blocking.multisect_kmeans(fx.vectors(spark, sf_dir), max_cluster_size=30, k_split=10)
    return blocks.select("cluster_id", "cluster_size", F.to_json("member_ids").alias("member_ids"))


@query("blocking_invariants")
def q_blocking_invariants(spark, sf_dir):
    """What any blocking of the vectors must satisfy, checked on the real one."""
    blocks, metrics, inertia = blocking.multisect_kmeans(fx.vectors(spark, sf_dir), max_cluster_size=30, k_split=10)
    ids = blocks.select("cluster_size", F.explode("member_ids").alias("id"))
    return ids.agg(
        F.count("*").alias("n_members"), F.count_distinct("id").alias("n_ids"), (F.max("cluster_size") <= 30).alias("within_cap"),
    ).select("*", F.lit(inertia > 0).alias("has_inertia"))


@query("split_progress")
def q_split_progress(spark, sf_dir):
    """Open points of each level never grow, and none is open at the end."""
    _, metrics, _ = blocking.multisect_kmeans(fx.vectors(spark, sf_dir), max_cluster_size=30, k_split=10, local_max=100)
    first = F.max(F.when(F.col("level") == 0, F.col("open_points")))
    falling = F.max(F.col("open_points") - F.coalesce(F.col("before"), F.col("open_points"))) <= 0
    return metrics.withColumn("before", F.lag("open_points").over(Window.orderBy("level"))).agg(
        first.alias("first_open"), falling.alias("falling"), (F.max("level") > 0).alias("several_levels"))


@query("hash_embed_shape")
def q_hash_embed_shape(spark, sf_dir):
    e = embed.hash_embed(fx.texts(spark, sf_dir), "doc_id", "text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return e.select("id", F.size("embedding").cast("bigint").alias("dims"), F.round(norm, 6).alias("norm"))


@query("elbow")
def q_elbow(spark, sf_dir):
    return blocking.elbow(fx.vectors(spark, sf_dir), k_values=range(2, 21), max_cluster_size=30)


@query("kmeans_flat")
def q_kmeans_flat(spark, sf_dir):
    """Both backends at one k, judged by what every k-means result must satisfy."""
    vec, k, out = fx.vectors(spark, sf_dir), 12, None
    for backend in ("lloyd", "mllib"):
        labels, centroids = kmeans.kmeans_flat(vec, k, backend=backend)
        labels = cut_lineage(labels)
        row = kmeans.violations(vec, labels, centroids).select(
            F.lit(backend).alias("backend"), "n_points", "not_nearest", "not_mean", F.lit(centroids.count() <= k).alias("within_k"))
        out = row if out is None else out.unionByName(row)
    return out


@query("elbow_sweep")
def q_elbow_sweep(spark, sf_dir):
    """All k in one scan an iteration: every point in a cluster, inertia falling with k, one k chosen."""
    t = cut_lineage(kmeans.elbow_sweep(fx.vectors(spark, sf_dir), range(2, 21, 2)))
    first = F.max(F.when(F.col("k") == 2, F.col("inertia"))).over(Window.partitionBy(F.lit(0)))  # a row a k
    chosen = F.sum(F.col("chosen").cast("int")).over(Window.partitionBy(F.lit(0)))
    return t.select("k", "n_points", (F.col("n_clusters") <= F.col("k")).alias("within_k"),
                    ((F.col("k") == 2) | (F.col("inertia") < first)).alias("falls"), (chosen == 1).alias("one_chosen"))


def vec_blocks(spark, sf_dir):
    """Vectors blocked by class label, cut into runs of 32 ids (bounded blocks)."""
    v = fx.vectors(spark, sf_dir)
    key = F.col("label").cast("bigint") * 1_000_000_000_000 + F.floor(F.col("vec_id") / 32).cast("bigint")
    return blocking.collect_blocks(v.select("id", key.alias("label")))


@query("collect_blocks")
def q_collect_blocks(spark, sf_dir):
    return vec_blocks(spark, sf_dir).select("cluster_id", "cluster_size", _json("member_ids"))


@query("bounded_blocks")
def q_bounded_blocks(spark, sf_dir):
    both = fx.doc_blocks(spark, sf_dir).withColumn("kind", F.lit("doc")).unionByName(
        vec_blocks(spark, sf_dir).withColumn("kind", F.lit("vec")))
    return blocks_ops.bounded(blocks_ops.non_singleton(both), 30).select("kind", "cluster_id", "cluster_size")


@query("block_size_hist")
def q_block_size_hist(spark, sf_dir):
    return blocks_ops.size_histogram(fx.doc_blocks(spark, sf_dir).unionByName(vec_blocks(spark, sf_dir)), 5)


def toxic_blocks(spark, sf_dir):
    lab = load(spark, sf_dir, "labels", "doc_id", "toxic").filter(F.col("toxic") == 1)
    return lab.select(F.floor(F.col("doc_id") / 8).cast("bigint").alias("cluster_id")).distinct()


@query("blacklist_blocks")
def q_blacklist_blocks(spark, sf_dir):
    return blocks_ops.without_ids(fx.doc_blocks(spark, sf_dir), toxic_blocks(spark, sf_dir)).select(
        "cluster_id", "cluster_size"
    )


# ------------------------------------------------- requests, tokens, shards

def counted_texts(spark, sf_dir):
    return batching.token_counts(fx.texts(spark, sf_dir), "text")


def counted_with_oversized(spark, sf_dir):
    return batching.token_counts(fx.texts_with_oversized(spark, sf_dir), "text")


@query("embedding_inputs")
def q_embedding_inputs(spark, sf_dir):
    nodes_df = nodes.build_nodes(remapped_kg(spark, sf_dir))
    return nodes_df.select(F.col("id").alias("node_id"), T.embedding_input("id", "extracted_definition").alias("text"))


@query("embedding_requests")
def q_embedding_requests(spark, sf_dir):
    nodes_df = nodes.build_nodes(remapped_kg(spark, sf_dir))
    inputs = nodes_df.select("id", T.embedding_input("id", "extracted_definition").alias("text"))
    return requests.embedding_requests(inputs, "id", "text")


@query("token_counts")
def q_token_counts(spark, sf_dir):
    return counted_texts(spark, sf_dir).select("doc_id", "n_tokens")


@query("token_budget")
def q_token_budget(spark, sf_dir):
    return batching.token_budget(counted_texts(spark, sf_dir))


@query("oversized_inputs")
def q_oversized_inputs(spark, sf_dir):
    return batching.oversized(counted_with_oversized(spark, sf_dir)).select("doc_id", "n_tokens")


@query("token_batches")
def q_token_batches(spark, sf_dir):
    out = batching.batches_and_rejects(counted_with_oversized(spark, sf_dir), "doc_id", "doc_id")
    return out.withColumn("batch_id", F.coalesce("batch_id", F.lit(-1)))


def doc_block_requests(spark, sf_dir):
    blocks = fx.doc_blocks(spark, sf_dir)
    user = requests.block_payload("cluster_id", "member_ids")
    return requests.completion_requests(blocks, "cluster_id", user, options=requests.REASONING)


@query("completion_requests")
def q_completion_requests(spark, sf_dir):
    return doc_block_requests(spark, sf_dir)


@query("request_shards")
def q_request_shards(spark, sf_dir):
    reqs = doc_block_requests(spark, sf_dir).withColumn("cid", F.col("custom_id").cast("bigint"))
    sharded, ledger = batching.request_shards(reqs, [F.col("cid")], 50)
    return ledger


@query("chunk_blocks")
def q_chunk_blocks(spark, sf_dir):
    out = batching.chunk_blocks(fx.doc_blocks(spark, sf_dir), 1)
    return out.select("chunk_id", F.to_json("payload").alias("payload"))


@query("chunk_blocks_several")
def q_chunk_blocks_several(spark, sf_dir):
    """Three blocks a request, in order."""
    out = batching.chunk_blocks(fx.doc_blocks(spark, sf_dir), 3)
    return out.select("chunk_id", F.to_json("payload").alias("payload"))


@query("block_prompts")
def q_block_prompts(spark, sf_dir):
    return requests.block_prompts(edge_stage(spark, sf_dir)["blocks"])


@query("chat_examples")
def q_chat_examples(spark, sf_dir):
    return requests.conversation_examples(fx.chat_turns(spark, sf_dir))


# ---------------------------------------------------------------- responses

def parsed_completions(spark, sf_dir):
    return responses.parse_completion_lines(fx.completion_lines(edge_stage(spark, sf_dir)["resp"]))


@query("ingest_completions")
def q_ingest_completions(spark, sf_dir):
    return responses.completion_entries(parsed_completions(spark, sf_dir))


@query("ingest_completions_dir")
def q_ingest_completions_dir(spark, sf_dir):
    """Response files of a folder, read back as files."""
    from graphmend.streaming import ingest

    path = scratch_path(spark, "completions")
    ingest.write_line_files(fx.completion_lines(edge_stage(spark, sf_dir)["resp"]), path)
    return responses.completion_entries(responses.parse_completion_lines(responses.read_lines(spark, path, "*.txt")))


@query("scan_triples")
def q_scan_triples(spark, sf_dir):
    """Triple CSV files, quotes and line breaks in their fields, written from the triple table and scanned back."""
    path = scratch_path(spark, "triples")
    kg = fx.kg(spark, sf_dir)
    cols = [F.col(c.replace(" ", "_")).alias(c) if c.replace(" ", "_") in kg.columns else F.lit(None).cast("string").alias(c)
            for c in files.TRIPLE_COLUMNS]
    broken = F.when(F.col("row_id") % 13 == 0, F.replace("source_extracted_definition", F.lit(" def "), F.lit(' "def"\n, '))).otherwise(
        F.col("source_extracted_definition"))
    files.write_csv(kg.withColumn("source_extracted_definition", broken).select(*cols), path)
    return files.read_triples_csv(spark, path).select(
        "source", "source_type", "target", "target_type", "source_extracted_definition", "target_extracted_definition")


@query("scan_json_table")
def q_scan_json_table(spark, sf_dir):
    """JSON-lines table written from the triple table and scanned back."""
    path = scratch_path(spark, "json-table")
    fx.kg(spark, sf_dir).select("row_id", "source_type", "interaction", "target_type").write.json(path)
    return files.read_json_table(spark, path, ["row_id", "source_type", "interaction", "target_type"], orient="lines")


@query("scan_json_columns")
def q_scan_json_columns(spark, sf_dir):
    """Column-oriented JSON objects, one for each 5,000 rows, scanned back file by file."""
    path, columns = scratch_path(spark, "json-columns"), ["source_type", "interaction", "target_type"]
    index = F.col("row_id").cast("string")
    whole = F.struct(*[F.map_from_entries(F.collect_list(F.struct(index, F.col(c)))).alias(c) for c in columns])
    fx.kg(spark, sf_dir).groupBy(F.floor(F.col("row_id") / 5000).alias("part")).agg(F.to_json(whole).alias("value")).write.partitionBy(
        "part").text(path)
    return files.read_json_table(spark, path, columns, orient="columns")


@query("scan_outputs")
def q_scan_outputs(spark, sf_dir):
    """Blocks with their member lists through CSV and back."""
    path = scratch_path(spark, "outputs")
    files.write_csv(fx.doc_blocks(spark, sf_dir).select("cluster_id", "cluster_size", "member_ids"), path)
    back = files.read_outputs_csv(spark, path, "cluster_id bigint, cluster_size bigint, member_ids array<string>")
    return back.select("cluster_id", "cluster_size", F.to_json("member_ids").alias("members"))


@query("ingest_report")
def q_ingest_report(spark, sf_dir):
    return responses.ingest_report(parsed_completions(spark, sf_dir))


@query("ingest_embeddings")
def q_ingest_embeddings(spark, sf_dir):
    ok, _ = responses.ingest_embeddings(fx.embedding_lines(spark, sf_dir), dim=64)
    scaled = F.transform("embedding", lambda x, i: (i + 1) * F.round(x.cast("double") * 10000).cast("bigint"))
    return ok.select("id", F.size("embedding").cast("bigint").alias("dims"),
                     F.aggregate(scaled, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("checksum"))


@query("embedding_rejects")
def q_embedding_rejects(spark, sf_dir):
    _, rejects = responses.ingest_embeddings(fx.embedding_lines(spark, sf_dir), dim=64)
    return rejects


def parsed_verdicts(spark, sf_dir):
    return responses.parse_completion_lines(fx.verdict_response_lines(spark, sf_dir))


@query("ingest_verdicts")
def q_ingest_verdicts(spark, sf_dir):
    return responses.verdict_entries(parsed_verdicts(spark, sf_dir))


@query("verdict_summary")
def q_verdict_summary(spark, sf_dir):
    return responses.verdict_summary(responses.verdict_entries(parsed_verdicts(spark, sf_dir)))


@query("ingest_reasoning")
def q_ingest_reasoning(spark, sf_dir):
    parsed = responses.parse_completion_lines(fx.reasoning_response_lines(spark, sf_dir))
    return responses.reasoning_entries(parsed)


@query("pending_requests")
def q_pending_requests(spark, sf_dir):
    st = edge_stage(spark, sf_dir)
    blocks = blocks_ops.non_singleton(st["blocks"])
    reqs = requests.completion_requests(
        blocks, "cluster_id", requests.block_payload("cluster_id", "ids_in_cluster"),
        system_prompt=requests.EDGE_PROMPT, options=requests.REASONING,
    ).withColumn("cid", F.col("custom_id").cast("bigint"))
    sharded, _ = batching.request_shards(reqs, [F.col("cid")], 25_000)
    received = responses.parse_completion_lines(fx.completion_lines(st["resp"])).filter(F.col("status") == "ok")
    return responses.pending_requests(sharded, received)


# ------------------------------------------------------------ training data

def run_frame_a(spark, sf_dir, shuffle_seed=None):
    outs = fx.run_outputs(spark, sf_dir).join(fx.run_a_ids(spark, sf_dir), "cluster_id", "left_semi")
    return training.run_frame(outs, shuffle_seed=shuffle_seed)


def run_frame_b(spark, sf_dir):
    outs = fx.run_outputs(spark, sf_dir).join(fx.run_b_ids(spark, sf_dir), "cluster_id", "left_semi")
    return training.run_frame(outs)


@query("run_frame")
def q_run_frame(spark, sf_dir):
    return run_frame_a(spark, sf_dir)


@query("shuffle_members")
def q_shuffle_members(spark, sf_dir):
    return run_frame_a(spark, sf_dir, shuffle_seed=7).select("cluster_id", "input")


@query("combine_runs")
def q_combine_runs(spark, sf_dir):
    return training.combine_runs(run_frame_a(spark, sf_dir), run_frame_b(spark, sf_dir)).select("cluster_id", "run")


@query("common_blocks")
def q_common_blocks(spark, sf_dir):
    return training.common_ids(run_frame_a(spark, sf_dir), run_frame_b(spark, sf_dir))


def test_ids(spark, sf_dir):
    return fx.run_b_ids(spark, sf_dir).join(fx.run_a_ids(spark, sf_dir), "cluster_id", "left_anti")


@query("split_leakage")
def q_split_leakage(spark, sf_dir):
    """Every 50th block of the training run is planted in the test ids; only those may come out."""
    train = run_frame_a(spark, sf_dir)
    planted = train.filter(F.pmod("cluster_id", F.lit(50)) == 0).select("cluster_id")
    return training.leakage(train, test_ids(spark, sf_dir).select("cluster_id").unionByName(planted))


@query("semi_blocks")
def q_semi_blocks(spark, sf_dir):
    return blocks_ops.only_ids(fx.doc_blocks(spark, sf_dir), fx.run_a_ids(spark, sf_dir)).select("cluster_id", "cluster_size")


@query("anti_blocks")
def q_anti_blocks(spark, sf_dir):
    return blocks_ops.without_ids(fx.doc_blocks(spark, sf_dir), fx.run_a_ids(spark, sf_dir)).select("cluster_id", "cluster_size")


@query("resume_pending")
def q_resume_pending(spark, sf_dir):
    seeds, _ = seed_and_query_vectors(spark, sf_dir)
    mapping = seeds.select("id", F.col("id").alias("parent_node"))
    return types.pending_types(fx.vectors(spark, sf_dir).select("id"), mapping)


@query("attach_inputs")
def q_attach_inputs(spark, sf_dir):
    out = training.attach_inputs(run_frame_a(spark, sf_dir), fx.doc_blocks(spark, sf_dir))
    return out.select("cluster_id", F.to_json("input_members").alias("input_members"))


@query("attach_corrections")
def q_attach_corrections(spark, sf_dir):
    out = training.attach_corrections(run_frame_a(spark, sf_dir), fx.correction_versions(spark, sf_dir))
    return out.select("cluster_id", F.to_json("groups").alias("groups"))


def restored(spark, sf_dir):
    frame = training.attach_inputs(run_frame_a(spark, sf_dir), fx.doc_blocks(spark, sf_dir))
    frame = training.attach_corrections(frame, fx.correction_versions(spark, sf_dir))
    return frame.withColumn("restored", training.restore_missing(F.col("input_members"), F.col("groups")))


@query("restore_missing")
def q_restore_missing(spark, sf_dir):
    r = restored(spark, sf_dir)
    return r.select("cluster_id", training._key_json("cluster_id", F.col("restored")).alias("clusters"))


@query("test_split")
def q_test_split(spark, sf_dir):
    t = training.test_split(fx.doc_blocks(spark, sf_dir), test_ids(spark, sf_dir))
    return t.select("cluster_id", "cluster_size", training._key_json("cluster_id", F.col("member_ids")).alias("input"))


@query("finetune_examples")
def q_finetune_examples(spark, sf_dir):
    r = restored(spark, sf_dir).select(
        "cluster_id",
        training._key_json("cluster_id", F.col("input_members")).alias("user"),
        training._key_json("cluster_id", F.col("restored")).alias("assistant"),
    )
    ex = requests.finetune_examples(r.select("cluster_id", "user", "assistant"), requests.SUBCLUSTER_PROMPT, "user", "assistant")
    return ex


# ------------------------------------------------------- payload functions

@query("strip_markers")
def q_strip_markers(spark, sf_dir):
    kg = fx.kg(spark, sf_dir)
    return kg.select("row_id", "interaction", T.strip_markers("interaction").alias("stripped"))


@query("parse_payload")
def q_parse_payload(spark, sf_dir):
    resp = edge_stage(spark, sf_dir)["resp"]
    m = T.parse_object(F.col("output_string"))
    return resp.select(
        "id",
        m.isNotNull().alias("is_object"),
        F.coalesce(F.size(m).cast("bigint"), F.lit(-1).cast("bigint")).alias("n_keys"),
        T.first_value(m).alias("first_value"),
    )


@query("parse_groups")
def q_parse_groups(spark, sf_dir):
    resp = edge_stage(spark, sf_dir)["resp"]
    g = T.parse_groups(T.first_value(T.parse_object(F.col("output_string"))))
    return resp.select("id", F.to_json(g).alias("groups"))


def response_groups(spark, sf_dir):
    resp = edge_stage(spark, sf_dir)["resp"]
    return resp.select("id", T.parse_groups(T.first_value(T.parse_object(F.col("output_string")))).alias("groups"))


@query("flatten_groups")
def q_flatten_groups(spark, sf_dir):
    g = response_groups(spark, sf_dir)
    return g.select("id", F.to_json(T.leaf_members(T.flatten_members("groups"))).alias("members"))


@query("multi_member_groups")
def q_multi_member_groups(spark, sf_dir):
    return response_groups(spark, sf_dir).select("id", F.to_json(T.multi_member_groups("groups")).alias("groups"))


@query("find_representatives")
def q_find_representatives(spark, sf_dir):
    m = response_groups(spark, sf_dir).select("id", F.posexplode("groups").alias("group_pos", "g"))
    m = m.select("id", F.col("group_pos").cast("bigint").alias("group_pos"), F.posexplode("g").alias("member_pos", "member"))
    marked = T.is_representative("member") & ~T.is_list_member("member")
    return m.filter(marked).select("id", "group_pos", F.col("member_pos").cast("bigint").alias("member_pos"),
                                   T.strip_markers("member").alias("representative"))


@query("parse_signature")
def q_parse_signature(spark, sf_dir):
    p = T.signature_types("signature")
    return edge_stage(spark, sf_dir)["sig"].select("signature", p["source"].alias("source"), p["target"].alias("target"))


@query("edge_signatures_raw")
def q_edge_signatures_raw(spark, sf_dir):
    return edges.edge_signatures(remapped_kg(spark, sf_dir))


@query("safe_extract")
def q_safe_extract(spark, sf_dir):
    frame = run_frame_a(spark, sf_dir)
    return frame.select("cluster_id", F.to_json(T.safe_extract(F.col("output"))).alias("extracted"))


@query("flatten_bracketed")
def q_flatten_bracketed(spark, sf_dir):
    outs = fx.run_outputs(spark, sf_dir)
    g = T.parse_groups(F.col("output"), lenient_flat=False)
    mixed = F.concat(F.flatten(g), F.array(F.to_json(F.get(g, 0))))
    return outs.select("cluster_id", F.to_json(T.flatten_bracketed(mixed)).alias("members"))


# ---------------------------------------------------------------- sampling

@query("sample_blocks")
def q_sample_blocks(spark, sf_dir):
    return sampling.sample_rows(fx.doc_blocks(spark, sf_dir), 100, seed=1).select("cluster_id", "cluster_size")


@query("stratified_sample")
def q_stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(run_frame_a(spark, sf_dir), "one_item", 25, seed=128).select("cluster_id", "one_item")


@query("shuffled_shards")
def q_shuffled_shards(spark, sf_dir):
    return sampling.shuffled_shards(fx.doc_blocks(spark, sf_dir), 50, seed=42).select("cluster_id", "shard_id")


# --------------------------------------------------------------- resolvers

def edge_surface(spark, sf_dir):
    st = edge_stage(spark, sf_dir)
    return st, resolvers.surface_groups(st["members"].withColumnRenamed("signature", "member"), "member", "freq")


@query("surface_groups")
def q_surface_groups(spark, sf_dir):
    _, g = edge_surface(spark, sf_dir)
    return g.select("cluster_id", "key", F.to_json("group").alias("group"))


@query("choose_representative")
def q_choose_representative(spark, sf_dir):
    _, g = edge_surface(spark, sf_dir)
    return g.select("cluster_id", "key", "representative")


@query("abbreviation_groups")
def q_abbreviation_groups(spark, sf_dir):
    """Part names in blocks of 24 with planted initials: fitting ones, unrelated ones and some under another type."""
    groups = resolvers.surface_groups(fx.abbreviated_names(load(spark, sf_dir, "part")))
    return resolvers.merge_abbreviations(groups).select("cluster_id", "key", "representative", F.to_json("group").alias("group"))


@query("wrap_payload")
def q_wrap_payload(spark, sf_dir):
    _, g = edge_surface(spark, sf_dir)
    return resolvers.marked_payload(g)


def locally_resolved(spark, sf_dir):
    st, g = edge_surface(spark, sf_dir)
    validated = edges.validate_outputs(resolvers.marked_payload(g), st["blocks"])
    mapping = edges.merge_mapping(edges.extract_mapping(validated))
    return edges.apply_edge_mapping(st["kg"], mapping)


@query("resolve_edges")
def q_resolve_edges(spark, sf_dir):
    return edges.compression_stats(locally_resolved(spark, sf_dir))


@query("similarity_groups")
def q_similarity_groups(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    blocks, _, _ = blocking.multisect_kmeans(v, max_cluster_size=30, k_split=10)
    members = blocks_ops.explode_blocks(blocks).join(v.select(F.col("id").alias("member"), "embedding"), "member")
    return resolvers.similarity_groups(members, tau=0.5)


@query("similarity_components")
def q_similarity_components(spark, sf_dir):
    """Blocks by label, whatever their size, cut into chunks of 16: most links cross tasks."""
    v = fx.vectors(spark, sf_dir).filter(F.col("label").isNotNull())
    members = v.select(F.col("label").cast("bigint").alias("cluster_id"), F.col("id").alias("member"), "embedding")
    return resolvers.similarity_groups(members, tau=0.5, chunk_rows=16)


@query("entity_mapping")
def q_entity_mapping(spark, sf_dir):
    return resolvers.duplicate_mapping(fx.texts(spark, sf_dir), "doc_id", "text")


@query("collapse_entities")
def q_collapse_entities(spark, sf_dir):
    mapping = resolvers.duplicate_mapping(fx.texts(spark, sf_dir), "doc_id", "text")
    return resolvers.collapse_entities(fx.doc_triples(spark, sf_dir), mapping)


# ------------------------------------------------- embeddings, type choice

@query("hash_embed")
def q_hash_embed(spark, sf_dir):
    e = embed.hash_embed(fx.texts(spark, sf_dir), "doc_id", "text")
    return e.select("id", F.size("embedding").cast("bigint").alias("dims"),
                    F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("nnz"))


@query("resolve_types")
def q_resolve_types(spark, sf_dir):
    return types.resolve_types(ranked_vectors(spark, sf_dir), tau=0.3)


@query("cosine_pairs")
def q_cosine_pairs(spark, sf_dir):
    seeds, rest = seed_and_query_vectors(spark, sf_dir)
    t = types.topk_similar_types(rest, seeds, k=1)
    return t.select("query_id", "ref_id", F.round("cosine", 6).alias("cosine"))


# ---------------------------------------------------------------- streaming

def _streamed(spark, sf_dir, blocks=None):
    """All response files, then the files with redelivered lines in a later run of the stream."""
    from graphmend.streaming import ingest

    base = scratch_path(spark, "stream-ingest")
    src, sink, ckpt = (os.path.join(base, p) for p in ("outputs", "parsed", "checkpoint"))
    resp = edge_stage(spark, sf_dir)["resp"]
    ingest.write_line_files(fx.completion_lines(resp), src)
    ingest.stream_completions(spark, src, sink, ckpt, 2, dedupe_within=ingest.DEDUPE_WITHIN, blocks=blocks)
    ingest.write_line_files(fx.redelivered_lines(resp), src, mode="append")
    return ingest.stream_completions(spark, src, sink, ckpt, dedupe_within=ingest.DEDUPE_WITHIN, blocks=blocks)


@query("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Entries straight from the sink: an id delivered again in a later micro-batch must not be there twice."""
    ok = _streamed(spark, sf_dir).filter(F.col("status") == responses.OK)
    return ok.select("custom_id", F.explode("payload").alias("key", "value"))


@query("stream_validated")
def q_stream_validated(spark, sf_dir):
    return _streamed(spark, sf_dir, edge_stage(spark, sf_dir)["blocks"]).select(*VALIDATION_COLS)


@query("contract_report")
def q_contract_report(spark, sf_dir):
    return edges.contract_report(edge_stage(spark, sf_dir)["validated"])


@query("second_pass_requests")
def q_second_pass_requests(spark, sf_dir):
    r = restored(spark, sf_dir).select("cluster_id", "restored")
    return requests.second_pass_requests(r, "cluster_id", "restored")
