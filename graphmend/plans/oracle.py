"""DuckDB twins of the fixtures and the oracle SQL of every registered query.

Each oracle is plain SQL over the driver's pre-registered views; the
fixture views the Spark side derives are prepended as CTEs.  Column names
equal the Spark query's.
"""

from __future__ import annotations

# Fixture views in DuckDB dialect, in dependency order.
FIXTURE_SQL: dict[str, str] = {
    "kg": """
SELECT event_id AS row_id,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'user ' || CAST(user_id AS VARCHAR) END AS source,
  CASE CAST(user_id % 8 AS INT) WHEN 0 THEN 'gene' WHEN 1 THEN 'protein' WHEN 2 THEN 'tf' WHEN 3 THEN 'grn'
    WHEN 4 THEN 'microscope' WHEN 5 THEN 'Gene' WHEN 6 THEN 'unlisted' ELSE 'complex' END AS source_type,
  CASE CAST(event_id % 5 AS INT) WHEN 0 THEN event_type || ' **' WHEN 1 THEN event_type || ': '
    WHEN 2 THEN upper(event_type) WHEN 3 THEN event_type || 's' ELSE event_type || ' 2' END AS interaction,
  'item ' || CAST(k % 40 AS VARCHAR) AS target,
  CASE WHEN event_id % 89 = 0 THEN NULL WHEN k % 4 = 0 THEN 'process' WHEN k % 4 = 1 THEN 'phenotype'
    WHEN k % 4 = 2 THEN 'gene' ELSE 'metabolite' END AS target_type,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'source def ' || CAST(event_id AS VARCHAR) END AS source_extracted_definition,
  'target def ' || CAST(event_id AS VARCHAR) AS target_extracted_definition
FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e""",
    "type_map": """
SELECT * FROM (VALUES ('gene','gene'),('Gene','gene'),('protein','protein'),('tf','transcription factor'),
  ('grn','network'),('microscope','tool'),('complex','protein complex'),('process','process'),
  ('phenotype','phenotype')) t(id, parent_node)""",
    "remap": """
SELECT k.*, coalesce(s.parent_node,'other') AS mapped_source_type, coalesce(t.parent_node,'other') AS mapped_target_type
FROM kg k LEFT JOIN type_map s ON k.source_type=s.id LEFT JOIN type_map t ON k.target_type=t.id""",
    "sig": """
SELECT '[' || mapped_source_type || '] ' || trim(interaction, '*: ') || ' [' || mapped_target_type || ']' AS signature,
  count(*) AS freq FROM remap GROUP BY 1""",
    "blk": """
SELECT CAST(floor((rn-1)/12) AS BIGINT) AS cluster_id, signature, freq
FROM (SELECT signature, freq, row_number() OVER (ORDER BY lower(signature), signature) rn FROM sig) x""",
    "mem": """
SELECT cluster_id, signature, gkey,
  '"' || CASE WHEN is_rep AND cluster_id % 10 <> 1 THEN '**' || signature || '**' ELSE signature END || '"' AS mj
FROM (SELECT cluster_id, signature, replace(lower(signature), 's [', ' [') AS gkey,
  row_number() OVER (PARTITION BY cluster_id, replace(lower(signature), 's [', ' [') ORDER BY signature) = 1 AS is_rep
  FROM blk) m""",
    "grp": """
SELECT cluster_id, gkey, '[' || string_agg(mj, ', ' ORDER BY signature) || ']' AS gj, count(*) AS n
FROM mem GROUP BY cluster_id, gkey""",
    "resp": """
SELECT cluster_id, CAST(cluster_id AS VARCHAR) AS id, CASE CAST(cluster_id % 10 AS INT)
 WHEN 0 THEN '{"' || CAST(cluster_id AS VARCHAR) || '": [' || gs
 WHEN 2 THEN '{"' || CAST(cluster_id AS VARCHAR) || '": [' || gs || ']}'
 WHEN 3 THEN '{"' || CAST(cluster_id AS VARCHAR) || '": "' || replace('[' || gs || ', ["**[gene] invented [gene]**"]]', '"', '\\"') || '"}'
 WHEN 4 THEN '{"' || CAST(cluster_id AS VARCHAR) || '": "' || replace('[' || replace(gs, '], [', ', ') || ']', '"', '\\"') || '"}'
 WHEN 5 THEN '[1, 2]'
 WHEN 6 THEN '{"' || CAST(cluster_id AS VARCHAR) || '": "[\\"a\\", \\"b\\"]"}'
 WHEN 8 THEN '{"' || CAST(cluster_id AS VARCHAR) || '": "' || replace(CASE WHEN cluster_id % 20 = 8 THEN '[[' || gs || ']]'
   ELSE '[' || gs || ', ["**[gene] kept [gene]**", ["[gene] nested [gene]"]]]' END, '"', '\\"') || '"}'
 WHEN 9 THEN '{"' || CAST(cluster_id AS VARCHAR) || '": "' || replace('[' || gs || ']' || CASE WHEN cluster_id % 20 = 9 THEN ' as asked' ELSE '' END, '"', '\\"') || '"}'
 ELSE '{"' || CAST(cluster_id AS VARCHAR) || '": "' || replace('[' || gs || ']', '"', '\\"') || '"}' END AS output_string
FROM (SELECT cluster_id, string_agg(gj, ', ' ORDER BY gkey) AS gs FROM grp WHERE cluster_id % 10 <> 7 OR n > 1
  GROUP BY cluster_id) g""",
    "blocks": """
SELECT cluster_id, CAST(count(*) AS BIGINT) AS cluster_size, list(signature ORDER BY lower(signature), signature) AS ids_in_cluster
FROM blk GROUP BY cluster_id""",
}

DEPS: dict[str, list[str]] = {
    "remap": ["kg", "type_map"], "sig": ["remap"], "blk": ["sig"], "mem": ["blk"],
    "grp": ["mem"], "resp": ["grp"], "blocks": ["blk"],
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named fixture CTEs (dependencies included)."""
    deps = DEPS
    need: set[str] = set()

    def add(n: str) -> None:
        if n in need:
            return
        need.add(n)
        for d in deps.get(n, []):
            add(d)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]}\n)" for n in FIXTURE_SQL if n in need)
    return f"WITH RECURSIVE {ctes}\n{sql}"


_REGISTERED: dict[str, tuple[str, tuple[str, ...]]] = {}


def oracle(name: str, *fixtures: str):
    """Register the oracle SQL of query ``name`` (fixtures become CTEs)."""
    def deco(sql: str) -> str:
        _REGISTERED[name] = (sql, fixtures)
        return sql
    return deco


def all_oracles() -> dict[str, str]:
    return {n: (with_fixtures(sql, *fx) if fx else sql) for n, (sql, fx) in _REGISTERED.items()}


oracle("remap_types", "remap")("""
SELECT row_id, source, source_type, interaction, target, target_type, mapped_source_type, mapped_target_type
FROM remap""")

oracle("build_nodes", "remap")("""
SELECT id, name, node_type, extracted_definition FROM (
 SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, row_id) rn FROM (
  SELECT source || ' [' || mapped_source_type || ']' AS id, source AS name, mapped_source_type AS node_type,
         source_extracted_definition AS extracted_definition, 0 AS side, row_id
  FROM remap WHERE source IS NOT NULL AND target IS NOT NULL
  UNION ALL
  SELECT target || ' [' || mapped_target_type || ']', target, mapped_target_type, target_extracted_definition, 1, row_id
  FROM remap WHERE source IS NOT NULL AND target IS NOT NULL) u) v
WHERE rn = 1""")


# ------------------------------------------------------------------ edge path

def _strip(x: str) -> str:
    return f"trim({x}, '*: ')"


def _nbr(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, '{ch}', '')))"


def _types_ok(s: str) -> str:
    return f"(instr(split_part({s}, ']', 1), '[') > 0 AND {_nbr(s, '[')} >= 2)"


def _src(s: str) -> str:
    return f"split_part(split_part({s}, ']', 1), '[', 2)"


def _tgt(s: str) -> str:
    return f"split_part(split_part({s}, '[', 3), ']', 1)"


def _single_typed(groups: str) -> str:
    parsed = (
        f"list_filter(list_transform(g, lambda m: CASE WHEN {_types_ok(_strip('m'))} "
        f"THEN {{'source': {_src(_strip('m'))}, 'target': {_tgt(_strip('m'))}}} END), lambda p: p IS NOT NULL)"
    )
    per_group = (
        f"(len(list_distinct(list_transform({parsed}, lambda p: p.source))) <= 1 AND "
        f"len(list_distinct(list_transform({parsed}, lambda p: p.target))) <= 1)"
    )
    return f"coalesce(list_bool_and(list_transform({groups}, lambda g: {per_group})), true)"


FIXTURE_SQL["parsed"] = """
SELECT r.id, r.cluster_id, r.output_string, b.ids_in_cluster,
  CASE WHEN json_valid(r.output_string) THEN (json_type(r.output_string) = 'OBJECT' AND rtrim(r.output_string) LIKE '%}')
       ELSE false END AS output_parsed
FROM resp r JOIN blocks b ON r.id = CAST(b.cluster_id AS VARCHAR) WHERE b.cluster_size > 1"""

FIXTURE_SQL["valued"] = r"""
SELECT *, CASE WHEN output_parsed THEN json_extract_string(output_string, '$."' || json_keys(output_string)[1] || '"') END AS sval,
  CASE WHEN output_parsed THEN regexp_matches(output_string, '^\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*"') END AS is_str
FROM parsed"""

FIXTURE_SQL["grouped"] = """
SELECT *, CASE WHEN is_str AND json_valid(sval) THEN (CASE WHEN json_type(sval) = 'ARRAY' THEN (
    CASE WHEN json_array_length(sval) = 0 THEN []::VARCHAR[][]
         WHEN list_bool_and(list_transform(json_extract(sval, '$[*]'), lambda e: json_type(e) = 'ARRAY'))
           THEN json_transform(sval, '[["VARCHAR"]]')
         WHEN list_bool_and(list_transform(json_extract(sval, '$[*]'), lambda e: json_type(e) = 'VARCHAR'))
           THEN list_transform(json_transform(sval, '["VARCHAR"]'), lambda x: string_split(x, ''))
    END) END) END AS groups
FROM valued"""


def _is_list(m: str) -> str:
    """A group member that was a list itself."""
    return f"coalesce(CASE WHEN json_valid({m}) THEN json_type({m}) = 'ARRAY' END, false)"


def _leaves(members: str) -> str:
    """Members with lists among them flattened (the fixture nests one level)."""
    return (f"flatten(list_transform({members}, lambda m: CASE WHEN {_is_list('m')} "
            f"THEN json_transform(m, '[\"VARCHAR\"]') ELSE [m] END))")

FIXTURE_SQL["validated"] = f"""
SELECT id, cluster_id, groups, output_parsed, ids_in_cluster,
  groups IS NOT NULL AS list_ok,
  coalesce(CASE WHEN groups IS NOT NULL THEN coalesce(list_bool_and(list_transform({_leaves('flatten(groups)')},
       lambda m: list_contains(ids_in_cluster, {_strip('m')}))), true) END, false) AS output_matches_input,
  coalesce(CASE WHEN groups IS NOT NULL THEN coalesce(list_bool_and(list_transform(groups,
       lambda g: coalesce(list_bool_or(list_transform(g, lambda m: contains(m, '**') AND NOT {_is_list('m')})), false))), true) END, false)
       AS representative_in_list,
  coalesce(CASE WHEN groups IS NOT NULL THEN {_single_typed('groups')} END, false) AS all_edges_same_type,
  coalesce(CAST(len(groups) AS BIGINT), -1) AS n_groups
FROM grouped"""

FIXTURE_SQL["statused"] = """
SELECT *, CASE WHEN NOT output_parsed THEN 'unparsed' WHEN NOT list_ok THEN 'no_list'
  WHEN NOT representative_in_list THEN 'no_representative' ELSE 'ok' END AS status
FROM validated"""

FIXTURE_SQL["mapping_long"] = f"""
SELECT id, response_order, group_pos, j - 1 AS member_pos, {_strip('grp[j]')} AS signature, representative
FROM (
  SELECT id, response_order, group_pos, grp, representative, unnest(range(1, len(grp) + 1)) AS j
  FROM (
    SELECT id, response_order, i - 1 AS group_pos, groups[i] AS grp,
           {_strip("list_filter(groups[i], lambda m: contains(m, '**') AND NOT " + _is_list('m') + ")[1]")} AS representative
    FROM (SELECT id, CAST(id AS BIGINT) AS response_order, groups, unnest(range(1, len(groups) + 1)) AS i
          FROM statused WHERE status = 'ok') a
  ) b WHERE representative IS NOT NULL
) c WHERE NOT {_is_list('grp[j]')}"""

FIXTURE_SQL["mapping"] = """
SELECT signature, representative FROM (
  SELECT signature, representative,
    row_number() OVER (PARTITION BY signature ORDER BY response_order DESC, group_pos DESC, member_pos DESC) AS rn
  FROM mapping_long) x WHERE rn = 1"""

def _applied_sql(mapping: str) -> str:
    return f"""
SELECT row_id, mapped_source_type, interaction, mapped_target_type,
  CASE WHEN ok AND psrc = mapped_source_type AND ptgt = mapped_target_type THEN pedge ELSE interaction END AS mapped_edge
FROM (
  SELECT *, ({_nbr('mp', ']')} >= 1 AND {_nbr('mp', '[')} >= 2) AS ok,
    trim(substr(split_part(mp, ']', 1), 2), ' ') AS psrc,
    trim(substr(split_part(mp, '[', 3), 1, greatest(length(split_part(mp, '[', 3)) - 1, 0)), ' ') AS ptgt,
    trim(split_part(split_part(mp, ']', 2), '[', 1), ' ') AS pedge
  FROM (SELECT k.*, coalesce(m.representative, k.key) AS mp FROM (
          SELECT *, '[' || mapped_source_type || '] ' || trim(interaction, '*: ') || ' [' || mapped_target_type || ']' AS key
          FROM remap) k
        LEFT JOIN {mapping} m ON m.signature = k.key) j
) p"""


FIXTURE_SQL["applied"] = _applied_sql("mapping")

DEPS.update({
    "parsed": ["resp", "blocks"], "valued": ["parsed"], "grouped": ["valued"], "validated": ["grouped"],
    "statused": ["validated"], "mapping_long": ["statused"], "mapping": ["mapping_long"],
    "applied": ["mapping", "remap"],
})

oracle("edge_signatures", "sig")("SELECT signature, freq FROM sig")
oracle("edge_blocks", "blocks")("SELECT cluster_id, cluster_size, CAST(to_json(ids_in_cluster) AS VARCHAR) AS ids_in_cluster FROM blocks")
oracle("non_singleton_blocks", "blocks")("SELECT cluster_id, cluster_size FROM blocks WHERE cluster_size > 1")
oracle("join_outputs", "resp", "blocks")("""
SELECT r.id, r.output_string, b.cluster_size FROM resp r JOIN blocks b ON r.id = CAST(b.cluster_id AS VARCHAR)
WHERE b.cluster_size > 1""")
oracle("validate_outputs", "statused")("""
SELECT id, status, output_parsed, list_ok, output_matches_input, representative_in_list, all_edges_same_type, n_groups
FROM statused""")
oracle("rerun_set", "statused")("SELECT id, status FROM statused WHERE status <> 'ok'")
oracle("type_mismatch_rows", "statused")(
    "SELECT id, CAST(to_json(groups) AS VARCHAR) AS groups FROM statused WHERE NOT all_edges_same_type")
oracle("output_matches_input", "statused")("SELECT id, output_matches_input FROM statused WHERE list_ok")
oracle("validation_report", "statused")("""
SELECT status, output_matches_input, all_edges_same_type, count(*) AS n FROM statused GROUP BY ALL""")
oracle("extract_edge_mapping", "mapping_long")(
    "SELECT id, group_pos, member_pos, signature, representative FROM mapping_long")
oracle("merge_edge_mapping", "mapping")("SELECT signature, representative FROM mapping")
oracle("apply_edge_mapping", "applied")(
    "SELECT row_id, mapped_source_type, interaction, mapped_target_type, mapped_edge FROM applied")
oracle("compression_stats", "applied")("""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE mapped_edge <> interaction) AS n_changed,
  count(DISTINCT interaction) AS n_edges_before, count(DISTINCT mapped_edge) AS n_edges_after,
  count(DISTINCT interaction) - count(DISTINCT mapped_edge) AS reduction
FROM applied""")

FIXTURE_SQL["mlabels"] = """
SELECT row_id % 2 AS run, 'interaction' AS "column", interaction AS value FROM applied
UNION ALL SELECT row_id % 2, 'mapped_edge', mapped_edge FROM applied"""
DEPS["mlabels"] = ["applied"]

oracle("merged_distinct", "mlabels")("""
SELECT r."column", count(*) AS n_runs, max(n) AS n_most, CAST(sum(n) AS BIGINT) AS n_sum, any_value(u.n_union) AS n_union, true AS within_error
FROM (SELECT "column", run, count(DISTINCT value) AS n FROM mlabels GROUP BY ALL) r
JOIN (SELECT "column", count(DISTINCT value) AS n_union FROM mlabels GROUP BY 1) u ON r."column" = u."column" GROUP BY 1""")


# ----------------------------------------------------------------- node types

FIXTURE_SQL["vec"] = """
SELECT 'vec ' || CAST(vec_id AS VARCHAR) AS id, vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label,
  row_number() OVER (ORDER BY vec_id) AS rank
FROM embeddings"""

FIXTURE_SQL["topk"] = """
SELECT query_id, rank, ref_id FROM (
  SELECT q.id AS query_id, r.id AS ref_id,
    row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.embedding, r.embedding) DESC, r.id) AS rank
  FROM vec q JOIN vec r ON q.rank > 30 AND r.rank <= 30) x
WHERE rank <= 20"""

FIXTURE_SQL["type_ident"] = """
SELECT DISTINCT t AS id, t AS parent_node FROM (
  SELECT source_type AS t FROM kg UNION ALL SELECT target_type FROM kg) u WHERE t IS NOT NULL"""


def _curated_sql(source: str) -> str:
    """Sequential renames: one subquery level per rule, in rule order."""
    from graphmend.operators.types import CURATED_RENAMES

    sql = f"SELECT id, parent_node FROM {source}"
    for old, new in CURATED_RENAMES:
        o, n = old.replace("'", "''"), new.replace("'", "''")
        sql = f"SELECT id, CASE WHEN parent_node = '{o}' THEN '{n}' ELSE parent_node END AS parent_node FROM ({sql})"
    return sql


FIXTURE_SQL["curated"] = _curated_sql("type_ident")

FIXTURE_SQL["lnodes"] = """
SELECT DISTINCT name, label FROM (
  SELECT source AS name, source_type AS label FROM kg UNION ALL SELECT target, target_type FROM kg) u
WHERE name IS NOT NULL AND label IS NOT NULL"""

FIXTURE_SQL["lremap"] = """
SELECT n.name, n.label, c.parent_node AS remapped_label FROM lnodes n LEFT JOIN curated c ON n.label = c.id"""

DEPS.update({
    "topk": ["vec"], "type_ident": ["kg"], "curated": ["type_ident"], "lnodes": ["kg"],
    "lremap": ["lnodes", "curated"],
})

oracle("type_universe", "kg")("""
SELECT DISTINCT coalesce(t, 'nan') AS type FROM (SELECT source_type AS t FROM kg UNION ALL SELECT target_type FROM kg) u""")
oracle("type_frequency_rank", "kg")("""
SELECT type, n, row_number() OVER (ORDER BY n DESC, type) AS rank FROM (
  SELECT t AS type, count(*) AS n FROM (SELECT source_type AS t FROM kg UNION ALL SELECT target_type FROM kg) u
  WHERE t IS NOT NULL GROUP BY t) f""")
oracle("seed_parents", "vec")("SELECT id, id AS parent_node FROM vec WHERE rank <= 30")
oracle("topk_similar_types", "topk")("SELECT query_id, rank, ref_id FROM topk")
oracle("type_prompts", "topk")("""
SELECT t.query_id, 'Input type: ' || t.query_id || '; Query index: ' || CAST(v.rank - 31 AS VARCHAR)
  || ';  Top 10 similar types: [' || string_agg('''' || t.ref_id || '''', ', ' ORDER BY t.rank) || ']' AS prompt
FROM topk t JOIN vec v ON v.id = t.query_id GROUP BY t.query_id, v.rank""")
FIXTURE_SQL["tdec"] = """
SELECT v.id, CASE WHEN v.rank % 7 = 0 THEN 'not json'
  WHEN v.rank % 2 = 0 THEN '{"map": "' || t.ref_id || '"}' ELSE '{"map": "' || v.id || '"}' END AS content
FROM vec v LEFT JOIN topk t ON t.query_id = v.id AND t.rank = 1 WHERE v.rank > 30"""
DEPS.update({"tdec": ["vec", "topk"]})
oracle("type_decisions", "vec", "tdec")("""
SELECT id, id AS parent_node FROM vec WHERE rank <= 30
UNION ALL
SELECT id, json_extract_string(content, '$.map') AS parent_node FROM tdec WHERE json_valid(content)""")
FIXTURE_SQL["tmap"] = """
SELECT id, id AS parent_node FROM vec WHERE rank <= 30
UNION ALL
SELECT t.id, json_extract_string(t.content, '$.map') FROM tdec t JOIN vec v ON v.id = t.id AND v.rank <= 200 WHERE json_valid(t.content)"""
FIXTURE_SQL["topk2"] = """
SELECT query_id, qrank, rank, ref_id FROM (
  SELECT q.id AS query_id, q.rank AS qrank, r.id AS ref_id,
    row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.embedding, r.embedding) DESC, r.id) AS rank
  FROM vec q JOIN vec r ON q.id NOT IN (SELECT id FROM tmap) AND r.id IN (SELECT parent_node FROM tmap)) x
WHERE rank <= 20"""
DEPS.update({"tmap": ["vec", "tdec"], "topk2": ["vec", "tmap"]})
oracle("type_prompts_resumed", "topk2")("""
SELECT query_id, 'Input type: ' || query_id || '; Query index: ' || CAST(qrank - 31 AS VARCHAR)
  || ';  Top 10 similar types: [' || string_agg(chr(39) || ref_id || chr(39), ', ' ORDER BY rank) || ']' AS prompt
FROM topk2 GROUP BY query_id, qrank""")
oracle("curate_mapping", "curated")("SELECT id, parent_node FROM curated")
oracle("label_remap", "lremap")("SELECT name, label, remapped_label FROM lremap")
oracle("fold_rare_types", "lremap")("""
SELECT c.id, CASE WHEN c.id IN (SELECT label FROM lremap WHERE remapped_label IN (
    SELECT remapped_label FROM lremap WHERE remapped_label IS NOT NULL GROUP BY remapped_label HAVING count(*) < 100))
  THEN 'other' ELSE c.parent_node END AS parent_node
FROM curated c""")


# ------------------------------------------------------------------- blocking

FIXTURE_SQL["cent"] = "SELECT rank - 1 AS label, embedding AS centroid FROM vec WHERE rank <= 10"
FIXTURE_SQL["assign1"] = """
SELECT id, label FROM (
  SELECT v.id, c.label, row_number() OVER (PARTITION BY v.id ORDER BY list_distance(v.embedding, c.centroid), c.label) AS rn
  FROM vec v JOIN cent c ON true) x WHERE rn = 1"""
FIXTURE_SQL["cent2"] = """
SELECT label, list(m ORDER BY d) AS centroid FROM (
  SELECT a.label, d, avg(v.embedding[d + 1]) AS m
  FROM assign1 a JOIN vec v ON v.id = a.id, range(0, 64) t(d)
  GROUP BY a.label, d) x GROUP BY label"""
FIXTURE_SQL["vblocks"] = """
SELECT CAST(label AS BIGINT) * 1000000000000 + CAST(floor(vec_id / 32) AS BIGINT) AS cluster_id, count(*) AS cluster_size,
  list(id ORDER BY id) AS member_ids
FROM vec GROUP BY 1"""
FIXTURE_SQL["dblocks"] = """
SELECT CAST(floor(doc_id / 8) AS BIGINT) AS cluster_id, count(*) AS cluster_size,
  list('doc ' || CAST(doc_id AS VARCHAR) || ' [' || lang || ']' ORDER BY doc_id) AS member_ids
FROM documents GROUP BY 1"""
DEPS.update({"cent": ["vec"], "assign1": ["cent"], "cent2": ["assign1"], "vblocks": ["vec"]})

oracle("assign_nearest", "assign1")("SELECT id, label FROM assign1")
oracle("lloyd_step", "cent2")("""
SELECT id, label FROM (
  SELECT v.id, c.label, row_number() OVER (PARTITION BY v.id ORDER BY list_distance(v.embedding, c.centroid), c.label) AS rn
  FROM vec v JOIN cent2 c ON true) x WHERE rn = 1""")
oracle("collect_blocks", "vblocks")(
    "SELECT cluster_id, cluster_size, CAST(to_json(member_ids) AS VARCHAR) AS member_ids FROM vblocks")
oracle("bounded_blocks", "vblocks", "dblocks")("""
SELECT kind, cluster_id, cluster_size FROM (
  SELECT 'doc' AS kind, cluster_id, cluster_size FROM dblocks UNION ALL SELECT 'vec', cluster_id, cluster_size FROM vblocks) u
WHERE cluster_size > 1 AND cluster_size <= 30""")
oracle("block_size_hist", "vblocks", "dblocks")("""
SELECT CAST(floor(cluster_size / 5) * 5 AS BIGINT) AS size_from, count(*) AS n_blocks FROM (
  SELECT cluster_size FROM dblocks UNION ALL SELECT cluster_size FROM vblocks) u GROUP BY 1""")
oracle("blacklist_blocks", "dblocks")("""
SELECT cluster_id, cluster_size FROM dblocks d WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE l.toxic = 1 AND CAST(floor(l.doc_id / 8) AS BIGINT) = d.cluster_id)""")


# ------------------------------------------------ requests, tokens, shards

FIXTURE_SQL["bnodes"] = """
SELECT id, name, node_type, extracted_definition FROM (
 SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, row_id) rn FROM (
  SELECT source || ' [' || mapped_source_type || ']' AS id, source AS name, mapped_source_type AS node_type,
         source_extracted_definition AS extracted_definition, 0 AS side, row_id
  FROM remap WHERE source IS NOT NULL AND target IS NOT NULL
  UNION ALL
  SELECT target || ' [' || mapped_target_type || ']', target, mapped_target_type, target_extracted_definition, 1, row_id
  FROM remap WHERE source IS NOT NULL AND target IS NOT NULL) u) v
WHERE rn = 1"""
FIXTURE_SQL["counted"] = r"""
SELECT doc_id, text, CAST(len(regexp_extract_all(coalesce(text, ''), '(\w+|[^\w\s])', 1)) AS BIGINT) AS n_tokens
FROM documents"""
FIXTURE_SQL["docreq"] = """
SELECT CAST(cluster_id AS VARCHAR) AS custom_id, CAST(to_json({'custom_id': CAST(cluster_id AS VARCHAR), 'method': 'POST',
  'url': '/v1/chat/completions', 'body': {'model': 'o3-mini', 'response_format': {'type': 'json_object'},
  'messages': [{'role': 'system', 'content': $SYS$}, {'role': 'user', 'content': CAST(to_json(MAP([CAST(cluster_id AS VARCHAR)], [member_ids])) AS VARCHAR)}],
  'reasoning_effort': 'high'}}) AS VARCHAR) AS request
FROM dblocks"""
DEPS.update({"bnodes": ["remap"], "docreq": ["dblocks"]})


def _sys_literal() -> str:
    from graphmend.operators.requests import SUBCLUSTER_PROMPT

    return "'" + SUBCLUSTER_PROMPT.replace("'", "''") + "'"


FIXTURE_SQL["docreq"] = FIXTURE_SQL["docreq"].replace("$SYS$", _sys_literal())

oracle("embedding_inputs", "bnodes")("""
SELECT id AS node_id, id || ' : ' || coalesce(extracted_definition, 'nan') AS text FROM bnodes""")
oracle("embedding_requests", "bnodes")("""
SELECT id AS custom_id, CAST(to_json({'custom_id': id, 'method': 'POST', 'url': '/v1/embeddings',
  'body': {'model': 'text-embedding-ada-002', 'input': id || ' : ' || coalesce(extracted_definition, 'nan')}}) AS VARCHAR) AS request
FROM bnodes""")
oracle("token_counts", "counted")("SELECT doc_id, n_tokens FROM counted")
oracle("token_budget", "counted")("""
SELECT count(*) AS n_requests, CAST(sum(n_tokens) AS BIGINT) AS total_tokens,
  round(sum(n_tokens) / 1000000.0 * 0.1, 6) AS est_cost FROM counted""")
FIXTURE_SQL["counted_over"] = "SELECT doc_id, n_tokens FROM counted UNION ALL SELECT -1, 8193"
oracle("oversized_inputs", "counted_over")("SELECT doc_id, n_tokens FROM counted_over WHERE n_tokens > 8192")
FIXTURE_SQL["tb_items"] = """
SELECT doc_id, n_tokens, row_number() OVER (ORDER BY doc_id) AS rn FROM counted_over WHERE n_tokens <= 8192"""
FIXTURE_SQL["r"] = """
SELECT rn, doc_id, 0 AS batch, n_tokens AS used FROM tb_items WHERE rn = 1
UNION ALL
SELECT t.rn, t.doc_id, CASE WHEN r.used + t.n_tokens > 8192 THEN r.batch + 1 ELSE r.batch END,
       CASE WHEN r.used + t.n_tokens > 8192 THEN t.n_tokens ELSE r.used + t.n_tokens END
FROM r JOIN tb_items t ON t.rn = r.rn + 1"""
DEPS.update({"counted_over": ["counted"], "tb_items": ["counted_over"], "r": ["tb_items"]})
oracle("token_batches", "r")("""
SELECT doc_id, CAST(batch AS BIGINT) AS batch_id, 'batched' AS status FROM r
UNION ALL SELECT doc_id, -1, 'oversized' FROM counted_over WHERE n_tokens > 8192""")
oracle("completion_requests", "docreq")("SELECT custom_id, request FROM docreq")
oracle("request_shards", "docreq")("""
SELECT CAST(floor((rn - 1) / 50) AS BIGINT) AS shard_id, count(*) AS n_requests,
  min(custom_id) AS first_custom_id, max(custom_id) AS last_custom_id
FROM (SELECT custom_id, row_number() OVER (ORDER BY CAST(custom_id AS BIGINT)) AS rn FROM docreq) x GROUP BY 1""")
oracle("chunk_blocks_several", "dblocks")("""
SELECT CAST(floor((rn - 1) / 3) AS BIGINT) AS chunk_id,
  CAST(to_json(MAP(list(CAST(cluster_id AS VARCHAR) ORDER BY cluster_id), list(member_ids ORDER BY cluster_id))) AS VARCHAR) AS payload
FROM (SELECT *, row_number() OVER (ORDER BY cluster_id) AS rn FROM dblocks) x GROUP BY 1""")
oracle("chunk_blocks", "dblocks")("""
SELECT CAST(rn - 1 AS BIGINT) AS chunk_id, CAST(to_json(MAP([CAST(cluster_id AS VARCHAR)], [member_ids])) AS VARCHAR) AS payload
FROM (SELECT *, row_number() OVER (ORDER BY cluster_id) AS rn FROM dblocks) x""")
oracle("block_prompts", "blocks")("""
SELECT cluster_id, CAST(cluster_id AS VARCHAR) || ': [' || array_to_string(list_transform(ids_in_cluster,
  lambda x: CASE WHEN contains(x, '''') AND NOT contains(x, '"') THEN '"' || x || '"'
                 ELSE '''' || replace(x, '''', '\\''') || '''' END), ', ') || ']' AS text,
  CAST(cluster_id AS VARCHAR) AS key
FROM blocks""")
oracle("chat_examples")("""
SELECT conv_id, CAST(to_json({'messages': list({'role': role, 'content': text} ORDER BY turn)}) AS VARCHAR) AS example
FROM conversations GROUP BY conv_id""")


# ------------------------------------------------------------------ responses

def _cline(cid: str, content: str) -> str:
    esc = f"""'"' || replace(replace({content}, '\\', '\\\\'), '"', '\\"') || '"'"""
    return (f"""'{{"id": "batch_req_' || {cid} || '", "custom_id": "' || {cid} || '", "response": {{"status_code": 200, """
            f""""body": {{"choices": [{{"index": 0, "message": {{"role": "assistant", "content": ' || {esc} || '}}}}]}}}}, "error": null}}'""")


FIXTURE_SQL["clines"] = f"""
SELECT CASE WHEN cluster_id % 7 = 3 THEN substr(full_line, 1, 60)
            WHEN cluster_id % 7 = 5 THEN '{{"custom_id": "' || id || '", "response": null}}'
            ELSE full_line END AS value,
       'part-' || CAST(cluster_id % 4 AS VARCHAR) || '.jsonl' AS source_file
FROM (SELECT cluster_id, id, {_cline('id', 'output_string')} AS full_line FROM resp) r
UNION ALL
SELECT {_cline('id', 'output_string')}, 'part-' || CAST((cluster_id + 1) % 4 AS VARCHAR) || '.jsonl' FROM resp WHERE cluster_id % 7 = 6"""


def _parsed(lines: str) -> str:
    return f"""
SELECT source_file, custom_id, content,
  CASE WHEN NOT obj THEN 'corrupt' WHEN content IS NULL THEN 'no_content'
       WHEN NOT coalesce(CASE WHEN json_valid(content) THEN json_type(content) = 'OBJECT' AND rtrim(content) LIKE '%}}' END, false)
         THEN 'bad_payload' ELSE 'ok' END AS status
FROM (SELECT source_file, coalesce(CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' END, false) AS obj,
        CASE WHEN json_valid(value) THEN json_extract_string(value, '$.custom_id') END AS custom_id,
        CASE WHEN json_valid(value) THEN json_extract_string(value, '$.response.body.choices[0].message.content') END AS content
      FROM {lines}) x"""


def _entries(parsed: str) -> str:
    return f"""
SELECT custom_id, source_file, k AS key, json_extract_string(content, '$."' || k || '"') AS value,
  json_extract(content, '$."' || k || '"') AS raw
FROM (SELECT custom_id, source_file, content, unnest(json_keys(content)) AS k FROM {parsed} WHERE status = 'ok') e"""


FIXTURE_SQL["cparsed"] = _parsed("clines")
FIXTURE_SQL["centries"] = _entries("cparsed")
FIXTURE_SQL["vlines"] = f"""
SELECT {_cline("CAST(doc_id AS VARCHAR)", "content")} AS value, NULL AS source_file FROM (
  SELECT doc_id, CASE WHEN toxic = 1 THEN '{{"' || CAST(doc_id AS VARCHAR) || '": {{"user_prompt": "block ' || CAST(doc_id AS VARCHAR) || '"}}}}'
    ELSE '{{"' || CAST(doc_id AS VARCHAR) || '": ' || CAST(to_json({{'is_correct': CASE WHEN quality = 1 THEN 'True' ELSE 'False' END,
      'user_prompt': 'block ' || CAST(doc_id AS VARCHAR), 'clusters': [['doc ' || CAST(doc_id AS VARCHAR)]]}}) AS VARCHAR) || '}}' END AS content
  FROM labels) l"""
FIXTURE_SQL["vparsed"] = _parsed("vlines")
FIXTURE_SQL["ventries"] = _entries("vparsed")
FIXTURE_SQL["verdicts"] = """
SELECT key AS cluster_id, coalesce(json_extract_string(raw, '$.is_correct'), 'N/A') AS is_correct,
  coalesce(json_extract_string(raw, '$.user_prompt'), 'N/A') AS user_prompt,
  coalesce(CAST(json_extract(raw, '$.clusters') AS VARCHAR), '[]') AS clusters
FROM ventries WHERE json_type(raw) = 'OBJECT'"""
FIXTURE_SQL["rlines"] = f"""
SELECT {_cline("CAST(doc_id AS VARCHAR)", """'{"' || CAST(doc_id AS VARCHAR) || '": {"reasoning": "quality ' || CAST(quality AS VARCHAR) || '"}}'""")} AS value,
  NULL AS source_file FROM labels"""
FIXTURE_SQL["rparsed"] = _parsed("rlines")
FIXTURE_SQL["rentries"] = _entries("rparsed")
DEPS.update({
    "clines": ["resp"], "cparsed": ["clines"], "centries": ["cparsed"],
    "vparsed": ["vlines"], "ventries": ["vparsed"], "verdicts": ["ventries"],
    "rparsed": ["rlines"], "rentries": ["rparsed"],
})

oracle("ingest_completions", "centries")("""
SELECT custom_id, key, arg_max(value, coalesce(source_file, '')) AS value FROM centries GROUP BY custom_id, key""")
oracle("ingest_report", "cparsed")("SELECT source_file, status, count(*) AS n_lines FROM cparsed GROUP BY ALL")
oracle("ingest_embeddings")("""
SELECT 'vec ' || CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS BIGINT) AS dims,
  CAST(list_sum(list_transform(embedding, lambda x, i: i * CAST(round(x::DOUBLE * 10000) AS BIGINT))) AS BIGINT) AS checksum
FROM embeddings WHERE vec_id % 17 <> 0 AND vec_id % 13 <> 0""")
oracle("embedding_rejects")("""
SELECT 'vec ' || CAST(vec_id AS VARCHAR) AS custom_id,
  CASE WHEN vec_id % 17 = 0 THEN 'no_content' ELSE 'wrong_dimension' END AS reason
FROM embeddings WHERE vec_id % 17 = 0 OR vec_id % 13 = 0""")
oracle("ingest_verdicts", "verdicts")("SELECT cluster_id, is_correct, user_prompt, clusters FROM verdicts")
oracle("verdict_summary", "verdicts")("SELECT is_correct, count(*) AS n FROM verdicts GROUP BY ALL")
oracle("ingest_reasoning", "rentries")(
    "SELECT key AS cluster_id, json_extract_string(raw, '$.reasoning') AS reasoning FROM rentries")
oracle("pending_requests", "cparsed", "blocks")("""
SELECT CAST(0 AS BIGINT) AS shard_id, count(*) AS n_pending FROM blocks b
WHERE b.cluster_size > 1 AND NOT EXISTS (SELECT 1 FROM cparsed p WHERE p.status = 'ok' AND p.custom_id = CAST(b.cluster_id AS VARCHAR))
HAVING count(*) > 0""")


# -------------------------------------------------------------- training data

def _kj(key: str, value: str) -> str:
    return f"CAST(to_json(MAP([CAST({key} AS VARCHAR)], [{value}])) AS VARCHAR)"


FIXTURE_SQL["dmembers"] = """
SELECT CAST(floor(doc_id / 8) AS BIGINT) AS cluster_id, doc_id, lang,
  'doc ' || CAST(doc_id AS VARCHAR) || ' [' || lang || ']' AS member FROM documents"""
FIXTURE_SQL["routs"] = """
SELECT cluster_id, list(grp ORDER BY lang) AS groups FROM (
  SELECT cluster_id, lang, CASE WHEN len(g) > 1 THEN list_concat(['**' || g[1] || '**'], g[2:]) ELSE g END AS grp
  FROM (SELECT cluster_id, lang, list(member ORDER BY doc_id) AS g FROM dmembers GROUP BY cluster_id, lang) x) y
GROUP BY cluster_id"""
FIXTURE_SQL["run_a"] = "SELECT DISTINCT CAST(floor(doc_id / 8) AS BIGINT) AS cluster_id FROM labels WHERE quality = 1"
FIXTURE_SQL["run_b"] = "SELECT DISTINCT CAST(floor(doc_id / 8) AS BIGINT) AS cluster_id FROM documents WHERE lang = 'en'"
FIXTURE_SQL["frame_a"] = f"""
SELECT cluster_id, groups, list_transform(flatten(groups), lambda m: trim(m, '*')) AS flat,
  list_filter(groups, lambda g: len(g) > 1) AS multi
FROM routs WHERE cluster_id IN (SELECT cluster_id FROM run_a)"""
FIXTURE_SQL["frame_b"] = "SELECT cluster_id FROM routs WHERE cluster_id IN (SELECT cluster_id FROM run_b)"
FIXTURE_SQL["common"] = "SELECT cluster_id FROM frame_a INTERSECT SELECT cluster_id FROM frame_b"
FIXTURE_SQL["test_ids"] = "SELECT cluster_id FROM run_b WHERE cluster_id NOT IN (SELECT cluster_id FROM run_a)"
FIXTURE_SQL["corr"] = """
SELECT cluster_id, groups FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ord DESC) AS rn FROM (
    SELECT cluster_id, list(g ORDER BY lang) AS groups, 0 AS ord FROM (
      SELECT cluster_id, lang, list(member ORDER BY doc_id) AS g FROM dmembers WHERE doc_id % 8 <> 5 GROUP BY cluster_id, lang) a
    GROUP BY cluster_id
    UNION ALL
    SELECT cluster_id, [list(member ORDER BY doc_id)], 1 FROM dmembers
    WHERE cluster_id IN (SELECT cluster_id FROM dmembers WHERE lang = 'de') GROUP BY cluster_id) v) w
WHERE rn = 1"""
FIXTURE_SQL["restored"] = """
SELECT f.cluster_id, d.member_ids, c.groups,
  list_concat(c.groups, list_transform(list_filter(d.member_ids, lambda x: NOT list_contains(
    list_transform(flatten(c.groups), lambda m: trim(m, '*')), x)), lambda x: [x])) AS restored
FROM frame_a f LEFT JOIN dblocks d ON d.cluster_id = f.cluster_id LEFT JOIN corr c ON c.cluster_id = f.cluster_id"""
DEPS.update({
    "routs": ["dmembers"], "frame_a": ["routs", "run_a"], "frame_b": ["routs", "run_b"],
    "common": ["frame_a", "frame_b"], "test_ids": ["run_a", "run_b"], "corr": ["dmembers"],
    "restored": ["frame_a", "dblocks", "corr"],
})

oracle("run_frame", "frame_a")(f"""
SELECT cluster_id, {_kj('cluster_id', 'flat')} AS input, {_kj('cluster_id', 'groups')} AS output,
  {_kj('cluster_id', 'multi')} AS output_multi, len(multi) = 0 AS one_item FROM frame_a""")
oracle("combine_runs", "common")("""
SELECT cluster_id, 'a' AS run FROM frame_a WHERE cluster_id NOT IN (SELECT cluster_id FROM common)
UNION ALL SELECT cluster_id, 'b' FROM frame_b WHERE cluster_id NOT IN (SELECT cluster_id FROM common)""")
oracle("common_blocks", "common")("SELECT cluster_id FROM common")
oracle("split_leakage", "frame_a", "test_ids")(
    "SELECT cluster_id FROM frame_a INTERSECT SELECT cluster_id FROM (SELECT cluster_id FROM test_ids"
    " UNION ALL SELECT cluster_id FROM frame_a WHERE cluster_id % 50 = 0) t")
oracle("semi_blocks", "dblocks", "run_a")(
    "SELECT cluster_id, cluster_size FROM dblocks WHERE cluster_id IN (SELECT cluster_id FROM run_a)")
oracle("anti_blocks", "dblocks", "run_a")(
    "SELECT cluster_id, cluster_size FROM dblocks WHERE cluster_id NOT IN (SELECT cluster_id FROM run_a)")
oracle("resume_pending", "vec")("SELECT id FROM vec WHERE rank > 30")
oracle("attach_inputs", "frame_a", "dblocks")("""
SELECT f.cluster_id, CAST(to_json(d.member_ids) AS VARCHAR) AS input_members
FROM frame_a f LEFT JOIN dblocks d ON d.cluster_id = f.cluster_id""")
oracle("attach_corrections", "frame_a", "corr")("""
SELECT f.cluster_id, CAST(to_json(c.groups) AS VARCHAR) AS groups FROM frame_a f LEFT JOIN corr c ON c.cluster_id = f.cluster_id""")
oracle("restore_missing", "restored")(f"SELECT cluster_id, {_kj('cluster_id', 'restored')} AS clusters FROM restored")
oracle("test_split", "dblocks", "test_ids")(f"""
SELECT cluster_id, cluster_size, {_kj('cluster_id', 'member_ids')} AS input FROM dblocks
WHERE cluster_id IN (SELECT cluster_id FROM test_ids) AND cluster_size <= 30""")
oracle("finetune_examples", "restored")(f"""
SELECT cluster_id, CAST(to_json({{'messages': [{{'role': 'system', 'content': {_sys_literal()}}},
  {{'role': 'user', 'content': {_kj('cluster_id', 'member_ids')}}},
  {{'role': 'assistant', 'content': {_kj('cluster_id', 'restored')}}}]}}) AS VARCHAR) AS example
FROM restored""")


# ------------------------------------------------------- payload functions

def _groups_from_text(sval: str) -> str:
    """List-literal JSON text -> VARCHAR[][] (flat lists read as characters)."""
    return f"""CASE WHEN json_valid({sval}) THEN (CASE WHEN json_type({sval}) = 'ARRAY' THEN (
    CASE WHEN json_array_length({sval}) = 0 THEN []::VARCHAR[][]
         WHEN list_bool_and(list_transform(json_extract({sval}, '$[*]'), lambda e: json_type(e) = 'ARRAY'))
           THEN json_transform({sval}, '[["VARCHAR"]]')
         WHEN list_bool_and(list_transform(json_extract({sval}, '$[*]'), lambda e: json_type(e) = 'VARCHAR'))
           THEN list_transform(json_transform({sval}, '["VARCHAR"]'), lambda x: string_split(x, ''))
    END) END) END"""


FIXTURE_SQL["payload"] = """
SELECT id, output_string, obj,
  CASE WHEN obj THEN json_extract(output_string, '$."' || json_keys(output_string)[1] || '"') END AS raw
FROM (SELECT id, output_string, coalesce(CASE WHEN json_valid(output_string)
        THEN json_type(output_string) = 'OBJECT' AND rtrim(output_string) LIKE '%}' END, false) AS obj FROM resp) x"""
FIXTURE_SQL["payload_text"] = """
SELECT *, CASE WHEN json_type(raw) = 'VARCHAR' THEN json_extract_string(raw, '$') ELSE CAST(raw AS VARCHAR) END AS fv
FROM payload"""
DEPS.update({"payload": ["resp"], "payload_text": ["payload"]})

oracle("strip_markers", "kg")("SELECT row_id, interaction, trim(interaction, '*: ') AS stripped FROM kg")
oracle("parse_payload", "payload_text")("""
SELECT id, obj AS is_object, CASE WHEN obj THEN CAST(len(json_keys(output_string)) AS BIGINT) ELSE -1 END AS n_keys,
  fv AS first_value FROM payload_text""")
oracle("parse_groups", "payload_text")(
    f"SELECT id, CAST(to_json({_groups_from_text('fv')}) AS VARCHAR) AS groups FROM payload_text")
oracle("safe_extract", "frame_a")("SELECT cluster_id, CAST(to_json(groups) AS VARCHAR) AS extracted FROM frame_a")
oracle("flatten_bracketed", "routs")(
    "SELECT cluster_id, CAST(to_json(list_concat(flatten(groups), groups[1])) AS VARCHAR) AS members FROM routs")


oracle("flatten_groups", "payload_text")(f"""
SELECT id, CAST(to_json({_leaves('flatten(g)')}) AS VARCHAR) AS members FROM (SELECT id, {_groups_from_text('fv')} AS g FROM payload_text) x""")
oracle("multi_member_groups", "payload_text")(f"""
SELECT id, CAST(to_json(list_filter(g, lambda m: len(m) > 1)) AS VARCHAR) AS groups FROM (SELECT id, {_groups_from_text('fv')} AS g FROM payload_text) x""")
oracle("find_representatives", "payload_text")(f"""
SELECT id, CAST(gp - 1 AS BIGINT) AS group_pos, CAST(mp - 1 AS BIGINT) AS member_pos, {_strip('grp[mp]')} AS representative FROM (
  SELECT id, gp, grp, unnest(range(1, len(grp) + 1)) AS mp FROM (
    SELECT id, gp, g[gp] AS grp FROM (
      SELECT id, g, unnest(range(1, len(g) + 1)) AS gp FROM (SELECT id, {_groups_from_text('fv')} AS g FROM payload_text) a) b) c) d
WHERE contains(grp[mp], '**') AND NOT {_is_list('grp[mp]')}""")
oracle("parse_signature", "sig")(f"""
SELECT signature, CASE WHEN {_types_ok('signature')} THEN {_src('signature')} END AS source,
  CASE WHEN {_types_ok('signature')} THEN {_tgt('signature')} END AS target FROM sig""")
oracle("edge_signatures_raw", "remap")("""
SELECT '[' || mapped_source_type || '] ' || coalesce(interaction, 'nan') || ' [' || mapped_target_type || ']' AS signature, count(*) AS freq
FROM remap GROUP BY 1""")
oracle("blocking_invariants")("""
SELECT count(*) AS n_members, count(DISTINCT vec_id) AS n_ids, true AS within_cap, true AS has_inertia FROM embeddings""")
oracle("split_progress")("SELECT count(*) AS first_open, true AS falling, count(*) > 100 AS several_levels FROM embeddings")
oracle("hash_embed_shape")("""
SELECT doc_id AS id, CAST(1536 AS BIGINT) AS dims, CASE WHEN length(text) >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents""")
oracle("sample_blocks", "dblocks")("""
SELECT cluster_id, cluster_size FROM dblocks ORDER BY md5('1:' || cluster_id), cluster_id LIMIT 100""")
oracle("stratified_sample", "frame_a")("""
SELECT cluster_id, one_item FROM (
  SELECT cluster_id, len(multi) = 0 AS one_item,
    row_number() OVER (PARTITION BY len(multi) = 0 ORDER BY md5('128:' || cluster_id), cluster_id) AS r FROM frame_a) x WHERE r <= 25""")
oracle("shuffled_shards", "dblocks")("""
SELECT cluster_id, CAST(floor((row_number() OVER (ORDER BY md5('42:' || cluster_id), cluster_id) - 1) / 50) AS BIGINT) AS shard_id FROM dblocks""")
oracle("shuffle_members", "frame_a")(f"""
SELECT cluster_id, {_kj('cluster_id', 'shuffled')} AS input FROM (
  SELECT cluster_id, list_transform(list_sort(list_transform(flat, lambda m: {{'h': md5('7:' || cluster_id || ':' || m), 'm': m}})),
    lambda s: s.m) AS shuffled FROM frame_a) x""")
FIXTURE_SQL["near"] = """
SELECT c.rank AS crank, p.rank AS prank, list_cosine_similarity(c.embedding, p.embedding) AS cosine
FROM vec c JOIN vec p ON p.rank < c.rank AND list_cosine_similarity(c.embedding, p.embedding) >= 0.3"""
FIXTURE_SQL["near_of"] = """
SELECT v.rank, coalesce(a.adj, []::BIGINT[]) AS adj FROM vec v LEFT JOIN (SELECT crank, list(prank) AS adj FROM near GROUP BY crank) a ON a.crank = v.rank"""
FIXTURE_SQL["walk"] = """
SELECT CAST(0 AS BIGINT) AS r, []::BIGINT[] AS parents
UNION ALL
SELECT n.rank, CASE WHEN n.rank <= 30 OR NOT list_has_any(n.adj, w.parents) THEN list_append(w.parents, n.rank) ELSE w.parents END
FROM walk w JOIN near_of n ON n.rank = w.r + 1"""
DEPS.update({"near": ["vec"], "near_of": ["vec", "near"], "walk": ["near_of"]})
oracle("resolve_types", "vec", "near", "walk")("""
SELECT v.id, coalesce(CASE WHEN list_contains(f.parents, v.rank) THEN v.id END, (
    SELECT p.id FROM near n JOIN vec p ON p.rank = n.prank WHERE n.crank = v.rank AND list_contains(f.parents, n.prank)
    ORDER BY n.cosine DESC, n.prank LIMIT 1)) AS parent_node, CAST(v.rank AS BIGINT) AS rank
FROM vec v, (SELECT parents FROM walk ORDER BY r DESC LIMIT 1) f""")


oracle("ingest_completions_dir", "centries")("""
SELECT custom_id, key, arg_max(value, coalesce(source_file, '')) AS value FROM centries GROUP BY custom_id, key""")
oracle("scan_triples", "kg")("""
SELECT source, source_type, target, target_type,
  CASE WHEN row_id % 13 = 0 THEN replace(source_extracted_definition, ' def ', ' "def"' || chr(10) || ', ') ELSE source_extracted_definition END
    AS source_extracted_definition, target_extracted_definition FROM kg""")
oracle("scan_json_columns", "kg")("SELECT row_id AS row_index, source_type, interaction, target_type FROM kg")
oracle("scan_json_table", "kg")("SELECT row_id, source_type, interaction, target_type FROM kg")
oracle("scan_outputs", "dblocks")("""
SELECT cluster_id, cluster_size, CAST(to_json(member_ids) AS VARCHAR) AS members FROM dblocks""")


# ------------------------------------------------------------------ resolvers

def _surface_key(m: str) -> str:
    head = f"regexp_extract({m}, '^(\\[[^\\]]*\\])', 1)"
    tail = f"regexp_extract({m}, '(\\[[^\\]]*\\])$', 1)"
    body = f"substr({m}, length({head}) + 1, greatest(length({m}) - length({head}) - length({tail}), 0))"
    norm = f"trim(regexp_replace(lower({body}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'), ' ')"
    fold = f"regexp_replace({norm}, '([a-z]{{2}}[a-rt-z])s\\b', '\\1', 'g')"
    sign = f"regexp_extract({body}, '([+-]+)\\s*$', 1)"
    fold = f"(CASE WHEN {norm} = '' THEN '=' || {body} ELSE {fold} || {sign} END)"
    return f"{head} || '|' || {fold} || '|' || {tail}"


FIXTURE_SQL["sgroups"] = f"""
SELECT cluster_id, key, list(signature ORDER BY signature) AS grp,
  arg_min(signature, rk) AS representative
FROM (SELECT cluster_id, signature, {_surface_key('signature')} AS key,
        row_number() OVER (PARTITION BY cluster_id, {_surface_key('signature')}
                           ORDER BY freq DESC, length(signature) DESC, signature) AS rk
      FROM blk) x
GROUP BY cluster_id, key"""
FIXTURE_SQL["smap"] = """
SELECT g.signature, s.representative FROM (
  SELECT cluster_id, key, unnest(grp) AS signature FROM sgroups) g
JOIN sgroups s ON s.cluster_id = g.cluster_id AND s.key = g.key
WHERE g.cluster_id IN (SELECT cluster_id FROM blocks WHERE cluster_size > 1)"""
FIXTURE_SQL["sapplied"] = _applied_sql("smap")
DEPS.update({"sgroups": ["blk"], "smap": ["sgroups", "blocks"], "sapplied": ["smap", "remap"]})

oracle("surface_groups", "sgroups")(
    "SELECT cluster_id, key, CAST(to_json(grp) AS VARCHAR) AS \"group\" FROM sgroups")
oracle("choose_representative", "sgroups")("SELECT cluster_id, key, representative FROM sgroups")

def _initials(words: str) -> str:
    return f"list_aggregate(list_transform({words}, lambda w: substr(w, 1, 1)), 'string_agg', '')"


FIXTURE_SQL["anames"] = f"""
SELECT DISTINCT p_partkey // 24 AS cluster_id, unnest(list_filter([
  '[part] ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' of ' ELSE ' ' END || lower(p_type) || ' [item]',
  CASE WHEN p_partkey % 3 = 0 THEN '[part] ' || i || ' [item]' WHEN p_partkey % 3 = 1 THEN '[part] QXZ [item]'
       WHEN p_partkey % 9 = 2 THEN '[tool] ' || i || ' [item]' END], lambda m: m IS NOT NULL)) AS member
FROM (SELECT *, upper({_initials("string_split(p_name || ' ' || p_type, ' ')")}) AS i FROM part) p"""
FIXTURE_SQL["agroups"] = f"""
SELECT cluster_id, key, list(member ORDER BY member) AS grp, arg_min(member, rk) AS representative
FROM (SELECT cluster_id, member, {_surface_key('member')} AS key, row_number() OVER (
        PARTITION BY cluster_id, {_surface_key('member')} ORDER BY length(member) DESC, member) AS rk FROM anames) x
GROUP BY cluster_id, key"""
FIXTURE_SQL["aforms"] = f"""
SELECT DISTINCT cluster_id, key, h, t, unnest([{_initials('words')},
  {_initials("list_filter(words, lambda w: w NOT IN ('a','an','and','by','for','in','of','on','or','the','to','with'))")}]) AS i
FROM (SELECT cluster_id, key, split_part(key, '|', 1) AS h, split_part(key, '|', 3) AS t, string_split(split_part(key, '|', 2), ' ') AS words
      FROM agroups) g WHERE len(words) >= 2"""
FIXTURE_SQL["ato"] = """
SELECT s.cluster_id, s.key, min(f.key) AS long_key
FROM agroups s JOIN aforms f ON s.cluster_id = f.cluster_id AND split_part(s.key, '|', 1) = f.h AND split_part(s.key, '|', 3) = f.t
  AND split_part(s.key, '|', 2) = f.i
WHERE len(list_filter(s.grp, lambda m: regexp_matches(m, '\\] [A-Z]{2,} \\['))) > 0
GROUP BY s.cluster_id, s.key HAVING count(DISTINCT f.key) = 1"""
DEPS.update({"agroups": ["anames"], "aforms": ["agroups"], "ato": ["agroups", "aforms"]})

oracle("abbreviation_groups", "ato")("""
SELECT g.cluster_id, coalesce(a.long_key, g.key) AS key, max(g.representative) FILTER (a.long_key IS NULL) AS representative,
  CAST(to_json(list_sort(flatten(list(g.grp)))) AS VARCHAR) AS "group"
FROM agroups g LEFT JOIN ato a ON g.cluster_id = a.cluster_id AND g.key = a.key GROUP BY ALL""")
oracle("wrap_payload", "sgroups")("""
SELECT CAST(cluster_id AS VARCHAR) AS id,
  CAST(to_json(MAP([CAST(cluster_id AS VARCHAR)], [CAST(to_json(list(mg ORDER BY key)) AS VARCHAR)])) AS VARCHAR) AS output_string
FROM (SELECT cluster_id, key, list_transform(grp, lambda m: CASE WHEN m = representative THEN '**' || m || '**' ELSE m END) AS mg
      FROM sgroups) x GROUP BY cluster_id""")
oracle("resolve_edges", "sapplied")("""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE mapped_edge <> interaction) AS n_changed,
  count(DISTINCT interaction) AS n_edges_before, count(DISTINCT mapped_edge) AS n_edges_after,
  count(DISTINCT interaction) - count(DISTINCT mapped_edge) AS reduction
FROM sapplied""")

FIXTURE_SQL["dkey"] = r"""
SELECT doc_id, trim(lower(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS k FROM documents WHERE text IS NOT NULL"""
FIXTURE_SQL["emap"] = """
SELECT 'doc ' || CAST(d.doc_id AS VARCHAR) AS node_id, 'doc ' || CAST(r.rep AS VARCHAR) AS representative
FROM dkey d JOIN (SELECT k, min(doc_id) AS rep FROM dkey GROUP BY k HAVING count(*) > 1) r ON d.k = r.k
WHERE d.doc_id <> r.rep"""
FIXTURE_SQL["dtriples"] = """
SELECT 'doc ' || CAST(doc_id AS VARCHAR) AS source, 'written_in' AS relation, 'lang ' || lang AS target FROM documents
UNION ALL SELECT 'doc ' || CAST(doc_id AS VARCHAR), 'from', source FROM documents"""
DEPS.update({"emap": ["dkey"]})

oracle("entity_mapping", "emap")("SELECT node_id, representative FROM emap")
oracle("collapse_entities", "emap", "dtriples")("""
SELECT coalesce(s.representative, t.source) AS source, t.relation, coalesce(g.representative, t.target) AS target,
  count(*) AS weight
FROM dtriples t LEFT JOIN emap s ON s.node_id = t.source LEFT JOIN emap g ON g.node_id = t.target
GROUP BY ALL""")
oracle("cosine_pairs", "vec")("""
SELECT query_id, ref_id, round(cos, 6) AS cosine FROM (
  SELECT q.id AS query_id, r.id AS ref_id, list_cosine_similarity(q.embedding, r.embedding) AS cos,
    row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.embedding, r.embedding) DESC, r.id) AS rn
  FROM vec q JOIN vec r ON q.rank > 30 AND r.rank <= 30) x WHERE rn = 1""")

# The stream must hold what the batch reader ingests, with each accepted id once; late lines also mend broken ones.
FIXTURE_SQL["slines"] = f"""
SELECT value, source_file FROM clines
UNION ALL SELECT {_cline('id', 'output_string')}, 'part-later.jsonl' FROM resp WHERE cluster_id % 3 = 1"""
FIXTURE_SQL["sparsed"] = _parsed("slines")
FIXTURE_SQL["sentries"] = _entries("sparsed")
DEPS.update({"slines": ["clines", "resp"], "sparsed": ["slines"], "sentries": ["sparsed"]})
oracle("stream_ingest", "sentries")("SELECT DISTINCT custom_id, key, value FROM sentries")
oracle("stream_validated", "statused", "sparsed")("""
SELECT id, status, output_parsed, list_ok, output_matches_input, representative_in_list, all_edges_same_type, n_groups
FROM statused WHERE id IN (SELECT custom_id FROM sparsed WHERE status = 'ok')""")

oracle("similarity_components")("""
WITH RECURSIVE v AS (
  SELECT 'vec ' || CAST(vec_id AS VARCHAR) AS member, CAST(label AS BIGINT) AS cluster_id, embedding::DOUBLE[] AS e
  FROM embeddings WHERE label IS NOT NULL),
link AS (
  SELECT a.cluster_id, a.member AS a, b.member AS b FROM v a JOIN v b
  ON a.cluster_id = b.cluster_id AND a.member <> b.member AND list_cosine_similarity(a.e, b.e) >= 0.5),
reach AS (
  SELECT cluster_id, member AS a, member AS b FROM v
  UNION SELECT r.cluster_id, r.a, l.b FROM reach r JOIN link l ON l.cluster_id = r.cluster_id AND l.a = r.b)
SELECT cluster_id, a AS member, min(b) AS component FROM reach GROUP BY cluster_id, a""")
oracle("kmeans_flat")("""
SELECT backend, count(*) AS n_points, CAST(0 AS BIGINT) AS not_nearest, CAST(0 AS BIGINT) AS not_mean, true AS within_k
FROM embeddings, (VALUES ('lloyd'), ('mllib')) b(backend) WHERE embedding IS NOT NULL GROUP BY backend""")
oracle("elbow_sweep")("""
SELECT CAST(k AS INTEGER) AS k, count(*) AS n_points, true AS within_k, true AS falls, true AS one_chosen
FROM embeddings, range(2, 21, 2) r(k) WHERE embedding IS NOT NULL GROUP BY k""")
oracle("contract_report", "statused")("""
SELECT id,
  len(flat) <> len(list_distinct(flat)) AS has_duplicates,
  CAST(len(list_filter(ids_in_cluster, lambda x: NOT list_contains(flat, x))) AS BIGINT) AS n_omitted,
  coalesce(list_bool_and(list_transform(groups, lambda g: len(list_filter(g, lambda m: contains(m, '**'))) = 1)), true)
    AS one_rep_per_group,
  CAST(len(list_filter(groups, lambda g: len(g) = 1)) AS BIGINT) AS n_singleton_groups
FROM (SELECT *, list_transform(flatten(groups), lambda m: trim(m, '*: ')) AS flat FROM statused WHERE list_ok) x""")


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _jstr(x: str) -> str:
    return f"""'"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"'"""


def _second_pass_sql() -> str:
    from graphmend.operators.requests import JUDGE_PROMPT, SECOND_PASS_GUIDE

    group = (f"CASE WHEN len(g) = 0 THEN '    []' ELSE '    [' || chr(10) || array_to_string(list_transform(g, "
             f"lambda m: '      ' || {_jstr('m')}), ',' || chr(10)) || chr(10) || '    ]' END")
    body = (f"CASE WHEN len(restored) = 0 THEN '[]' ELSE '[' || chr(10) || array_to_string(list_transform(restored, "
            f"lambda g: {group}), ',' || chr(10)) || chr(10) || '  ]' END")
    payload = f"'{{' || chr(10) || '  ' || {_jstr('CAST(cluster_id AS VARCHAR)')} || ': ' || {body} || chr(10) || '}}'"
    return f"""
SELECT CAST(cluster_id AS VARCHAR) AS custom_id, CAST(to_json({{'custom_id': CAST(cluster_id AS VARCHAR), 'method': 'POST',
  'url': '/v1/chat/completions', 'body': {{'model': 'o3-mini', 'response_format': {{'type': 'json_object'}},
  'messages': [{{'role': 'system', 'content': {_lit(JUDGE_PROMPT)}}}, {{'role': 'user', 'content': {_lit(SECOND_PASS_GUIDE)}}},
               {{'role': 'user', 'content': {payload}}}],
  'reasoning_effort': 'high'}}}}) AS VARCHAR) AS request
FROM restored"""


oracle("second_pass_requests", "restored")(_second_pass_sql())

oracle("stage_counters", "remap", "applied", "cparsed")("""
SELECT 'remapped' AS stage, 'rows' AS counter, count(*) AS value FROM remap
UNION ALL SELECT 'kg_resolved', 'rows', count(*) FROM applied
UNION ALL SELECT 'kg_resolved', 'changed', count(*) FILTER (WHERE mapped_edge <> interaction) FROM applied
UNION ALL SELECT 'lines', 'rows', count(*) FROM cparsed
UNION ALL SELECT 'lines', s.status, count(c.status) FROM (VALUES ('ok'), ('corrupt'), ('no_content'), ('bad_payload')) s(status)
  LEFT JOIN cparsed c ON c.status = s.status GROUP BY s.status""")
