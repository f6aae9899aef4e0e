"""Edge (relationship) resolution: signatures, response validation, mapping, apply.

The resolver returns, per block, an object ``{"<cluster_id>": "<list of
groups>"}`` whose groups mark one representative as ``**member**``.  These
operators check those responses, turn accepted groups into a
signature -> representative mapping and rewrite the triple table with it.
All work is column expressions over whole tables; the only shuffles are the
block join, the mapping merge and the (size-checked) mapping lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmend.functions import text as T
from graphmend.operators.joins import lookup_join

# First value of the object is a JSON string (not a list / number / object).
_FIRST_VALUE_IS_STRING = r'^\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*"'

STATUS_OK = "ok"
STATUS_UNPARSED = "unparsed"  # payload is not a JSON object
STATUS_NO_LIST = "no_list"  # first value does not read as a list of groups
STATUS_NO_REP = "no_representative"  # some group has no marked member


def edge_signatures(remapped: DataFrame, strip: bool = False, null_text: str = T.NULL_TEXT) -> DataFrame:
    """Distinct directional signatures ``[src] edge [tgt]`` with their frequency.

    ``strip`` trims markers and blanks off the edge text first, so decorated
    spellings of one edge count together.
    """
    sig = T.edge_signature("mapped_source_type", "interaction", "mapped_target_type", null_text, strip)
    return remapped.groupBy(sig.alias("signature")).agg(F.count("*").alias("freq"))


def parse_response_groups(output_string, strict_string: bool = True):
    """(payload map, groups) of a response text.

    With ``strict_string`` the first value must be a JSON *string* holding a
    list literal; a native JSON array is refused (sent to rerun).
    """
    t = F.col(output_string) if isinstance(output_string, str) else output_string
    payload = T.parse_object(t)
    value = T.first_value(payload)
    groups = T.parse_groups(value)
    if strict_string:
        groups = F.when(t.rlike(_FIRST_VALUE_IS_STRING), groups)
    return payload, groups


def validate_outputs(
    outputs: DataFrame,
    blocks: DataFrame,
    strict_string: bool = True,
    members_col: str = "ids_in_cluster",
) -> DataFrame:
    """Join responses to their (non-singleton) blocks and flag every check.

    Adds ``output_parsed`` (object), ``list_ok`` (groups read),
    ``output_matches_input`` (members all come from the block; report only),
    ``representative_in_list`` (every group marked), ``all_edges_same_type``
    (one source and one target type per group; report only), ``n_groups``,
    ``groups`` (flags are false and ``n_groups`` is -1 where the check could
    not run) and a single ``status`` that gates: ok / unparsed / no_list /
    no_representative.
    """
    blk = blocks.filter(F.col("cluster_size") > 1).select(
        F.col("cluster_id").cast("string").alias("id"), F.col(members_col).alias("ids_in_cluster")
    )
    merged = outputs.join(blk, "id", "inner")
    payload, groups = parse_response_groups(F.col("output_string"), strict_string)
    parsed = payload.isNotNull()
    out = merged.withColumn("output_parsed", parsed).withColumn("groups", F.when(parsed, groups))
    g = F.col("groups")
    has_list = g.isNotNull()
    # Flags are false where a check could not run (status says why).
    def flag(c):
        return F.coalesce(F.when(has_list, c), F.lit(False))

    out = (
        out.withColumn("list_ok", has_list)
        .withColumn("output_matches_input", flag(T.members_within(g, "ids_in_cluster")))
        .withColumn("representative_in_list", flag(T.groups_have_representative(g)))
        .withColumn("all_edges_same_type", flag(T.groups_single_typed(g)))
        .withColumn("n_groups", F.coalesce(F.size(g).cast("bigint"), F.lit(-1).cast("bigint")))
    )
    status = (
        F.when(~F.col("output_parsed"), F.lit(STATUS_UNPARSED))
        .when(~F.col("list_ok"), F.lit(STATUS_NO_LIST))
        .when(~F.col("representative_in_list"), F.lit(STATUS_NO_REP))
        .otherwise(F.lit(STATUS_OK))
    )
    return out.withColumn("status", status)


def rerun_set(validated: DataFrame) -> DataFrame:
    """Responses to send back to the resolver (parse or marker failures)."""
    return validated.filter(F.col("status") != STATUS_OK)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("status") == STATUS_OK)


def extract_mapping(validated: DataFrame, order_col: str = "id_order") -> DataFrame:
    """Long mapping rows: every member of a marked group -> its representative.

    The representative is the first member containing the marker (trimmed);
    groups that are empty or unmarked give nothing, nor do members that are
    lists themselves.  ``ord`` is (response
    order, group position, member position) for last-wins merging.
    """
    src = accepted(validated)
    if order_col not in src.columns:
        src = src.withColumn(order_col, F.col("id").cast("bigint"))
    grp = src.select(order_col, "id", F.posexplode("groups").alias("group_pos", "grp"))
    rep = T.strip_markers(F.try_element_at(F.filter("grp", lambda m: T.is_representative(m) & ~T.is_list_member(m)), F.lit(1)))
    grp = grp.withColumn("representative", F.when(F.size("grp") > 0, rep)).filter(F.col("representative").isNotNull())
    mem = grp.select(
        order_col, "id", "group_pos", F.posexplode("grp").alias("member_pos", "member"), "representative"
    ).filter(~T.is_list_member("member"))
    return mem.select(
        "id",
        F.col(order_col).alias("response_order"),
        "group_pos",
        "member_pos",
        T.strip_markers("member").alias("signature"),
        "representative",
    )


def merge_mapping(long_mapping: DataFrame) -> DataFrame:
    """One representative per signature; the latest entry wins.

    ``max_by`` is a partial aggregate, so a signature repeated across many
    responses is reduced per task before the shuffle.
    """
    ordk = F.struct("response_order", "group_pos", "member_pos")
    return long_mapping.groupBy("signature").agg(F.max_by("representative", ordk).alias("representative"))


def apply_edge_mapping(
    remapped: DataFrame,
    mapping: DataFrame,
    source_type: str = "mapped_source_type",
    target_type: str = "mapped_target_type",
    edge: str = "interaction",
) -> DataFrame:
    """Add ``mapped_edge``: the representative's edge text where it applies.

    Key = ``[src] trimmed-edge [tgt]``; an unmapped key maps to itself.  The
    mapped signature is split back into parts; if it does not split, or its
    endpoint types differ from the row's, the raw edge text is kept.  Row
    count is preserved (left lookup on a unique key).
    """
    key = F.concat(
        F.lit("["), F.col(source_type), F.lit("] "), T.strip_markers(edge), F.lit(" ["), F.col(target_type), F.lit("]")
    )
    lookup = mapping.select(F.col("signature").alias("_key"), F.col("representative").alias("_rep"))
    joined = lookup_join(remapped.withColumn("_key", key), lookup, ["_key"])
    parts = T.signature_parts(F.coalesce("_rep", "_key"))
    same = (parts["source"] == F.col(source_type)) & (parts["target"] == F.col(target_type))
    mapped = F.when(parts.isNotNull() & F.coalesce(same, F.lit(False)), parts["edge"]).otherwise(F.col(edge))
    return joined.withColumn("mapped_edge", mapped).drop("_key", "_rep")


def compression_stats(applied: DataFrame, edge: str = "interaction") -> DataFrame:
    """Rows, changed rows, distinct edge labels before/after and the reduction."""
    return applied.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("mapped_edge") != F.col(edge)).alias("n_changed"),
        F.countDistinct(edge).alias("n_edges_before"),
        F.countDistinct("mapped_edge").alias("n_edges_after"),
    ).withColumn("reduction", F.col("n_edges_before") - F.col("n_edges_after"))


def join_outputs(outputs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Responses joined to their non-singleton blocks on the block id (as text)."""
    blk = blocks.filter(F.col("cluster_size") > 1).withColumn("id", F.col("cluster_id").cast("string"))
    return outputs.join(blk, "id", "inner")


def type_mismatch_rows(validated: DataFrame) -> DataFrame:
    """Responses whose groups mix endpoint types (inspection only)."""
    return validated.filter(~F.col("all_edges_same_type"))


def validation_report(validated: DataFrame) -> DataFrame:
    """Counts per status and per report-only flag."""
    return validated.groupBy("status", "output_matches_input", "all_edges_same_type").agg(
        F.count("*").alias("n")
    )


def contract_report(validated: DataFrame) -> DataFrame:
    """Rules the resolver is asked to follow but the gate does not check.

    Per response with readable groups: members repeated, block members left
    out, groups without exactly one marked representative, singleton groups.
    """
    g = F.col("groups")
    flat = F.transform(F.flatten(g), lambda m: T.strip_markers(m))
    return validated.filter(F.col("list_ok")).select(
        "id",
        (F.size(flat) != F.size(F.array_distinct(flat))).alias("has_duplicates"),
        F.size(F.filter("ids_in_cluster", lambda x: ~F.array_contains(flat, x))).cast("bigint").alias("n_omitted"),
        F.forall(g, lambda grp: F.size(F.filter(grp, lambda m: T.is_representative(m))) == 1).alias("one_rep_per_group"),
        F.size(F.filter(g, lambda grp: F.size(grp) == 1)).cast("bigint").alias("n_singleton_groups"),
    )
