"""Node-type resolution: type universe, frequency rank, candidates, curation.

Types are few compared with triples, but every step is still a Spark job
over the whole triple / node table: counts are partial aggregates, ranks use
the range-partitioned ordinal, lookups are size-checked joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmend.functions.text import NULL_TEXT, as_text
from graphmend.operators.joins import lookup_join
from graphmend.operators.ordinal import with_ordinal
from graphmend.operators.similarity import follow_by_rank, topk_cosine

OTHER = "other"
N_SEEDS = 30  # fixed value: most frequent types seed the reference set
TOP_K = 20  # fixed value: candidates shown per queried type
RARE_BELOW = 100  # fixed value: remapped labels on fewer nodes fold into "other"

# Curated parent renames, applied in this order.
CURATED_RENAMES = [
    ("webservice", "tool"),
    ("difference", "other"),
    ("response regulator 6", "regulation"),
    ("ubiquitin-conjugating protein", "protein"),
    ("cysteine protease substrate", "metabolite"),
    ("agrochemicale", "other"),
    ("cystatin", "protein"),
    ("microscope", "tool"),
    ("p12", "protein"),
    ("grn", "network"),
    ("tf", "transcription factor"),
    ("clade", "genetic lineage"),
    ("cystatin", "protein"),
    ("sphingolipid", "molecule"),
    ("sig", "description"),
    ("viral virulence factor", "molecular effect"),
    ("similar to gottwald et al., 2000", "description"),
    ("protein, organism", "protein"),
    ("complex", "protein complex"),
    ("protein clas", "protein class"),
    ("gene clas", "gene class"),
    ("molecular mas", "molecular mass"),
    ("consensu site", "consensus site"),
    ("bioinformatic suite", "tool"),
    ("cros", "cross"),
    ("nucleotide binding-leucine-rich repeat protein", "protein"),
    ("gene and process", "gene"),
    ("calcium-dependent protein kinase", "enzyme"),
    ("wheat protein", "protein"),
    ("pseudoprotease", "enzyme"),
    ("protein synthesi", "process"),
    ("clas ius", "other"),
    ("variable pair", "relationship"),
    ("chemical shift", "process"),
]


def type_occurrences(kg: DataFrame, cols=("source_type", "target_type"), null_text: str | None = NULL_TEXT) -> DataFrame:
    """One row per endpoint type occurrence (``type``); nulls become text.

    All endpoint columns come out of one pass (``explode`` of an array).
    """
    vals = [as_text(c, null_text) if null_text is not None else F.col(c) for c in cols]
    out = kg.select(F.explode(F.array(*vals)).alias("type"))
    return out if null_text is not None else out.filter(F.col("type").isNotNull())


def type_universe(kg: DataFrame, cols=("source_type", "target_type"), null_text: str | None = NULL_TEXT) -> DataFrame:
    """Distinct endpoint types of a triple table (sorted when collected)."""
    return type_occurrences(kg, cols, null_text).distinct()


def type_frequency_rank(kg: DataFrame, cols=("source_type", "target_type"), null_text: str | None = None) -> DataFrame:
    """``type, n, rank``: rank 1 = most frequent, ties by type text."""
    freq = type_occurrences(kg, cols, null_text).groupBy("type").agg(F.count("*").alias("n"))
    return with_ordinal(freq, [F.col("n").desc(), F.col("type")], "rank")


def seed_parents(ranked: DataFrame, n_seeds: int = N_SEEDS) -> DataFrame:
    """Identity mapping rows for the ``n_seeds`` most frequent types."""
    return ranked.filter(F.col("rank") <= n_seeds).select(F.col("type").alias("id"), F.col("type").alias("parent_node"))


def parents_on_resume(mapping: DataFrame, type_vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """Reference set when resuming: types already used as a parent."""
    parents = mapping.select(F.col("parent_node").alias(id_col)).distinct()
    return type_vectors.join(parents, id_col, "left_semi")


def pending_types(candidates: DataFrame, mapping: DataFrame, id_col: str = "id") -> DataFrame:
    """Types not yet in the mapping (resume by anti join)."""
    return candidates.join(mapping.select(F.col("id").alias(id_col)), id_col, "left_anti")


def topk_similar_types(queries: DataFrame, refs: DataFrame, k: int = TOP_K, vec_col: str = "embedding") -> DataFrame:
    return topk_cosine(queries, refs, k=k, id_col="id", vec_col=vec_col)


def python_list_text(arr) -> F.Column:
    """Text of a list of strings as a Python list prints it: ``['a', 'b']``."""
    def item(x):
        return F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), F.concat(F.lit('"'), x, F.lit('"'))) \
            .otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(F.transform(arr, item), ", "), F.lit("]"))


def type_prompts(topk: DataFrame, query_rank: DataFrame) -> DataFrame:
    """One prompt per queried type: id, frequency index and its candidates."""
    cands = topk.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref_id"))), lambda s: s["ref_id"]).alias("cands")
    )
    j = cands.join(query_rank.select(F.col("id").alias("query_id"), "query_index"), "query_id")
    # Fixed wording: answers recorded for these prompts are keyed by it.
    text = F.concat(
        F.lit("Input type: "), F.col("query_id"), F.lit("; Query index: "), F.col("query_index").cast("string"),
        F.lit(";  Top 10 similar types: "), python_list_text(F.col("cands")),
    )
    return j.select("query_id", text.alias("prompt"))


def resumed_prompts(ranked: DataFrame, mapping: DataFrame, k: int = TOP_K, n_seeds: int = N_SEEDS) -> DataFrame:
    """Prompts of the next answer batch: types still pending against all parents so far.

    ``ranked`` has ``id, rank, embedding``.  After each batch of answers the
    types that are parents by now (seeds and types mapped to themselves) are the
    references; call again with the grown mapping until nothing is pending.
    """
    pending = pending_types(ranked, mapping)
    topk = topk_similar_types(pending, parents_on_resume(mapping, ranked), k)
    return type_prompts(topk, pending.select("id", (F.col("rank") - n_seeds - 1).alias("query_index")))


def curate_mapping(mapping: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rename parent labels with an ordered rule list (each rule sees the
    result of the previous ones).  The rule list is a small parameter, so its
    composition is resolved on the driver into a final lookup of at most
    ``len(rules)`` rows and applied with a broadcast join."""
    rules = CURATED_RENAMES if rules is None else rules
    final: dict[str, str] = {}
    for old, new in rules:
        for k, v in list(final.items()):
            if v == old:
                final[k] = new
        if old not in final:
            final[old] = new
    spark = mapping.sparkSession
    table = spark.createDataFrame(sorted(final.items()), "_old string, _new string")
    j = mapping.join(F.broadcast(table), mapping["parent_node"] == table["_old"], "left")
    return j.withColumn("parent_node", F.coalesce("_new", "parent_node")).drop("_old", "_new")


def label_remap(nodes: DataFrame, mapping: DataFrame, label_col: str = "label") -> DataFrame:
    """``remapped_label`` = parent of the node's label (null when unmapped)."""
    m = mapping.select(F.col("id").alias("_lab"), F.col("parent_node").alias("remapped_label"))
    return lookup_join(nodes.withColumn("_lab", F.col(label_col)), m, ["_lab"]).drop("_lab")


def fold_rare_types(
    nodes: DataFrame, mapping: DataFrame, label_col: str = "label", min_count: int = RARE_BELOW, other: str = OTHER
) -> DataFrame:
    """Mapping where labels of nodes whose remapped label is rare -> ``other``.

    The node table is read once, for a count per original label (one partial
    aggregate, a row for each label); all else works on those counts.  The
    null label is never rare.
    """
    per_label = nodes.groupBy(F.col(label_col).alias("id")).agg(F.count("*").alias("_n"))
    counted = per_label.join(mapping.select("id", F.col("parent_node").alias("_p")), "id").filter(F.col("_p").isNotNull())
    rare = counted.groupBy("_p").agg(F.sum("_n").alias("_total")).filter(F.col("_total") < min_count).select("_p")
    rare_labels = counted.join(rare, "_p", "left_semi").select("id").distinct().withColumn("_rare", F.lit(True))
    out = mapping.join(rare_labels, "id", "left")
    return out.withColumn(
        "parent_node", F.when(F.col("_rare"), F.lit(other)).otherwise(F.col("parent_node"))
    ).drop("_rare")


# ------------------------------------------------------ decisions from a response table

def decision_parent(content) -> F.Column:
    """``map`` value of a decision text ``{"map": "<parent>"}`` (single quotes allowed); else null."""
    c = F.col(content) if isinstance(content, str) else content
    m = F.from_json(c, "map<string,string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return F.when(F.rtrim(c).endswith(F.lit("}")), F.try_element_at(m, F.lit("map")))


def decision_mapping(
    decisions: DataFrame, base: DataFrame, content_col: str = "content", order_col: str | None = None
) -> DataFrame:
    """Type mapping (id, parent_node) from the resolver's answers, one per asked type.

    ``base`` is the seeds' identity rows on a fresh start (``seed_parents``)
    or the mapping so far on resume; its rows win, as the rank-ordered walk
    skips types already mapped.  An answer that does not parse leaves its type
    pending (``pending_types`` asks it again).  Repeated answers for a type
    keep the first by ``order_col`` (else the smallest parent).  Types that
    map to themselves become references (``parents_on_resume``).
    """
    parsed = decisions.select("id", decision_parent(content_col).alias("parent_node"), *([order_col] if order_col else []))
    parsed = parsed.filter(F.col("parent_node").isNotNull())
    pick = F.min_by("parent_node", order_col) if order_col else F.min("parent_node")
    answered = parsed.groupBy("id").agg(pick.alias("parent_node"))
    base = base.select("id", "parent_node")
    return base.unionByName(answered.join(base.select("id"), "id", "left_anti"))


# ------------------------------------------------------ parallel type resolution

def resolve_types(vectors: DataFrame, tau: float = 0.9, n_seeds: int = N_SEEDS) -> DataFrame:
    """Frequency-ordered "join a parent, else become one".

    Walk types by rank: a type whose best lower-ranked parent has cos >= tau
    follows it, otherwise it becomes a parent (the ``n_seeds`` most frequent are
    parents from the start).  Done block by block of ranks, each against the
    parents so far and then in itself (``follow_by_rank``), so the reference
    set grows as in the sequential rule and only child -> parent rows move.
    Output: id, parent_node (the most similar parent), rank.
    """
    return follow_by_rank(vectors, tau, n_seeds)
