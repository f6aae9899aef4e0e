"""Deterministic sub-clustering resolvers and entity collapse.

The reference sends every block to a language model.  These resolvers give
the same output shape without a network: a surface-form resolver (case,
spacing, punctuation and simple plurals ignored; numbers and bracketed types
kept) and a similarity resolver (connected components of cos >= tau inside a
block).  Their groups can be wrapped as a marked payload and fed to the same
validation / mapping / apply operators as external responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmend.functions import text as T
from graphmend.operators.components import CHUNK_ROWS, block_components
from graphmend.operators.joins import lookup_join
from graphmend.session import cut_lineage


def surface_key(col) -> Column:
    """Case/space/punctuation-insensitive key; trailing plural ``s`` folded.

    Bracketed ``[type]`` parts are kept verbatim (types must match exactly)
    and digits are kept (sub-identifiers stay apart).  Letters of every
    script are kept, and so is a trailing ``+`` or ``-`` (ions, mutants).  A
    text without letters and digits is its own key, never an empty one.
    """
    head, body, tail = _surface_parts(col)
    return F.concat(head, F.lit("|"), _surface_body(body), F.lit("|"), tail)


def _surface_parts(col) -> tuple[Column, Column, Column]:
    """Leading bracket, text between, trailing bracket."""
    c = T._c(col)
    head = F.regexp_extract(c, r"^(\[[^\]]*\])", 1)
    tail = F.regexp_extract(c, r"(\[[^\]]*\])$", 1)
    return head, F.substring(c, F.length(head) + 1, F.greatest(F.length(c) - F.length(head) - F.length(tail), F.lit(0))), tail


def _surface_body(body: Column) -> Column:
    sign = F.regexp_extract(body, r"([+-]+)\s*$", 1)
    norm = F.btrim(F.regexp_replace(F.lower(body), r"[^\p{L}\p{M}\p{N}]+", " "), F.lit(" "))
    norm = F.regexp_replace(norm, r"([a-z]{2}[a-rt-z])s\b", "$1")
    return F.when(norm == "", F.concat(F.lit("="), body)).otherwise(F.concat(norm, sign))


def surface_groups(members: DataFrame, member: str = "member", freq: str | None = None) -> DataFrame:
    """Groups per block from long ``(cluster_id, member[, freq])`` rows.

    Representative = most frequent, then longest, then smallest text
    (a full term is preferred over an abbreviation).
    """
    f = F.col(freq) if freq else F.lit(1)
    keyed = members.withColumn("_key", surface_key(member)).withColumn("_f", f)
    rank = F.struct((-F.col("_f")).alias("a"), (-F.length(member)).alias("b"), F.col(member).alias("c"))
    return keyed.groupBy("cluster_id", "_key").agg(
        F.array_sort(F.collect_list(member)).alias("group"),
        F.min_by(member, rank).alias("representative"),
    ).withColumnRenamed("_key", "key")


#: Words that an abbreviation may leave out.
SMALL_WORDS = ("a", "an", "and", "by", "for", "in", "of", "on", "or", "the", "to", "with")


def merge_abbreviations(groups: DataFrame) -> DataFrame:
    """Groups of ``surface_groups`` with abbreviations joined to their long form.

    A group is an abbreviation if a member's text between the brackets is one
    word of two or more capitals.  It joins the group of its block whose words
    (two or more) have these initials, small words counted or left out, under
    equal bracketed types; the long form keeps key and representative.  If two
    long forms of the block fit, or none does, the abbreviation stays apart.
    """
    def initials(words):
        return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")

    def bare(member):
        return F.btrim(_surface_parts(member)[1], F.lit(" "))

    head, body, tail = _surface_parts("representative")
    words = F.split(_surface_body(body), " ")
    g = groups.select("cluster_id", "key", head.alias("_h"), tail.alias("_t"), words.alias("_w"),
                      F.transform(F.filter("group", lambda m: bare(m).rlike("^[A-Z]{2,}$")), lambda m: F.lower(bare(m))).alias("_short"))
    big = F.filter("_w", lambda w: ~w.isin(*SMALL_WORDS))
    forms = g.where(F.size("_w") >= 2).select(
        "cluster_id", "_h", "_t", F.col("key").alias("_long"), F.explode(F.array_distinct(F.array(initials(F.col("_w")), initials(big)))).alias("_i"))
    one = forms.groupBy("cluster_id", "_h", "_t", "_i").agg(F.min("_long").alias("_long"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    short = g.where(F.size("_w") == 1).select("cluster_id", "_h", "_t", "key", F.explode(F.array_distinct("_short")).alias("_i"))
    to = short.join(one, ["cluster_id", "_h", "_t", "_i"]).groupBy("cluster_id", "key").agg(
        F.min("_long").alias("_long"), F.max("_long").alias("_other")).where("_long = _other").drop("_other")
    placed = groups.join(to, ["cluster_id", "key"], "left").withColumn("_k", F.coalesce("_long", "key"))
    return placed.groupBy("cluster_id", F.col("_k")).agg(
        F.array_sort(F.flatten(F.collect_list("group"))).alias("group"),
        F.max(F.when(F.col("key") == F.col("_k"), F.col("representative"))).alias("representative"),
    ).withColumnRenamed("_k", "key")


def marked_payload(groups: DataFrame) -> DataFrame:
    """``{"<cluster_id>": "[[...], ...]"}`` response text with ``**rep**`` marks.

    Groups are ordered by their key; the list is a JSON string value, the
    format external responses use.
    """
    marked = F.transform("group", lambda m: F.when(m == F.col("representative"), F.concat(F.lit("**"), m, F.lit("**"))).otherwise(m))
    per_block = groups.select("cluster_id", "key", marked.alias("g")).groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("key", "g"))), lambda s: s["g"]).alias("groups")
    )
    text = F.to_json(F.create_map(F.col("cluster_id").cast("string"), F.to_json("groups")))
    return per_block.select(F.col("cluster_id").cast("string").alias("id"), text.alias("output_string"))


def similarity_groups(members: DataFrame, tau: float = 0.9, member: str = "member", vec: str = "embedding", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Connected components of ``cos >= tau`` inside each block, blocks of any size (``components.block_components``).

    Component id = smallest member text.
    """
    return block_components(members, tau, member, vec, chunk_rows)


def collapse_entities(
    triples: DataFrame,
    mapping: DataFrame,
    source: str = "source",
    target: str = "target",
    relation: str = "relation",
) -> DataFrame:
    """Rewrite both endpoints with their representative and merge duplicates.

    ``mapping`` is ``(node_id, representative)``, unique on ``node_id``;
    unmapped endpoints stay.  Lookups are size-checked (broadcast or salted
    shuffle); the merge counts duplicates into ``weight`` with a partial
    aggregate, so a hot endpoint does not funnel into one task.
    """
    from graphmend.operators.joins import BROADCAST_ROWS, bounded_rows

    mapping = cut_lineage(mapping.select("node_id", "representative"))  # used twice: computed once
    fits = bounded_rows(mapping, BROADCAST_ROWS)
    m_src = mapping.select(F.col("node_id").alias("_s"), F.col("representative").alias("_sr"))
    m_tgt = mapping.select(F.col("node_id").alias("_t"), F.col("representative").alias("_tr"))
    out = lookup_join(triples.withColumn("_s", F.col(source)), m_src, ["_s"], small_fits=fits)
    out = lookup_join(out.withColumn("_t", F.col(target)), m_tgt, ["_t"], small_fits=fits)
    out = out.select(
        F.coalesce("_sr", source).alias(source), F.col(relation), F.coalesce("_tr", target).alias(target)
    )
    return out.groupBy(source, relation, target).agg(F.count("*").alias("weight"))


def text_key(col) -> Column:
    """Whole-text duplicate key: lower case, whitespace runs collapsed."""
    return F.btrim(F.lower(F.regexp_replace(T._c(col), r"\s+", " ")), F.lit(" "))


def duplicate_mapping(docs: DataFrame, id_col: str, text_col: str, node_prefix: str = "doc ") -> DataFrame:
    """node_id -> representative for documents whose whole texts match after
    normalisation (representative = smallest id).  ``min`` is a partial
    aggregate, so a text copied a million times collapses per task, and the
    join back is salted for such hot keys."""
    # The shuffle carries a 256-bit digest of the normalised text, not the text.
    # Texts are normalised and hashed once; (id, digest) is checkpointed.
    keyed = cut_lineage(
        docs.select(F.col(id_col).alias("_id"), F.sha2(text_key(text_col), 256).alias("_k")).filter(F.col("_k").isNotNull())
    )
    reps = keyed.groupBy("_k").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n")).filter(F.col("_n") > 1)
    m = lookup_join(keyed, reps.select("_k", "_rep"), ["_k"], how="inner").filter(F.col("_id") != F.col("_rep"))
    return m.select(
        F.concat(F.lit(node_prefix), F.col("_id").cast("string")).alias("node_id"),
        F.concat(F.lit(node_prefix), F.col("_rep").cast("string")).alias("representative"),
    )
