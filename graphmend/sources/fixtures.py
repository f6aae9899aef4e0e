"""Resolution inputs derived from the driver tables (see FIXTURES.md).

The library works on triple tables, embedding tables and resolver
responses.  The driver ships TPC-H-style tables instead, so these
functions derive the same shapes from them with Spark: every fixture
grows with the table it reads (``events`` -> KG, ``embeddings`` ->
vectors, ``documents`` -> entity blocks, ``labels`` -> verdicts,
``conversations`` -> chat examples).  The DuckDB twins live in
``graphmend.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmend.sources.tables import load_spread as load

# Node-type lookup of the synthetic KG (id -> parent_node).
TYPE_MAP = [
    ("gene", "gene"),
    ("Gene", "gene"),
    ("protein", "protein"),
    ("tf", "transcription factor"),
    ("grn", "network"),
    ("microscope", "tool"),
    ("complex", "protein complex"),
    ("process", "process"),
    ("phenotype", "phenotype"),
]

# Source-type names by user_id % 8 and target types by k % 4.
SOURCE_TYPES = ["gene", "protein", "tf", "grn", "microscope", "Gene", "unlisted", "complex"]
TARGET_TYPES = ["process", "phenotype", "gene", "metabolite"]

BLOCK_WIDTH = 12  # signatures per synthetic edge block


def _pick(values: list[str], idx) -> F.Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr


def kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triple table with the defects real extractions have (nulls, decorations)."""
    e = load(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    k = F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT)")
    eid = F.col("event_id")
    inter = F.pmod(eid, F.lit(5))
    tgt_type = (
        F.when(F.pmod(eid, F.lit(89)) == 0, F.lit(None).cast("string"))
        .otherwise(_pick(TARGET_TYPES, F.pmod(k, F.lit(4))))
    )
    return e.select(
        eid.alias("row_id"),
        F.when(F.pmod(eid, F.lit(97)) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("source"),
        _pick(SOURCE_TYPES, F.pmod(F.col("user_id"), F.lit(8))).alias("source_type"),
        F.when(inter == 0, F.concat("event_type", F.lit(" **")))
        .when(inter == 1, F.concat("event_type", F.lit(": ")))
        .when(inter == 2, F.upper("event_type"))
        .when(inter == 3, F.concat("event_type", F.lit("s")))
        .otherwise(F.concat("event_type", F.lit(" 2"))).alias("interaction"),
        F.concat(F.lit("item "), F.pmod(k, F.lit(40)).cast("string")).alias("target"),
        tgt_type.alias("target_type"),
        F.when(F.pmod(eid, F.lit(11)) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("source def "), eid.cast("string"))).alias("source_extracted_definition"),
        F.concat(F.lit("target def "), eid.cast("string")).alias("target_extracted_definition"),
    )


def type_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPE_MAP, "id string, parent_node string")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as (id, vec_id, embedding, label)."""
    v = load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return v.select(F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("id"), "vec_id", "embedding", "label")


def doc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form entity blocks: 8 consecutive documents per block."""
    d = load(spark, sf_dir, "documents", "doc_id", "lang")
    return d.select(
        F.floor(F.col("doc_id") / 8).cast("bigint").alias("cluster_id"),
        F.col("doc_id"),
        F.col("lang"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" ["), F.col("lang"), F.lit("]")).alias("member"),
    )


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide entity blocks: cluster_id, cluster_size, member_ids (sorted by doc_id)."""
    m = doc_members(spark, sf_dir)
    return m.groupBy("cluster_id").agg(
        F.count("*").alias("cluster_size"),
        F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "member"))), lambda s: s["member"]).alias("member_ids"),
    )


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected sub-clusters per block: members grouped by language, some left out."""
    m = doc_members(spark, sf_dir).filter(F.pmod("doc_id", F.lit(8)) != 5)
    g = m.groupBy("cluster_id", "lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "member"))), lambda s: s["member"]).alias("grp")
    )
    return g.groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lang", "grp"))), lambda s: s["grp"]).alias("groups")
    )


def run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolver output per block as list-literal text: members grouped by
    language (doc order), the first member of a multi-member group marked."""
    m = doc_members(spark, sf_dir)
    g = m.groupBy("cluster_id", "lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "member"))), lambda s: s["member"]).alias("grp")
    )
    g = g.withColumn("grp", F.when(F.size("grp") > 1, F.concat(
        F.array(F.concat(F.lit("**"), F.get("grp", 0), F.lit("**"))), F.slice("grp", 2, 1 << 20))).otherwise(F.col("grp")))
    return g.groupBy("cluster_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("lang", "grp"))), lambda s: s["grp"])).alias("output")
    )


def run_a_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the first judged run: those holding a document labelled good."""
    lab = load(spark, sf_dir, "labels", "doc_id", "quality").filter(F.col("quality") == 1)
    return lab.select(F.floor(F.col("doc_id") / 8).cast("bigint").alias("cluster_id")).distinct()


def run_b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the second run: those holding an English document."""
    d = load(spark, sf_dir, "documents", "doc_id", "lang").filter(F.col("lang") == "en")
    return d.select(F.floor(F.col("doc_id") / 8).cast("bigint").alias("cluster_id")).distinct()


def correction_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected groups with a version order: v0 for every block, and a
    later v1 (all members in one group) for blocks holding a German document."""
    v0 = corrections(spark, sf_dir).withColumn("ord", F.lit(0))
    m = doc_members(spark, sf_dir)
    de = m.filter(F.col("lang") == "de").select("cluster_id").distinct()
    v1 = m.join(de, "cluster_id", "left_semi").groupBy("cluster_id").agg(
        F.array(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "member"))), lambda s: s["member"])).alias("groups")
    ).withColumn("ord", F.lit(1))
    return v0.unionByName(v1)


def verdict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge responses: one JSON object text per labelled document."""
    lab = load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    key = F.col("doc_id").cast("string")
    body = F.to_json(F.struct(
        F.when(F.col("quality") == 1, F.lit("True")).otherwise(F.lit("False")).alias("is_correct"),
        F.concat(F.lit("block "), key).alias("user_prompt"),
        F.array(F.array(F.concat(F.lit("doc "), key))).alias("clusters"),
    ))
    content = F.when(F.col("toxic") == 1, F.concat(F.lit('{"'), key, F.lit('": {"user_prompt": "block '), key, F.lit('"}}'))) \
        .otherwise(F.concat(F.lit('{"'), key, F.lit('": '), body, F.lit("}")))
    return lab.select(F.col("doc_id").alias("cluster_id"), content.alias("content"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", "doc_id", "text")


OVERSIZED_WORDS = 8193  # one word more than an embedding call takes


def texts_with_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``texts`` plus document -1, which is longer than any embedding call at every scale."""
    extra = spark.range(1, numPartitions=1).select(
        F.lit(-1).cast("long").alias("doc_id"), F.repeat(F.lit("over "), OVERSIZED_WORDS).alias("text"))
    return texts(spark, sf_dir).unionByName(extra)


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


# ------------------------------------------------------------ edge blocks

def edge_block_members(signatures: DataFrame) -> DataFrame:
    """Long-form edge blocks: signatures in case-folded order, BLOCK_WIDTH per block."""
    from graphmend.operators.ordinal import with_chunk

    return with_chunk(
        signatures.select("signature", "freq"), [F.lower("signature"), F.col("signature")], BLOCK_WIDTH, "cluster_id"
    ).select("cluster_id", "signature", "freq")


def edge_blocks(members: DataFrame) -> DataFrame:
    """Wide blocks: cluster_id, cluster_size, ids_in_cluster."""
    return members.groupBy("cluster_id").agg(
        F.count("*").alias("cluster_size"),
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.lower("signature").alias("l"), F.col("signature").alias("s")))),
            lambda x: x["s"],
        ).alias("ids_in_cluster"),
    )


def edge_responses(members: DataFrame) -> DataFrame:
    """Resolver responses per block, with a defect chosen by ``cluster_id % 10``.

    0 truncated JSON; 1 no marker; 2 native array value; 3 invented member;
    4 all groups merged; 5 JSON array instead of object; 6 flat list;
    7 singletons omitted; 8 lists nested too deep (every other block: one
    nested member); 9 text after the list (every other block: clean).  Groups = same case-folded signature
    with a trailing plural ``s`` removed; the smallest member is marked.
    """
    from pyspark.sql import Window

    gkey = F.replace(F.lower("signature"), F.lit("s ["), F.lit(" ["))
    m = members.withColumn("gkey", gkey)
    w = Window.partitionBy("cluster_id", "gkey")
    is_rep = F.col("signature") == F.min("signature").over(w)
    marked = F.when(is_rep & (F.pmod("cluster_id", F.lit(10)) != 1), F.concat(F.lit("**"), "signature", F.lit("**"))) \
        .otherwise(F.col("signature"))
    m = m.withColumn("mj", F.concat(F.lit('"'), marked, F.lit('"')))
    grp = m.groupBy("cluster_id", "gkey").agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("signature", "mj"))), lambda x: x["mj"]), ", "), F.lit("]")).alias("gj"),
        F.count("*").alias("n"),
    )
    grp = grp.filter((F.pmod("cluster_id", F.lit(10)) != 7) | (F.col("n") > 1))
    g = grp.groupBy("cluster_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gkey", "gj"))), lambda x: x["gj"]), ", ").alias("gs")
    )
    cid = F.col("cluster_id").cast("string")
    head = F.concat(F.lit('{"'), cid, F.lit('": '))

    def quoted(s):
        return F.concat(head, F.lit('"'), F.replace(s, F.lit('"'), F.lit('\\"')), F.lit('"}'))

    gs = F.col("gs")
    case, even = F.pmod("cluster_id", F.lit(10)), F.pmod("cluster_id", F.lit(20))
    out = (
        F.when(case == 0, F.concat(head, F.lit("["), gs))
        .when(case == 2, F.concat(head, F.lit("["), gs, F.lit("]}")))
        .when(case == 3, quoted(F.concat(F.lit("["), gs, F.lit(', ["**[gene] invented [gene]**"]]'))))
        .when(case == 4, quoted(F.concat(F.lit("["), F.replace(gs, F.lit("], ["), F.lit(", ")), F.lit("]"))))
        .when(case == 5, F.lit("[1, 2]"))
        .when(case == 6, F.concat(head, F.lit('"[\\"a\\", \\"b\\"]"}')))
        .when((case == 8) & (even == 8), quoted(F.concat(F.lit("[["), gs, F.lit("]]"))))
        .when(case == 8, quoted(F.concat(F.lit("["), gs, F.lit(', ["**[gene] kept [gene]**", ["[gene] nested [gene]"]]]'))))
        .when((case == 9) & (even == 9), quoted(F.concat(F.lit("["), gs, F.lit("] as asked"))))
        .otherwise(quoted(F.concat(F.lit("["), gs, F.lit("]"))))
    )
    return g.select("cluster_id", cid.alias("id"), out.alias("output_string"))


# -------------------------------------------------------- response lines

def _json_str(col) -> F.Column:
    """A string as a JSON string literal (quotes and backslashes escaped)."""
    esc = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), esc, F.lit('"'))


def _completion_line(cid, content) -> F.Column:
    return F.concat(
        F.lit('{"id": "batch_req_'), cid, F.lit('", "custom_id": "'), cid,
        F.lit('", "response": {"status_code": 200, "body": {"choices": [{"index": 0, "message": '
              '{"role": "assistant", "content": '), _json_str(content), F.lit("}}]}}, \"error\": null}"),
    )


def completion_lines(resp: DataFrame) -> DataFrame:
    """Edge responses as batch-output JSONL lines in 4 files.

    By ``cluster_id % 7``: 3 truncated line, 5 ``response: null``, 6 delivered
    twice (second copy in the next file).
    """
    cid = F.col("id")
    full = _completion_line(cid, F.col("output_string"))
    case = F.pmod("cluster_id", F.lit(7))
    value = (
        F.when(case == 3, F.substring(full, 1, 60))
        .when(case == 5, F.concat(F.lit('{"custom_id": "'), cid, F.lit('", "response": null}')))
        .otherwise(full)
    )
    part = lambda c: F.concat(F.lit("part-"), F.pmod(c, F.lit(4)).cast("string"), F.lit(".jsonl"))
    base = resp.select(value.alias("value"), part(F.col("cluster_id")).alias("source_file"))
    dup = resp.filter(case == 6).select(full.alias("value"), part(F.col("cluster_id") + 1).alias("source_file"))
    return base.unionByName(dup)


def redelivered_lines(resp: DataFrame) -> DataFrame:
    """Full lines of ``cluster_id % 3 = 1`` once more, in a file of their own: late copies, and retries of broken lines."""
    full = _completion_line(F.col("id"), F.col("output_string"))
    return resp.filter(F.pmod("cluster_id", F.lit(3)) == 1).select(full.alias("value"), F.lit("part-later.jsonl").alias("source_file"))


def verdict_response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge verdicts over labelled documents as completion lines."""
    v = verdict_lines(spark, sf_dir)
    return v.select(_completion_line(F.col("cluster_id").cast("string"), F.col("content")).alias("value"))


def reasoning_response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = load(spark, sf_dir, "labels", "doc_id", "quality")
    key = F.col("doc_id").cast("string")
    content = F.concat(F.lit('{"'), key, F.lit('": {"reasoning": "quality '), F.col("quality").cast("string"), F.lit('"}}'))
    return lab.select(_completion_line(key, content).alias("value"))


def embedding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding responses: ``vec_id % 13 == 0`` truncated vector, ``% 17 == 0`` no response."""
    v = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    cid = F.concat(F.lit("vec "), F.col("vec_id").cast("string"))
    emb = F.when(F.pmod("vec_id", F.lit(13)) == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    rec = F.struct(
        cid.alias("custom_id"),
        F.when(F.pmod("vec_id", F.lit(17)) == 0, F.lit(None)).otherwise(
            F.struct(F.lit(200).alias("status_code"), F.struct(F.array(F.struct(
                F.lit(0).alias("index"), emb.cast("array<double>").alias("embedding"))).alias("data")).alias("body"))
        ).alias("response"),
    )
    return v.select(F.to_json(rec).alias("value"))


# ------------------------------------------------------------ document KG

def doc_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small property graph over documents: language and source edges."""
    d = load(spark, sf_dir, "documents", "doc_id", "lang", "source")
    node = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    lang = d.select(node.alias("source"), F.lit("written_in").alias("relation"), F.concat(F.lit("lang "), F.col("lang")).alias("target"))
    src = d.select(node.alias("source"), F.lit("from").alias("relation"), F.col("source").alias("target"))
    return lang.unionByName(src)


def abbreviated_names(part: DataFrame) -> DataFrame:
    """``(cluster_id, member)``: typed part names, and for some of them initials, unrelated capitals or initials of another type."""
    k = F.col("p_partkey")
    between = F.when(k % 2 == 0, F.lit(" of ")).otherwise(F.lit(" "))
    name = F.concat("p_name", between, F.lower("p_type"))
    first = F.upper(F.array_join(F.transform(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), lambda w: F.substring(w, 1, 1)), ""))
    planted = F.when(k % 3 == 0, F.concat(F.lit("[part] "), first, F.lit(" [item]"))).when(
        k % 3 == 1, F.lit("[part] QXZ [item]")).when(k % 9 == 2, F.concat(F.lit("[tool] "), first, F.lit(" [item]")))
    members = F.array_compact(F.array(F.concat(F.lit("[part] "), name, F.lit(" [item]")), planted))
    return part.select(F.floor(k / 24).alias("cluster_id"), F.explode(members).alias("member")).distinct()
