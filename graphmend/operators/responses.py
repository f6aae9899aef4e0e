"""Resolver response ingestion: completions, embeddings, verdicts, reasoning.

Input is a DataFrame of raw JSONL lines (``value``, optional
``source_file``) — what ``spark.read.text`` (batch) or ``readStream.text``
(incremental) yields — so both paths share one parser.  Malformed lines are
never fatal: every line gets a ``status`` and failures go to a reject
table instead of stopping the job (``get``/``try_*`` accessors only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmend.functions.text import parse_object

EMBED_DIM = 1536  # fixed value: dimension an accepted embedding must have

CHOICE = "struct<index:int,message:struct<role:string,content:string>>"
COMPLETION_LINE = (
    "struct<id:string,custom_id:string,"
    f"response:struct<status_code:int,body:struct<choices:array<{CHOICE}>>>,error:string>"
)
EMBEDDING_LINE = (
    "struct<custom_id:string,"
    "response:struct<status_code:int,body:struct<data:array<struct<index:int,embedding:array<double>>>>>>"
)
VERDICT = "struct<is_correct:string,user_prompt:string,clusters:array<array<string>>>"

OK, CORRUPT, NO_CONTENT, BAD_PAYLOAD = "ok", "corrupt", "no_content", "bad_payload"


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """All ``glob`` files below ``path`` as lines with their file name and place in it."""
    df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return with_line_pos(df.select("value", F.col("_metadata.file_name").alias("source_file"),
                                   F.col("_metadata.file_block_start").alias("_block")))


def with_line_pos(lines: DataFrame) -> DataFrame:
    """``line_pos`` = (split start ``_block``, row number within the task): ascends within a file."""
    pos = F.struct(F.col("_block").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.withColumn("line_pos", pos).drop("_block")


def parse_completion_lines(lines: DataFrame) -> DataFrame:
    """custom_id, source_file, status, content, payload (map) per line."""
    if "source_file" not in lines.columns:
        lines = lines.withColumn("source_file", F.lit(None).cast("string"))
    obj_ok = F.from_json("value", "map<string,string>").isNotNull()
    rec = F.from_json("value", COMPLETION_LINE)
    content = F.get(rec["response"]["body"]["choices"], 0)["message"]["content"]
    out = lines.select(
        "source_file",
        *(["line_pos"] if "line_pos" in lines.columns else []),
        F.when(obj_ok, rec["custom_id"]).alias("custom_id"),
        F.when(obj_ok, content).alias("content"),
        obj_ok.alias("_obj"),
    ).withColumn("payload", parse_object(F.col("content")))
    status = (
        F.when(~F.col("_obj"), F.lit(CORRUPT))
        .when(F.col("content").isNull(), F.lit(NO_CONTENT))
        .when(F.col("payload").isNull(), F.lit(BAD_PAYLOAD))
        .otherwise(F.lit(OK))
    )
    return out.withColumn("status", status).drop("_obj")


def completion_entries(parsed: DataFrame) -> DataFrame:
    """One row per payload key of accepted lines: (custom_id, key, value).

    A ``custom_id`` delivered twice keeps the entry of the last file, and
    within a file of the last line (``max_by`` is a partial aggregate:
    duplicates collapse per task).  Lines without a known place fall back to
    the larger value, so the result never depends on the order of tasks.
    """
    ok = parsed.filter(F.col("status") == OK)
    place = [F.col("line_pos")] if "line_pos" in parsed.columns else []
    order = F.struct(F.coalesce(F.col("source_file"), F.lit("")).alias("f"), *place)
    ex = ok.select("custom_id", order.alias("_order"), F.explode("payload").alias("key", "value"))
    return ex.groupBy("custom_id", "key").agg(F.max_by("value", F.struct("_order", "value")).alias("value"))


def ingest_report(parsed: DataFrame) -> DataFrame:
    """Lines per (file, status): the skip counters."""
    return parsed.groupBy("source_file", "status").agg(F.count("*").alias("n_lines"))


def ingest_embeddings(lines: DataFrame, dim: int = EMBED_DIM):
    """(accepted (id, embedding), rejects (custom_id, reason)) from embedding lines.

    A vector of the wrong length is a reject — the set to request again.
    """
    rec = F.from_json("value", EMBEDDING_LINE)
    emb = F.get(rec["response"]["body"]["data"], 0)["embedding"]
    p = lines.select(rec["custom_id"].alias("custom_id"), emb.alias("embedding"))
    reason = (
        F.when(F.col("custom_id").isNull(), F.lit(CORRUPT))
        .when(F.col("embedding").isNull(), F.lit(NO_CONTENT))
        .when(F.size("embedding") != dim, F.lit("wrong_dimension"))
    )
    p = p.withColumn("reason", reason)
    ok = p.filter(F.col("reason").isNull()).select(F.col("custom_id").alias("id"), "embedding")
    rejects = p.filter(F.col("reason").isNotNull()).select("custom_id", "reason")
    return ok, rejects


def verdict_entries(parsed: DataFrame) -> DataFrame:
    """Judge verdicts: one row per judged block; missing fields default to N/A / [].

    Entries whose value is not an object are skipped (``is_object`` false).
    """
    ok = parsed.filter(F.col("status") == OK)
    ex = ok.select("custom_id", F.explode("payload").alias("cluster_id", "data"))
    is_obj = F.ltrim("data").startswith("{")
    v = F.from_json("data", VERDICT)
    return ex.filter(is_obj).select(
        "cluster_id",
        F.coalesce(v["is_correct"], F.lit("N/A")).alias("is_correct"),
        F.coalesce(v["user_prompt"], F.lit("N/A")).alias("user_prompt"),
        F.to_json(F.coalesce(v["clusters"], F.array().cast("array<array<string>>"))).alias("clusters"),
    )


def reasoning_entries(parsed: DataFrame) -> DataFrame:
    ok = parsed.filter(F.col("status") == OK)
    ex = ok.select(F.explode("payload").alias("cluster_id", "data"))
    return ex.select("cluster_id", F.get_json_object("data", "$.reasoning").alias("reasoning"))


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("is_correct").agg(F.count("*").alias("n"))


def pending_requests(requests: DataFrame, received: DataFrame, shard_col: str = "shard_id") -> DataFrame:
    """Requests with no accepted response yet, counted per shard (anti join)."""
    missing = requests.join(received.select("custom_id").distinct(), "custom_id", "left_anti")
    return missing.groupBy(shard_col).agg(F.count("*").alias("n_pending"))
