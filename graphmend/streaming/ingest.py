"""Incremental ingestion of resolver output files with Structured Streaming.

Batch outputs arrive as JSONL files over time.  ``stream_completions`` runs
a file stream over the output folder: lines are parsed with the same column
expressions as the batch reader, answers that come again are dropped by the
stream's own state, and each micro-batch is written to a Parquet sink folder
keyed by epoch (rewriting an epoch on retry is idempotent).  The checkpoint
remembers which files were taken and which ids were seen, and
``availableNow`` processes everything present and stops.  Files already
ingested are skipped on the next run — the resume rule of the polling loop
this replaces.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from graphmend.operators import edges, responses

DEDUPE_WITHIN = "30 days"  # how long an accepted id is remembered


def write_line_files(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lay lines out as files, one folder per ``source_file`` value."""
    lines.select("value", "source_file").write.mode(mode).partitionBy("source_file").text(path)


def _once(parsed: DataFrame, dedupe_within: str, blocks: DataFrame | None) -> DataFrame:
    """The lines of a stream with every accepted id once, checked against ``blocks`` if given."""
    key = F.when((F.col("status") == responses.OK) & F.col("custom_id").isNotNull(), F.concat(F.lit("id "), "custom_id")).otherwise(F.uuid())
    # Arrival times never run late, so the watermark drops state but no line.
    once = (parsed.withColumn("key", key).withColumn("arrived", F.current_timestamp())
            .withWatermark("arrived", dedupe_within).dropDuplicatesWithinWatermark(["key"]).drop("key", "arrived"))
    if blocks is None:
        return once
    ok = once.filter(F.col("status") == responses.OK).select(F.col("custom_id").alias("id"), "source_file", F.col("content").alias("output_string"))
    return edges.validate_outputs(ok, blocks)


def stream_completions(
    spark: SparkSession,
    src_dir: str,
    sink_dir: str,
    checkpoint: str,
    max_files_per_trigger: int = 64,
    glob: str = "*.{jsonl,txt}",
    dedupe_within: str | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Ingest every new completion file under ``src_dir``; returns parsed lines so far.

    ``source_file`` is the file's name, or the value of a ``source_file=``
    folder around it.  By default every line stays, with its place in the file
    (``line_pos``), and readers let the last one of an id win.  With
    ``dedupe_within`` (such as ``DEDUPE_WITHIN``) an accepted line is dropped if one of its
    ``custom_id`` was accepted before, in this run or an earlier one: the
    state keeps an id for ``dedupe_within`` after its arrival.  Lines that are
    not accepted (corrupt, without content, unreadable) all stay and never
    block a later good one.  Of several lines of one id in the same micro-batch
    one stays, whichever.

    With ``blocks`` (and ``dedupe_within``) the accepted lines are checked against their blocks in the
    stream (``edges.validate_outputs``, a stream-static join): the result has
    its flags and gating ``status``, one row per response.  Before any file has
    come the result is empty.
    """
    named = F.regexp_extract(F.col("_metadata.file_path"), r"source_file=([^/]+)", 1)
    stream = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(src_dir)
        .select(
            "value",
            F.when(named != "", named).otherwise(F.col("_metadata.file_name")).alias("source_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )
    if blocks is not None and dedupe_within is None:
        raise ValueError("blocks needs dedupe_within")
    if dedupe_within is None:
        once = stream
        empty = spark.createDataFrame([], "value string, source_file string, line_pos struct<block:bigint,row:bigint>")
        schema = responses.parse_completion_lines(empty).schema
    else:
        once = _once(responses.parse_completion_lines(stream.drop("_block")), dedupe_within, blocks)
        schema = once.schema

    def sink(batch: DataFrame, epoch_id: int) -> None:
        if dedupe_within is None:  # lines have a place only within a batch
            batch = responses.parse_completion_lines(responses.with_line_pos(batch))
        batch.write.mode("overwrite").parquet(os.path.join(sink_dir, f"epoch={epoch_id}"))

    q = once.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        return spark.read.schema(schema).parquet(sink_dir)
    except AnalysisException:  # no file so far
        return spark.createDataFrame([], schema)
