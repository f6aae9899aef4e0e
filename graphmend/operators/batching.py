"""Token budgets, token-bounded batches, chunks and request shards.

Request files carry at most N requests, embedding calls at most ``cap``
tokens.  Ordinals come from the range-partitioned ``with_ordinal`` (no
single-task window), and the greedy token packing runs per shard of bounded
size so no task ever holds more than ``shard_rows`` items; the packing is
the exact sequential greedy at any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmend.functions.text import word_token_count
from graphmend.operators.joins import BROADCAST_ROWS, bounded_rows, lookup_join
from graphmend.operators.ordinal import with_chunk, with_running_sum
from graphmend.session import cut_lineage, ship_package

TOKENS_PER_CALL = 8192  # fixed value: token cap of one embedding call
PRICE_PER_M = 0.1  # fixed value: USD per million embedding tokens in the estimate
SHARD_ROWS = 200_000  # items one greedy-packing task holds at most (plus a cap-token head)


def token_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens``: words + single punctuation marks, a proxy computed in the JVM."""
    return df.withColumn("n_tokens", word_token_count(text_col))


def token_budget(counted: DataFrame, price_per_m: float = PRICE_PER_M) -> DataFrame:
    """Submissions, total tokens and estimated cost."""
    return counted.agg(
        F.count("*").alias("n_requests"),
        F.sum("n_tokens").cast("bigint").alias("total_tokens"),
    ).withColumn("est_cost", F.round(F.col("total_tokens") / F.lit(1_000_000.0) * F.lit(price_per_m), 6))


def oversized(counted: DataFrame, cap: int = TOKENS_PER_CALL) -> DataFrame:
    """Inputs that can never fit one call (reject table; strict mode raises)."""
    return counted.filter(F.col("n_tokens") > cap)


def _segment_exits(cap: int):
    """Per segment: for each node a batch could start at on entering the segment, where
    its greedy chain enters the next segment and how many batches it starts meanwhile.

    Rows of the segment come first (``_head`` false), then the next segment's first
    ``cap`` items, which hold every item whose in-segment token offset is below
    ``cap`` (every chain leaving the segment lands among them).  ``to`` > 0 is that landing node, < 0 means the chain ends before any
    batch starts in the next segment (-first node of it), 0 means the data ends.
    """
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k", kind="stable")
        k = pdf["_k"].to_numpy(dtype=np.int64)
        t = pdf["n_tokens"].to_numpy(dtype=np.int64)
        m = int((~pdf["_head"].to_numpy(dtype=bool)).sum())
        q = np.cumsum(t)
        p = q - t
        nxt = np.searchsorted(q, p[:m] + cap, side="right")  # next batch start after a start at i
        exit_ = np.empty(m, dtype=np.int64)
        cnt = np.empty(m, dtype=np.int64)
        for i in range(m - 1, -1, -1):  # nxt[i] > i: fill from the back
            j = nxt[i]
            if j >= m:
                exit_[i], cnt[i] = j, 1
            else:
                exit_[i], cnt[i] = exit_[j], cnt[j] + 1
        cand = p[:m] < cap
        end = -k[m] if len(k) > m else 0
        to = np.where(exit_ < len(k), k[np.minimum(exit_, len(k) - 1)], end)
        return pd.DataFrame({"node": k[:m][cand], "to": to[cand].astype(np.int64), "cnt": cnt[cand]})
    return kernel


def _segment_batches(cap: int, id_col: str):
    """Greedy pass of one segment from its chain entry ``_e`` (batches numbered from ``_off``)."""
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k", kind="stable")
        k = pdf["_k"].to_numpy(dtype=np.int64)
        q = np.cumsum(pdf["n_tokens"].to_numpy(dtype=np.int64))
        p = q - pdf["n_tokens"].to_numpy(dtype=np.int64)
        e, off, m = int(pdf["_e"].iloc[0]), int(pdf["_off"].iloc[0]), len(k)
        starts = np.zeros(m, dtype=np.int64)
        i = int(np.searchsorted(k, e)) if e > 0 else m
        while i < m:
            starts[i] = 1
            i = int(np.searchsorted(q, p[i] + cap, side="right"))
        out = off - 1 + np.cumsum(starts)  # items before the entry finish the previous batch
        return pd.DataFrame({
            id_col: pdf[id_col].to_numpy(), "_k": k, "shard": pdf["seg"].to_numpy(dtype=np.int64),
            "batch_in_shard": out - out.min(), "batch_id": out,
        })
    return kernel


def token_batches(
    counted: DataFrame,
    id_col: str,
    order_col: str,
    cap: int = TOKENS_PER_CALL,
    shard_rows: int = SHARD_ROWS,
    strict: bool = True,
) -> DataFrame:
    """Greedy batches: a new batch starts when the running total would pass ``cap``.

    Exactly the sequential pass over ``(order_col, id_col)`` order, by the same
    way at every size: items are cut into contiguous segments of
    ``shard_rows`` non-empty items (see ``_exact_batches``), of which small
    data have one.  An item above ``cap`` raises; with ``strict`` off the
    caller takes care of those (``oversized`` lists them) and the rest is
    packed.  Output: id, shard, batch_in_shard, batch_id.
    """
    if strict and oversized(counted, cap).limit(1).count():
        raise ValueError(f"an input exceeds {cap} tokens")
    ship_package(counted.sparkSession)
    cols = [id_col] + ([order_col] if order_col != id_col else [])
    # Token counts are computed once (whole texts) and kept as a narrow table.
    ok = cut_lineage(counted.filter(F.col("n_tokens") <= cap).select(*cols, "n_tokens"))
    return _exact_batches(ok, id_col, [F.col(c) for c in dict.fromkeys([order_col, id_col])], cap, max(shard_rows, cap + 1))


def batches_and_rejects(counted: DataFrame, id_col: str, order_col: str, cap: int = TOKENS_PER_CALL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per input: ``id, batch_id, status``.

    Inputs of at most ``cap`` tokens are batched as by ``token_batches`` (status
    ``batched``); larger ones fit no call and come back as rows of their own
    (status ``oversized``, null batch), so one long text never stops the run
    and none is lost.  Token counts are computed once for both.  A null count
    is ``oversized`` too, as it cannot be shown to fit.
    """
    sized = cut_lineage(counted.select(*dict.fromkeys([id_col, order_col]), "n_tokens"))
    batched = token_batches(sized, id_col, order_col, cap, shard_rows, strict=False)
    rejects = sized.filter(~F.coalesce(F.col("n_tokens") <= cap, F.lit(False)))
    return batched.select(id_col, "batch_id", F.lit("batched").alias("status")).unionByName(
        rejects.select(id_col, F.lit(None).cast("long").alias("batch_id"), F.lit("oversized").alias("status")))


def _exact_batches(ok: DataFrame, id_col: str, order: list, cap: int, seg_rows: int) -> DataFrame:
    """Exact greedy packing over data no single task should hold.

    1. A global running count of non-empty items gives each item ``_k``; items
       with tokens get dense ``_k`` and are cut into segments of ``seg_rows``
       (> cap, so every full segment holds more than ``cap`` tokens and every
       batch chain passes through it).  Empty items never start or grow a batch:
       they join the batch of the non-empty item before them.
    2. Per segment (one bounded task): for every node the chain could enter at,
       the node it enters the next segment at and the batches it starts.
    3. Pointer jumping over that small entry graph (log2(segments) rounds of
       equi-joins) yields each segment's true entry and batch offset.
    4. Per segment, the greedy pass from its entry numbers the batches.
    """
    spark = ok.sparkSession
    id_type = dict(ok.dtypes)[id_col]
    run = with_running_sum(ok.withColumn("_nz", (F.col("n_tokens") > 0).cast("long")), order, "_nz", "_k").drop("_nz")
    items = cut_lineage(run)
    nz = items.filter(F.col("n_tokens") > 0).withColumn("seg", F.floor((F.col("_k") - 1) / F.lit(seg_rows)).cast("long"))
    n_seg = int(nz.agg(F.coalesce(F.max("seg"), F.lit(-1))).first()[0]) + 1
    # Every item here has a token, so a segment's first ``cap`` tokens lie within its
    # first ``cap`` items: the head is picked by position, with no window or sort.
    head = nz.filter((F.pmod(F.col("_k") - 1, F.lit(seg_rows)) < cap) & (F.col("seg") > 0)).withColumn("seg", F.col("seg") - 1)
    parts = nz.withColumn("_head", F.lit(False)).unionByName(head.withColumn("_head", F.lit(True)))
    jump = cut_lineage(
        parts.select("seg", "_k", "n_tokens", "_head").groupBy("seg")
        .applyInPandas(_segment_exits(cap), "node long, to long, cnt long")
    )
    def seg_of(c):
        return F.floor((F.abs(c) - 1) / F.lit(seg_rows))

    entries = spark.createDataFrame([(1, 0)], "e long, off long")
    step = 1
    while step < n_seg:
        # Entries of segments [0, step) give those of [step, 2*step).  A jump that stops
        # short (the chain ends in the last segment) is kept only from the entry exactly
        # ``step`` segments back, so every segment gets one entry.
        ahead = (
            entries.filter(F.col("e") > 0).join(jump, F.col("e") == F.col("node"))
            .filter((F.col("to") != 0) & (seg_of(F.col("to")) == seg_of(F.col("e")) + step))
            .select(F.col("to").alias("e"), (F.col("off") + F.col("cnt")).alias("off"))
        )
        entries = cut_lineage(entries.unionByName(ahead))
        step *= 2
        if step < n_seg:
            a, b = jump.alias("a"), jump.alias("b")
            jump = cut_lineage(
                a.join(b, F.col("a.to") == F.col("b.node"), "left").select(
                    F.col("a.node").alias("node"),
                    F.when(F.col("b.node").isNull(), F.col("a.to")).otherwise(F.col("b.to")).alias("to"),
                    (F.col("a.cnt") + F.coalesce(F.col("b.cnt"), F.lit(0))).alias("cnt"),
                )
            )
    entries = entries.select(seg_of(F.col("e")).cast("long").alias("seg"), F.col("e").alias("_e"), F.col("off").alias("_off"))
    numbered = cut_lineage(
        lookup_join(nz.select(id_col, "_k", "n_tokens", "seg"), entries, ["seg"], "inner")
        .groupBy("seg")
        .applyInPandas(
            _segment_batches(cap, id_col),
            f"{id_col} {id_type}, _k long, shard long, batch_in_shard long, batch_id long",
        )
    )
    out = numbered.drop("_k")
    empty = items.filter(F.col("n_tokens") == 0).select(id_col, "_k")
    if empty.limit(1).count():
        fits = bounded_rows(numbered, BROADCAST_ROWS)
        before = lookup_join(empty, numbered.drop(id_col), ["_k"], "left", small_fits=fits).select(
            id_col, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("shard", "batch_in_shard", "batch_id")]
        )
        out = out.unionByName(before)
    return out


def chunk_blocks(blocks: DataFrame, chunk_size: int = 1, order_col: str = "cluster_id", members: str = "member_ids") -> DataFrame:
    """Requests carrying ``chunk_size`` blocks each: chunk_id + payload map.

    With ``chunk_size = 1`` (the only size used) every block is its own
    request and no grouping happens.
    """
    chunked = with_chunk(blocks, [F.col(order_col)], chunk_size, "chunk_id")
    if chunk_size == 1:
        return chunked.select("chunk_id", F.create_map(F.col(order_col).cast("string"), F.col(members)).alias("payload"))
    return chunked.groupBy("chunk_id").agg(
        F.map_from_entries(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(members).alias("m")))),
            lambda s: F.struct(s["o"].cast("string"), s["m"]))).alias("payload")
    )


def request_shards(requests: DataFrame, order_cols: list, max_batch_size: int = 50_000):
    """(requests + shard_id, ledger): at most ``max_batch_size`` per shard."""
    sharded = with_chunk(requests, order_cols, max_batch_size, "shard_id")
    ledger = sharded.groupBy("shard_id").agg(
        F.count("*").alias("n_requests"),
        F.min("custom_id").alias("first_custom_id"),
        F.max("custom_id").alias("last_custom_id"),
    )
    return sharded, ledger
