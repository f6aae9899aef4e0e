"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are cut into ``b`` blocks.  Two fingerprints that
differ in at most ``d`` bits agree on at least ``b - d`` whole blocks, so
keys made of every choice of ``b - d`` blocks bring each close pair
together; candidates are then verified by Hamming distance.  ``b`` grows
with the number of distinct fingerprints, which keeps blocks short; every
``b`` finds the same pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmend.llm.common import bounded_batches, connected_components, stage, text_of, unstage

#: Largest slice of one block compared with another slice in one task.
SLICE = 16_384
#: Blocks up to this many fingerprints are compared pairwise in one vector step.
SMALL = 24


def simhash64(data: bytes, k: int = 4, seed: int = 42) -> int:
    """Majority fingerprint of the ``k``-word shingles of UTF-8 ``data``.

    ``bytes.lower`` maps A-Z only and ``bytes.split`` cuts at
    ``\\x20 \\x09-\\x0D``.  Fewer than ``k`` words: the whole sequence is the
    only shingle; none: zero.
    """
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= k:
        return xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(lengths) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - k + 1].tolist()
    stops = ends[k - 1:].tolist()
    m = n - k + 1
    ones = np.zeros(64, np.int64)
    for i in range(0, m, 65_536):
        h = np.array([xxh64_intdigest(joined[a:z], seed) for a, z in zip(starts[i:i + 65_536], stops[i:i + 65_536])], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp)`` for every row: the fingerprint as a signed long."""
    import pyarrow as pa

    bounded_batches(docs.sparkSession)

    def kernel(batches):
        for b in batches:
            fps = [simhash64(t, shingle) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())],
                names=["doc_id", "text_hash", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"),
                      text_of(text_col).alias("text"))
    return src.mapInArrow(kernel, "doc_id long, text_hash long, fp long")


def block_count(n: int, distance: int) -> int:
    """Blocks so that keys hold about the bits of ``n``: more rows, longer keys."""
    want = max(16, int(n).bit_length() - 3)
    b = distance + 2
    while 64 * (b - distance) // b < want and b < distance + 8:
        b += 1
    return b


def block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """Array of long keys, one for each choice of ``blocks - distance`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)), hi - lo) for lo, hi in zip(edges, edges[1:])]
    keys = []
    for combo in itertools.combinations(range(blocks), blocks - distance):
        key = F.lit(0).cast("long")
        for i in combo:
            col, width = parts[i]
            key = F.shiftleft(key, width).bitwiseOR(col)
        keys.append(key)
    return F.array(*keys)


def _close(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the 'at most ``distance`` bits apart' graph on ``fps``.

    Breadth first: a reached fingerprint is compared with those not reached
    yet, in strips, so a dense group ends after few strips.
    """
    left = np.arange(len(fps))
    a, b = [], []
    while len(left):
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            reached = []
            for i in range(0, len(frontier), 64):
                near = (np.bitwise_count(fps[frontier[i:i + 64], None] ^ fps[None, left]) <= distance).any(axis=0)
                reached.append(left[near])
                left = left[~near]
            frontier = np.concatenate(reached)
            a.append(np.full(len(frontier), root))
            b.append(frontier)
    return (fps[np.concatenate(a)], fps[np.concatenate(b)]) if a else (fps[:0], fps[:0])


def _block_edges(distance: int):
    """Kernel over rows sorted by block: complete blocks in, spanning edges out."""
    import pandas as pd

    def edges(gid, fp):
        out_a, out_b = [], []
        start = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
        size = np.diff(np.r_[start, len(gid)])
        small = np.repeat(size <= SMALL, size)
        for d in range(1, min(SMALL, int(size.max()))):
            hit = small[d:] & (gid[d:] == gid[:-d]) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= distance)
            out_a.append(fp[:-d][hit])
            out_b.append(fp[d:][hit])
        for s, n in zip(start[size > SMALL], size[size > SMALL]):
            x, y = _close(fp[s:s + n], distance)
            out_a.append(x)
            out_b.append(y)
        if not out_a:
            return None
        a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    def kernel(batches):
        gids, fps = [], []
        for pdf in batches:
            if not len(pdf):
                continue
            g = pdf["gid"].to_numpy()
            f = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            cut = np.flatnonzero(g[1:] != g[:-1])
            if not len(cut):  # still the same block
                if gids and gids[-1][-1] != g[0]:
                    done = edges(np.concatenate(gids), np.concatenate(fps))
                    gids, fps = [], []
                    if done is not None and len(done):
                        yield done
                gids.append(g)
                fps.append(f)
                continue
            k = cut[-1] + 1
            done = edges(np.concatenate([*gids, g[:k]]), np.concatenate([*fps, f[:k]]))
            gids, fps = [g[k:]], [f[k:]]
            if done is not None and len(done):
                yield done
        if gids:
            done = edges(np.concatenate(gids), np.concatenate(fps))
            if done is not None and len(done):
                yield done

    return kernel


def close_pairs(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Edges ``(a, b)`` that span the groups of fingerprints within ``distance`` bits.

    ``distinct`` has each ``fp`` once.  A block larger than ``SLICE`` is cut
    into slices and every pair of slices is compared in a task of its own,
    so no task holds more than two slices and no pair is left out.
    """
    spark = distinct.sparkSession
    blocks = block_count(distinct.count(), distance)
    keyed = distinct.select("fp", F.posexplode(block_keys(F.col("fp"), blocks, distance)).alias("table", "key"))
    keyed = keyed.select("fp", F.xxhash64("table", "key").alias("gid"))
    shared = keyed.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(shared, "gid")
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    rows = rows.withColumn("c", slices).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("c") - 1),
                                 lambda j: F.struct(F.least("s", j).alias("i"), F.greatest("s", j).alias("j"))))
    rows = rows.select("fp", "gid", "c", pair.alias("p")).select(
        "fp", F.when(F.col("c") == 1, F.col("gid")).otherwise(F.xxhash64("gid", "p.i", "p.j")).alias("gid"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "gid").sortWithinPartitions("gid").mapInPandas(_block_edges(distance), "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id, text_hash, group_fp)``, one row for each row of ``docs``.

    Fingerprints link at ``distance`` or fewer differing bits;
    ``component_id`` is the smallest ``doc_id`` reachable, itself included,
    and ``group_fp`` the smallest fingerprint, which names the group without ids.
    Null and empty texts have the fingerprint zero and link like any other.
    Rows that repeat a ``doc_id`` keep their own fingerprints; a null
    ``doc_id`` takes part but never names a group (null only where a group
    has no other).  Other columns are not read; an empty table gives an
    empty result.
    """
    fps = stage(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-class")
    edges = stage(close_pairs(classes.select("fp"), distance), "simhash-edge")
    comp = connected_components(edges)
    of_class = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("group_fp"))
    low = of_class.groupBy("group_fp").agg(F.min("rep").alias("component_id"))
    ids = stage(of_class.join(low, "group_fp").select("fp", "component_id", "group_fp"), "simhash-id")
    unstage(edges)
    return fps.join(ids, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_hash", "group_fp")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each group: smallest ``doc_id``, then smallest text hash.

    Null ids come last.  Rows equal in id and text count as one document, of
    which the smallest row over all columns stays.  All columns stay.
    """
    groups = stage(simhash_groups(docs, shingle, distance), "simhash-groups")
    first = groups.groupBy("group_fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k"))
    first = first.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    rows = groups.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_n"))
    kept = stage(first.join(rows, first["_id"].eqNullSafe(rows["_id"]) & (first["_hash"] == rows["_hash"]))
                 .select(first["_id"], first["_hash"], "_n"), "simhash-kept")
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_of()) == F.col("_hash"))
    plain = docs.join(kept.where("_n = 1"), on, "left_semi")
    several = kept.where("_n > 1").drop("_n")
    if several.isEmpty():
        return plain
    packed = docs.join(several, on).select("_id", "_hash", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return plain.unionByName(packed.groupBy("_id", "_hash").agg(F.min("_row").alias("_row")).select("_row.*"))
