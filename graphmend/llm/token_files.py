"""Token-id files with Re-Pair grammar compression.

A file row is a block of whole documents in ascending ``doc_id`` order.
Within a block frequent id pairs are replaced again and again by
nonterminals; the block stores the rules, the length of every rule's
expansion and the remaining sequence, so one document is decoded without
expanding the others.  Blocks are written by Spark's Parquet writer, so they
go to any store Spark can write and survive lost executors.

Block payload, little endian: magic, u32 documents, u32 rules, u32 symbols,
u32 first nonterminal, u64 ids; then per document i64 id, u8 null flag and
u64 length; per rule two u32 symbols and a u64 expansion length; u32 numbered
ids (none where symbols below the first nonterminal are the ids themselves)
and each of them as u32; the symbols as u16 when all fit, else u32 (u8 width
before them).
"""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmend.llm.common import bounded_batches, text_of
from graphmend.llm.word_cache import cached_encoder, word_parts

MAGIC = b"GTOK2\0\0\0"
_HEAD = struct.Struct("<8sIIIIQ")
BLOCK_IDS = 1 << 20     # a block is closed once it holds this many ids
NARROW = 1 << 16        # pairs of symbols below this are counted as 32-bit codes, others as 64-bit ones
LEAST = 32              # a pair is replaced when it occurs at least this often


_SLOT_BITS = 18


def _slot(code: np.ndarray) -> np.ndarray:
    bits = 8 * code.itemsize
    return (code * code.dtype.type(0x9E3779B97F4A7C15 >> (64 - bits))) >> code.dtype.type(bits - _SLOT_BITS)


def re_pair(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """``(symbols, first nonterminal, rules, expansion lengths)`` of an id sequence.

    Each round counts all adjacent pairs, gives the frequent ones nonterminals
    and replaces their occurrences from left to right, until no pair occurs
    ``least`` times.  A pair that overlaps others of its round may be left with
    fewer occurrences than counted; with less than a quarter of ``least`` it
    waits for a later round, unless no other is left.
    """
    seq = ids.astype(np.uint32, copy=True)
    base = int(seq.max()) + 1 if len(seq) else 0
    rules: list[np.ndarray] = []
    lengths = np.ones(base, np.int64)
    top = base
    while len(seq) > 1:
        half = np.dtype(np.uint32 if top <= NARROW else np.uint64)
        shift = half.type(4 * half.itemsize)
        code = seq[:-1].astype(half)
        code <<= shift
        code |= seq[1:].astype(half, copy=False)
        ordered = np.sort(code)
        edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        count = np.diff(np.r_[edge, len(ordered)])
        often = np.flatnonzero(count >= least)
        if half.itemsize == 4 and top + len(often) > NARROW:  # more than 16 bits can number: the most frequent first
            room = NARROW - top
            if room and len(often) > room:
                often = often[np.argpartition(count[often], -room)[-room:]]
        if not len(often):
            break
        pairs = ordered[edge[often]]
        # Pairs that share a slot: the more frequent one stays, the others wait for a later round.
        by_count = np.argsort(count[often], kind="stable")
        slot_of = np.zeros(1 << _SLOT_BITS, np.int32)
        slot_of[_slot(pairs[by_count])] = by_count
        which = slot_of[_slot(code)]
        at = np.flatnonzero(pairs[which] == code)
        which = which[at]
        # In a run of overlapping occurrences take every other one.
        start = np.r_[True, at[1:] != at[:-1] + 1]
        take = (at - at[start][np.cumsum(start) - 1]) % 2 == 0
        uses = np.bincount(which[take], minlength=len(pairs))
        made = uses >= min(max(2, least // 4), uses.max())
        if uses.max() < 2:
            break
        take &= made[which]
        at, which = at[take], which[take]
        used = np.flatnonzero(made)
        number = np.zeros(len(pairs), np.uint32)
        number[used] = np.arange(top, top + len(used), dtype=np.uint32)
        seq[at] = number[which]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq.compress(keep)
        new = np.stack([pairs[used] >> shift, pairs[used] & half.type((1 << int(shift)) - 1)], axis=1).astype(np.int64)
        rules.append(new)
        lengths = np.r_[lengths, lengths[new[:, 0]] + lengths[new[:, 1]]]
        top += len(used)
    return seq, base, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), lengths[base:]


def expand_all(symbols: np.ndarray, base: int, rules: np.ndarray, expansion: np.ndarray) -> np.ndarray:
    """``expand`` for a whole block: each rule is written out once, then all symbols are looked up."""
    size = np.r_[np.ones(base, np.int64), expansion]
    if not len(rules) or expansion.sum() > 4 * size[symbols].sum():
        return expand(symbols, base, rules)
    full: list[list[int]] = []
    for a, b in rules.tolist():
        full.append((full[a - base] if a >= base else [a]) + (full[b - base] if b >= base else [b]))
    flat = np.r_[np.arange(base, dtype=np.uint32), np.fromiter(itertools.chain.from_iterable(full), np.uint32, int(expansion.sum()))]
    begin = (np.cumsum(size) - size)[symbols]
    size = size[symbols]
    ends = np.cumsum(size)
    return flat[np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def renumber(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(numbers, the id of each number)`` where ids are too large for narrow symbols, else the ids and no table."""
    if not len(ids) or int(ids.max()) + 1 < NARROW:
        return ids, np.zeros(0, np.uint32)
    table, numbers = np.unique(ids, return_inverse=True)
    return numbers.astype(np.uint32), table.astype(np.uint32)


def expand(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """Ids that ``symbols`` stand for."""
    seq = symbols.astype(np.int64)
    while True:
        non = seq >= base
        if not non.any():
            return seq
        width = np.where(non, 2, 1)
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[at[~non]] = seq[~non]
        pair = rules[seq[non] - base]
        out[at[non]], out[at[non] + 1] = pair[:, 0], pair[:, 1]
        seq = out


def pack_block(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    numbers, table = renumber(ids)
    seq, base, rules, expansion = re_pair(numbers)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return b"".join([
        _HEAD.pack(MAGIC, len(doc_ids), len(rules), len(seq), base, len(ids)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array(lengths, "<u8").tobytes(), rules.astype("<u4").tobytes(), expansion.astype("<u8").tobytes(),
        struct.pack("<I", len(table)), table.astype("<u4").tobytes(), bytes([width]), seq.astype(f"<u{width}").tobytes()])


class Block:
    """Random access to the documents of one payload."""

    def __init__(self, payload: bytes):
        magic, docs, rules, symbols, self.base, self.n_ids = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = _HEAD.size

        def take(dtype, n):
            nonlocal at
            a = np.frombuffer(payload, dtype, n, at)
            at += a.nbytes
            return a

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.expansion = expansion = take("<u8", rules).astype(np.int64)
        self.table = take("<u4", int(take("<u4", 1)[0]))
        width = int(take("u1", 1)[0])
        self.symbols = take(f"<u{width}", symbols)
        size = np.ones(symbols, np.int64)
        non = self.symbols >= self.base
        size[non] = expansion[self.symbols[non].astype(np.int64) - self.base]
        self.ends = np.cumsum(size)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def document(self, i: int) -> np.ndarray:
        """Ids of document ``i`` of the block, expanding only the symbols it needs."""
        lo, hi = int(self.starts[i]), int(self.starts[i] + self.lengths[i])
        a, z = np.searchsorted(self.ends, [lo, hi - 1], side="right")
        before = int(self.ends[a - 1]) if a else 0
        return self._ids(expand(self.symbols[a:z + 1], self.base, self.rules))[lo - before:hi - before]

    def all(self) -> np.ndarray:
        return self._ids(expand_all(self.symbols, self.base, self.rules, self.expansion))

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        return self.table[numbers] if len(self.table) else numbers


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write blocks below ``path``.

    Documents are in ascending ``doc_id`` order (nulls first, equal ids by
    text).  Null and empty texts are just the end id.  Rows that repeat stay.
    Other columns are not read.  An empty table writes no block.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark, 4)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                        ("payload", pa.binary())])

    def kernel(batches):
        from pyspark import TaskContext

        enc = cached_encoder(tokenizer, word_parts)
        part, block = TaskContext.get().partitionId(), 0
        doc_ids, parts, total = [], [], 0

        def close():
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [[part], [block], [len(doc_ids)], [len(ids)], [pack_block(doc_ids, [len(p) // 4 for p in parts], ids)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for b in batches:
            ids_of, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(texts), 256):
                for d, x in zip(ids_of[i:i + 256], enc.encode(texts[i:i + 256])):
                    doc_ids.append(d)
                    parts.append(x + end)
                    total += len(x) // 4 + 1
                    if total >= BLOCK_IDS:
                        yield close()
                        doc_ids, parts, total, block = [], [], 0, block + 1
        if doc_ids:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    ordered = src.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(kernel, "part long, block long, n_docs long, n_ids long, payload binary").write.option(
        "compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of the files: ``(doc_id, start, n_tokens, ids)``, or ``ids_crc32`` for ``ids`` with ``digest``.

    ``start`` counts the ids of all documents before: a running sum within
    each written part plus the totals of the parts before it (one row a part).
    """
    import pyarrow as pa

    bounded_batches(spark)
    blocks = spark.read.schema("part long, block long, n_docs long, n_ids long, payload binary").parquet(path)
    sizes = blocks.select("part", "block", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("part").orderBy("block")
    at = sizes.withColumn("inner", F.sum("n_ids").over(inner) - F.col("n_ids")).join(before, "part").select(
        "part", "block", (F.col("inner") + F.col("before")).alias("at"))

    def kernel(batches):
        for b in batches:
            for part, block, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                blk = Block(payload)
                n = len(blk.doc_ids)
                if digest:
                    data = memoryview(blk.all().astype("<u4").tobytes())
                    cuts = zip((4 * blk.starts).tolist(), (4 * (blk.starts + blk.lengths)).tolist())
                    tail = pa.array([zlib.crc32(data[a:z]) for a, z in cuts], pa.int64())
                else:
                    tail = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(blk.lengths)], pa.int32()),
                                                    pa.array(blk.all().astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part)), pa.array(np.full(n, block)), pa.array(blk.doc_ids, pa.int64()), pa.array(blk.starts, pa.int64()),
                     pa.array(blk.lengths, pa.int64()), tail], names=["part", "block", "doc_id", "inside", "n_tokens", last])

    # Only the rows of documents meet the blocks' offsets, never the payloads.
    last = "ids_crc32" if digest else "ids"
    out = "part long, block long, doc_id long, inside long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")
    docs = blocks.select("part", "block", "payload").mapInArrow(kernel, out).join(at, ["part", "block"])
    return docs.select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", last)
