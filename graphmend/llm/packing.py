"""Best-fit packing of documents into sequences, improved by swaps.

Documents are encoded and cut into pieces of at most one sequence; full
pieces are sequences of their own.  The others are packed by best fit and a
local search: documents move, change places one for one or two for one
between underfull bins whenever that raises the sum of squared fills, until
no such step is left.  A bin whose fill reaches zero is gone.

Each task packs the pieces it has just encoded, ``CELL`` at a time, and keeps
the bins that are exactly full, so their ids never move.  The pieces of all
other bins are dealt over cells by a hash and packed once more.  Cells lose at
most about one bin each against packing everything at once.
"""

from __future__ import annotations

import itertools
import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmend.llm.common import bounded_batches, stage, text_of
from graphmend.llm.word_cache import byte_bpe_parts, cached_encoder

CELL = 25_000  # pieces packed together in one task
OUT_ROWS = 256  # pieces handed back at once: 1 MB of ids


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that takes it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - n
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins


class _Search:
    """Underfull bins, found by their room and by what a swap could replace in them.

    ``replaceable[s]`` has, by size, the documents that a length of ``s`` can
    take the place of so that their bin is exactly full.  Bit masks tell which
    rooms, lengths and sizes there are.
    """

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size, self.capacity = bins, size, capacity
        self.fill = [sum(size[i] for i in b) for b in bins]
        self.rooms: dict[int, set[int]] = {}
        self.replaceable: dict[int, dict[int, set[tuple[int, int]]]] = {}
        self.room_mask = self.length_mask = 0
        self.size_mask: dict[int, int] = {}

    def enter(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        self.rooms.setdefault(room, set()).add(b)
        self.room_mask |= 1 << room
        for i in self.bins[b]:
            n = self.size[i]
            self.replaceable.setdefault(n + room, {}).setdefault(n, set()).add((b, i))
            self.length_mask |= 1 << (n + room)
            self.size_mask[n + room] = self.size_mask.get(n + room, 0) | 1 << n

    def leave(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        self.rooms[room].discard(b)
        if not self.rooms[room]:
            self.room_mask &= ~(1 << room)
        for i in self.bins[b]:
            n = self.size[i]
            at = self.replaceable[n + room][n]
            at.discard((b, i))
            if not at:
                self.size_mask[n + room] &= ~(1 << n)
                if not self.size_mask[n + room]:
                    self.length_mask &= ~(1 << (n + room))

    def partner(self, c: int, n: int) -> tuple[int, int | None] | None:
        """A bin that gains by ``n`` from the bin ``c``, and the document it gives back if any: the tightest one."""
        room = _at_least(self.room_mask, n)
        # A bin found at length s ends with a fill of capacity - s + n, which has to exceed the fill of c.
        s, most = _at_least(self.length_mask, n), self.capacity + n - self.fill[c]
        while s and s < most and (not room or s < room):
            low = _lowest(self.size_mask[s])
            if low < n:
                return next(iter(self.replaceable[s][low]))
            s = _at_least(self.length_mask, s + 1)
        return (next(iter(self.rooms[room])), None) if room and room < most else None

    def give(self, c: int, docs: tuple[int, ...]) -> int | None:
        """Give documents of the bin ``c``, which is not entered, to a partner; the partner's number."""
        n = sum(self.size[i] for i in docs)
        found = self.partner(c, n)
        if found is None:
            return None
        b, back = found
        self.leave(b)
        for i in docs:
            self.bins[c].remove(i)
            self.bins[b].append(i)
        if back is not None:
            self.bins[b].remove(back)
            self.bins[c].append(back)
            n -= self.size[back]
        self.fill[b] += n
        self.fill[c] -= n
        if self.fill[b] < self.capacity:
            self.enter(b)
        return b


def _lowest(mask: int) -> int:
    return (mask & -mask).bit_length() - 1


def _at_least(mask: int, n: int) -> int:
    rest = mask >> n
    return n + _lowest(rest) if rest else 0


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search over the underfull bins; every step raises the sum of squared fills.

    A bin gives documents to fuller ones: a move into free room, an exchange of
    one for a shorter one, or of two for one that is shorter than both together.
    A step shifts ``d > 0`` of length from bin ``c`` to ``b`` with
    ``fill(b) + d > fill(c)``, so squared fill grows each time and the search
    ends.  The emptiest bins start; a changed bin is looked at again, until no
    step is left for any bin or no fewer bins are possible.  Documents of equal
    length stand for one another, so pairs are tried by distinct lengths.
    """
    size = [int(x) for x in lengths]
    s = _Search(bins, size, capacity)
    least, alive = -(-sum(size) // capacity), len(bins)
    under = [b for b in range(len(bins)) if s.fill[b] < capacity]
    for b in under:
        s.enter(b)
    waiting, due = deque(sorted(under, key=s.fill.__getitem__)), set(under)
    while waiting and alive > least:
        c = waiting.popleft()
        due.discard(c)
        if not bins[c] or s.fill[c] >= capacity:
            continue
        s.leave(c)
        changed = False
        while bins[c]:
            of = {}
            for i in bins[c]:
                of.setdefault(size[i], []).append(i)
            own = sorted(of, reverse=True)
            steps = itertools.chain(((of[n][0],) for n in own), ((of[n][0], of[m][m == n]) for k, n in enumerate(own) for m in own[k:] if m != n or len(of[n]) > 1))
            b = next((x for x in map(lambda docs: s.give(c, docs), steps) if x is not None), None)
            if b is None:
                break
            changed = True
            if s.fill[b] < capacity and b not in due:
                waiting.append(b)
                due.add(b)
        if bins[c]:
            s.enter(c)
            if changed and c not in due:
                waiting.append(c)
                due.add(c)
        else:
            alive -= 1
    return [b for b in bins if b]


def _places(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed pieces in the order of their bins: ``(piece, bin, offset, whether its bin is full)``."""
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    which = np.concatenate([np.asarray(b, np.int64) for b in bins])
    seq = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    size = lengths[which]
    fill = np.bincount(seq, size, len(bins)).astype(np.int64)
    begins = np.cumsum(size) - size
    return which, seq, begins - (np.cumsum(fill) - fill)[seq], (fill == capacity)[seq]


def _pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Pieces of all documents; ``sequence_id`` and ``offset`` are null where their bin is not full yet."""
    import pyarrow as pa

    bounded_batches(docs.sparkSession, 4)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids" if with_ids else "ids_crc32", "sequence_id", "offset"]

    def batch(cols, ids, seq, offset):
        """Rows of numpy columns and id bytes."""
        if with_ids:
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        else:
            tail = pa.array([zlib.crc32(x) for x in ids], pa.int64())
        open_ = seq < 0
        doc, null, piece, start, length = cols
        return pa.RecordBatch.from_arrays([
            pa.array(doc, mask=null), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), tail,
            pa.array(seq, mask=open_), pa.array(offset, mask=open_)], names=names)

    def kernel(batches):
        from pyspark import TaskContext

        enc = cached_encoder(tokenizer, byte_bpe_parts)
        number = TaskContext.get().partitionId() << 33
        held, held_ids = [], []
        pa.default_memory_pool().release_unused()  # the worker may have run other stages before

        def pack():
            nonlocal number
            cols = [np.concatenate(c) for c in zip(*held)]
            which, seq, offset, full = _places(cols[4], capacity)
            seq = np.where(full, number + seq, -1)
            number = max(number, int(seq.max()) + 1)
            held.clear()
            for s in range(0, len(which), OUT_ROWS):
                w = which[s:s + OUT_ROWS]
                yield batch([c[w] for c in cols], [held_ids[i] for i in w.tolist()], seq[s:s + OUT_ROWS], offset[s:s + OUT_ROWS])
                for i in w.tolist():
                    held_ids[i] = b""  # handed back
            held_ids.clear()
            pa.default_memory_pool().release_unused()

        for b in batches:
            doc_ids, texts = b.column(0), b.column(1).to_pylist()
            for i in range(0, len(texts), 512):
                ids = [x + end for x in enc.encode(texts[i:i + 512])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = np.where(n % capacity, n % capacity, capacity)[doc]
                start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first)
                mine = doc_ids.slice(i, len(n))
                cols = [np.asarray(mine.fill_null(0))[doc], np.asarray(mine.is_null())[doc], piece, start, length]
                parts = [ids[d] if not k and z == m else ids[d][4 * a:4 * (a + z)]
                         for d, k, a, z, m in zip(doc.tolist(), piece.tolist(), start.tolist(), length.tolist(), n[doc].tolist())]
                full = length == capacity
                if full.any():
                    w = np.flatnonzero(full)
                    seq = number + np.arange(len(w))
                    number += len(w)
                    yield batch([c[w] for c in cols], [parts[j] for j in w.tolist()], seq, np.zeros(len(w), np.int64))
                w = np.flatnonzero(~full)
                held.append([c[w] for c in cols])
                held_ids += [parts[j] for j in w.tolist()]
                if len(held_ids) >= CELL:
                    yield from pack()
        if held_ids:
            yield from pack()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return src.mapInArrow(kernel, "doc_id long, piece int, start long, length long, "
                          + ("ids array<int>" if with_ids else "ids_crc32 long") + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids, sequence_id, offset)`` of every piece.

    ``ids`` is the piece's token ids; without ``with_ids`` their CRC-32
    ``ids_crc32`` (unsigned, little-endian unsigned 32-bit ids).  Only
    documents longer than ``capacity`` are cut; their first piece holds what is
    left over, the others are full.  Null and empty texts are one piece of the
    end id.  Repeated rows and null ids are documents of their own.  Other
    columns are not read.  An empty table gives an empty result.
    """
    import pandas as pd

    last = "ids" if with_ids else "ids_crc32"
    cut = _pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)
    pieces = stage(cut.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    cols = ["doc_id", "piece", "start", "length", last]
    full = pieces.where("sequence_id is not null").drop("row")
    part = pieces.where("sequence_id is null").select(*cols, "row")
    cells = max(1, -(-part.count() // CELL))
    # Only row numbers and lengths go to the cells.
    dealt = part.select("row", "length").withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("long"))

    def pack(key, pdf):
        pdf = pdf.sort_values("row", ignore_index=True)
        which, seq, offset, _ = _places(pdf["length"].to_numpy(), capacity)
        return pd.DataFrame({"row": pdf["row"].to_numpy()[which], "sequence_id": -1 - ((int(key[0]) << 32) + seq), "offset": offset})

    placed = dealt.groupBy("cell").applyInPandas(pack, "row long, sequence_id long, offset long")
    return full.unionByName(part.join(placed, "row").drop("row"))


def id_digests(packed: DataFrame) -> DataFrame:
    """``packed`` with ``ids_crc32`` in place of ``ids``: CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    import pyarrow as pa

    cols = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    bounded_batches(packed.sparkSession, 4)

    def kernel(batches):
        for b in batches:
            ids = b.column(4)
            at, values = ids.offsets.to_pylist(), memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B")
            crc = pa.array([zlib.crc32(values[4 * s:4 * e]) for s, e in zip(at, at[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([crc if i == 4 else b.column(i) for i in range(len(cols))],
                                             names=["ids_crc32" if c == "ids" else c for c in cols])

    return packed.select(*cols).mapInArrow(
        kernel, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
