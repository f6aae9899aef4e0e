"""Compression of vectors to codes by integer k-means over parts.

A vector's components become integers ``floor(scale * x)`` and are cut into
equal parts; each part position has a codebook of its own, improved by rounds
of k-means in which all arithmetic is exact.

Vectors are gathered in chunks of bounded size.  Within a chunk the parts of
each position are sorted along a Hilbert curve and cut into flat blocks that
keep their box (least and greatest component) and their sum.  A round never
compares every part with every entry: an entry whose least distance to a
block's box exceeds the smallest greatest distance of any entry cannot be
nearest to a member, so the box distances leave a shortlist for each block.
A shortlist of one entry takes the whole block by its stored sum; the others
are evaluated by an integer kernel.  Chunks never move between tasks; only
sums by entry are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmend.llm.common import bounded_batches, stage, unstage
from graphmend.operators.joins import lookup_join

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK = 32                 # parts of a block
CHUNK_VALUES = 1 << 21     # components of a chunk
LARGEST = 1 << 26          # greatest size of an integer component: distances and sums stay within 64 bits
BOOK_VALUES = 8_000_000    # components of all codebooks together that are broadcast
_CURVE_DIMS = 8            # components of a part that the curve follows


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (unsigned, below ``2**bits``) on the Hilbert curve."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the curve's rotations, from the highest bit on
        q = np.uint64(1 << b)
        low = q - one
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, t)
            x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] & np.uint64(1 << b) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def curve_order(values: np.ndarray) -> np.ndarray:
    """Order of the rows along a Hilbert curve through their widest components."""
    if values.shape[1] == 0 or len(values) < 2:
        return np.arange(len(values))
    spread = values.max(axis=0) - values.min(axis=0)
    dims = np.sort(np.argsort(-spread, kind="stable")[:_CURVE_DIMS])
    v = values[:, dims] - values[:, dims].min(axis=0)
    bits = max(1, min(60 // len(dims), 10))
    top = int(v.max()) + 1
    cells = (v * (1 << bits)) // top if top > (1 << bits) else v
    return np.argsort(hilbert_keys(cells, bits), kind="stable")


def shortlists(lo: np.ndarray, hi: np.ndarray, book: np.ndarray) -> np.ndarray:
    """``(blocks, entries)``: which entries can be nearest to a member of a block."""
    near = np.zeros((len(lo), len(book)), np.int64)
    far = np.zeros_like(near)
    for j in range(book.shape[1]):
        e, a, z = book[None, :, j], lo[:, j, None], hi[:, j, None]
        gap = np.maximum(np.maximum(a - e, e - z), 0)
        near += gap * gap
        gap = np.maximum(e - a, z - e)
        far += gap * gap
    return near <= far.min(axis=1, keepdims=True)


def nearest_entries(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, book: np.ndarray, block: int, settle: bool = False):
    """``(entry of each row, -1 where its block is settled, entry of each settled block or -1)``.

    ``values`` holds whole blocks in order, then a shorter last one.  Ties go to
    the lower entry.  With ``settle`` blocks with a shortlist of one are not evaluated.
    """
    n = len(values)
    allowed = shortlists(lo, hi, book)
    size = allowed.sum(axis=1)
    whole = np.where((size == 1) & settle, allowed.argmax(axis=1), -1)
    entry = np.full(n, -1, np.int64)
    todo = np.flatnonzero(whole < 0)
    ranked = np.argsort(~allowed, axis=1, kind="stable")  # a block's shortlist first, ascending
    widths = np.minimum(1 << np.ceil(np.log2(size)).astype(int), allowed.shape[1])
    for width in np.unique(widths[todo]).tolist():
        blocks = todo[widths[todo] == width]
        step = max(1, (1 << 21) // (width * block))
        for s in range(0, len(blocks), step):
            some = blocks[s:s + step]
            # Past its size a shortlist repeats its last entry, which a tie never prefers.
            pick = ranked[some[:, None], np.minimum(np.arange(width)[None, :], size[some, None] - 1)]
            rows = some[:, None] * block + np.arange(block)[None, :]
            x = values[np.minimum(rows, n - 1)]
            d = np.zeros((len(some), block, width), np.int64)
            for j in range(values.shape[1]):
                gap = x[:, :, j, None] - book[pick, j][:, None, :]
                d += gap * gap
            best = np.take_along_axis(pick, d.argmin(axis=2), axis=1)
            real = rows < n
            entry[rows[real]] = best[real]
    return entry, whole


class Chunk:
    """Vectors of one length as Hilbert-sorted blocks for each part position."""

    def __init__(self, rows: np.ndarray, parts: int, block: int):
        n, dim = rows.shape
        self.n, self.parts, self.block = n, parts, block
        self.width = -(-dim // parts)
        if self.width * parts != dim:
            rows = np.concatenate([rows, np.zeros((n, self.width * parts - dim), rows.dtype)], axis=1)
        self.cuts = np.arange(0, n, block)
        self.order, self.values = [], []
        for p in range(parts):
            v = rows[:, p * self.width:(p + 1) * self.width]
            order = curve_order(v)
            self.order.append(order.astype(np.int32))
            self.values.append(v[order])
        self._boxes()

    def _boxes(self):
        cut = self.cuts
        self.lo = [np.minimum.reduceat(v, cut, axis=0) for v in self.values]
        self.hi = [np.maximum.reduceat(v, cut, axis=0) for v in self.values]
        self.sums = [np.add.reduceat(v, cut, axis=0) for v in self.values]
        self.sizes = np.diff(np.r_[cut, self.n])

    def pack(self) -> bytes:
        return b"".join(np.concatenate([np.asarray(x) for x in xs]).astype(t).tobytes() for xs, t in (
            (self.values, "<i4"), (self.order, "<i4"), (self.lo, "<i4"), (self.hi, "<i4"), (self.sums, "<i8")))

    @classmethod
    def unpack(cls, data: bytes, n: int, width: int, parts: int, block: int) -> "Chunk":
        c = cls.__new__(cls)
        c.n, c.parts, c.block, c.width = n, parts, block, width
        c.cuts = np.arange(0, n, block)
        at, nb = 0, len(c.cuts)

        def take(t, rows, cols):
            nonlocal at
            a = np.frombuffer(data, t, parts * rows * cols, at).reshape(parts, rows, cols)
            at += a.nbytes
            return list(a.astype(np.int64))

        c.values = take("<i4", n, width)
        c.order = [o[:, 0] for o in take("<i4", n, 1)]
        c.lo, c.hi, c.sums = take("<i4", nb, width), take("<i4", nb, width), take("<i8", nb, width)
        c.sizes = np.diff(np.r_[c.cuts, n])
        return c

    def add_to(self, books: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
        """Add the members of each entry: settled blocks by their sums, the others one by one."""
        for p in range(self.parts):
            entry, whole = nearest_entries(self.values[p], self.lo[p], self.hi[p], books[p], self.block, settle=True)
            done = whole >= 0
            np.add.at(total[p], whole[done], self.sums[p][done])
            np.add.at(count[p], whole[done], self.sizes[done])
            single = entry >= 0
            count[p] += np.bincount(entry[single], minlength=len(books[p]))
            for j in range(self.width):
                # Sums of doubles below 2**53 are exact; the chunk's bound keeps them there.
                total[p][:, j] += np.bincount(entry[single], self.values[p][single, j].astype(float), len(books[p])).astype(np.int64)

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(codes, errors)`` of the vectors in their first order."""
        code, error = np.zeros((self.n, self.parts), np.uint8), np.zeros(self.n, np.int64)
        for p in range(self.parts):
            entry, _ = nearest_entries(self.values[p], self.lo[p], self.hi[p], books[p], self.block)
            gap = self.values[p] - books[p][entry]
            code[self.order[p], p] = entry
            error[self.order[p]] += (gap * gap).sum(axis=1)
        return code, error


def _kept(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, dim, x)`` of vectors without null or non-finite components."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col(vec_col).isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.size(x).cast("long").alias("dim"), x.alias("x"))


def _chunks(kept: DataFrame, parts: int, scale: int, block: int) -> DataFrame:
    """``(dim, n, ids, labels, data)``: one row a chunk."""
    import pyarrow as pa

    schema = pa.schema([("dim", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("data", pa.binary())])

    def kernel(batches):
        waiting: dict[int, list] = {}

        def close(dim):
            got = waiting.pop(dim)
            rows = np.concatenate([g[2] for g in got])
            ids, labels = [i for g in got for i in g[0]], [x for g in got for x in g[1]]
            row = ([dim], [len(rows)], [ids], [labels], [Chunk(rows, parts, block).pack()])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        held = 0
        for b in batches:
            dims = b.column(2).to_numpy()
            flat, ends = b.column(3).flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
            flat = np.floor(scale * flat)
            if len(flat) and np.abs(flat).max() > LARGEST:
                raise ValueError(f"a component exceeds {LARGEST} after scaling")
            flat = flat.astype(np.int64)
            ids, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                most = max(1, CHUNK_VALUES // max(dim, 1))
                for s in range(0, len(rows), most):
                    r = rows[s:s + most]
                    x = flat[(ends[r] - dim)[:, None] + np.arange(dim)[None, :]]
                    waiting.setdefault(dim, []).append(([ids[i] for i in r.tolist()], [labels[i] for i in r.tolist()], x))
                    held += len(r) * (dim + 1)
                    if sum(len(g[0]) for g in waiting[dim]) >= most:
                        held -= sum(len(g[0]) for g in waiting[dim]) * (dim + 1)
                        yield close(dim)
                    elif held > 2 * CHUNK_VALUES:
                        for d in list(waiting):
                            yield close(d)
                        held = 0
        for d in list(waiting):
            yield close(d)

    return kept.mapInArrow(kernel, "dim long, n long, ids array<long>, labels array<string>, data binary")


def _first_books(kept: DataFrame, parts: int, entries: int, scale: int) -> DataFrame:
    """``(dim, book)``: parts of the vectors with the smallest ids, flat by part, entry, component.

    Equal ids are ordered by a hash of the integer components; a null id is the last.
    The smallest are taken within 256 groups of ids first, so no task sees all ids.
    """
    ints = F.transform("x", lambda v: F.floor(v * scale).cast("long"))
    ids = kept.select("dim", "vec_id", ints.alias("i")).select("dim", "vec_id", F.xxhash64("i").alias("h"), F.pmod(F.xxhash64("vec_id", "i"), F.lit(256)).alias("g"))
    rank = [F.col("vec_id").asc_nulls_last(), F.col("h")]
    some = ids.withColumn("r", F.row_number().over(Window.partitionBy("dim", "g").orderBy(*rank))).where(F.col("r") <= entries)
    least = some.withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy(*rank))).where(F.col("r") <= entries).select(
        F.col("dim").alias("d"), F.col("vec_id").alias("id"), F.col("h").alias("hash"), "r")
    # Rows that repeat both id and components stand for one another, so any of them gives the entry.
    rows = kept.select("dim", "vec_id", ints.alias("i")).withColumn("h", F.xxhash64("i"))
    same = (F.col("dim") == F.col("d")) & F.col("vec_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))
    found = rows.join(least, same).groupBy("dim", "r").agg(F.any_value("i").alias("i"))
    width = F.ceil(F.col("dim") / parts).cast("int")
    padded = F.concat("i", F.array_repeat(F.lit(0).cast("long"), (width * parts - F.col("dim")).cast("int")))
    by_part = found.select("dim", "r", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(padded, p * width + 1, width))).alias("p", "v"))
    return by_part.groupBy("dim").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", "r", "v"))), lambda s: s["v"])).alias("book"))


def _with_books(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """Chunks beside the codebooks of their length, broadcast if all of them together are small."""
    size = books.agg(F.coalesce(F.sum(F.size("book")), F.lit(0))).first()[0]
    return chunks.join(F.broadcast(books) if size <= BOOK_VALUES else books, "dim")


def _shaped(book, parts: int, width: int) -> np.ndarray:
    flat = np.asarray(book, np.int64)
    entries = len(flat) // (parts * width) if width else 1
    return flat.reshape(parts, entries, width)


def _round(chunks: DataFrame, books: DataFrame, parts: int, block: int) -> DataFrame:
    """Codebooks after one round: the floored mean of each entry's parts; unused entries stay."""
    import pyarrow as pa

    def kernel(batches):
        sums = {}
        for b in batches:
            for dim, n, data, book in zip(*(b.column(i).to_pylist() for i in range(4))):
                width = -(-dim // parts)
                shaped = _shaped(book, parts, width)
                if dim not in sums:
                    sums[dim] = np.zeros(shaped.shape, np.int64), np.zeros(shaped.shape[:2], np.int64)
                Chunk.unpack(data, n, width, parts, block).add_to(shaped, *sums[dim])
        for dim, (total, count) in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([dim], pa.int64()), pa.array([total.reshape(-1)], pa.list_(pa.int64())),
                pa.array([np.repeat(count.reshape(-1), total.shape[2])], pa.list_(pa.int64()))], names=["dim", "total", "count"])

    made = _with_books(chunks.select("dim", "n", "data"), books).select("dim", "n", "data", "book").mapInArrow(
        kernel, "dim long, total array<long>, count array<long>")
    added = made.select("dim", F.posexplode(F.arrays_zip("total", "count")).alias("i", "s")).groupBy("dim", "i").agg(
        F.sum("s.total").alias("total"), F.sum("s.count").alias("count"))
    old = books.select("dim", F.posexplode("book").alias("i", "old"))
    mean = F.expr("(total - pmod(total, count)) div count")
    new = old.join(added, ["dim", "i"], "left").select("dim", "i", F.when(F.col("count") > 0, mean).otherwise(F.col("old")).alias("v"))
    listed = new.groupBy("dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("book"))
    empty = books.where(F.size("book") == 0)
    return stage(listed.unionByName(empty), "codes-books")


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
                     id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(codes, codebooks)``: ``(vec_id, label, dim, code, error)`` of every kept vector, and ``(dim, book)``.

    Vectors that are null or hold null or non-finite components are dropped.
    ``code`` has two hex digits a part; ``error`` is the squared distance to the
    coded vector.  Vectors of every length get codebooks of their own; where
    a length is no multiple of ``parts``, zeros are added at the end.  An empty
    vector has codes and error zero.  Fewer vectors than ``entries`` give as
    many entries.  Rows that repeat are coded each; null ids and labels stay
    null.  A component above ``LARGEST`` after scaling is an error.  Other
    columns are not read.  An empty table gives empty results.
    """
    import pyarrow as pa

    if not 1 <= entries <= 256:
        raise ValueError("a code has room for 256 entries")
    bounded_batches(vectors.sparkSession)
    kept = _kept(vectors, id_col, vec_col, label_col)
    chunks = stage(_chunks(kept, parts, scale, block), "codes-chunks")
    books = stage(_first_books(kept, parts, entries, scale), "codes-books")
    for _ in range(rounds):
        books, old = _round(chunks, books, parts, block), books
        unstage(old)

    def kernel(batches):
        for b in batches:
            for dim, n, ids, labels, data, book in zip(*(b.column(i).to_pylist() for i in range(6))):
                width = -(-dim // parts)
                code, error = Chunk.unpack(data, n, width, parts, block).codes(_shaped(book, parts, width))
                text = code.tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(np.full(n, dim)),
                    pa.array([text[i:i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error)],
                    names=["vec_id", "label", "dim", "code", "error"])

    codes = _with_books(chunks, books).select("dim", "n", "ids", "labels", "data", "book")
    codes = codes.select("dim", "n", "ids", "labels", "data", "book").mapInArrow(kernel, "vec_id long, label string, dim long, code string, error long")
    return stage(codes, "codes"), books


def decode(code: str, book, dim: int, parts: int = PARTS) -> np.ndarray:
    """The coded vector's integer components."""
    width = -(-dim // parts)
    shaped = _shaped(book, parts, width)
    return np.concatenate([shaped[p, int(code[2 * p:2 * p + 2], 16)] for p in range(parts)])[:dim]


def code_report(vectors: DataFrame, **columns) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``: codes with the error of each label and a digest of the codebooks."""
    codes, books = compress_vectors(vectors, **columns)
    digest = books.select("dim", F.sha2(F.array_join(F.transform("book", lambda v: v.cast("string")), ",").cast("binary"), 256).alias("codebooks_sha256"))
    keyed = codes.withColumn("no_label", F.col("label").isNull()).withColumn("label", F.coalesce("label", F.lit("")))
    errors = keyed.groupBy("label", "no_label").agg(F.sum("error").alias("label_error"))
    out = lookup_join(lookup_join(keyed, errors, ["label", "no_label"]), digest, ["dim"])
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
