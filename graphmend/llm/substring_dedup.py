"""Removal of repeated passages by compacting a De Bruijn graph of words.

Every window of ``k`` consecutive words is an edge of the graph; its nodes
are the ``k - 1`` words before and after.  Only edges that documents share
matter, so the steps are:

1. A window's *minimizer* is the smallest hash among its ``SEED``-word
   sequences.  Equal windows have equal minimizers, and neighbouring windows
   mostly share theirs, so a run of windows costs one narrow row.  Minimizers
   of one document only are dropped.  Where all runs of a minimizer are the
   same, the run is a nonbranching path already and stays one unit; the
   windows of the other runs become units of their own, keyed by a 64-bit hash.
2. An aggregate gives each unit its count, least and greatest document and
   *source*: its smallest coordinate, a word's place in the whole table.
3. A unit continues its predecessor's path if it follows it in every
   occurrence and both occur equally often.  Then their sources are
   neighbours too, so nonbranching paths are runs of sources: joins mark where
   paths begin, and a window in the source document numbers them.  Every
   occurrence of a path is a whole copy of it: one row instead of one a window.
4. Each occurrence's words are read back at its coordinates and their
   digests compared by path.  Where a path's digests differ (a hash collision),
   its windows are compared one by one by digest instead, so the result is
   exact.
"""

from __future__ import annotations

import hashlib
from itertools import chain, compress

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmend.llm.common import bounded_batches, stage, unstage

K = 13              # words of a window
SEED = 5            # words of a minimizer
WORDS = 2_000_000   # hashes of words that a worker remembers
_PART_BITS = 40     # words a written part can hold: its number is above these bits
_LAST = (1 << 63) - 1   # stands for a null doc_id: smaller than none
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def _sequences(words: np.ndarray, k: int, factor: np.uint64) -> np.ndarray:
    """A hash of every ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    h = words[:n].copy()
    for i in range(1, k):
        h *= factor
        h += words[i:i + n]
    return _mix(h)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    return _sequences(words, k, _A).view(np.int64)


def minimizers(words: np.ndarray, k: int) -> np.ndarray:
    """Smallest hash of the seed sequences in each window."""
    seed = min(SEED, k)
    h = _sequences(words, seed, _B)
    n = len(words) - k + 1
    m = h[:n].copy()
    for i in range(1, k - seed + 1):
        np.minimum(m, h[i:i + n], out=m)
    return m.view(np.int64)


class _Hashes(dict):
    """Word -> unsigned 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES = _Hashes()


def _split(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Each text's words, their number, and the place of the first among those of all texts."""
    lists = [t.split() for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return lists, n, np.cumsum(n) - n


def _hashed(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, each text's first place and number of words, and which places begin a window."""
    lists, n, first = _split(texts)
    words = _HASHES.of(list(chain.from_iterable(lists)))
    begins = np.ones(len(words), bool)
    for i in range(1, k):  # the last k - 1 words of a text
        last = (first + n - i)[n >= i]
        begins[last] = False
    return words, first, n, begins


def _hashed_at(lists: list[list[bytes]], begin: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Word hashes of all texts one after another; only those of ``n`` windows from each place ``begin``, the others are zero."""
    words = np.zeros(sum(map(len, lists)), np.uint64)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, begin + n + k - 1, -1)
    on = np.cumsum(depth[:-1]) > 0
    words[on] = _HASHES.of(list(compress(chain.from_iterable(lists), on.tolist())))
    return words


def _table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(at, doc_id, doc, text, n_words)`` written: ``at`` is the coordinate of the first word, unique for each row."""
    import pyarrow as pa

    bounded_batches(docs.sparkSession, 4)
    schema = pa.schema([("at", pa.int64()), ("doc_id", pa.int64()), ("doc", pa.int64()), ("text", pa.binary()), ("n_words", pa.int64())])

    def kernel(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << _PART_BITS
        for b in batches:
            n = np.fromiter((len(t.split()) for t in b.column(2).to_pylist()), np.int64, b.num_rows)
            ends = at + np.cumsum(n + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ends - n - 1), b.column(0), b.column(1), b.column(2), pa.array(n)], schema=schema)
            at = int(ends[-1]) if len(ends) else at

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return stage(src.mapInArrow(kernel, "at long, doc_id long, doc long, text binary, n_words long"), "passages-docs")


def _runs(table: DataFrame, k: int) -> DataFrame:
    """Runs of windows with one minimizer: ``(m, x, at, c, n, doc)``; ``x`` hashes the run's windows."""
    import pyarrow as pa

    names = ["m", "x", "at", "c", "n", "doc"]

    def kernel(batches):
        for b in batches:
            words, first, lengths, begins = _hashed(b.column(2).to_pylist(), k)
            if not begins.any():
                continue
            m, h = minimizers(words, k), window_hashes(words, k)
            on = begins[:len(m)]
            row = np.repeat(np.arange(len(lengths)), lengths)[:len(m)]
            edge = np.r_[True, (m[1:] != m[:-1]) | (row[1:] != row[:-1]) | ~on[:-1]] & on
            start = np.flatnonzero(edge)
            ends = np.flatnonzero(np.r_[edge[1:] | ~on[1:], True] & on) + 1
            position = np.arange(len(m))
            place = position - start[np.maximum(np.cumsum(edge) - 1, 0)]
            weighed = np.where(on, h.view(np.uint64) * (2 * place + 1).astype(np.uint64), np.uint64(0))
            x = _mix(np.add.reduceat(weighed, start)).view(np.int64)
            r = row[start]
            at = b.column(0).to_numpy()[r]
            cols = (m[start], x, at, at + start - first[r], ends - start, b.column(1).to_numpy()[r])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in cols], names=names)

    return table.where(F.col("n_words") >= k).select("at", "doc", "text").mapInArrow(kernel, ", ".join(f"{c} long" for c in names))


def _windows(table: DataFrame, spans: DataFrame, k: int, exact: bool) -> DataFrame:
    """Windows that begin in the spans ``(at, c, n)``: ``(h, g, at, c, doc)``.

    ``c`` is the window's coordinate; ``h`` its hash and ``g`` zero, or with
    ``exact`` both from its words' digest.
    """
    import pyarrow as pa

    names = ["h", "g", "at", "c", "doc"]

    def digests(texts, places, first):
        for text, mine, a in zip(texts, places, first.tolist()):
            words = text.split()
            for i in mine.tolist():
                yield hashlib.sha256(b" ".join(words[i - a:i - a + k])).digest()[:16]

    def kernel(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            lists, _, first = _split(texts)
            at = b.column(0).to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(3).offsets.to_numpy()))
            begin, n = b.column(3).flatten().to_numpy() - at[row] + first[row], b.column(4).flatten().to_numpy()
            where = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            row = np.repeat(row, n)
            if exact:
                order = np.argsort(row, kind="stable")
                row, where = row[order], where[order]
                parts = np.split(where, np.cumsum(np.bincount(row, minlength=b.num_rows))[:-1])
                pair = np.frombuffer(b"".join(digests(texts, parts, first)), np.int64).reshape(-1, 2)
                h, g = pair[:, 0], pair[:, 1]
            else:
                h = window_hashes(_hashed_at(lists, begin, n, k), k)[where] if len(where) else np.zeros(0, np.int64)
                g = np.zeros(len(h), np.int64)
            cols = (h, g, at[row], at[row] + where - first[row], b.column(1).to_numpy()[row])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    lists = spans.groupBy("at").agg(F.collect_list(F.struct("c", "n")).alias("s")).select("at", F.col("s.c").alias("cs"), F.col("s.n").alias("ns"))
    return table.select("at", "doc", "text").join(lists, "at").select("at", "doc", "text", "cs", "ns").mapInArrow(
        kernel, ", ".join(f"{c} long" for c in names))


def repeated_paths(table: DataFrame, k: int = K) -> DataFrame:
    """Occurrences of compacted paths: ``(at, c, n, path, late)``.

    ``n`` windows from the word at ``c`` are one whole copy of ``path`` (its source
    coordinate); ``late`` if the path also occurs in a smaller document.
    """
    runs = stage(_runs(table, k), "passages-runs")
    shared = stage(runs.groupBy("m").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("x").alias("x"), F.max("x").alias("y"),
                                         F.min("c").alias("source"), F.count("*").alias("cnt"))
                   .where("lo < hi").select("m", "lo", "source", "cnt", (F.col("x") == F.col("y")).alias("one")), "passages-shared")
    common = stage(runs.drop("x").join(shared, "m").select(
        "at", "c", "n", "one", "source", "cnt", (F.col("doc") > F.col("lo")).alias("late")), "passages-common")
    unstage(runs)
    unstage(shared)
    windows = stage(_windows(table, common.where("not one"), k, False).drop("g"), "passages-windows")
    edges = stage(windows.groupBy("h").agg(F.min("c").alias("source"), F.min("doc").alias("lo"), F.max("doc").alias("hi"),
                                           F.count("*").alias("cnt")).where("lo < hi").drop("hi"), "passages-edges")
    single = windows.join(edges, "h").select("at", "c", F.lit(1).cast("long").alias("n"), "source", "cnt", (F.col("doc") > F.col("lo")).alias("late"))
    units = common.where("one").drop("one").unionByName(single)
    in_text = Window.partitionBy("at").orderBy("c")
    before = {x: F.lag(x).over(in_text) for x in ("c", "n", "source", "cnt")}
    follows = ((before["c"] + before["n"] == F.col("c")) & (before["source"] + before["n"] == F.col("source"))
               & (before["cnt"] == F.col("cnt")))
    hits = stage(units.withColumn("begins", ~F.coalesce(follows, F.lit(False))).drop("cnt"), "passages-hits")
    for t in (common, windows, edges):
        unstage(t)
    begins = hits.groupBy("source").agg(F.max("begins").alias("begins"))
    sources = hits.where("c = source").select("at", "source", "n").join(begins, "source")
    along = Window.partitionBy("at").orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    # Written first: a join of two plain shuffles is one that adaptive execution splits at passages which occur everywhere.
    paths = stage(sources.withColumn("path", F.max(F.when(F.col("begins"), F.col("source"))).over(along))
                  .groupBy("path").agg(F.sum("n").alias("n")), "passages-lengths")
    return stage(hits.drop("n").join(paths, F.col("source") == F.col("path")).select("at", "c", "n", "path", "late"), "passages-paths")


_SPAN = "array<struct<c:bigint,n:bigint,path:bigint,late:boolean>>"


def _cut(table: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """Every row with its late spans removed, and the digest of each span's words."""
    import pyarrow as pa

    out = pa.schema([("at", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                     ("kept", pa.binary()), ("checks", pa.list_(pa.struct([("path", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])))])

    def kernel(batches):
        for b in batches:
            rows = []
            for at, doc_id, text, spans in zip(*(b.column(i).to_pylist() for i in range(4))):
                words = text.split()
                gone, checks = [], []
                for s in spans or ():
                    a, z = s["c"] - at, s["c"] - at + s["n"] + k - 1
                    if s["path"] is not None:
                        x, y = np.frombuffer(hashlib.sha256(b" ".join(words[a:z])).digest()[:16], np.int64).tolist()
                        checks.append({"path": s["path"], "x": x, "y": y})
                    if s["late"]:
                        gone.append((a, z))
                n = len(words)
                if gone:
                    left, end = [], 0
                    for a, z in sorted(gone):
                        left += words[end:a]
                        end = max(end, z)
                    words = left + words[end:]
                kept = b" ".join(words)
                rows.append((at, doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept, checks))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), out)] if rows else
                                             [pa.array([], f.type) for f in out], schema=out)

    listed = spans.groupBy("at").agg(F.collect_list(F.struct("c", "n", "path", "late")).cast(_SPAN).alias("spans"))
    return table.select("at", "doc_id", "text").join(listed, "at", "left").select("at", "doc_id", "text", "spans").mapInArrow(
        kernel, "at long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary, "
                "checks array<struct<path:bigint,x:bigint,y:bigint>>")


def remove_repeats(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)`` of every row.

    Words are runs other than space and U+0009 to U+000D, unchanged.  A word
    goes if a window of ``k`` words covers it whose words also start in a
    document with a smaller ``doc_id``; windows are those of the input.
    ``kept`` is the text left (words joined by one space), absent without
    ``with_text``.  Null and empty texts have no words.  A null id counts as the
    largest.  Repeated rows, and rows with one id, do not count as smaller
    than each other.  Other columns are not read.  An empty table gives an
    empty result.
    """
    table = _table(docs, id_col, text_col)
    paths = repeated_paths(table, k)
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"] + (["kept"] if with_text else [])
    cut = _cut(table, paths, k)
    done = stage(cut.select("at", *cols, "checks"), "passages-cut")
    checked = done.select(F.explode("checks").alias("s")).select("s.*").groupBy("path").agg(
        *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")])
    unequal = stage(checked.where("min_x <> max_x or min_y <> max_y").select("path"), "passages-unequal")
    if unequal.limit(1).count():
        bad = stage(paths.join(unequal, "path", "left_semi"), "passages-collided")
        one_by_one = _windows(table, bad.select("at", "c", "n"), k, True)
        least = one_by_one.groupBy("h", "g").agg(F.min("doc").alias("lo"))
        late = one_by_one.join(least, ["h", "g"]).where("doc > lo").select(
            "at", "c", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("path"), F.lit(True).alias("late"))
        rows = bad.select("at").distinct()
        again = paths.join(unequal, "path", "left_anti").join(rows, "at", "left_semi").unionByName(late)
        mended = _cut(table.join(rows, "at", "left_semi"), again, k).select("at", *cols)
        done = done.join(rows, "at", "left_anti").select("at", *cols).unionByName(mended)
    out = done.select(*cols)
    return out.withColumn("kept", F.col("kept").cast("string")) if with_text else out
