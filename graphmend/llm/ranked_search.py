"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time scoring.

``build_index`` cuts the documents into shards of bounded size, each an
inverted index of its own: for every term the documents that hold it, in
ascending ``doc_id`` order, and its counts.  Lists of ``LONG`` documents and
more also keep, for every range of ``RANGE`` documents, the greatest count and
the least document length, which bound any score in the range whatever the
statistics of the whole table are.

``search`` weighs terms by statistics of all shards, then scores every shard
for every query:

* term at a time: the short lists are summed to accumulators, a sorted list of
  documents with their partial scores;
* document at a time: the accumulators are one more iterator, bounded by their
  greatest partial score in a range, beside the long lists.  A range is
  skipped if all bounds together stay below the tenth best score so far.
  Otherwise only documents of iterators that can reach it are candidates;
  lists that cannot are probed for the candidates that still can.

Only the best documents of a task leave it, and the final ranking takes the
best of those.  Documents never move.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmend.llm.common import bounded_batches, stage

SHARD_TERMS = 4_000_000    # a shard is closed once it holds this many terms
RANGE = 256                # documents whose bounds are kept together
LONG = 128                 # a list of so many documents keeps bounds and is skipped over
SHORT_TOTAL = 4_096        # postings of short lists that are summed first, at most
QUERY_BYTES = 16 << 20     # texts of queries that are broadcast together
_LAST = (1 << 63) - 1      # stands for a null doc_id, which ranks last
_TERM = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _TERM else 0x20 for c in range(256))

_INDEX = ("n_docs long, n_terms long, terms binary, ends binary, docs binary, counts binary, doc_ids array<long>, lengths binary, "
          "range_ends binary, range_counts binary, range_lengths binary")


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


class _Vocabulary(dict):
    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _shard(docs: list[tuple[int, np.ndarray]], vocabulary: _Vocabulary) -> dict:
    """Index of ``(doc_id, term numbers)`` rows; every row has a term."""
    docs.sort(key=lambda d: d[0])
    lengths = np.array([len(t) for _, t in docs], np.int64)
    key = np.concatenate([t for _, t in docs]).astype(np.int64)
    key <<= 32
    key |= np.repeat(np.arange(len(docs)), lengths)
    key, counts = np.unique(key, return_counts=True)
    term, doc = key >> 32, key & 0xFFFFFFFF
    ends = np.searchsorted(term, np.arange(len(vocabulary)), side="right")
    size = np.diff(np.r_[0, ends])
    ranges = -(-len(docs) // RANGE)
    long_terms = np.flatnonzero(size >= LONG)
    number = np.full(len(vocabulary), -1)
    number[long_terms] = np.arange(len(long_terms))
    cell = number[term] * ranges + doc // RANGE
    on = number[term] >= 0
    most = np.zeros(len(long_terms) * ranges, np.int64)
    least = np.full(len(long_terms) * ranges, _LAST, np.int64)
    np.maximum.at(most, cell[on], counts[on])
    np.minimum.at(least, cell[on], lengths[doc[on]])
    within = np.bincount(cell[on], minlength=len(most))
    width = "u1" if counts.max() < 256 else "<u4"
    return {
        "n_docs": len(docs), "n_terms": int(lengths.sum()), "terms": b" ".join(vocabulary), "ends": ends.astype("<u4").tobytes(),
        "docs": doc.astype("<u4").tobytes(), "counts": counts.astype(width).tobytes(), "doc_ids": [d for d, _ in docs],
        "lengths": lengths.astype("<i8").tobytes(), "range_ends": np.cumsum(within.reshape(-1, ranges), axis=1).astype("<u4").tobytes(),
        "range_counts": most.astype("<u4").tobytes(), "range_lengths": least.astype("<i8").tobytes()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """One row for each shard of the documents that have a term, written below the checkpoint folder."""
    import pyarrow as pa

    bounded_batches(docs.sparkSession, 4)
    schema = pa.schema([(f, t) for f, t in zip((c.split()[0] for c in _INDEX.split(", ")), (
        pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.binary()] * 4))])

    def kernel(batches):
        held, total, vocabulary = [], 0, _Vocabulary()
        number = vocabulary.__getitem__

        def close():
            row = _shard(held, vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                terms = terms_of(text)
                if not terms:
                    continue
                held.append((doc, np.fromiter(map(number, terms), np.int32, len(terms))))
                total += len(terms)
                if total >= shard_terms:
                    yield close()
                    held, total = [], 0
                    vocabulary = _Vocabulary()
                    number = vocabulary.__getitem__
        if held:
            yield close()

    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return stage(src.where("text is not null").mapInArrow(kernel, _INDEX), "search-index")


def _gain(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What ``counts`` occurrences add to a score, before the term's weight."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


class Shard:
    """A shard made ready for scoring the queries' terms."""

    def __init__(self, row: dict, wanted, n_all: int, l_all: int):
        self.doc_ids = np.asarray(row["doc_ids"], np.int64)
        n = len(self.doc_ids)
        lengths = np.frombuffer(row["lengths"], "<i8")
        self.factor = 90 * n_all, l_all
        self.m = self._m(lengths)
        ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
        begins = np.r_[0, ends[:-1]]
        docs = np.frombuffer(row["docs"], "<u4")
        counts = np.frombuffer(row["counts"], "u1" if len(row["counts"]) == len(docs) else "<u4")
        self.ranges = -(-n // RANGE)
        long_terms = np.flatnonzero(ends - begins >= LONG)
        cells = [np.frombuffer(row[c], t).astype(np.int64).reshape(len(long_terms), self.ranges)
                 for c, t in (("range_ends", "<u4"), ("range_counts", "<u4"), ("range_lengths", "<i8"))]
        self.lists = {}
        for i, term in enumerate(row["terms"].split(b" ")):
            if term in wanted:
                s = slice(begins[i], ends[i])
                at = int(np.searchsorted(long_terms, i))
                bounds = [c[at] for c in cells] if ends[i] - begins[i] >= LONG else None
                self.lists[term] = _List(self, docs[s].astype(np.int64), counts[s].astype(np.int64), bounds, wanted[term])

    def _m(self, lengths: np.ndarray) -> np.ndarray:
        by, over = self.factor
        if len(lengths) and int(lengths.max()) * by >= 1 << 63:  # beyond 64 bits on the way, not in the end
            return np.array([10 + int(x) * by // over for x in lengths], np.int64)
        return 10 + lengths * by // over

    def best(self, terms: list[bytes], k: int, least: int = 0) -> list[tuple[int, int]]:
        """``(score, doc_id)`` of the ``k`` best documents that reach ``least``, best first."""
        lists = sorted((self.lists[t] for t in terms if t in self.lists), key=len)
        if not lists:
            return []
        short, total = [], 0
        while lists and (lists[0].bounds is None or total + len(lists[0]) <= SHORT_TOTAL):
            total += len(lists[0])
            short.append(lists.pop(0))
        acc_docs, acc = _accumulate(short)
        top_docs, top = acc_docs[:0], acc[:0]
        if not lists:
            return self._ranked(acc_docs, acc, k, least)
        if len(acc) >= k:
            least = max(least, int(np.partition(acc, -k)[-k]))
        cuts = np.searchsorted(acc_docs, np.arange(self.ranges + 1) * RANGE)
        acc_bound = np.zeros(self.ranges, np.int64)
        filled = np.flatnonzero(np.diff(cuts))
        if len(filled):
            acc_bound[filled] = np.maximum.reduceat(acc, cuts[filled])
        bounds = np.array([x.range_bounds() for x in lists] + [acc_bound])
        together = bounds.sum(axis=0)
        for r in range(self.ranges):
            if together[r] < max(least, 1):
                continue
            # Ascending bounds: those that stay below the least score together cannot bring a document in.
            order = np.argsort(bounds[:, r], kind="stable")
            below = np.cumsum(bounds[order, r])
            score, seen = np.zeros(RANGE, np.int64), np.zeros(RANGE, bool)
            for place in range(len(order) - 1, -1, -1):
                i = order[place]
                if not bounds[i, r]:
                    continue
                docs, gains = (acc_docs[cuts[r]:cuts[r + 1]], acc[cuts[r]:cuts[r + 1]]) if i == len(lists) else lists[i].postings(r)
                at = docs - r * RANGE
                if below[place] < least:
                    seen &= score + below[place] >= least
                    on = seen[at]
                    if not on.any():
                        continue
                    at, gains = at[on], gains[on]
                else:
                    seen[at] = True
                score[at] += gains
            found = np.flatnonzero(seen & (score >= max(least, 1)))
            if len(found):
                top_docs, top = np.r_[top_docs, found + r * RANGE], np.r_[top, score[found]]
                if len(top) > k:
                    first = np.lexsort((top_docs, -top))[:k]
                    top_docs, top = top_docs[first], top[first]
                if len(top) == k:
                    least = max(least, int(top.min()))
        return self._ranked(top_docs, top, k, least)

    def _ranked(self, docs: np.ndarray, scores: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        on = scores >= max(least, 1)
        docs, scores = docs[on], scores[on]
        first = np.lexsort((docs, -scores))[:k]
        return list(zip(scores[first].tolist(), self.doc_ids[docs[first]].tolist()))


class _List:
    """Postings of one term in a shard."""

    def __init__(self, shard: Shard, docs: np.ndarray, counts: np.ndarray, bounds, weight: int):
        self.shard, self.docs, self.counts, self.bounds, self.weight = shard, docs, counts, bounds, weight
        self.ready: dict[int, tuple] = {}
        self.bound = None

    def __len__(self):
        return len(self.docs)

    def range_bounds(self) -> np.ndarray:
        if self.bound is None:
            _, counts, lengths = self.bounds
            held = counts > 0
            m = self.shard._m(np.where(held, lengths, 0))
            self.bound = np.where(held, self.weight * _gain(counts, m), 0)
        return self.bound

    def postings(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and gains within a range, kept for the next query."""
        if r not in self.ready:
            z = self.bounds[0]
            s = slice(z[r - 1] if r else 0, z[r])
            docs = self.docs[s]
            self.ready[r] = docs, self.weight * _gain(self.counts[s], self.shard.m[docs])
        return self.ready[r]

    def all(self) -> np.ndarray:
        if -1 not in self.ready:
            self.ready[-1] = self.weight * _gain(self.counts, self.shard.m[self.docs])
        return self.ready[-1]


def _accumulate(lists: list[_List]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of all lists in order, with their summed gains."""
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs = np.concatenate([x.docs for x in lists])
    gains = np.concatenate([x.all() for x in lists])
    order = np.argsort(docs, kind="stable")
    docs, gains = docs[order], gains[order]
    start = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    return docs[start], np.add.reduceat(gains, start)


def _weights(index: DataFrame, wanted: set[bytes], n_all: int) -> dict[bytes, int]:
    """Weight of each wanted term that some document holds."""
    import pyarrow as pa

    sent = index.sparkSession.sparkContext.broadcast(wanted)

    def kernel(batches):
        found: dict[bytes, int] = {}
        for b in batches:
            for terms, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                size = np.diff(np.r_[0, np.frombuffer(ends, "<u4").astype(np.int64)])
                for i, t in enumerate(terms.split(b" ")):
                    if t in sent.value:
                        found[t] = found.get(t, 0) + int(size[i])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    df = index.select("terms", "ends").mapInArrow(kernel, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_all + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return {bytes(r.term): r.w for r in df.select("term", weight.alias("w")).toLocalIterator()}  # as many as the queries' terms at most


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each query with a score above 0.

    A score sums, over the query's terms once each, the term's weight
    ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` times
    ``(10**9 tf) div (1000 tf + 8 m)`` with ``m = 10 + (90 n N) div L``: ``N``
    documents with a term, ``L`` terms of all, ``n`` of the document.  Equal
    scores rank by ascending ``doc_id``, a null id last; rows that repeat rank
    each.  Queries that repeat count once; queries with one id and other texts
    are ranked apart.  Null texts and texts without a term give no row, nor does
    an empty table.  Queries go in blocks of ``QUERY_BYTES``, so their number
    is not bounded.
    """
    asked = stage(queries.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct(), "search-queries")
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // QUERY_BYTES))
    item_type = asked.schema["item_id"].dataType.simpleString()
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        found = _search_block(index, part.orderBy("item_id", "text").collect(), k, total.n or 0, total.l or 1, item_type)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("item_id", "item").orderBy(F.col("score").desc(), "doc")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"),
                         F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "score")


def _search_block(index: DataFrame, items: list, k: int, n_all: int, l_all: int, item_type: str) -> DataFrame:
    """Best documents of every task for the items: ``(item_id, item, doc, score)``; ``item`` parts equal ids."""
    import pyarrow as pa

    terms = [sorted(set(terms_of(r.text.encode()))) for r in items]
    weights = _weights(index, {t for ts in terms for t in ts}, n_all)
    sent = index.sparkSession.sparkContext.broadcast((terms, weights))

    def kernel(batches):
        terms, weights = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in terms]
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard({c: b.column(c)[i].as_py() for c in b.schema.names}, weights, n_all, l_all)
                for q, ts in enumerate(terms):
                    least = best[q][-1][0] if len(best[q]) == k else 0
                    found = shard.best(ts, k, least)
                    if found:
                        best[q] = sorted(best[q] + found, key=lambda x: (-x[0], x[1]))[:k]
        rows = [(q, d, s) for q, found in enumerate(best) for s, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["item", "doc", "score"])

    scored = index.drop("n_docs", "n_terms").mapInArrow(kernel, "item long, doc long, score long")
    names = index.sparkSession.createDataFrame([(q, r.item_id) for q, r in enumerate(items)], f"item long, item_id {item_type}")
    return scored.join(F.broadcast(names), "item")  # a block's queries: bounded
