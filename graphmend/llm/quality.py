"""Quality classifier on random-indexing word vectors.

Texts are cut into runs of letters, digits and signs.  A token stands for its
surface (lower case, hashed to ``SURFACES`` rows) and for its shape (case,
length, repetition, kind of sign).  Each row has a sparse random index
vector; its context vector is the sum of the index vectors of the tokens next
to it, gathered over the whole corpus.  A word vector is index vector plus
unit context vector.  Documents pool the vectors of their tokens, and a
two-layer network with a fitted temperature gives the probability.

The context table has a fixed number of rows, so every task adds up its own
and the tables are summed by row blocks in two salted steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmend.llm.common import bounded_batches, text_of

SURFACES = 1 << 14
SHAPES = 256
ROWS = SURFACES + SHAPES
DIM = 48
NONZERO = 2            # entries of +1 or -1 in an index vector
WINDOW = 2             # tokens on each side that count as context
BLOCK = 1_040          # rows of the context table summed together
TRAIN_ROWS = 20_000    # bound of the labelled sample the network is fitted on
HIDDEN = 32
SEGMENT = 1 << 20      # bytes of a text handled at once

_SPACE, _LETTER, _DIGIT, _SIGN = 0, 1, 2, 3
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[:33] = _SPACE
_KIND[127] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:] = _LETTER
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every row's index vector."""
    rng = np.random.default_rng(20_240_601)
    places = np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], (ROWS, NONZERO))


def tokens(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(part, surface row, shape row)`` of all tokens of UTF-8 parts."""
    joined = b"\n".join(parts)
    raw = np.frombuffer(joined, np.uint8)
    none = np.zeros(0, np.int64)
    if not len(raw):
        return none, none, none
    kind = _KIND[raw]
    # Upper case: A-Z, and the second byte of the Latin-1 capitals.
    upper = (raw >= 65) & (raw <= 90)
    upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    low = raw + (upper.astype(np.uint8) << 5)
    edge = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    begins = edge[kind[edge] != _SPACE]
    if not len(begins):
        return none, none, none
    length = np.diff(np.r_[edge, len(raw)])[kind[edge] != _SPACE]
    place = np.arange(len(raw), dtype=np.int64)
    place -= np.repeat(edge, np.diff(np.r_[edge, len(raw)]))
    value = (low.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63]
    total = np.add.reduceat(value, edge)[kind[edge] != _SPACE]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    surface = (total >> np.uint64(64 - 14)).astype(np.int64)
    capitals = np.add.reduceat(upper.astype(np.int32), edge)[kind[edge] != _SPACE]
    k = kind[begins]
    same = np.r_[False, total[1:] == total[:-1]]
    apart = np.r_[True, begins[1:] != (begins + length)[:-1]]  # white space before it
    case = np.where(capitals == 0, 0, np.where((capitals == 1) & upper[begins], 1, np.where(2 * capitals >= length, 2, 3)))
    size = np.digitize(length, [2, 4, 8])
    letters = case * 4 + size
    signs = np.minimum(length, 4) - 1 + 4 * (raw[begins] % 8)
    shape = np.where(k == _LETTER, letters, np.where(k == _DIGIT, 16 + size, 32 + signs)) + 64 * same + 128 * apart
    ends = np.cumsum([len(p) + 1 for p in parts])
    return np.searchsorted(ends, begins, side="right"), surface, SURFACES + shape


def _segments(texts: list[bytes]) -> tuple[list[bytes], list[int]]:
    """Texts in parts of bounded size, cut at white space where there is any, with the text each belongs to."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > SEGMENT:
            z = t.rfind(b" ", at, at + SEGMENT)
            z = z if z > at else at + SEGMENT
            parts.append(t[at:z])
            owner.append(i)
            at = z
        parts.append(t[at:])
        owner.append(i)
    return parts, owner


def _strips(parts: list[bytes]):
    """Ranges of parts of about two segments together."""
    a, size = 0, 0
    for z, p in enumerate(parts, 1):
        size += len(p)
        if size >= 2 * SEGMENT or z == len(parts):
            yield a, z
            a, size = z, 0


def _add_contexts(table: np.ndarray, texts: list[bytes], places: np.ndarray, signs: np.ndarray) -> None:
    """Add the contexts of the tokens of ``texts`` to ``table`` (rows times dimensions, flat)."""
    parts, owner = _segments(texts)
    for a, z in _strips(parts):
        part, surface, shape = tokens(parts[a:z])
        for d in range(1, WINDOW + 1):
            near = part[d:] == part[:-d]
            x, y = np.flatnonzero(near), np.flatnonzero(near) + d
            pairs = [(surface[x], surface[y]), (surface[y], surface[x])]
            if d == 1:
                pairs += [(shape[x], shape[y]), (shape[y], shape[x])]
            for row, other in pairs:
                for j in range(NONZERO):
                    table += np.bincount(row * DIM + places[other, j], signs[other, j], len(table))


def context_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors of all rows, gathered over every whole text of ``docs``."""
    import pandas as pd
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark, 4)
    blocks = -(-ROWS // BLOCK)

    def gather(batches):
        from pyspark import TaskContext

        table, seen = np.zeros(ROWS * DIM), False
        places, signs = _index_vectors()
        for b in batches:
            _add_contexts(table, b.column(0).cast(pa.binary()).to_pylist(), places, signs)
            seen = True
        if seen:
            salt = TaskContext.get().partitionId() % 64
            whole = np.zeros((blocks * BLOCK, DIM), "<i8")
            whole[:ROWS] = table.reshape(ROWS, DIM)
            for k in range(blocks):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()),
                                                  pa.array([whole[k * BLOCK:(k + 1) * BLOCK].astype("<i4" if np.abs(whole).max() < 2**31 else "<i8").tobytes()], pa.binary())],
                                                 names=["block", "salt", "sums"])

    def total(batches):
        """Running sums by block: one table of a task's blocks, however many rows come in."""
        sums: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for k, salt, x in zip(pdf["block"], pdf["salt"], pdf["sums"]):
                a = np.frombuffer(x, "<i4" if len(x) == BLOCK * DIM * 4 else "<i8").astype(np.int64)
                sums[k, salt] = sums[k, salt] + a if (k, salt) in sums else a
        if sums:
            yield pd.DataFrame({"block": [k for k, _ in sums], "salt": [s for _, s in sums],
                                "sums": [a.astype("<i8").tobytes() for a in sums.values()]})

    schema = "block int, salt int, sums binary"
    own = docs.select(text_of(text_col).alias("text")).mapInArrow(gather, schema)
    some = own.repartition("block", "salt").mapInPandas(total, schema).withColumn("salt", F.lit(0))
    out = np.zeros((blocks * BLOCK, DIM))
    for r in some.repartition("block").mapInPandas(total, schema).collect():  # ROWS * DIM numbers in all
        out[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"], "<i8").reshape(BLOCK, DIM)
    return out[:ROWS]


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    places, signs = _index_vectors()
    own = np.zeros((ROWS, DIM))
    np.put_along_axis(own, places, signs, axis=1)
    norm = np.linalg.norm(contexts, axis=1, keepdims=True)
    return (own + contexts / np.maximum(norm, 1e-12)).astype(np.float32)


def pool(texts: list[bytes], words: np.ndarray) -> np.ndarray:
    """One row for each text: mean surface vector, mean shape vector, log of the token count.

    A text without tokens pools to zeros.
    """
    parts, owner = _segments(texts)
    owner = np.array(owner, np.int64)
    surfaces = np.zeros((len(texts), DIM))
    shapes = np.zeros((len(texts), SHAPES))
    for a, z in _strips(parts):
        part, surface, shape = tokens(parts[a:z])
        doc = owner[a:z][part]
        lo, hi = owner[a], owner[z - 1] + 1
        shapes[lo:hi] += np.bincount((doc - lo) * SHAPES + shape - SURFACES, minlength=(hi - lo) * SHAPES).reshape(hi - lo, SHAPES)
        for i in range(0, len(doc), 100_000):
            d = doc[i:i + 100_000]
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            surfaces[d[first]] += np.add.reduceat(words[surface[i:i + 100_000]], first, axis=0, dtype=np.float64)
    n = shapes.sum(axis=1, keepdims=True)
    scale = 1 / np.maximum(n, 1)
    return np.c_[surfaces * scale, (shapes @ words[SURFACES:].astype(np.float64)) * scale, np.log1p(n)]


@dataclass
class QualityModel:
    """Word vectors, network and temperature; ``score`` maps pooled rows to probabilities."""

    words: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        h = np.maximum((pooled - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(pooled) / self.temperature, -50, 50)))


def fit_network(words: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 3) -> QualityModel:
    """Train on four fifths of the rows (Adam on cross-entropy), fit the temperature on the last fifth.

    Without rows, or with one label only, the score is that label's smoothed share.
    """
    width = 2 * DIM + 1
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(words, np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN),
                            float(np.log(p / (1 - p))), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5]
    train = order[len(y) // 5:]
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
    m = QualityModel(words, mean, scale, rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN),
                     rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), 0.0, 1.0)
    b2 = np.zeros(1)
    weights = [m.w1, m.b1, m.w2, b2]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    z = (x - mean) / scale
    step = 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        batch_order = rng.permutation(train)
        for i in range(0, len(batch_order), 128):
            rows = batch_order[i:i + 128]
            a = z[rows] @ m.w1 + m.b1
            h = np.maximum(a, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ m.w2 + b2[0], -50, 50)))
            g = (p - y[rows]) / len(rows)
            back = np.outer(g, m.w2) * (a > 0)
            grads = [z[rows].T @ back + 1e-4 * m.w1, back.sum(axis=0), h.T @ g + 1e-4 * m.w2, np.array([g.sum()])]
            step += 1
            for w, grad, u, v in zip(weights, grads, first, second):
                u += 0.1 * (grad - u)
                v += 0.001 * (grad * grad - v)
                w -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    m.b2 = float(b2[0])
    if len(held):
        logits, target = m.logit(x[held]), y[held]
        choices = np.geomspace(0.05, 8, 81)
        loss = [np.logaddexp(0, np.where(target == 1, -logits, logits) / t).mean() for t in choices]
        m.temperature = float(choices[int(np.argmin(loss))])
    return m


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, text_col: str = "text") -> QualityModel:
    """Word vectors from all of ``docs``; the network from at most ``train_rows`` labelled documents.

    The sample is the first of the labelled rows in order of a hash of their
    id, and again the first of the documents that have them, as ids may repeat.  Labels other than 0 and 1, null ids and held-out rows are not used.
    """
    import pandas as pd
    import pyarrow as pa

    words = word_vectors(context_table(docs, text_col))
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).where(
        F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    sample = usable.orderBy(F.xxhash64("_id"), "_id", "_y").limit(train_rows)  # bounded, so it is broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "_id")
    shared = docs.sparkSession.sparkContext.broadcast(words)  # ROWS * DIM numbers

    def kernel(batches):
        for b in batches:
            x = pool(b.column(2).cast(pa.binary()).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())],
                                             names=["_id", "_y", "x"])

    pooled = rows.select("_id", "_y", "text").mapInArrow(kernel, "_id long, _y int, x binary")
    got = pooled.orderBy(F.xxhash64("_id"), "_id", "_y", "x").limit(train_rows).toPandas()
    got = got.sort_values(["_id", "_y"], ignore_index=True) if len(got) else pd.DataFrame({"_id": [], "_y": [], "x": []})
    x = np.frombuffer(b"".join(got["x"]), "<f4").reshape(-1, 2 * DIM + 1).astype(np.float64)
    shared.unpersist()
    return fit_network(words, x, got["_y"].to_numpy(np.float64))


def score_documents(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with all its columns and ``score``, the probability of label 1.

    Null and empty texts score like a text without tokens.  Repeated rows stay;
    an empty table gives an empty result.
    """
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    bounded_batches(docs.sparkSession, 4)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kernel(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            score = shared.value.score(pool(texts, shared.value.words))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, score_col])

    return docs.mapInArrow(kernel, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that score at least 0.5, with the columns of ``docs``."""
    score = "_quality_score"
    scored = score_documents(docs, fit_quality(docs, labels), score_col=score)
    return scored.where(F.col(score) >= 0.5).drop(score)
