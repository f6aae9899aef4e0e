"""Exact top-k by cosine over cells of references, pruned by the triangle inequality.

On unit vectors the distance ``d = sqrt(2 - 2 cos)`` is a metric.  References
belong to the nearest of a bounded number of centres; a cell knows how near
and how far its members lie from the centre.  A reference at distance ``r``
from a centre that lies at distance ``c`` from a query is at least
``|c - r|`` from the query, so a cell, and within it all but a slice of its
members sorted by ``r``, cannot hold one of the ``k`` best once ``k`` closer
references are known.  Cells are probed best bound first.

``CellIndex`` does this for references that fit a task; ``topk_cells`` does it
with Spark for any number: every query first probes the cells nearest to it,
which gives its ``k``-th best cosine, then only the cells that can still beat
it.  Results are exact; how much is pruned depends on the vectors (well for
related groups, not at all for isotropic ones of many dimensions).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmend.session import cut_lineage, ship_package

CELLS = 1024               # centres at most
SAMPLE = 16                # centres are picked among so many vectors for each of them
CENTRE_VALUES = 2_000_000  # components of all centres together at most
FIRST = 4                  # cells probed in each query's own order
GROUP_VALUES = 4_000_000   # components one side of a cell's task holds
MARGIN = 1e-7              # bounds give way by this, so rounding never prunes a tie
DECIMALS = 12              # cosines are rounded, so equal vectors tie

TOPK_SCHEMA = "query_id string, rank bigint, ref_id string, cosine double"


def unit(mat: np.ndarray) -> np.ndarray:
    """Rows over their length; rows without a direction become NaN."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        out = mat / np.linalg.norm(mat, axis=1, keepdims=True)
    out[~np.isfinite(out).all(axis=1)] = np.nan
    return out


def stack(values) -> np.ndarray:
    return np.asarray([np.asarray(v, dtype=np.float64) for v in values], dtype=np.float64)


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def centre_count(rows: int, dim: int) -> int:
    return int(max(1, min(CELLS, CENTRE_VALUES // max(dim, 1), round(4 * rows ** 0.5), rows)))


def spread_out(v: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the unit rows, each the farthest from those before, so no row is far from all of them."""
    picked, nearest = [0], v @ v[0]
    while len(picked) < min(n, len(v)):
        i = int(nearest.argmin())
        if nearest[i] >= 1 - MARGIN:
            break
        picked.append(i)
        np.maximum(nearest, v @ v[i], out=nearest)
    return v[picked]


class Best:
    """The ``k`` best (cosine, reference) of each query so far; equal cosines prefer the lower reference number."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.cos = np.full((n, k), -np.inf)
        self.ref = np.full((n, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        return self.cos.min(axis=1)

    def add(self, rows: np.ndarray, cos: np.ndarray, refs: np.ndarray) -> None:
        """Offer references ``refs`` with cosines ``cos`` (queries x references) to the queries ``rows``."""
        gain = (cos >= self.least()[rows][:, None]).any(axis=1)
        rows, cos = rows[gain], cos[gain]
        if not len(rows):
            return
        v = np.concatenate([self.cos[rows], cos], axis=1)
        r = np.concatenate([self.ref[rows], np.broadcast_to(refs, cos.shape)], axis=1)
        pick = np.argpartition(-v, self.k - 1, axis=1)[:, :self.k]
        kth = np.take_along_axis(v, pick, axis=1).min(axis=1)
        tied = np.flatnonzero((v >= kth[:, None]).sum(axis=1) > self.k)
        if len(tied):
            pick[tied] = np.lexsort((r[tied], -v[tied]), axis=-1)[:, :self.k]
        self.cos[rows] = np.take_along_axis(v, pick, axis=1)
        self.ref[rows] = np.take_along_axis(r, pick, axis=1)

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(query, rank from 1, reference, cosine)``, a row for each."""
        order = np.lexsort((self.ref, -self.cos), axis=-1)
        cos, ref = np.take_along_axis(self.cos, order, axis=1), np.take_along_axis(self.ref, order, axis=1)
        q, j = np.nonzero(cos > -np.inf)
        return q, j + 1, ref[q, j], cos[q, j]


class CellIndex:
    """References of one task in cells.  ``vectors`` are unit rows; those without a direction rank nowhere."""

    def __init__(self, vectors: np.ndarray, centres: np.ndarray | None = None):
        self.scored = 0  # pairs of query and reference whose cosine was computed
        ok = np.flatnonzero(~np.isnan(vectors).any(axis=1)) if len(vectors) else np.zeros(0, np.int64)
        v = vectors[ok]
        if centres is None:
            n = centre_count(len(v), v.shape[1] if v.ndim == 2 else 1)
            centres = spread_out(v[np.unique(np.linspace(0, len(v) - 1, SAMPLE * n).astype(int))], n) if len(v) else v
        self.centres = centres
        if not len(v):
            self.vectors, self.refs, self.radius, self.begins = v, ok, np.zeros(0), np.zeros(len(centres) + 1, int)
            return
        cos = v @ centres.T
        cell = cos.argmax(axis=1)
        radius = distance(cos[np.arange(len(v)), cell])
        order = np.lexsort((radius, cell))
        self.vectors, self.refs, self.radius = v[order], ok[order], radius[order]
        self.begins = np.searchsorted(cell[order], np.arange(len(centres) + 1))

    def topk(self, queries: np.ndarray, k: int) -> Best:
        """The ``k`` best references of each unit query, by number."""
        best = Best(len(queries), k)
        full = np.flatnonzero(np.diff(self.begins))
        active = np.flatnonzero(~np.isnan(queries).any(axis=1)) if len(queries) else np.zeros(0, np.int64)
        if not len(full) or not len(active):
            return best
        far = distance(queries[active] @ self.centres[full].T)
        near = self.radius[self.begins[full]]
        wide = self.radius[self.begins[full + 1] - 1]
        bound = np.maximum(np.maximum(far - wide, near - far), 0) - MARGIN
        # The nearest centre first, then by bound: the first cell gives a good k-th best.
        rank = bound.copy()
        rank[np.arange(len(active)), far.argmin(axis=1)] = -1.0
        first = min(FIRST, len(full))
        order = np.argpartition(rank, first - 1, axis=1)[:, :first]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(rank, order, axis=1), axis=1, kind="stable"), axis=1)
        for turn in range(first):
            cells = order[:, turn]
            reach = distance(best.least()[active])
            going = np.flatnonzero(np.take_along_axis(bound, cells[:, None], axis=1)[:, 0] <= reach)
            going = going[np.argsort(cells[going], kind="stable")]
            cuts = np.flatnonzero(np.r_[True, cells[going][1:] != cells[going][:-1], True]) if len(going) else [0]
            for a, z in zip(cuts, cuts[1:]):
                mine, cell = going[a:z], cells[going[a]]
                self._probe(best, queries, active[mine], far[mine, cell], reach[mine], int(full[cell]))
        # What is left goes cell by cell: fewer and larger products than in each query's own order.
        np.put_along_axis(bound, order, np.nan, axis=1)  # visited: never within reach
        for cell in np.flatnonzero((bound <= distance(best.least()[active])[:, None]).any(axis=0)):
            reach = distance(best.least()[active])
            mine = np.flatnonzero(bound[:, cell] <= reach)
            if len(mine):
                self._probe(best, queries, active[mine], far[mine, cell], reach[mine], int(full[cell]))
        return best

    def _probe(self, best: Best, queries, rows, far, reach, cell: int) -> None:
        b, e = self.begins[cell], self.begins[cell + 1]
        radius = self.radius[b:e]
        lo = b + np.searchsorted(radius, (far - reach).min() - MARGIN)
        hi = b + np.searchsorted(radius, (far + reach).max() + MARGIN, side="right")
        step = max(1, (1 << 22) // max(1, len(rows)))
        for s in range(lo, hi, step):
            part = slice(s, min(s + step, hi))
            cos = np.round(queries[rows] @ self.vectors[part].T, DECIMALS)
            self.scored += cos.size
            best.add(rows, cos, self.refs[part])


def rows_of(best: Best, query_ids, ref_ids) -> pd.DataFrame:
    q, rank, ref, cos = best.ranked()
    return pd.DataFrame({
        "query_id": pd.Series([query_ids[i] for i in q], dtype=object), "rank": rank.astype(np.int64),
        "ref_id": pd.Series([ref_ids[i] for i in ref], dtype=object), "cosine": cos.astype(np.float64)})


def topk_local(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """``queries (qid, qvec)`` against references ``(rid, rvec)`` that are known to fit a task: one broadcast index."""
    spark = queries.sparkSession
    pdf = refs.toPandas().sort_values("rid", ignore_index=True)  # numbers follow the ids, for ties
    index = CellIndex(unit(stack(pdf["rvec"])) if len(pdf) else np.zeros((0, 1)))
    sent = spark.sparkContext.broadcast((pdf["rid"].tolist(), index))

    def score(batches):
        ids, index = sent.value
        for b in batches:
            if len(b) and ids:
                yield rows_of(index.topk(unit(stack(b["qvec"])), k), b["qid"].tolist(), ids)

    return queries.mapInPandas(score, TOPK_SCHEMA)


def topk_cells(queries: DataFrame, refs: DataFrame, k: int, dim: int, n_ref: int) -> DataFrame:
    """``queries (qid, qvec)`` against any number of references ``(rid, rvec)``.

    The centres are spread over the references with the smallest hashes, a bounded sample;
    cells too large for a task are cut into chunks by id, and queries of a
    cell into buckets, so a cell that holds most references, or that most
    queries visit, is many tasks.
    """
    spark = queries.sparkSession
    ship_package(spark)
    n = centre_count(n_ref, dim)
    first = refs.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE * n).toPandas()
    centres = unit(stack(first["rvec"]))
    centres = centres[~np.isnan(centres).any(axis=1)]
    if not len(centres):
        return spark.createDataFrame([], TOPK_SCHEMA)
    centres = spread_out(centres, n)
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches):
        c = sent.value
        for b in batches:
            v = unit(stack(b["rvec"]))
            ok = ~np.isnan(v).any(axis=1)
            v, ids = v[ok], b["rid"][ok]
            cos = v @ c.T
            cell = cos.argmax(axis=1) if len(v) else np.zeros(0, np.int64)
            yield pd.DataFrame({"cell": cell.astype(np.int64), "rid": ids.astype(str), "rvec": list(v), "radius": distance(cos[np.arange(len(v)), cell])})

    cells = cut_lineage(refs.mapInPandas(assign, "cell long, rid string, rvec array<double>, radius double"))
    stats = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("near"), F.max("radius").alias("wide")).toPandas()  # at most CELLS rows
    if not len(stats):
        return spark.createDataFrame([], TOPK_SCHEMA)
    stats = stats.sort_values("cell", ignore_index=True)
    per_task = max(1, GROUP_VALUES // dim)
    full, size, near, wide = (stats[c].to_numpy() for c in ("cell", "n", "near", "wide"))

    def far_from(b):
        q = unit(stack(b["qvec"]))
        ok = ~np.isnan(q).any(axis=1)
        return q[ok], b[ok], distance(q[ok] @ sent.value[full].T)

    def home(batches):
        """The nearest cells that have ``k`` references together."""
        for b in batches:
            q, b, far = far_from(b)
            order = np.argsort(far, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            i, j = np.nonzero(before < k)
            yield pd.DataFrame({"qid": b["qid"].astype(str).to_numpy()[i], "qvec": list(q[i]), "least": np.full(len(i), -np.inf),
                                "cell": full[order[i, j]].astype(np.int64)})

    def others(batches):
        """Cells that can beat the ``k``-th best of the home cells."""
        for b in batches:
            q, b, far = far_from(b)
            order = np.argsort(far, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            visited = np.zeros(far.shape, bool)
            np.put_along_axis(visited, order, before < k, axis=1)
            bound = np.maximum(np.maximum(far - wide, near - far), 0) - MARGIN
            least = b["least"].to_numpy(dtype=float)
            i, j = np.nonzero(~visited & (bound <= distance(np.where(np.isnan(least), -1.0, least))[:, None]))
            yield pd.DataFrame({"qid": b["qid"].astype(str).to_numpy()[i], "qvec": list(q[i]), "least": least[i], "cell": full[j].astype(np.int64)})

    pair = "qid string, qvec array<double>, least double, cell long"
    visits = spark.createDataFrame(pd.DataFrame({"cell": full.astype(np.int64), "chunks": (-(-size // per_task)).astype(np.int64)}))
    at_home = _probe_cells(cut_lineage(queries.mapInPandas(home, pair)), cells, visits, sent, per_task, k)
    at_home = cut_lineage(_k_best(at_home, k))
    least = at_home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("cosine")).alias("least"))
    known = queries.join(least, queries["qid"] == least["query_id"], "left").select("qid", "qvec", F.coalesce("least", F.lit(-1.0)).alias("least"))
    elsewhere = _probe_cells(cut_lineage(known.mapInPandas(others, pair)), cells, visits, sent, per_task, k)
    return _k_best(at_home.unionByName(elsewhere), k)


def _probe_cells(pairs: DataFrame, cells: DataFrame, visits: DataFrame, sent, per_task: int, k: int) -> DataFrame:
    """Score queries against the cells they visit: the ``k`` best of each task, none below the query's ``least``."""
    load = visits.join(pairs.groupBy("cell").agg(F.ceil(F.count("*") / per_task).alias("buckets")), "cell")  # a row a cell
    q = pairs.join(F.broadcast(load), "cell").withColumn("b", F.pmod(F.xxhash64("qid"), "buckets")).withColumn(
        "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("cell", "b", "c", "qid", "qvec", "least")
    r = cells.join(F.broadcast(load), "cell").withColumn("c", F.pmod(F.xxhash64("rid"), "chunks")).withColumn(
        "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1))).select("cell", "b", "c", "rid", "rvec")

    def score(key, qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        rpdf = rpdf.sort_values("rid", ignore_index=True)
        index = CellIndex(stack(rpdf["rvec"]) if len(rpdf) else np.zeros((0, 1)), sent.value[int(key[0])][None, :])
        best = index.topk(stack(qpdf["qvec"]) if len(qpdf) else np.zeros((0, 1)), k)
        out = rows_of(best, qpdf["qid"].tolist(), rpdf["rid"].tolist())
        floor = dict(zip(qpdf["qid"], qpdf["least"]))
        return out[out["cosine"] >= out["query_id"].map(floor).astype(float)]

    return q.groupBy("cell", "b", "c").cogroup(r.groupBy("cell", "b", "c")).applyInPandas(score, TOPK_SCHEMA)


def _k_best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), F.col("ref_id"))
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
