"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors are one class.  Every tree splits its cells by a random
direction near the median of the projections; vectors near the cut go to
both sides (spill), so close pairs are rarely parted, and several trees make
up for those that are.  Inside a leaf all pairs are verified by cosine in
double precision.  A pair that meets in several leaves counts only in the
smallest of its shared leaves, so links are counted without gathering pairs,
and only spanning edges leave a leaf for the union.

The number of trees and their spill follow from the data (``plan_forest``):
trial trees over a bounded sample tell, for each spill, the chance that a
pair just at the threshold is parted by one tree of the table's depth; so
many trees are grown that all of them part at most ``MISSED`` of such pairs
even among the ``HARDEST`` tenth of the vectors, so a crowded group among
easy rows counts in full, with the spill that needs the fewest copies of a vector.  Where the forest
would compare more pairs than there are, the vectors are one leaf.

Splits are fitted on a bounded sample for each cell; every vector is routed.
Cells still too large are split again in further rounds.  A cell whose
vectors are mostly close to each other is not split, as its links alone are
that many: it stays one leaf and is compared slice against slice.
"""

from __future__ import annotations

from functools import lru_cache
from math import erfc

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmend.llm.common import bounded_batches, connected_components, stage, unstage

MISSED = 0.01         # share of pairs just at the threshold that all trees together may part, by estimate ...
HARDEST = 0.1         # ... as the mean over this share of the vectors, those whose pairs are parted most
SPILLS = (0.02, 0.04, 0.06, 0.08, 0.12)  # shares of a cell on each side of the median that go both ways, to choose from
TRIALS = 2            # trial trees for each spill
LEAF = 768            # cells expected to hold at most this many vectors are leaves
FIT_SAMPLE = 8_192    # vectors sampled of a cell to fit its splits
FIT_LEAST = 32        # a sampled cell smaller than this is not split in this round
PLAN_DEPTH = 5        # halvings of the sample in trial trees, so that a cell still tells its share of parted pairs
DENSE = 0.10          # share of sampled pairs that link, from which a cell is not split
SLICE = 2_048         # leaves above this are compared in slices
ROUTED = 16_384       # vectors that share one copy of the splits while they are routed
_SHIFT = 48           # leaf code: tree number above, path (heap index) below
_DEEPEST = 46
_MOST = 1 << 14       # tree numbers fit above the path


@lru_cache(maxsize=4096)
def _direction(code: int, dim: int) -> np.ndarray:
    v = np.random.default_rng(code).standard_normal(dim)
    return v / np.linalg.norm(v)


def _children(code: int) -> tuple[int, int]:
    tree, path = code >> _SHIFT, code & ((1 << _SHIFT) - 1)
    return (tree << _SHIFT) | (2 * path), (tree << _SHIFT) | (2 * path + 1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def grow(code: int, sample: np.ndarray, size: float, threshold: float, spill: float, leaf: int, least: int):
    """Split a cell of ``size`` vectors as far as its sample tells: ``(splits, ends, parted)``.

    ``splits`` are ``(code, low, high)``: left takes projections below
    ``high``, right those from ``low`` on.  ``ends`` are the cells left whole,
    as ``(kept, size, last, whole)``: for each sampled vector the chance that
    a pair just at ``threshold`` is still together there, the expected size,
    the share parted by the split above, and whether the cell is to stay
    whole.  ``parted`` is the mean share parted by the splits of each level.
    """
    gap = float(np.sqrt(max(2 - 2 * threshold, 0.0)))  # distance of such a pair
    splits, ends, levels, todo = [], [], [], [(code, sample, np.ones(len(sample)), float(size), 0.0, 0)]
    while todo:
        c, x, stay, n, last, depth = todo.pop()
        if n <= leaf or len(x) < least or (c & ((1 << _SHIFT) - 1)).bit_length() > _DEEPEST:
            ends.append((stay, n, last, n <= leaf))
            continue
        probe = x[np.linspace(0, len(x) - 1, min(len(x), 256)).astype(int)]
        p = x @ _direction(c, x.shape[1])
        low, high = np.quantile(p, [0.5 - spill, 0.5 + spill])
        if ((probe @ probe.T) >= threshold).mean() - 1 / len(probe) >= DENSE or not low < high:
            ends.append((stay, n, last, True))
            continue
        # Over random directions the pair's projected gap is normal, with the share of its distance that a
        # dimension has; where the vectors fill fewer dimensions, the cell's own spread tells that share.
        spread = float(np.sqrt(x.var(axis=0).sum()))
        sigma = gap * max(x.shape[1] ** -0.5, float(p.std()) / spread if spread > 0 else 0.0)
        parted = np.where(p < low, _above((high - p) / sigma), np.where(p >= high, _above((p - low) / sigma), 0.0)) if sigma else np.zeros(len(p))
        splits.append((c, float(low), float(high)))
        levels.append((depth, len(x), parted.sum()))
        after = stay * (1 - parted)
        for child, inside in zip(_children(c), (p < high, p >= low)):
            todo.append((child, x[inside], after[inside], n * inside.mean(), float(parted.mean()), depth + 1))
    deep = [[(k, total) for d, k, total in levels if d == depth] for depth in range(1 + max((d for d, _, _ in levels), default=-1))]
    return splits, ends, [sum(t for _, t in level) / sum(k for k, _ in level) for level in deep]


def plan_forest(sample: np.ndarray, size: int, threshold: float, leaf: int | None = None, least: int | None = None) -> tuple[int, float, float]:
    """``(trees, spill, copies)`` for ``size`` vectors of which ``sample`` is a sample; 0 trees: one leaf.

    Below the cells that the sample can split, further levels part as much
    as the last split, growing as it did from level to level.
    """
    leaf, least = leaf or LEAF, max(least or FIT_LEAST, len(sample) >> PLAN_DEPTH)
    best = (0, 0.0, 1.0)
    cheapest = size / leaf  # with more copies than that, leaves hold more pairs than the table
    for spill in SPILLS:
        kept, copies = [], 0.0
        for trial in range(TRIALS):
            _, ends, parted = grow((_MOST + trial << _SHIFT) | 1, sample, size, threshold, spill, leaf, least)
            from_, to = (parted[len(parted) // 2], parted[-1]) if parted else (0.0, 0.0)
            growth = max(1.0, (to / from_) ** (1 / max(1, len(parted) - 1 - len(parted) // 2))) if from_ > 0 else 1.0
            for stay, n, last, whole in ends:
                levels = 0.0 if whole else max(0.0, np.log(n / leaf) / -np.log(0.5 + spill))
                for k in range(int(np.ceil(levels))):
                    share = 1 - min(0.5, last * growth ** (k + 1))
                    stay = stay * share ** min(1.0, levels - k)
                kept.append(stay)
                # A cell that stays whole is compared in slices, with a copy for each other slice.
                copies += len(stay) * (1 + 2 * spill) ** levels * (max(1.0, n / SLICE) if whole else 1.0)
        missed = np.sort(1 - np.concatenate(kept))
        missed = missed[int((1 - HARDEST) * len(missed)):]
        copies /= TRIALS * len(sample)
        trees = 1
        while trees < _MOST and (missed ** trees).mean() > MISSED:
            trees += max(1, trees // 16)
        if (missed ** trees).mean() <= MISSED and trees * copies < cheapest:
            best, cheapest = (trees, spill, trees * copies), trees * copies
    return best


_GRID = np.linspace(0, 8, 1601)
_TAIL = np.array([0.5 * erfc(z / 2 ** 0.5) for z in _GRID])


def _above(z: np.ndarray) -> np.ndarray:
    """Chance that a standard normal value is above ``z >= 0``."""
    return np.interp(z, _GRID, _TAIL)


def route(code: int, splits: dict[int, tuple[float, float]], unit: np.ndarray):
    """Yield ``(leaf code, row indices)`` of the vectors below a cell."""
    todo = [(code, np.arange(len(unit)))]
    while todo:
        c, rows = todo.pop()
        if not len(rows):
            continue
        if c not in splits:
            yield c, rows
            continue
        low, high = splits[c]
        p = unit[rows] @ _direction(c, unit.shape[1])
        left, right = _children(c)
        todo += [(left, rows[p < high]), (right, rows[p >= low])]


def _matrix(col) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def _leaves(classes: DataFrame, threshold: float, trees: int | None) -> DataFrame:
    """``(cid, dim, cell)``: every leaf of every vector that shares one, as staged tables.

    Every vector length (``dim``) has a forest of its own; all of them grow in
    the same jobs, as cells are told apart by length and code.  Lengths with
    no more vectors than a leaf holds are one leaf.  ``trees`` sets the number
    of trees in place of the planned one.
    """
    import pandas as pd

    leaf, least = LEAF, FIT_LEAST
    lengths = stage(classes.groupBy("dim").agg(F.count("*").alias("n")), "forest-lengths")
    share = F.rand(seed=7) < F.lit(float(FIT_SAMPLE)) / F.col("n")
    sample = stage(classes.select("dim", "vec").join(lengths.where(F.col("n") > leaf), "dim").where(share), "forest-sample")

    def plan(key, pdf):
        planned, spill, _ = plan_forest(_unit(_matrix(pdf["vec"])), int(pdf["n"].iloc[0]), threshold, leaf, least)
        return pd.DataFrame({"dim": [int(key[0])], "trees": [trees if trees and planned else planned], "spill": [spill]})

    def fit(key, pdf):
        first = pdf.iloc[0]
        splits, _, _ = grow(int(key[1]), _unit(_matrix(pdf["vec"])), float(first["n"]), threshold, float(first["spill"]), leaf, least)
        codes, low, high = zip(*splits) if splits else ((), (), ())
        return pd.DataFrame({"dim": [int(key[0])], "cell": [int(key[1])], "codes": [list(codes)], "low": [list(low)], "high": [list(high)]})

    def send(batches):
        """Rows sorted by group and slice: the splits of its cells (no ``cid``) come before its vectors."""
        at, roots, splits = None, [], {}
        for pdf in batches:
            out = []
            for key, own in pdf.groupby(["dim", "grp", "slice"], sort=False):
                if key != at:
                    at, roots, splits = key, [], {}
                head = own["cid"].isna().to_numpy()
                for h in own[head].itertuples():
                    roots.append(int(h.cell))
                    splits.update((int(k), (lo, hi)) for k, lo, hi in zip(h.codes, h.low, h.high))
                own = own[~head]
                if not len(own):
                    continue
                cid, unit = own["cid"].to_numpy().astype(np.int64), _unit(_matrix(own["vec"]))
                for root in roots:
                    for cell, inside in route(root, splits, unit):
                        out.append((cid[inside], key[0], cell, root))
            if out:
                n = [len(x[0]) for x in out]
                yield pd.DataFrame({"cid": np.concatenate([x[0] for x in out])} | {
                    name: np.repeat([x[i] for x in out], n) for i, name in enumerate(("dim", "cell", "was"), 1)})

    plans = stage(sample.groupBy("dim").applyInPandas(plan, "dim int, trees int, spill double"), "forest-plan")
    whole = lengths.join(plans, "dim", "left").where((F.col("n") > 1) & (F.coalesce("trees", F.lit(0)) == 0)).select("dim")
    done = [classes.join(whole, "dim", "left_semi").select("cid", "dim", F.lit(1).cast("long").alias("cell"))]
    planted = plans.where("trees > 0").join(lengths, "dim")
    roots = F.explode(F.transform(F.sequence(F.lit(0), F.col("trees") - 1), lambda t: F.shiftleft(t.cast("long"), _SHIFT) + 1)).alias("cell")
    sizes = planted.select("dim", "n", "spill", roots)
    # The first round routes a vector through all trees at once (group 0), later ones each open cell by itself.
    todo = classes.select("cid", "dim", "vec").join(planted.select("dim", "n"), "dim").withColumn("grp", F.lit(0).cast("long"))
    sample = sample.select("dim", "vec").join(sizes, "dim")
    while not sizes.isEmpty():
        fitted = stage(sample.groupBy("dim", "cell").applyInPandas(
            fit, "dim int, cell long, codes array<long>, low array<double>, high array<double>"), "forest-splits")
        slices = F.ceil(F.col("n") / ROUTED).cast("int")
        group = F.lit(0).cast("long") if len(done) == 1 else F.col("cell")
        heads = fitted.join(sizes, ["dim", "cell"]).select("dim", group.alias("grp"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "cell",
                                                           "codes", "low", "high", F.lit(None).cast("long").alias("cid"), F.lit(None).cast("array<double>").alias("vec"))
        body = todo.select("dim", "grp", F.pmod(F.xxhash64("cid"), slices).cast("int").alias("slice"), F.lit(None).cast("long").alias("cell"),
                           *[F.lit(None).cast(t).alias(c) for c, t in (("codes", "array<long>"), ("low", "array<double>"), ("high", "array<double>"))],
                           "cid", "vec")
        keys = ["dim", "grp", "slice"]
        routed = stage(heads.unionByName(body).repartition(*keys).sortWithinPartitions(*keys, F.col("cid").asc_nulls_first()).mapInPandas(
            send, "cid long, dim int, cell long, was long"), "forest-cells")
        if len(done) > 1:  # open cells of which nothing was sampled
            done.append(todo.select("cid", "dim", F.col("grp").alias("cell")).join(fitted.select("dim", "cell"), ["dim", "cell"], "left_anti"))
        counts = routed.groupBy("dim", "cell", "was").agg(F.count("*").alias("n"))
        # Split again what is still far above a leaf and was split at all this time.
        sizes = stage(counts.where((F.col("n") > 4 * leaf) & (F.col("cell") != F.col("was"))).join(plans.select("dim", "spill"), "dim")
                      .select("dim", "cell", "n", "spill"), "forest-open")
        done.append(routed.join(sizes, ["dim", "cell"], "left_anti").select("cid", "dim", "cell"))
        open_ = routed.join(sizes, ["dim", "cell"]).select("cid", "dim", "cell", "n", "spill")
        todo = open_.join(classes.select("cid", "vec"), "cid").withColumn("grp", F.col("cell"))
        sample = open_.where(share).join(classes.select("cid", "vec"), "cid").select("dim", "cell", "n", "spill", "vec")
    leaves = done[0]
    for d in done[1:]:
        leaves = leaves.union(d)
    return leaves


def _compare(threshold: float):
    import pandas as pd

    def kernel(key, pdf):
        """Counts ``(cid, -1, links)`` and spanning edges ``(a, b, 0)`` of one leaf or pair of slices."""
        vec = _matrix(pdf["vec"])
        norm = np.linalg.norm(vec, axis=1)
        unit = vec / norm[:, None]
        cid, copies, part = pdf["cid"].to_numpy(), pdf["copies"].to_numpy(), pdf["part"].to_numpy()
        cross = key[1] != key[2]
        codes = np.full((len(pdf), max(map(len, pdf["codes"]))), -1, np.int64)
        for i, c in enumerate(pdf["codes"]):
            codes[i, :len(c)] = c
        step = max(1, 2_000_000 // (codes.shape[1] + 1))
        links = np.zeros(len(pdf), np.int64)
        root = np.arange(len(pdf))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for s in range(0, len(pdf), 512):
            cos = unit[s:s + 512] @ unit.T
            i, j = np.nonzero(cos >= threshold - 1e-9)
            i += s
            ok = (j > i) & ((part[i] != part[j]) if cross else True)
            i, j = i[ok], j[ok]
            c = cos[i - s, j]
            edge = np.abs(c - threshold) < 1e-9  # decide borderline pairs by the plain formula
            if edge.any():
                c[edge] = [vec[a] @ vec[b] / (norm[a] * norm[b]) for a, b in zip(i[edge], j[edge])]
            i, j = i[c >= threshold], j[c >= threshold]
            for k in range(0, len(i), step):
                a, b = i[k:k + step], j[k:k + step]
                # Codes of one vector differ, so equal neighbours in the sorted union are shared leaves.
                both = np.sort(np.concatenate([codes[a], codes[b]], axis=1), axis=1)
                mine = ~((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)).any(axis=1)
                np.add.at(links, a[mine], copies[b[mine]])
                np.add.at(links, b[mine], copies[a[mine]])
            for a, b in zip(i, j):
                ra, rb = find(a), find(b)
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
        top = np.array([find(i) for i in range(len(pdf))])
        counted, tied = np.flatnonzero(links), np.flatnonzero(top != np.arange(len(pdf)))
        return pd.DataFrame({"a": np.r_[cid[counted], cid[top[tied]]],
                             "b": np.r_[np.full(len(counted), -1), cid[tied]].astype(np.int64),
                             "links": np.r_[links[counted], np.zeros(len(tied), np.int64)]})

    return kernel


def near_vectors(vectors: DataFrame, threshold: float = 0.9, trees: int | None = None, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Rows with equal vectors link with each other.  Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing:
    ``n_links`` 0, ``component_id`` their own id, kept.  Vectors of different
    length never link.  Rows that repeat an id are vectors of their own; a
    null id takes part but never names a component (null only where there is
    no other; such a row is kept).  Other columns are not read.  An empty
    table gives an empty result.  ``trees`` sets the number of trees; by
    default it follows from the data.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    # Scaling by the largest component keeps the squares of the norm finite.
    scaled = F.transform("vec", lambda x: x / F.array_max(F.transform("vec", lambda y: F.abs(y))))
    rows = src.select("vec_id", F.when(usable, F.col("vec")).alias("vec"))
    grouped = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = stage(grouped.select(F.monotonically_increasing_id().alias("cid"), "rep", "copies", F.col("vec").alias("raw"),
                                   scaled.alias("vec"), F.size("vec").alias("dim")), "forest-class")
    leaves = _leaves(classes.select("cid", "dim", "vec"), threshold, trees)
    of_vec = leaves.groupBy("cid").agg(F.array_sort(F.collect_set("cell")).alias("codes"))
    sizes = leaves.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    carried = classes.join(of_vec, "cid").select("cid", "copies", "vec", "dim", "codes", F.explode("codes").alias("cell"))
    carried = carried.join(sizes.where(F.col("n") > 1), ["dim", "cell"])
    # Only leaves before this one matter: a pair that shares one of them counts there.
    carried = carried.withColumn("codes", F.filter("codes", lambda c: c < F.col("cell")))
    slices = carried.withColumn("c", F.ceil(F.col("n") / SLICE).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("cid"), F.col("c")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("c") - 1),
                                 lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j"))))
    slices = slices.withColumn("p", pair).select("cid", "copies", "vec", "codes", "part", "cell", "dim",
                                                 F.col("p.i").alias("i"), F.col("p.j").alias("j"))
    found = stage(slices.groupBy("cell", "i", "j", "dim").applyInPandas(_compare(threshold), "a long, b long, links long"),
                  "forest-links")
    links = found.where("b = -1").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("other"))
    comp = connected_components(found.where("b >= 0").select("a", "b"))
    named = classes.select("cid", "rep", "copies").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "root", F.coalesce("root", "cid"))
    low = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    per = named.join(low, "root").join(links, "cid", "left").join(classes.select("cid", "raw"), "cid").select(
        "raw", "component_id", (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"))
    per = stage(per, "forest-result")
    unstage(found)
    out = rows.join(per, rows["vec"] == per["raw"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("raw").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
