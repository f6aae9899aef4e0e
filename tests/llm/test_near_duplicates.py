import numpy as np
import pytest
from brute import cosine_links, groups, simhash
from pyspark.sql import functions as F

from graphmend.llm import common, embedding_forest, simhash as sh

DOCS = "doc_id long, text string, fp long, gid string, component_id string"


def doc_rows(texts):
    return [(i, t, 7, "x", "y") for i, t in enumerate(texts)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(900, 901), (901, 902), (902, 900), (5, 5)]
    got = {r.node: r.root for r in common.connected_components(
        spark.createDataFrame(edges + edges + [(None, 3)], "a long, b long")).collect()}
    want = {**{i: 100 for i in range(101, 161)}, **{k: 1 for k in range(2, 40)}, 901: 900, 902: 900}
    assert got == want


def test_components_without_edges(spark):
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_against_brute_force(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [base, base + " more", base.replace("word7 ", "Word7\t"), base.replace("word150", "other"), None, "", " \n", "one", "ONE two",
             "one two three four", "É é", "É É", "a b c d e " * 4000, "a b c d e " * 4000]
    rng = np.random.default_rng(1)
    for k in range(40):
        words = base.split()
        words[int(rng.integers(300))] = f"new{k}"
        texts.append(" ".join(words))
    rows = doc_rows(texts) + [(None, base, 1, "a", "b"), (3, "unlike", 1, "a", "b")]
    got = sh.simhash_groups(spark.createDataFrame(rows, DOCS)).collect()
    fps = [simhash(r[1]) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    low = groups(len(rows), linked)
    members = {}
    for i, r in enumerate(rows):
        members.setdefault(low[i], []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    key = lambda x: tuple("" if y is None else str(y) for y in x)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(
        ((r[0], f"{f:016x}", least[k]) for r, f, k in zip(rows, fps, low)), key=key)


def test_simhash_keeps_one_of_each_group(spark):
    texts = ["same text of a few words here", "same text of a few words here", "another one entirely, not like it", None, ""]
    docs = spark.createDataFrame(doc_rows(texts) + doc_rows(texts[:1]) + [(None, "no id but text", 1, "a", "b")], DOCS)
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect()) == [
        (-1, "no id but text"), (0, texts[0]), (2, texts[2]), (3, "")]


def test_simhash_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert sh.simhash_groups(empty).count() == 0
    assert sh.keep_one(empty).count() == 0


def test_every_block_count_finds_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for _ in range(6):
            x = int(b)
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    want = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    at = {f - (1 << 64) if f >> 63 else f: i for i, f in enumerate(fps)}
    for blocks, slice_, small in ((6, 16_384, 24), (7, 5, 2), (8, 16_384, 1)):
        monkeypatch.setattr(sh, "block_count", lambda n, d, b=blocks: b)
        monkeypatch.setattr(sh, "SLICE", slice_)
        monkeypatch.setattr(sh, "SMALL", small)
        edges = [(at[r.a], at[r.b]) for r in sh.close_pairs(df, 4).collect()]
        assert groups(len(fps), edges) == want


def test_more_rows_mean_longer_keys():
    assert [sh.block_count(n, 4) for n in (0, 1000, 10**6, 10**9)] == sorted(sh.block_count(n, 4) for n in (0, 1000, 10**6, 10**9))
    assert sh.block_count(10**9, 4) > sh.block_count(1000, 4) >= 6


VECS = "vec_id long, embedding array<float>, cid string, cell long, copies long"


def check_vectors(spark, vectors, ids=None):
    ids = ids or list(range(len(vectors)))
    df = spark.createDataFrame([(i, v, "c", 1, 2) for i, v in zip(ids, vectors)], VECS)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_forest.near_vectors(df).collect())
    single = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors]
    clean = [None if v is None or None in v else v for v in single]
    links = cosine_links(clean)
    low = groups(len(vectors), links)
    n = np.zeros(len(vectors), int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    least = {}
    for i, k in enumerate(low):
        least[k] = min(least.get(k, ids[i]), ids[i])
    assert got == sorted((ids[i], int(n[i]), least[low[i]], ids[i] == least[low[i]]) for i in range(len(vectors)))


def test_vectors_odd_values(spark):
    x = [1.0, 0.0, 0.0]
    check_vectors(spark, [x, [0.95, 0.05, 0.0], x, x, None, [], [0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 0.0, 0.0],
                          [None, 1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [1e-30, 0.0, 0.0], [1e30, 0.0, 0.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]])


def test_vectors_empty_table(spark):
    assert embedding_forest.near_vectors(spark.createDataFrame([], VECS)).count() == 0


def test_vectors_of_many_lengths(spark):
    """Each of 90 lengths finds its links, however many lengths there are."""
    rng = np.random.default_rng(4)
    vectors = []
    for dim in range(2, 92):
        v = rng.standard_normal(dim)
        vectors += [v.tolist(), (v + 0.01 * rng.standard_normal(dim)).tolist()]
    check_vectors(spark, vectors)


def test_forests_of_several_lengths(spark, monkeypatch):
    """Lengths that are split and lengths that are one leaf, in the same jobs."""
    monkeypatch.setattr(embedding_forest, "LEAF", 40)
    monkeypatch.setattr(embedding_forest, "FIT_SAMPLE", 100)
    monkeypatch.setattr(embedding_forest, "FIT_LEAST", 16)
    rng = np.random.default_rng(6)
    vectors = []
    for dim, n in ((16, 30), (17, 25), (18, 4)):
        vectors += (np.repeat(rng.standard_normal((n, dim)), 4, axis=0) + 0.05 * rng.standard_normal((4 * n, dim))).tolist()
    check_vectors(spark, vectors)


def test_vectors_null_id_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], "a", 1, 1), (4, [1.0, 0.01], "a", 1, 1), (4, [1.0, 0.01], "a", 1, 1), (None, [0.0, 1.0], "a", 1, 1)], VECS)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_forest.near_vectors(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 0, None, True), (None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True)], key=str)


def test_forest_splits_dense_groups_and_slices(spark, monkeypatch):
    """Small leaves, several rounds of splitting and sliced leaves give the exact links."""
    monkeypatch.setattr(embedding_forest, "LEAF", 40)
    monkeypatch.setattr(embedding_forest, "FIT_SAMPLE", 100)
    monkeypatch.setattr(embedding_forest, "FIT_LEAST", 16)
    monkeypatch.setattr(embedding_forest, "SLICE", 32)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    near = np.repeat(centres, 6, axis=0) + 0.1 * rng.standard_normal((180, 16))
    hot = centres[0] + 0.05 * rng.standard_normal((120, 16))
    check_vectors(spark, np.concatenate([near, hot, rng.standard_normal((200, 16))]).astype(np.float32).tolist())


@pytest.mark.parametrize("n", [3000])
def test_forest_recall_near_the_threshold(spark, n):
    """Random pairs at cosine 0.9 to 0.93, the hardest to keep together: recall of at least 0.9."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((n, 64))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = rng.uniform(0.901, 0.93, (n, 1))
    other = c * a + np.sqrt(1 - c * c) * b
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, other]))]
    got = embedding_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = got.agg(F.sum("n_links")).first()[0] / 2
    assert n >= found >= 0.97 * n


def related_group(rng, n, pairs, mean=0.8, dim=64):
    """``n`` unit vectors of a group with this mean cosine; the first ``pairs`` have partners at cosine 0.901 to 0.93 at the end."""
    def around(k):
        v = np.c_[np.zeros(k), rng.standard_normal((k, dim - 1))]
        return v / np.linalg.norm(v, axis=1)[:, None]

    own = around(n - pairs)
    a, b = own[:pairs], around(pairs)
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = (rng.uniform(0.901, 0.93, (pairs, 1)) - mean) / (1 - mean)
    group = np.sqrt(1 - mean) * np.concatenate([a, own[pairs:], c * a + np.sqrt(1 - c * c) * b])
    group[:, 0] = np.sqrt(mean)
    return group


@pytest.mark.parametrize("n,rest", [(60_000, 0), (20_000, 40_000)])
def test_trees_keep_pairs_of_a_large_related_group(n, rest):
    """Mean cosine 0.8, alone and as a third of the rows: planted pairs share a leaf of some tree, and leaves stay small."""
    rng = np.random.default_rng(11)
    pairs = 1000
    other = rng.standard_normal((rest, 64))
    x = np.concatenate([related_group(rng, n, pairs), other / np.linalg.norm(other, axis=1)[:, None]])
    sample = x[rng.random(len(x)) < embedding_forest.FIT_SAMPLE / len(x)]
    trees, spill, copies = embedding_forest.plan_forest(sample, len(x), 0.9)
    assert 1 < trees and copies < len(x) / embedding_forest.LEAF
    found, placed, largest = np.zeros(pairs, bool), 0, 0
    for tree in range(trees):
        root = (tree << embedding_forest._SHIFT) | 1
        fitted, _, _ = embedding_forest.grow(root, sample, len(x), 0.9, spill, embedding_forest.LEAF, embedding_forest.FIT_LEAST)
        for _, rows in embedding_forest.route(root, {c: (low, high) for c, low, high in fitted}, x):
            inside = np.zeros(len(x), bool)
            inside[rows] = True
            found |= inside[:pairs] & inside[n - pairs:n]
            placed, largest = placed + len(rows), max(largest, len(rows))
    assert found.mean() >= 0.99
    assert largest <= 4 * embedding_forest.LEAF
    assert placed <= 1.2 * copies * len(x)


@pytest.mark.parametrize("mean", [0.5, 0.7, 0.8])
def test_plans_of_related_groups_grow_slower_than_all_pairs(mean):
    """Declared sizes of a million and of a hundred million: cells split down to the leaf, copies stay far below all pairs."""
    x = related_group(np.random.default_rng(13), embedding_forest.FIT_SAMPLE, 0, mean)
    plans = {size: embedding_forest.plan_forest(x, size, 0.9) for size in (10 ** 6, 10 ** 8)}
    for size, (trees, spill, copies) in plans.items():
        assert trees and copies <= (0.25 if size == 10 ** 6 else 0.05) * size / embedding_forest.LEAF
        _, ends, _ = embedding_forest.grow(1, x, size, 0.9, spill, embedding_forest.LEAF, embedding_forest.FIT_LEAST)
        # What is still above four leaves lacks only sampled vectors, so the next round splits it.
        assert all(len(stay) < embedding_forest.FIT_LEAST for stay, n, _, whole in ends if n > 4 * embedding_forest.LEAF)
        assert not any(whole and n > 4 * embedding_forest.LEAF for _, n, _, whole in ends)
    assert plans[10 ** 8][2] < 15 * plans[10 ** 6][2]


def test_links_of_a_related_group(spark, monkeypatch):
    """All steps with small leaves and several rounds of splits: recall of all links of a group with mean cosine 0.8."""
    monkeypatch.setattr(embedding_forest, "LEAF", 48)
    monkeypatch.setattr(embedding_forest, "FIT_SAMPLE", 400)
    rng = np.random.default_rng(12)
    other = rng.standard_normal((2000, 64))
    x = np.concatenate([related_group(rng, 3000, 1000), other / np.linalg.norm(other, axis=1)[:, None]])
    links = (np.count_nonzero(x @ x.T >= 0.9) - len(x)) / 2
    got = embedding_forest.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    found = got.agg(F.sum("n_links")).first()[0] / 2
    assert links >= found >= 0.98 * links
