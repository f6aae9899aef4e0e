"""Repeated passages, ranked search and vector codes against plain versions."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest

from graphmend.llm import ranked_search as rs, substring_dedup as sd, vector_codes as vc

DOCS = "doc_id long, text string, at long, n_words long, m long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut_plain(rows, k):
    last = float("inf")
    least = collections.defaultdict(lambda: last)
    split = [(last if d is None else d, d, WORDS.findall(t or "")) for d, t in rows]
    for d, _, w in split:
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            least[key] = min(least[key], d)
    out = []
    for d, doc_id, w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if least[tuple(w[i:i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def passages():
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    shared, other = word(80), word(30)
    rows = [(i, f"{word(20)} {shared} {word(25)}") for i in range(10, 20)]
    rows += [(5, shared), (6, " ".join(shared.split()[20:60])), (7, shared + " " + other), (8, other + "\t\n" + shared + " x")]
    rows += [(i, f"{word(5)} {other} {shared} {other}") for i in range(30, 34)]
    near = word(200).split()
    for i in range(40, 60):
        w = list(near)
        w[int(rng.integers(200))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(70, "a b " * 100), (71, "a b " * 50), (72, "b a " * 9), (73, "z " * 300), (74, "z " * 13), (75, "z " * 12)]
    rows += [(80, None), (81, ""), (82, " \n\t"), (83, "one two"), (None, shared), (None, word(40)), (5, shared), (5, shared + " tail")]
    rows += [(90, "É " * 20), (91, "é " * 20), (92, "É " * 13)]
    return rows


def as_docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], DOCS).repartition(5)


@pytest.mark.parametrize("k", [13, 4])
def test_repeats_against_plain(spark, k):
    rows = passages()
    got = sd.remove_repeats(as_docs(spark, rows), k=k)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == cut_plain(rows, k)


def test_repeats_with_colliding_hashes(spark, monkeypatch):
    """Path digests find the collisions, and the windows concerned are compared by their words."""
    rows = passages()
    docs = as_docs(spark, rows)
    table = sd._table(docs, "doc_id", "text")
    occurrences = sd.repeated_paths(table, 13)
    real = sd.repeated_paths

    def confused(t, k):
        paths = real(t, k)
        return paths.withColumn("path", (paths["path"] % 2).cast("long")).withColumn("late", paths["c"] % 3 == 0)

    assert occurrences.count() > 50
    monkeypatch.setattr(sd, "repeated_paths", confused)
    got = sd.remove_repeats(docs, k=13)
    assert sorted((tuple(r) for r in got.collect()), key=str) == cut_plain(rows, 13)


def test_paths_are_whole_copies(spark):
    """A passage of n windows in many documents is one path: one row an occurrence."""
    rng = np.random.default_rng(1)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared = word(60)
    rows = [(i, f"{word(30)} {shared} {word(30)}") for i in range(50)]
    paths = sd.repeated_paths(sd._table(as_docs(spark, rows), "doc_id", "text"), 13).collect()
    assert len(paths) == 50 and {r.n for r in paths} == {48} and sum(r.late for r in paths) == 49


def test_repeats_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def rank_plain(docs, items, k=10):
    fold = {c: c + 32 for c in range(65, 91)}
    terms = lambda t: TERMS.findall((t or "").translate(fold))
    table = [(d, collections.Counter(terms(t))) for d, t in docs]
    table = [(d, c, sum(c.values())) for d, c in table if c]
    n_all, l_all, df = len(table), sum(n for *_, n in table), collections.Counter()
    for _, c, _ in table:
        df.update(c.keys())
    out = []
    for item, text in set(items):
        score = collections.Counter()
        for t in set(terms(text)):
            if df[t]:
                w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
                for i, (_, c, n) in enumerate(table):
                    if c[t]:
                        score[i] += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (10 + (90 * n * n_all) // l_all)))
        best = sorted((-s, table[i][0] is None, table[i][0] or 0) for i, s in score.items() if s > 0)[:k]
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("long_, total, span, shard", [(128, 4096, 256, 4_000_000), (3, 0, 4, 900), (5, 12, 8, 4_000_000), (10**9, 0, 16, 700)])
def test_search_against_plain(spark, monkeypatch, long_, total, span, shard):
    for name, value in (("LONG", long_), ("SHORT_TOTAL", total), ("RANGE", span)):
        monkeypatch.setattr(rs, name, value)
    rng = np.random.default_rng(2)
    zipf = lambda n: " ".join(f"t{x}" for x in np.minimum(rng.zipf(1.3, n), 500))
    docs = [(int(i), zipf(int(rng.integers(1, 60)))) for i in rng.permutation(400)]
    docs += [(500, None), (501, ""), (502, "!!! --"), (None, "t1 t2 t900"), (503, "T1 t2-T3"), (7, "t900 t901"), (7, "t900 t901"), (504, "t1 " * 5000), (505, "Ünï T1ß")]
    docs += [(600 + i, "t900 same words") for i in range(30)]
    items = [(1, "t1 t2 t3"), (2, "t900 t901 t1 t1"), (3, "none of these"), (4, None), (5, ""), (1, "t1 t2 t3"), (1, "other t77"), (None, "ünï t5 t400 T2"), (6, zipf(80))]
    monkeypatch.setattr(rs, "QUERY_BYTES", 120)
    frame = spark.createDataFrame([(d, t, 0, 0, 0) for d, t in docs], DOCS).repartition(2)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, score long")
    index = rs.build_index(frame, shard_terms=shard)
    got = rs.search(index, asked)
    assert sorted((tuple(r) for r in got.collect()), key=str) == rank_plain(docs, items)


def test_search_skips_ranges(spark):
    """With a common and a rare term, ranges without the rare one are not read."""
    docs = [(i, ("rare " if i == 5 else "") + "common " * (1 + i % 3) + f"x{i}") for i in range(4000)]
    docs += [(10_000 + i, "rare common") for i in range(9)]
    index = rs.build_index(spark.createDataFrame([(d, t, 0, 0, 0) for d, t in docs], DOCS).coalesce(1))
    row = index.collect()[0].asDict()
    n_all, l_all = row["n_docs"], row["n_terms"]
    shard = rs.Shard(row, {b"common": 3, b"rare": 5000}, n_all, l_all)
    assert len(shard.best([b"common", b"rare"], 10)) == 10
    assert 0 < len(shard.lists[b"common"].ready) < shard.ranges / 2


def test_search_empty(spark):
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rs.search(rs.build_index(spark.createDataFrame([], DOCS)), asked).count() == 0
    index = rs.build_index(spark.createDataFrame([(1, "a", 0, 0, 0)], DOCS))
    assert rs.search(index, asked.where("item_id = 2")).count() == 0


def codes_plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, np.floor(256 * np.asarray(v, float)).astype(np.int64), lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([k[1] for k in kept])
    w = x.shape[1] // parts
    books = [x[:entries, p * w:(p + 1) * w].copy() for p in range(parts)]
    far = lambda p: ((x[:, None, p * w:(p + 1) * w] - books[p][None]) ** 2).sum(2)
    for _ in range(rounds):
        near = [far(p).argmin(1) for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = x[near[p] == e, p * w:(p + 1) * w]
                if len(mine):
                    books[p][e] = mine.sum(0) // len(mine)
    d = [far(p) for p in range(parts)]
    code = ["".join(f"{d[p][i].argmin():02x}" for p in range(parts)) for i in range(len(x))]
    error = [int(sum(d[p][i].min() for p in range(parts))) for i in range(len(x))]
    by_label = collections.Counter()
    for k, e in zip(kept, error):
        by_label[k[2]] += e
    sha = hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((k[0], c, e, by_label[k[2]], sha) for k, c, e in zip(kept, code, error)), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, dim int, code string"


def vector_rows(n=600, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.2, (n, dim)) + rng.normal(0, 0.5, (4, dim))[rng.integers(0, 4, n)]
    rows = [(int(i), x[i].tolist(), None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(n)]
    rows += [(n + 1, None, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [float("inf")] + [0.0] * (dim - 1), 2), (n + 4, [None] + [0.0] * (dim - 1), 2)]
    return rows + [(n + 5 + i, x[0].tolist(), 1) for i in range(300)] + [(None, x[1].tolist(), None)]


@pytest.mark.parametrize("block", [1, 7, 32])
def test_codes_against_plain(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS).repartition(3)
    got = vc.code_report(df, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == codes_plain(rows)


def test_codes_of_few_vectors_and_other_lengths(spark):
    rows = [(i, [0.1 * i, 0.2, 0.3], 1) for i in range(5)] + [(9, [], 1), (10, [], 2)] + [(20 + i, [float(i)] * 32, None) for i in range(6)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS)
    codes, books = vc.compress_vectors(df)
    book = {r.dim: r.book for r in books.collect()}
    got = {r.vec_id: r for r in codes.collect()}
    assert set(got) == {r[0] for r in rows} and all(r.error == 0 for r in got.values())
    for i, x, _ in rows:
        if x:
            assert vc.decode(got[i].code, book[len(x)], len(x)).tolist() == [math.floor(256 * v) for v in x]


def test_codes_empty(spark):
    codes, books = vc.compress_vectors(spark.createDataFrame([], VECTORS))
    assert codes.count() == 0 and books.count() == 0
    assert vc.code_report(spark.createDataFrame([], VECTORS)).count() == 0


def test_shortlists_keep_the_nearest_and_prune():
    rng = np.random.default_rng(4)
    x = rng.integers(-200, 200, (4096, 4))
    x = x[vc.curve_order(x)]
    book = rng.integers(-200, 200, (64, 4))
    cut = np.arange(0, len(x), 32)
    lo, hi = np.minimum.reduceat(x, cut), np.maximum.reduceat(x, cut)
    allowed = vc.shortlists(lo, hi, book)
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    for settle in (False, True):
        entry, whole = vc.nearest_entries(x, lo, hi, book, 32, settle)
        entry = np.where(entry < 0, whole[np.arange(len(x)) // 32], entry)
        assert (entry == d.argmin(1)).all()
    assert allowed.mean() < 0.6


def test_hilbert_neighbours_are_adjacent():
    side = np.arange(16)
    cells = np.array([(a, b) for a in side for b in side])
    walk = cells[np.argsort(vc.hilbert_keys(cells, 4))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_masking_many_spans_is_linear_and_exact(spark):
    import re as regex
    import time

    from graphmend.llm import secrets_ledger as sl

    key = "password=abcdef"
    texts = [" é ".join([key] * 12_000), "x" * 4096 + key, key, "é" * 4095 + key + "ü" * 5000 + key, "none", None, "",
             "token=" + "f" * 30 + " " + "0123456789abcdef" * 3]
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in enumerate(texts)], DOCS)
    ledger = sl.scan(docs)
    from graphmend.llm.common import stage

    ledger = stage(ledger, "mask-test")
    began = time.time()
    got = {r.doc_id: r.text for r in sl.masked(docs, ledger).collect()}
    assert time.time() - began < 30
    found = {r.doc_id: [(s["start"], s["end"]) for s in r.spans] for r in sl.findings(docs, ledger).collect()}
    for i, t in enumerate(texts):
        out, at = [], 0
        merged = []
        for a, z in sorted(found[i]):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        for a, z in merged:
            out.append(t[at:a] + "[SECRET]")
            at = z
        assert got[i] == (t if not merged else "".join(out) + t[at:])
    assert got[0].count("[SECRET]") == 12_000 and not regex.search("abcdef", got[0])


def test_fit_is_bounded_where_ids_repeat(spark, monkeypatch):
    from graphmend.llm import quality

    seen = []
    real = quality.fit_network
    monkeypatch.setattr(quality, "fit_network", lambda words, x, y: seen.append(len(x)) or real(words, x, y))
    rows = [(i % 3, f"good text number {i} with some words", 0, 0, 0) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, quality int")
    quality.fit_quality(spark.createDataFrame(rows, DOCS), labels, train_rows=20)
    assert seen == [20]
