import numpy as np
from brute import groups, simhash

import __spark_entry__ as entry
import corpus_pipeline
from graphmend.llm import common, packing, quality, queries

SF = "/root/testdata/sf0.001"


def test_registered():
    q = entry.queries()
    assert [n for n in q if n.startswith("op")] == list(queries.QUERIES) and "pipeline" in q
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.ORACLE_SQL) <= set(q)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    outs = []
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = common.stage(stage(spark, current, SF), f"test-{name}")
        outs.append(current)
        if len(outs) < 4:
            assert current.columns == docs.columns
    scores = {r.doc_id: r.score for r in quality.score_documents(docs, quality.fit_quality(docs, labels)).select("doc_id", "score").collect()}
    good = sorted(d for d, s in scores.items() if s >= 0.5)
    assert sorted(r.doc_id for r in outs[0].collect()) == good
    fps = [simhash(rows[d].text) for d in good]
    linked = [(i, j) for i in range(len(good)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    single = sorted(d for d, k in zip(good, groups(len(good), linked)) if good[k] == d)
    assert sorted(r.doc_id for r in outs[1].collect()) == single
    masked = {r.doc_id: r for r in outs[2].collect()}
    assert sorted(masked) == single
    changed = [d for d in single if masked[d].text != rows[d].text]
    assert all("[SECRET]" in masked[d].text and masked[d].n_chars == len(masked[d].text) for d in changed)
    assert all("token = \"" not in masked[d].text for d in single)
    packed = outs[3].toPandas()
    assert sorted(set(packed.doc_id)) == single
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert np.array_equal(np.sort(packed[packed["piece"] == 0]["doc_id"]), single)


def test_pipeline_gives_the_ids_of_the_corpus(spark):
    """The last stage's ids, put together, are the library's of every text that was packed."""
    import tokenizers

    docs = spark.createDataFrame([(1, "some words " * 900), (2, "a [SECRET] kept"), (3, None), (4, "")], "doc_id long, text string")
    lib = tokenizers.Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    got = {}
    for r in sorted(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), key=lambda r: (r.doc_id, r.piece)):
        assert len(r.ids) == r.length
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {r.doc_id: lib.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}


def test_packing_query_digests_the_packed_ids(spark, monkeypatch):
    import zlib

    real, asked = packing.pack_documents, []
    monkeypatch.setattr(packing, "pack_documents", lambda *a, **k: asked.append(k) or real(*a, **k))
    got = queries.QUERIES["op7_best_fit_packing"](spark, SF).collect()
    assert asked and all(k.get("with_ids", True) for k in asked)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = real(docs, queries.tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2).collect()
    place = lambda r: (r.doc_id, r.piece, r.start, r.length)
    assert sorted((*place(r), r.ids_crc32) for r in got) == sorted(
        (*place(r), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in want)
