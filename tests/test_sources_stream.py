"""File sources/sinks round trips and streaming == batch ingestion."""

import json
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from graphmend.operators import responses
from graphmend.sources import files
from graphmend.streaming import ingest


def _tmp():
    return tempfile.mkdtemp(prefix="graphmend-test-", dir="/tmp")


def test_triple_csv_roundtrip(spark):
    d = _tmp()
    pdf = pd.DataFrame({c: [f"{c} {i}" for i in range(5)] for c in files.TRIPLE_COLUMNS})
    pdf.loc[2, "source_extracted_definition"] = 'multi\nline, "quoted"'
    pdf.to_csv(os.path.join(d, "kg.csv"), index=False)
    df = files.read_triples_csv(spark, os.path.join(d, "kg.csv"))
    assert "source_type" in df.columns and df.count() == 5
    assert df.filter(F.col("source_extracted_definition").contains("multi\nline")).count() == 1


def test_json_table_columns_orient(spark):
    d = _tmp()
    p = os.path.join(d, "t.json")
    with open(p, "w") as f:
        json.dump({"entity1type": {"0": "gene", "1": "tf"}, "edge": {"0": "binds", "1": "regulates"},
                   "entity2type": {"0": "protein", "1": "gene"}}, f)
    df = files.read_json_table(spark, p, ["entity1type", "edge", "entity2type"])
    rows = sorted(df.collect())
    assert [(r["row_index"], r["edge"]) for r in rows] == [(0, "binds"), (1, "regulates")]


def test_nodes_csv_label_and_csv_sink(spark):
    d = _tmp()
    pd.DataFrame({"id:ID": ["a", "b"], ":LABEL": ["gene", "tf"]}).to_csv(os.path.join(d, "n.csv"), index=False)
    nodes = files.read_nodes_csv(spark, os.path.join(d, "n.csv"))
    assert sorted(r["label"] for r in nodes.collect()) == ["gene", "tf"]
    out = os.path.join(d, "out")
    files.write_csv(spark.createDataFrame([(1, ["x", "y"])], "k int, v array<string>"), out)
    back = spark.read.option("header", True).option("escape", "\"").csv(out).collect()
    assert json.loads(back[0]["v"]) == ["x", "y"]


def _line(cid, content):
    return json.dumps({"custom_id": cid, "response": {"status_code": 200, "body": {"choices": [
        {"index": 0, "message": {"role": "assistant", "content": content}}]}}})


def test_stream_equals_batch_and_resumes(spark):
    base = _tmp()
    src, sink, ckpt = (os.path.join(base, x) for x in ("in", "out", "ckpt"))
    lines = [(_line(str(i), json.dumps({str(i): "[[\"a\"]]"})), f"f{i % 3}.jsonl") for i in range(9)]
    lines.append(("{broken", "f0.jsonl"))
    df = spark.createDataFrame(lines, "value string, source_file string")
    ingest.write_line_files(df, src)
    streamed = ingest.stream_completions(spark, src, sink, ckpt)
    batch = responses.parse_completion_lines(df)
    key = lambda d: sorted((r["custom_id"] or "", r["status"]) for r in d.collect())
    assert key(streamed) == key(batch)
    # a new file arrives: the next run takes only that file
    more = spark.createDataFrame([(_line("99", json.dumps({"99": "[[\"b\"]]"})), "f9.jsonl")], "value string, source_file string")
    more.select("value", "source_file").write.mode("append").partitionBy("source_file").text(src)
    again = ingest.stream_completions(spark, src, sink, ckpt)
    assert again.count() == len(lines) + 1
    assert again.filter(F.col("custom_id") == "99").count() == 1


def test_stream_drops_redeliveries_but_not_retries(spark):
    base = _tmp()
    src, sink, ckpt = (os.path.join(base, x) for x in ("in", "out", "ckpt"))
    good = lambda i, v="a": _line(str(i), json.dumps({str(i): f'[["{v}"]]'}))
    cols = "value string, source_file string"

    def deliver(lines, name, mode="append"):
        ingest.write_line_files(spark.createDataFrame([(x, name) for x in lines], cols), src, mode=mode)
        return ingest.stream_completions(spark, src, sink, ckpt, max_files_per_trigger=1, dedupe_within=ingest.DEDUPE_WITHIN)

    deliver([good(1), good(2), good(2), "{broken", "{broken", _line("3", "no object")], "f0.jsonl", "overwrite")
    out = deliver([good(1, "later"), good(3), good(4)], "f1.jsonl")
    rows = sorted((r.custom_id or "", r.status, r.content or "") for r in out.collect())
    text = lambda i, v="a": json.dumps({str(i): f'[["{v}"]]'})
    assert rows == sorted([("", "corrupt", "")] * 2 + [("1", "ok", text(1)), ("2", "ok", text(2)), ("3", "bad_payload", "no object"),
                                                       ("3", "ok", text(3)), ("4", "ok", text(4))])
    again = deliver([good(3), good(4, "x"), good(5)], "f2.jsonl")
    assert sorted(r.custom_id for r in again.collect() if r.status == "ok") == ["1", "2", "3", "4", "5"]
