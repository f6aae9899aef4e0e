"""Memory of packing."""

from graphmend.llm import packing, queries


def test_pieces_are_handed_back_in_small_batches(spark, monkeypatch):
    import pyarrow as pa
    import pyspark

    class Docs:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, kernel, _):
            return kernel

    class Task:
        @staticmethod
        def get():
            return type("T", (), {"partitionId": staticmethod(lambda: 0)})

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    kernel = packing._pieces(Docs(), queries.tokenizer_path("byte_bpe_50k.json"), 1024, 2, "doc_id", "text", True)
    n = 3000
    docs = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"word {i} " * (i % 40) for i in range(n)])], names=["doc_id", "text"])
    out = list(kernel(iter([docs])))
    assert max(b.num_rows for b in out) <= packing.OUT_ROWS
    assert sorted(x for b in out for x in b.column(0).to_pylist()) == list(range(n))
