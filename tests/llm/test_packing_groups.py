"""Texts are tokenized together by their bytes, not by a number of rows, so memory is bounded and distinct chunks are looked up seldom."""

from provintel.llm import packing
from provintel.llm.entries import tokenizer_path


def test_groups_follow_bytes(spark, monkeypatch):
    groups = []

    class Ids:
        def texts(self, texts):
            groups.append(texts)
            return [b"\1\0\0\0" * len(t) for t in texts]

    class Documents:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    import pyarrow as pa

    monkeypatch.setattr(packing, "_shared_ids", lambda path: Ids())
    run = packing.cut_pieces(Documents(), tokenizer_path())
    of = lambda texts: pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    short = list(run(iter([of(["a b"] * 999 + [None])])))
    assert [len(g) for g in groups] == [1000] and sum(b.num_rows for b in short) == 1000
    groups.clear()
    long = list(run(iter([of(["x" * 700_000] * 5)])))
    assert [len(g) for g in groups] == [2, 2, 1] and sum(sum(b.column(2).to_pylist()) for b in long) == 5 * 700_001
