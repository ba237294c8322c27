"""The pipeline's stages on odd rows: nulls, shared ids, clashing columns, an empty table, long texts; one stage after the other."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, row_key string"
CLEAN = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "


def rows():
    long = " ".join(f"w{i}" for i in range(30_000))
    out = [(None, None, None, None, None, "k", None, "r"), (None, CLEAN * 3, "en", "s", 1, None, None, None), (5, None, None, None, None, None, None, None), (6, "", "en", "s", 0, None, None, None)]
    out += [(7, "a b c d e f g h i j k l m n " * 6, "en", "s", 1, None, "c", None)] * 2
    out += [(8, "a b c d e f g h i j k l m n " * 6, "en", "s", 1, None, None, None), (9, long, "en", "s", 1, None, None, None), (10, "stolen text of the test set that is ten words long " * 2, "en", "s", 1, None, None, None)]
    return out


@pytest.fixture()
def folder(spark, tmp_path):
    spark.createDataFrame([(7, 1, 0), (None, None, None), (10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "stolen text of the test set that is ten words long"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages_on_odd_rows(spark, folder):
    docs = spark.createDataFrame(rows(), SCHEMA)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        seen[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids = {name: sorted((i for i, _ in s if i is not None)) for name, s in seen.items()}
    assert ids["quality classifier"] == [5, 6, 7, 7, 8, 9, 10]  # labels of one class only: all stay
    assert ids["minhash near-dedup"] == [5, 6, 7, 7, 9, 10]  # 8 is like 7; rows of one id stay together
    assert sum(i is None for i, _ in seen["minhash near-dedup"]) == 2
    assert 10 not in ids["decontamination"] and 9 in ids["decontamination"]
    assert dict(seen["decontamination"])[9].count(" ") == 29_999
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in pieces} == {None, 5, 6, 7, 9} and all(r["length"] > 0 for r in pieces)


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.collect() == []
        if "text" in docs.columns:
            docs = spark.createDataFrame([], SCHEMA)
