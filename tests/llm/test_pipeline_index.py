"""The pipeline's stages: the index of repeats has runs to meet and compact, and workers get few rows at once."""

import pyarrow as pa

import corpus_pipeline
from provintel.llm.substring_dedup import WIDTH, FingerprintIndex


def test_the_stage_of_repeats_meets_compacted_runs(spark, monkeypatch):
    met, compacted = [], []
    repeats, compact = FingerprintIndex.repeats, FingerprintIndex.compact
    monkeypatch.setattr(FingerprintIndex, "repeats", lambda x, *a, **k: (met.append(len(x.runs)), repeats(x, *a, **k))[1])
    monkeypatch.setattr(FingerprintIndex, "compact", lambda x: (compacted.append(len(x.runs)), compact(x))[1])
    passage = [f"p{i}" for i in range(20)]
    texts = {d: [f"a{d}_{i}" for i in range(8)] + (passage[: 14 + d % 5] if d % 3 == 0 else []) + [f"b{d}_{i}" for i in range(5)] for d in range(1, 61)}
    docs = spark.createDataFrame([(d, " ".join(t), len(" ".join(t))) for d, t in texts.items()], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    seen, want = set(), {}
    for d, words in sorted(texts.items()):
        windows = [tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)]
        gone = {j for i, w in enumerate(windows) if w in seen for j in range(i, i + WIDTH)}
        seen.update(windows)
        text = " ".join(w for j, w in enumerate(words) if j not in gone)
        want[d] = (text, len(text))
    assert got == want
    assert max(met) > 0 and compacted


def test_workers_get_few_rows_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        corpus_pipeline.run(spark, "/root/testdata/sf0.001")
        rows = spark.range(3000).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"id": pa.array([b.num_rows])}) for b in batches), "id long")
        assert max(r["id"] for r in rows.collect()) <= 1000
    finally:
        spark.conf.set(key, before)
