"""Learned operators on the small tables: held-out accuracy, exact base scores, and edge rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from provintel.llm import entries
from provintel.llm.language_id import viterbi
from provintel.llm.quality_classifier import classify_quality

SF = "/root/testdata/sf0.001"
FOLD = {i: i + 32 for i in range(65, 91)}


def test_language_id(spark):
    rows = entries.op2_language_id(spark, SF).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(langs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([langs[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 64, 65, 200):
        scores = np.round(rng.normal(size=(n, 3)) * 3, 3)
        best, back = scores[0].copy(), []
        for t in range(1, n):
            step = best[:, None] - 6.0 * (1 - np.eye(3))
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + scores[t]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert viterbi(scores, np.zeros(n, dtype=np.int64), 1).tolist() == path[::-1]


def test_lm_scores(spark):
    rows = entries.op3_lm_scoring(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None] for i, t in texts.items()}
    train = Counter(x for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for x in w)
    n, v = sum(train.values()), len(train)
    for r in rows:
        w = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"]: r["kept"] for r in classify_quality(docs, labels).collect()}
    good = [kept[r["doc_id"]] for r in labels.where("quality = 1 and toxic = 0").collect() if r["doc_id"] in kept]
    assert len(kept) == docs.count() and np.mean(good) > 0.9
    assert all(r["kept"] for r in classify_quality(docs, labels.limit(0)).collect())
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "x", "y")], "doc_id long, text string, source string, lang string")
    assert classify_quality(odd, labels).count() == 2


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0.5 * docs.count() < out.count() <= docs.count()
        docs = out
    assert P.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.count()
