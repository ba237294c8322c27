"""Texts beyond one slice, beside short ones that share a passage with them."""

import random

from provintel.llm import suffix_dedup as X
from provintel.llm.decontamination import contamination_report, decontaminate
from provintel.llm.language_id import fit_language_model, label_languages
from provintel.llm.lm_scoring import score_documents
from provintel.llm.minhash import near_duplicates
from provintel.llm.quality_classifier import classify_quality
from provintel.llm.quality_rules import quality_rules
from provintel.llm.substring_dedup import substring_dedup

RNG = random.Random(11)
PASSAGE = " ".join(f"p{RNG.randrange(10**6)}" for _ in range(60))


def long_text(words: int) -> str:
    return " ".join(f"{RNG.choice('abcdefgh')}{RNG.randrange(10**7)}" for _ in range(words))


def documents(spark):
    """A text of 3 MB, a copy of it with one word more, and a short one; all hold the passage."""
    half = long_text(170_000)
    rows = [(1, f"short {PASSAGE} text", "en", "s"), (2, f"{half} {PASSAGE} {half[::-1]}", "en", "s"), (3, f"{half} {PASSAGE} {half[::-1]} more", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_long_texts(spark):
    docs = documents(spark)
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup(docs).collect() if r["doc_id"] < 3} == {1: 0, 2: 60}
    size = len(PASSAGE) + 2  # the spaces beside the passage are shared too
    assert {r["doc_id"]: r["n_removed"] for r in X.suffix_dedup(docs.where("doc_id < 3")).collect()} == {1: size, 2: size}
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 2}
    bench = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    assert {r["n_hit"] for r in contamination_report(docs, bench).collect()} == {60}
    cut = decontaminate(docs.where("doc_id = 2"), bench).first()["text"]
    assert PASSAGE not in cut and len(cut.split()) > 339_000
    assert {r["n_words"] for r in quality_rules(docs.where("doc_id = 2"), docs.select("doc_id").limit(0)).collect()} == {340_061 - 1}
    assert label_languages(docs, fit_language_model(docs)).where("lang_pred = 'en'").count() == 3
    assert score_documents(docs, docs).where("n_tokens > 340000").count() == 2
    assert classify_quality(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).where("kept").count() == 3
