"""Nulls in any column, empty tables, repeated rows and clashing column names: every operator has a defined result."""

import pytest

from provintel.llm import entries
from provintel.llm.decontamination import contamination_report, decontaminate
from provintel.llm.language_id import fit_language_model, label_languages
from provintel.llm.lm_scoring import score_documents
from provintel.llm.minhash import near_duplicates
from provintel.llm.packing import pack
from provintel.llm.quality_classifier import classify_quality
from provintel.llm.quality_rules import quality_rules
from provintel.llm.substring_dedup import substring_dedup, without_repeats
from provintel.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, __doc string, d string"
ROWS = [
    (None, None, None, None, None, None, None, None),
    (None, "Hello world hello", None, None, 3, None, "x", None),
    (5, None, None, None, None, None, None, None),
    (6, "a b c " * 40, "en", "s", 1, "q", "k", "r"),
    (6, "a b c " * 40, "en", "s", 1, "q", "k", "r"),
    (7, "a b c " * 40 + "z", "en", "s", 1, "q", "k", "r"),
]
ITEMS = [(1, "a b c a b c a b c a"), (None, None)]
LABELS = [(6, 1, 0), (7, 0, 1), (None, None, None)]

OPERATORS = {
    "pack": (lambda d, b, lab: pack(d, entries.tokenizer_path()), 6),
    "languages": (lambda d, b, lab: label_languages(d, fit_language_model(d)), 6),
    "scores": (lambda d, b, lab: score_documents(d, d), 6),
    "report": (lambda d, b, lab: contamination_report(d, b), 6),
    "cut": (lambda d, b, lab: decontaminate(d, b), 3),  # three are hits by more than half
    "cut nothing": (lambda d, b, lab: decontaminate(d, b.limit(0)), 6),
    "substrings": (lambda d, b, lab: substring_dedup(d, batches=2), 6),
    "without": (lambda d, b, lab: without_repeats(d), 6),
    "rules": (lambda d, b, lab: quality_rules(d, lab.select("doc_id")), 6),
    "suffixes": (lambda d, b, lab: suffix_dedup(d), 6),
    "near": (lambda d, b, lab: near_duplicates(d), 6),
    "quality": (lambda d, b, lab: classify_quality(d, lab), 6),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, name):
    run, rows = OPERATORS[name]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    items, labels = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert len(run(docs, items, labels).collect()) == rows
    assert run(docs.limit(0), items, labels).collect() == []


def test_repeats_of_one_document_stay(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r["doc_id"], r["n_removed"]) for r in substring_dedup(docs).collect()}
    assert (6, 0) in got and (7, 120) in got and (None, 0) in got
