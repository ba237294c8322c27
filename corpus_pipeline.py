"""A corpus pipeline of five stages: quality, near-duplicates, repeated substrings, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of documents; the
last returns packed pieces.

The first two stages decide by doc_id: rows of one doc_id go or stay together, so one bad row takes the others of its id
along, near copies under one id all stay, and rows without a doc_id always stay, as nothing can name them. The other
stages work row by row. Null texts pass as empty ones, an empty table gives an empty one, and columns of any other name,
such as those that operators use inside, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provintel.llm.decontamination import decontaminate
from provintel.llm.entries import tokenizer_path
from provintel.llm.minhash import near_duplicates
from provintel.llm.packing import pack
from provintel.llm.quality_classifier import classify_quality
from provintel.llm.substring_dedup import without_repeats
from provintel.session import broadcast_if_small, materialize

ORACLE_SQL = None
ARROW_ROWS = 1000  # rows that a Python worker is sent at once: two workers share an executor with its JVM


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs less the rows of every doc_id that decided does not keep."""
    return docs.join(broadcast_if_small(materialize(decided.where("not kept").select("doc_id").distinct(), "dropped")), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, learned from the labels among docs; without labels of both classes, all."""
    return _without(docs, classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies, and all documents that are like no other; texts of no words are like none."""
    return _without(docs, near_duplicates(docs))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages that an earlier document has; a text that loses everything is empty."""
    return without_repeats(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go. Null or empty items leak nowhere."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; an empty text still has its end token."""
    return pack(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("minhash near-dedup", near_dedup), ("substring dedup", repeats), ("decontamination", leaks), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
