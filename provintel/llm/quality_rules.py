"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus, JVM expressions only.

Unigrams and bigrams of case-kept words are hashed into ``buckets`` classes. Two multinomials are counted over whole
tables: the target over trusted documents, the raw one over all documents. The target is shrunk toward the raw one, so
a bucket that the target never saw is judged by how common it is. A document's score is its mean ratio per n-gram;
``score >= threshold`` keeps it, for every document alike.

Defined cases: null text counts as no words; a document without words has score 0 and fails the base rules; without
trusted documents every ratio is 0 and only the base rules decide; repeated rows are judged each on its own, extra
columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
BUCKETS = 1 << 15
THRESHOLD = -0.12
PRIOR = 1.0


def grams(words: Column, buckets: int) -> Column:
    """Bucket ids of all unigrams and bigrams, as one array."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"),
    )
    return F.concat(one, two)


def fit_ratios(documents: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """Log ratio per bucket from all documents and those whose doc_id is in trusted; ``buckets`` rows reach the driver."""
    marks = broadcast_if_small(trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("_t", F.lit(1)))
    counted = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
        .join(marks, "doc_id", "left")
        .select(F.coalesce("_t", F.lit(0)).alias("_t"), F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_w"))
        .select("_t", F.explode(grams(F.col("_w"), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("_t").alias("target"))
        .collect()
    )
    raw, target = [0] * buckets, [0] * buckets
    for r in counted:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw), sum(target)
    if not n_target:
        return [0.0] * buckets
    weight = prior * buckets
    share = [(r + 0.5) / (n_raw + 0.5 * buckets) for r in raw]
    return [math.log((t + weight * s) / (n_target + weight) / s) for t, s in zip(target, share, strict=True)]


def quality_rules(
    documents: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, prior: float = PRIOR
) -> DataFrame:
    """One row per document: base counts, base_failed, score and the verdict kept."""
    ratios = [round(x, 6) for x in fit_ratios(documents, trusted, buckets, prior)]
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = documents.select(
        "doc_id",
        text.alias("_text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    n = F.size("_w")
    windows = F.zip_with(
        F.zip_with("_w", F.slice("_w", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice("_w", 3, F.greatest(n - 2, F.lit(0))),
        lambda p, c: F.when(c.isNotNull(), F.xxhash64(p["a"], p["b"], c)),
    )
    hashed = words.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(
            F.transform(F.slice(windows, 1, F.greatest(n - 2, F.lit(0))), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        ).alias("_s"),
        F.aggregate(grams(F.col("_w"), buckets), F.lit(0.0), lambda acc, g: acc + F.get(table, g)).alias("_sum"),
        F.greatest(2 * n - 1, F.lit(1)).alias("_n"),
    )
    repeated = F.filter(
        F.col("_s"),
        lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get("_s", i + 1)["h"]).eqNullSafe(True),
    )
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    judged = hashed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.size(covered).cast("long").alias("n_repeat_words"),
        (F.col("_sum") / F.col("_n")).alias("score"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
