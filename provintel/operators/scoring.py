"""Weighted evidence to attributions: scores per provider, single / multi / hybrid decisions, fallbacks and priors.

Signals: startup_id, provider_type, provider_name, signal_source, evidence_text, confidence_weight decimal(3,1), ord.
Scores are exact decimals; ties rank by first ord, then name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

CLOUD_GAP, AI_GAP, FALLBACK_BELOW = 0.3, 0.5, 0.60
BIG_THREE = ("AWS", "GCP", "Azure")
HARDWARE_KEEPS = 0.6


def entrenchment(score: Column) -> Column:
    return F.when(score >= 2, "STRONG").when(score >= 1, "MODERATE").when(score >= F.lit("0.3").cast("decimal(3,1)"), "WEAK").otherwise("UNKNOWN")


def score_providers(signals: DataFrame, owned_sources: list[str] = rules.OWNED_SOURCES) -> DataFrame:
    """score, n and first ord per (startup, type, provider), whether an owned source is among them, and a role."""
    purpose = F.when(F.col("signal_source") == "subprocessors_page", F.struct("ord", F.coalesce(F.regexp_extract("evidence_text", r"purpose: *'?([^']*)", 1), F.lit("")).alias("p")))
    return (
        signals.groupBy("startup_id", "provider_type", "provider_name")
        .agg(
            F.sum("confidence_weight").alias("score"),
            F.count("*").alias("n"),
            F.min("ord").alias("first_ord"),
            F.max(F.col("signal_source").isin(list(owned_sources))).alias("owned"),
            F.max("confidence_weight").alias("best"),
            F.min(purpose).alias("_purpose"),
        )
        .withColumn(
            "role",
            F.when(F.col("_purpose").isNotNull(), F.when(F.col("_purpose.p") == "", "Subprocessor").otherwise(F.col("_purpose.p")))
            .when(F.col("provider_type") == "cloud", "Cloud infrastructure")
            .otherwise("AI service provider"),
        )
        .drop("_purpose")
    )


def provider_entries(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys and r: the entries of a side's providers (rows of score_providers), best first. A row per provider is grouped, not per signal."""
    entry = F.struct((-F.col("score")).alias("neg"), F.col("first_ord").alias("ord"), F.col("provider_name").alias("name"), "score", "role", "owned", "n", "best")
    return scored.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("r"))


def _sum(r: Column, field: str, kind: str) -> Column:
    return F.aggregate(r, F.lit(0).cast(kind), lambda a, x: (a + x[field]).cast(kind))


def _judged(r: Column, is_cloud: Column, cloud_gap: float, ai_gap: float) -> dict[str, Column]:
    """What ranked entries say: whether they count at all, are close, a hybrid, their confidence and total."""
    names, total = F.transform(r, lambda x: x["name"]), _sum(r, "score", "decimal(23,1)")
    shallow = (F.size(F.array_intersect(names, F.array(*map(F.lit, BIG_THREE)))) == 3) & ~F.exists(r, lambda x: x["name"].isin(*BIG_THREE) & x["owned"])
    top, second = F.get(r, F.lit(0))["score"], F.get(r, F.lit(1))["score"]
    gap = F.when(is_cloud, F.lit(str(cloud_gap)).cast("decimal(3,1)")).otherwise(F.lit(str(ai_gap)).cast("decimal(3,1)"))
    close = F.coalesce(top - second < gap, F.lit(False))
    share = F.when(second.isNull(), top / 2).when(close, total / F.size(r)).otherwise(top / total)
    return {
        "counts": (F.size(r) > 0) & ~(is_cloud & shallow), "close": close, "hybrid": is_cloud & F.array_contains(names, "On-Premises") & (F.size(r) > 1),
        "confidence": F.least(F.round(share, 2), F.lit(1)).cast("double"), "total": total,
    }


def decide(ranked: DataFrame, cloud_gap: float = CLOUD_GAP, ai_gap: float = AI_GAP) -> DataFrame:
    """Rows (startup_id, provider_type, r) that count, as attributions."""
    j = _judged(F.col("r"), F.col("provider_type") == "cloud", cloud_gap, ai_gap)
    entry = lambda x: F.struct(
        x["name"].alias("provider_name"), x["role"].alias("role"), (x["score"] / F.col("_total")).cast("double").alias("confidence"), entrenchment(x["score"]).alias("entrenchment"), x["score"].alias("raw_score"),
    )
    return ranked.where(j["counts"]).withColumn("_total", j["total"]).select(
        "startup_id", "provider_type", (j["close"] | j["hybrid"]).alias("is_multi"), F.when(j["hybrid"], "Hybrid").when(~j["close"], F.col("r")[0]["name"]).alias("primary_provider"),
        F.transform("r", entry).alias("providers"), j["confidence"].alias("confidence"), _sum(F.col("r"), "n", "bigint").alias("evidence_count"),
        F.lit(False).alias("is_not_applicable"), F.lit(None).cast("string").alias("not_applicable_note"),
    )


def counts(r: Column, is_cloud: Column) -> Column:
    """Whether a side's entries give an attribution."""
    return _judged(r, is_cloud, CLOUD_GAP, AI_GAP)["counts"]


def needs_fallback(r: Column, side: str, below: float = FALLBACK_BELOW) -> Column:
    """Whether a side's entries give no attribution, or one under the limit."""
    j = _judged(r, F.lit(side == "cloud"), CLOUD_GAP, AI_GAP)
    return ~F.coalesce(j["counts"] & (j["confidence"] >= below), F.lit(False))


def merged(r: Column, more: Column) -> Column:
    """Entries of both, one a provider, best first."""
    every = F.concat(r, more)

    def one(name: Column) -> Column:
        own = F.filter(every, lambda x: x["name"] == name)
        score = _sum(own, "score", "decimal(13,1)")
        return F.struct(
            (-score).cast("decimal(13,1)").alias("neg"), F.array_min(F.transform(own, lambda x: x["ord"])).alias("ord"), name.alias("name"), score.alias("score"), own[0]["role"].alias("role"),
            F.exists(own, lambda x: x["owned"]).alias("owned"), _sum(own, "n", "bigint").alias("n"), F.array_max(F.transform(own, lambda x: x["best"])).alias("best"),
        )

    return F.array_sort(F.transform(F.array_distinct(F.transform(every, lambda x: x["name"])), one))


def attribute(signals: DataFrame, owned_sources: list[str] = rules.OWNED_SOURCES, cloud_gap: float = CLOUD_GAP, ai_gap: float = AI_GAP) -> DataFrame:
    """One row per (startup, type) with ranked providers, is_multi, primary_provider, confidence, evidence_count.

    The second grouping is on a prefix of the first one's keys and holds a row per provider, not per signal.
    """
    return decide(provider_entries(score_providers(signals, owned_sources), ["startup_id", "provider_type"]), cloud_gap, ai_gap)


def is_hardware(industry: Column, words: list[str] = rules.HARDWARE_INDUSTRIES) -> Column:
    return F.coalesce(F.lower(industry).rlike("|".join(words)), F.lit(False))


def hardware_prior(signals: DataFrame, startups: DataFrame, words: list[str] = rules.HARDWARE_INDUSTRIES) -> DataFrame:
    """(startup_id) of hardware companies without a cloud signal of 0.6 or more: On-Premises at confidence 0.15."""
    strong = signals.where("provider_type = 'cloud'").groupBy("startup_id").agg(F.max("confidence_weight").alias("best"))
    return (
        startups.where(is_hardware(F.col("industry"), words)).select(F.col("id").alias("startup_id")).join(strong, "startup_id", "left")
        .where(F.coalesce(F.col("best"), F.lit(0)) < HARDWARE_KEEPS).select(
            "startup_id", F.lit("cloud").alias("provider_type"), F.lit("On-Premises").alias("primary_provider"), F.lit(0.15).alias("confidence"), F.lit(0.3).alias("raw_score"), F.lit(0).cast("long").alias("evidence_count"),
        )
    )


def fallback_needed(startups: DataFrame, attributions: DataFrame, below: float = FALLBACK_BELOW) -> DataFrame:
    """(startup_id, need_cloud, need_ai): sides without an attribution, or with one under the limit."""
    sides = attributions.groupBy("startup_id").agg(*[F.max(F.when(F.col("provider_type") == t, F.col("confidence"))).alias(t) for t in ("cloud", "ai")])
    joined = startups.select(F.col("id").alias("startup_id")).join(sides, "startup_id", "left")
    need = {t: (F.coalesce(F.col(t), F.lit(0.0)) < below) for t in ("cloud", "ai")}
    return joined.select("startup_id", *[need[t].alias(f"need_{t}") for t in need]).where("need_cloud or need_ai")


def with_fallback(signals: DataFrame, findings: DataFrame, startups: DataFrame, accumulate: bool = False) -> DataFrame:
    """Attributions after search (tier 4a) and inference (4b) findings for the sides that need them; 4b replaces 4a unless accumulate."""
    first = attribute(signals)
    need = fallback_needed(startups, first)
    wanted = findings.join(need, "startup_id").where(F.when(F.col("provider_type") == "cloud", F.col("need_cloud")).otherwise(F.col("need_ai")))
    has_4b = wanted.where("tier = '4b'").select("startup_id", "provider_type").distinct()
    early = wanted.where("tier = '4a'")
    if not accumulate:
        early = early.join(has_4b, ["startup_id", "provider_type"], "left_anti")
    return attribute(signals.unionByName(early.unionByName(wanted.where("tier = '4b'")).select(*signals.columns)))


def display_name(is_na: Column, is_multi: Column, primary: Column, names: Column) -> Column:
    return (
        F.when(is_na, "Not Applicable")
        .when(is_multi, F.concat(F.lit("Multi ("), F.array_join(names, ", "), F.lit(")")))
        .otherwise(F.coalesce(primary, F.lit("Unknown")))
    )
