"""Engagement: tiers, timing, triggers, outreach context; classification replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import parse_result_age

TIER1_DAYS, TIER2_DAYS = 90, 180
LABELS = {1: "Engage Now", 2: "Watch", 3: "Track"}


def engagement_tier(funding_date: Column, propensity: Column, entrenched: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, funding_date)
    weak = entrenched.isNull() | entrenched.isin("WEAK", "UNKNOWN")
    return F.when(funding_date.isNull(), 3).when((days <= TIER1_DAYS) & (propensity == "High") & weak, 1).when((days <= TIER2_DAYS) & propensity.isin("High", "Medium"), 2).otherwise(3)


def tier_label(tier: Column) -> Column:
    return F.when(tier == 1, LABELS[1]).when(tier == 2, LABELS[2]).otherwise(LABELS[3])


def tier_rationale(tier: Column, funding_date: Column, propensity: Column, entrenched: Column, as_of: Column) -> Column:
    raised = F.concat(F.lit("Raised "), F.datediff(as_of, funding_date).cast("string"), F.lit("d ago · "))
    return (
        F.when(funding_date.isNull(), "No funding date available")
        .when(tier == 1, F.concat(raised, F.lit("High propensity · "), F.coalesce(entrenched, F.lit("Unknown")), F.lit(" entrenchment — infrastructure decision likely in progress")))
        .when(tier == 2, F.concat(raised, propensity, F.lit(" propensity · Monitor for trigger events")))
        .otherwise(F.concat(raised, F.coalesce(propensity, F.lit("Unknown")), F.lit(" propensity")))
    )


def recalculate_tiers(latest: DataFrame, funding: DataFrame, as_of: str) -> DataFrame:
    """(startup_id, engagement_tier, label, rationale) from each startup's latest announcement."""
    dates = funding.groupBy(F.col("startup_id").alias("id")).agg(F.max("announcement_date").alias("funding_date"))
    day = F.lit(as_of).cast("date")
    args = (F.col("funding_date"), F.col("cloud_propensity"), F.col("cloud_entrenchment"), day)
    tiered = latest.select("id", "cloud_propensity", "cloud_entrenchment").join(dates, "id", "left").withColumn("engagement_tier", engagement_tier(*args))
    tier = F.col("engagement_tier")
    return tiered.select(F.col("id").alias("startup_id"), tier, tier_label(tier).alias("engagement_tier_label"), tier_rationale(tier, *args).alias("engagement_tier_rationale"))


def engagement_timing(latest: DataFrame, triggers: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    recent = triggers.where((F.col("signal_strength") == "strong") & (F.datediff(F.lit(as_of).cast("date"), F.to_date("detected_date")) <= days)).select(F.col("company_id").alias("id")).distinct().withColumn("hot", F.lit(True))
    tier = F.col("engagement_tier")
    return latest.join(recent, "id", "left").select("id", tier, F.when((tier == 1) & F.col("hot"), "Hot").when(tier.isin(1, 2), "Warm").otherwise("Watch").alias("engagement_timing"))


def new_triggers(found: DataFrame, known: DataFrame) -> DataFrame:
    """Found triggers without those known by (company, type, url); null urls compare equal."""
    k = known.select(F.col("company_id").alias("c"), F.col("trigger_type").alias("t"), F.col("source_url").alias("u")).distinct()
    return found.join(k, (F.col("company_id") == F.col("c")) & (F.col("trigger_type") == F.col("t")) & F.col("source_url").eqNullSafe(F.col("u")), "left_anti")


def upgrade_tiers(latest: DataFrame, triggers: DataFrame) -> DataFrame:
    """Tier-1 and tier-2 companies with new triggers: for high propensity two strong ones give tier 1, one at least tier 2; never down."""
    counts = triggers.groupBy(F.col("company_id").alias("id")).agg(F.count_if(F.col("signal_strength") == "strong").alias("strong"), F.count("*").alias("active_trigger_count"))
    tier = F.col("engagement_tier")
    to = F.when(F.col("cloud_propensity") != "High", tier).when(F.col("strong") >= 2, 1).when(F.col("strong") == 1, F.least(tier, F.lit(2))).otherwise(tier)
    return latest.where(tier.isin(1, 2)).join(counts, "id").select("id", F.coalesce(to, tier).alias("engagement_tier"), "active_trigger_count")


def outreach_due(latest: DataFrame, as_of: str) -> DataFrame:
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("intelligence_generated_at"))
    return latest.where(((F.col("engagement_tier") == 1) & (age.isNull() | (age >= 7))) | ((F.col("engagement_tier") == 2) & (age.isNull() | (age >= 14))))


def outreach_context(latest: DataFrame, funding: DataFrame, triggers: DataFrame, as_of: str) -> DataFrame:
    """Prompt fields: latest funding, days since, and trigger lines in date order."""
    last = funding.groupBy(F.col("startup_id").alias("id")).agg(F.max(F.struct("announcement_date", "funding_amount_usd", "funding_round")).alias("f"))
    lines = triggers.groupBy(F.col("company_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("detected_date", "trigger_label", "signal_strength"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x["trigger_label"], F.lit(" ("), x["signal_strength"], F.lit(")"))), "\n")
    joined = latest.join(last, "id", "left").join(lines, "id", "left")
    return joined.select("id", "f.funding_amount_usd", "f.funding_round", F.datediff(F.lit(as_of).cast("date"), F.col("f.announcement_date")).alias("days_since_funding"), F.coalesce(text, F.lit("None")).alias("trigger_lines"))


def hiring_surge(job_posts: DataFrame, least: int = 3, words: list[str] = rules.ROLE_KEYWORDS) -> DataFrame:
    """Startups with enough engineering roles, counted by title (url where there is none)."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("url"))
    roles = job_posts.where(F.lower(title).rlike("|".join(words)))
    return roles.groupBy("startup_id").agg(F.count("*").alias("roles"), F.min_by("url", "ord").alias("source_url")).where(F.col("roles") >= least).select(
        F.col("startup_id").alias("company_id"), F.lit("hiring_surge").alias("trigger_type"), F.concat(F.col("roles"), F.lit(" infrastructure/engineering roles posted")).alias("trigger_label"), "source_url", F.lit("strong").alias("signal_strength"),
    )


def _first_hit(hits: DataFrame, order: list[str]) -> DataFrame:
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("startup_id").orderBy(*order))).where("_n = 1").drop("_n")


def leadership_hire(hits: DataFrame, as_of: str, titles: list[str] = rules.LEADERSHIP_TITLES, word_boundaries: bool = False) -> DataFrame:
    """First hit by rank, at most 60 days old, that holds a leadership title and isn't refused by a ``confirmed`` column."""
    text = F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit(" "), F.lower(F.coalesce("snippet", F.lit(""))))
    test = (lambda t: text.rlike(rf"\b{t}\b")) if word_boundaries else (lambda t: F.contains(text, F.lit(t)))
    title = F.coalesce(*[F.when(test(t), t) for t in titles])
    some = hits.withColumn("_title", title).where((parse_result_age(F.col("date_str"), F.lit(as_of).cast("date")) <= 60) & F.col("_title").isNotNull())
    if "confirmed" in hits.columns:
        some = some.where(F.coalesce("confirmed", F.lit(True)))
    return _first_hit(some, ["rank"]).select(
        F.col("startup_id").alias("company_id"), F.lit("leadership_hire").alias("trigger_type"), F.concat(F.lit("New "), F.initcap("_title"), F.lit(" announcement")).alias("trigger_label"), F.col("url").alias("source_url"),
        F.when(F.col("_title").isin(rules.CTO_TITLES), "strong").otherwise("moderate").alias("signal_strength"),
    )


def news_trigger(hits: DataFrame, companies: DataFrame, as_of: str, kind: str = "product_launch", days: int = 30) -> DataFrame:
    """Product launches (30 days) or vendor partnerships (60): first hit by batch and rank whose title has the company's first word."""
    label = {"product_launch": "Product launch: ", "partnership": "Partnership: "}[kind]
    named = hits.join(companies.select(F.col("id").alias("startup_id"), F.split(F.lower("canonical_name"), r"\s+")[0].alias("_word")), "startup_id")
    some = named.where((parse_result_age(F.col("date_str"), F.lit(as_of).cast("date")) <= days) & F.contains(F.lower("title"), F.col("_word")))
    return _first_hit(some, ["batch", "rank"]).select(
        F.col("startup_id").alias("company_id"), F.lit(kind).alias("trigger_type"), F.concat(F.lit(label), F.substring("title", 1, 80)).alias("trigger_label"), F.col("url").alias("source_url"), F.lit("moderate").alias("signal_strength"),
    )


def vendor_batches(companies: DataFrame, vendors: list[str] = rules.VENDORS, size: int = 5) -> DataFrame:
    """(startup_id, batch, query) of vendor-partnership searches: vendors in order, so many a query; hits carry the batch on."""
    groups = [(i // size, " OR ".join(f'"{v}"' for v in vendors[i : i + size])) for i in range(0, len(vendors), size)]
    table = F.broadcast(companies.sparkSession.createDataFrame(groups, "batch int, vendors string"))
    query = F.concat(F.lit('"'), F.col("canonical_name"), F.lit('" (partnership OR integration) ('), F.col("vendors"), F.lit(")"))
    return companies.select(F.col("id").alias("startup_id"), "canonical_name").join(table, F.lit(True)).select("startup_id", "batch", query.alias("query"))  # a row a batch


def press_feature(hits: DataFrame, as_of: str, least: int = 3, domains: list[str] = rules.PRESS_DOMAINS, proper_www: bool = False) -> DataFrame:
    """Startups with enough hits of the last 14 days on press domains. Leading 'w' and '.' are stripped from hosts unless proper_www."""
    host = F.regexp_replace(F.try_parse_url("url", F.lit("HOST")), r"^www\." if proper_www else r"^[w.]+", "")
    some = hits.where((parse_result_age(F.col("date_str"), F.lit(as_of).cast("date")) <= 14) & host.isin(list(domains)))
    return some.groupBy("startup_id").agg(F.count("*").alias("n"), F.min_by("url", "rank").alias("source_url")).where(F.col("n") >= least).select(
        F.col("startup_id").alias("company_id"), F.lit("press_feature").alias("trigger_type"), F.concat(F.col("n"), F.lit(" major press mentions in 14 days")).alias("trigger_label"), "source_url", F.lit("moderate").alias("signal_strength"),
    )


def _best_name(candidate: Column, names: list[str]) -> Column:
    """Exact, then case-insensitive, then containing either way, each in the names' order; an empty candidate gets the first name."""
    low = F.lower(candidate)
    exact = [F.when(candidate == n, n) for n in names]
    folded = [F.when(low == n.lower(), n) for n in names]
    part = [F.when(F.contains(F.lit(n.lower()), low) | F.contains(low, F.lit(n.lower())), n) for n in names]
    return F.coalesce(*exact, *folded, *part)


def validate_classification(replies: DataFrame, taxonomy: dict = rules.TAXONOMY) -> DataFrame:
    """startup_id, vertical, sub_vertical, cloud_propensity, classification_confidence from raw replies; unparseable gives nulls."""
    body = F.regexp_replace(F.regexp_replace("raw", r"^```[a-z]*\n?", ""), r"\n?```$", "")
    parsed = replies.select("startup_id", F.from_json(body, "vertical string, sub_vertical string, confidence string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    ok = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    said = F.lower(F.trim(F.coalesce("r.confidence", F.lit(""))))
    named = parsed.select(
        "startup_id", ok.alias("ok"), F.when(ok, _best_name(F.trim(F.coalesce("r.vertical", F.lit(""))), list(taxonomy))).alias("vertical"), F.trim(F.coalesce("r.sub_vertical", F.lit(""))).alias("sub"),
        F.when(ok, F.when(said.isin("high", "medium", "low"), said).otherwise("low")).alias("classification_confidence"),
    )
    sub = F.coalesce(*[F.when(F.col("vertical") == v, _best_name(F.col("sub"), list(t["sub_verticals"]))) for v, t in taxonomy.items()])
    every = {s: p for t in taxonomy.values() for s, p in t["sub_verticals"].items()}
    spread = named.withColumn("sub_vertical", sub)
    propensity = F.coalesce(*[F.when(F.col("sub_vertical") == s, p) for s, p in every.items()], *[F.when(F.col("vertical") == v, t["propensity"]) for v, t in taxonomy.items()])
    return spread.select("startup_id", "vertical", "sub_vertical", propensity.alias("cloud_propensity"), "classification_confidence", F.lit("llm_classification").alias("classification_source"))


def parse_outreach(replies: DataFrame) -> DataFrame:
    body = F.regexp_extract("raw", r"(?s)(\{.*\})", 1)
    got = F.from_json(body, "recommended_angle string, key_signals array<string>")
    return replies.select("startup_id", got["recommended_angle"].alias("recommended_angle"), F.coalesce(got["key_signals"], F.array().cast("array<string>")).alias("key_signals"))


def reattribution_queue(overrides: DataFrame) -> DataFrame:
    return overrides.where("re_attribution_requested")


def mark_fulfilled(overrides: DataFrame, done: DataFrame) -> DataFrame:
    flag = done.select("startup_id").distinct().withColumn("_done", F.lit(True))
    return overrides.join(flag, "startup_id", "left").withColumn("re_attribution_requested", F.col("re_attribution_requested") & F.col("_done").isNull()).drop("_done")
