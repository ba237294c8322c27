"""The attribution run: signals of all builders to one final attribution per startup and side."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, rules
from ..session import materialize
from ..sources.upsert import build_snapshot
from . import signals as G
from .scoring import HARDWARE_KEEPS, attribute, counts, decide, fallback_needed, is_hardware, merged, needs_fallback, provider_entries, score_providers

ROLES = {"cloud": "Cloud infrastructure", "ai": "AI service provider"}
HARDWARE_ROLE = "Hardware company — on-premises prior (no cloud signals found)"


def union_signals(parts: list[DataFrame]) -> DataFrame:
    """All builders' signals; ``ord`` keeps the builders' order."""
    return reduce(DataFrame.unionByName, parts)


def side(signals: DataFrame, provider_type: str) -> DataFrame:
    return signals.where(F.col("provider_type") == provider_type)


def gather_signals(tables: dict[str, DataFrame], as_of: str) -> DataFrame:
    """Signals of every builder whose tables are given.

    Tables: startups, pages, evidence_urls, subprocessor_rows or subprocessor_pages, provider_pages, listings, press_hits,
    news, feed, batches, provider_hits, partner_articles, dns_records, job_posts, blog_urls, host_ips with ip_ranges. Pages
    are read once in Python, for all builders of texts. Hosting platforms come last, for startups that no other builder
    gave a cloud signal.
    """
    t = dict(tables)
    if "pages" in t:
        t["texts"] = materialize(G.page_texts(t["pages"]), "page-texts")
    if "subprocessor_pages" in t:
        pages = t["subprocessor_pages"]
        rows = pages.select("startup_id", F.col("url").alias("source_url"), F.posexplode(html.subprocessor_rows(F.col("html"))).alias("ord", "v"))
        t["subprocessor_rows"] = rows.select("startup_id", "v.name", "v.purpose", "v.location", "source_url", "ord")
    if "provider_pages" in t:
        t["cases"] = materialize(G.case_studies(t["provider_pages"], t["startups"]), "case-studies")
    none = t["startups"].select(F.col("id").alias("startup_id"), F.lit("").alias("provider_name")).limit(0)
    hosted = G.hosted_startups(t["dns_records"]) if "dns_records" in t else none.select("startup_id")
    news = {k: t.get(n) for k, n in (("feed", "feed"), ("batches", "batches"), ("provider_hits", "provider_hits"), ("articles", "partner_articles"))}
    builders: list[tuple[tuple[str, ...], Callable[[], DataFrame]]] = [
        (("evidence_urls", "texts"), lambda: G.evidence_pages(t["evidence_urls"], t["texts"])),
        (("subprocessor_rows",), lambda: G.subprocessors(t["subprocessor_rows"])),
        (("cases",), lambda: t["cases"]),
        (("listings",), lambda: G.marketplace_listings(t["listings"], t["startups"], t.get("cases", none))),
        (("press_hits",), lambda: G.press_titles(t["press_hits"], t["startups"])),
        (("news",), lambda: G.partnerships(t["news"], t["startups"], as_of)),
        (("dns_records",), lambda: G.dns_cnames(t["dns_records"])),
        (("pages",), lambda: G.marketplaces(t["pages"])),
        (("pages",), lambda: G.http_headers(t["pages"], hosted)),
        (("job_posts",), lambda: G.job_postings(t["job_posts"])),
        (("texts",), lambda: G.site_pages(t["texts"])),
        (("texts",), lambda: G.homepage_investor_signals(t["texts"])),
        (("blog_urls", "texts"), lambda: G.blog_posts(t["blog_urls"], t["texts"])),
        (("pages",), lambda: G.security_txt(t["pages"])),
        (("host_ips", "ip_ranges"), lambda: G.ip_ranges(t["host_ips"], t["ip_ranges"], hosted)),
        (("startups",), lambda: G.investor_priors(t["startups"])),
        (("startups",), lambda: G.founder_priors(t["startups"])),
    ]
    parts = [build() for needs, build in builders if all(n in t for n in needs)]
    if any(x is not None for x in news.values()):
        parts.append(G.partnership_sources(t["startups"], as_of, **news))
    found = materialize(_one_case_study(union_signals(parts)), "signals")
    if "pages" in t and "dns_records" in t:
        found = found.unionByName(G.other_platforms(t["pages"], t["dns_records"], found))
    return found


def _one_case_study(signals: DataFrame) -> DataFrame:
    """Result cards and press titles tell of case studies both; of one provider the first counts."""
    first = F.row_number().over(Window.partitionBy("startup_id", "provider_type", "provider_name").orderBy("ord"))
    is_case = F.col("signal_source") == "case_study"
    cases = signals.where(is_case).withColumn("_n", first).where("_n = 1").drop("_n")
    return signals.where(~is_case).unionByName(cases)


def _by_name(startups: DataFrame, overrides: dict, na: dict) -> DataFrame:
    """canonical_name, and by side the note of a side that doesn't apply and the names of a fixed one."""
    names = lambda v: list(v) if isinstance(v, list) else [v] if v else None
    of = lambda table, c, side: (table.get(c) or {}).get(side)
    rows = [(c, of(na, c, "cloud") or None, of(na, c, "ai") or None, names(of(overrides, c, "cloud")), names(of(overrides, c, "ai"))) for c in {*overrides, *na}]
    return F.broadcast(startups.sparkSession.createDataFrame(rows, "canonical_name string, cloud_note string, ai_note string, cloud_names array<string>, ai_names array<string>"))


def run_attribution(
    startups: DataFrame, signals: DataFrame, findings: DataFrame | None = None, overrides: dict = rules.PARTNERSHIP_OVERRIDES, na: dict = rules.NOT_APPLICABLE, hardware: list[str] = rules.HARDWARE_INDUSTRIES,
) -> DataFrame:
    """One row per startup and side, as attribute() gives them.

    Not-applicable sides come first, then overrides, both at once for a startup; a startup of the not-applicable table has
    its other side scored, one of the override table has no other side. All others are scored; hardware companies without
    a cloud signal of 0.6 lose their weak ones and are On-Premises at 0.15; weak sides are scored again with findings (4b
    replaces 4a).

    Signals are exchanged twice, as partial sums per provider and as providers per startup; all guards and both tiers are
    then decided row by row.
    """
    entries = lambda df, keys: provider_entries(df, ["startup_id", *keys])
    sides = lambda df, key, values, names: df.groupBy("startup_id").agg(*[F.first(F.when(F.col(key) == v, F.col("r")), ignorenulls=True).alias(n) for v, n in zip(values, names, strict=True)])
    state = sides(entries(score_providers(signals), ["provider_type"]), "provider_type", ["cloud", "ai"], ["cloud_r", "ai_r"])
    kind = state.schema["cloud_r"].dataType
    state = startups.select(F.col("id").alias("startup_id"), "canonical_name", "industry").join(state, "startup_id", "left").join(_by_name(startups, overrides, na), "canonical_name", "left")
    if findings is not None:
        tiers = score_providers(findings.withColumn("provider_type", F.concat_ws("_", "provider_type", "tier")))
        tiers = tiers.withColumn("role", F.when(F.startswith("provider_type", F.lit("cloud")), ROLES["cloud"]).otherwise(ROLES["ai"]))
        wanted = [f"{side}_{tier}" for side in ("cloud", "ai") for tier in ("4a", "4b")]
        state = state.join(sides(entries(tiers, ["provider_type"]), "provider_type", wanted, wanted), "startup_id", "left")
    empty = F.array().cast(kind)
    or_empty = lambda c: F.coalesce(F.col(c), empty)
    state = state.withColumn("_na", F.coalesce("cloud_note", "ai_note").isNotNull()).withColumn("_free", ~F.col("_na") & F.coalesce("cloud_names", "ai_names").isNull())
    best = F.coalesce(F.array_max(F.transform("cloud_r", lambda x: x["best"])), F.lit(0))
    state = state.withColumn("_prior", F.col("_free") & is_hardware(F.col("industry"), hardware) & (best < HARDWARE_KEEPS))

    for side in ("cloud", "ai"):
        own = f"{side}_r"
        state = state.withColumn(own, F.when(F.col(f"{side}_note").isNotNull() | F.col(f"{side}_names").isNotNull() | ~(F.col("_free") | F.col("_na")), empty).otherwise(or_empty(own)))
        if side == "cloud":
            state = state.withColumn(own, F.when(F.col("_prior"), empty).otherwise(F.col(own)))
        if findings is not None:
            late = or_empty(f"{side}_4b")
            more = F.when(F.size(late) > 0, late).otherwise(or_empty(f"{side}_4a"))
            again = F.col("_free") & needs_fallback(F.col(own), side) & (F.size(more) > 0)
            state = state.withColumn("_more", more).withColumn(own, F.when(again, merged(F.col(own), F.col("_more"))).otherwise(F.col(own))).drop("_more")
    row = lambda side: F.struct(F.lit(side).alias("provider_type"), F.col(f"{side}_r").alias("r"), F.col(f"{side}_note").alias("note"), F.col(f"{side}_names").alias("names"), (F.col("_prior") & (F.lit(side) == "cloud")).alias("prior"))
    rows = materialize(state.select("startup_id", F.explode(F.array(row("cloud"), row("ai"))).alias("s")).select("startup_id", "s.*"), "sides")

    money = rows.schema["r"].dataType.elementType["score"].dataType
    entry = lambda n, role, sure, level, raw: F.struct(n.alias("provider_name"), role.alias("role"), F.lit(sure).cast("double").alias("confidence"), F.lit(level).alias("entrenchment"), F.lit(raw).cast(money).alias("raw_score"))
    scored = decide(rows.select("startup_id", "provider_type", "r"))
    site = F.lit("On-Premises")
    # Hardware companies whose cloud side has no entries, or such that don't count.
    on_site = rows.where("prior").where(~counts(F.col("r"), F.col("provider_type") == "cloud")).select(
        "startup_id", "provider_type", F.lit(False).alias("is_multi"), site.alias("primary_provider"), F.array(entry(site, F.lit(HARDWARE_ROLE), 0.15, "WEAK", "0.3")).alias("providers"),
        F.lit(0.15).alias("confidence"), F.lit(0).cast("long").alias("evidence_count"), F.lit(False).alias("is_not_applicable"), F.lit(None).cast("string").alias("not_applicable_note"),
    )
    names = F.when(F.col("note").isNull(), F.col("names")).otherwise(F.array().cast("array<string>"))
    role, size = F.when(F.col("provider_type") == "cloud", ROLES["cloud"]).otherwise(ROLES["ai"]), F.size("names")
    tables = rows.where("note is not null or names is not null").withColumn("names", names).select(
        "startup_id", "provider_type", (size > 1).alias("is_multi"), F.when(size == 1, F.col("names")[0]).alias("primary_provider"), F.transform("names", lambda n: entry(n, role, 1.0, "STRONG", "1.0")).alias("providers"),
        F.when(size > 0, 1.0).otherwise(0.0).alias("confidence"), size.cast("long").alias("evidence_count"), F.col("note").isNotNull().alias("is_not_applicable"), F.col("note").alias("not_applicable_note"),
    )
    return union_signals([tables, scored, on_site])


def run_everything(tables: dict[str, DataFrame], as_of: str) -> dict[str, DataFrame]:
    """From fetched tables to snapshots: signals, attributions and one snapshot row per startup.

    Tables: those of gather_signals(), and where given llm_findings (replies of both tiers), classification (startup_id, ...) and funding (startup_id, announcement_date).
    """
    startups = tables["startups"]
    signals = gather_signals(tables, as_of)
    findings = None
    if "llm_findings" in tables:
        known = sorted({p for table in (rules.CLOUD_KEYWORDS, rules.AI_KEYWORDS) for p in table})
        findings = materialize(G.llm_findings(tables["llm_findings"], known), "findings")
    attributions = materialize(run_attribution(startups, signals, findings), "attributions")
    classes = tables.get("classification")
    if classes is None:
        classes = startups.select(F.col("id").alias("startup_id"), F.lit(None).cast("string").alias("cloud_propensity")).limit(0)
    return {"signals": signals, "attributions": attributions, "snapshots": build_snapshot(attributions, classes, as_of, startups, tables.get("funding"))}


__all__ = ["attribute", "fallback_needed", "gather_signals", "run_attribution", "run_everything", "side", "union_signals"]
