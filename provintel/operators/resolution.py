"""Company names to web domains: candidates, link scores, and the cascade over them; domain health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, rules
from ..functions.text import apex_domain, contains_any, extract_domain, is_valid_domain


def domain_candidates(companies: DataFrame) -> DataFrame:
    """(startup_id, rank, domain): joined, hyphenated and first-word names with endings in order; single words give none."""
    name = F.trim(F.regexp_replace(F.lower("canonical_name"), r"\s+(inc\.?|llc|ltd\.?|corporation|corp\.?)$", ""))
    joined, hyphen, first = F.regexp_replace(name, " ", ""), F.regexp_replace(name, " ", "-"), F.split(name, r"\s+")[0]
    tries = [F.concat(n, F.lit(t)) for n, ts in ((joined, (".com", ".ai", ".io")), (hyphen, (".com", ".ai")), (first, (".com", ".ai"))) for t in ts]
    some = companies.where(F.size(F.split(name, r"\s+")) > 1)
    return some.select(F.col("id").alias("startup_id"), F.posexplode(F.array_distinct(F.array(*tries))).alias("rank", "domain"))


def name_on_homepage(pages: DataFrame, companies: DataFrame) -> DataFrame:
    """(startup_id, domain) where title, description or headings hold the name, its slug, or all its words of three letters."""
    head = pages.select("domain", F.lower(html.headline_text(F.col("html"))).alias("_head"))
    name = F.lower("canonical_name")
    words = F.filter(F.split(name, r"\s+"), lambda w: F.length(w) >= 3)
    pairs = companies.select(F.col("id").alias("startup_id"), "domain", name.alias("_name"), F.regexp_replace(name, r"[^a-z0-9]", "").alias("_slug"), words.alias("_words")).join(head, "domain")
    hit = F.contains(F.col("_head"), F.col("_name")) | F.contains(F.regexp_replace("_head", "[^a-z0-9\n]", ""), F.col("_slug")) | ((F.size("_words") > 0) & F.forall("_words", lambda w: F.contains(F.col("_head"), w)))
    return pairs.where(hit).select("startup_id", "domain")


def score_links(articles: DataFrame, skip: list[str] = rules.ARTICLE_SKIP_DOMAINS, prefixes: list[str] = rules.STARTUP_PREFIXES) -> DataFrame:
    """Per (startup_id, apex): anchor hits, pattern hits and frequency of links in article html (startup_id, canonical_name, domain, html)."""
    slug = F.regexp_replace(F.lower("canonical_name"), "[^a-z0-9]", "")
    links = articles.select("startup_id", slug.alias("slug"), F.lower("canonical_name").alias("name"), apex_domain(F.col("domain")).alias("own"), F.explode(html.extract_links(F.col("html"))).alias("l"))
    host = apex_domain(F.try_parse_url("l.href", F.lit("HOST")))
    flat = links.where(F.col("l.href").startswith("http")).select("startup_id", host.alias("apex"), "own", F.contains(F.lower("l.text"), F.col("name")).alias("anchor"), "slug")
    base = F.split("apex", r"\.")[0]
    pattern = F.exists(F.array(*map(F.lit, prefixes)), lambda p: base == F.concat(p, F.col("slug"))) | (F.col("apex") == F.concat("slug", F.lit(".ai"))) | (F.col("apex") == F.concat("slug", F.lit(".io")))
    usable = flat.where(is_valid_domain(F.col("apex")) & ~F.col("apex").isin(list(skip)) & (F.col("apex") != F.coalesce("own", F.lit(""))))
    return usable.groupBy("startup_id", "apex").agg(F.sum(F.col("anchor").cast("int")).alias("anchor_hits"), F.sum(pattern.cast("int")).alias("pattern_hits"), F.count("*").alias("freq"))


def resolve_domains(texts: DataFrame, search_scores: DataFrame, link_scores: DataFrame, candidates: DataFrame, replies: DataFrame, dns: DataFrame, homepages: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(startup_id, domain, stage): the first stage that gives one - text, search hosts, article links, name candidates, supplied reply.

    Text needs no check; a reply needs a DNS row; the others need a DNS row and the name on the homepage (startup_id, domain).
    With pages (domain, path, final_url), a domain that redirects to another registrable name becomes that one.
    """
    strong = "anchor_hits >= 1 or pattern_hits >= 1 or freq >= 2"
    by_score = Window.partitionBy("startup_id").orderBy(F.desc("anchor_hits"), F.desc("pattern_hits"), F.desc("freq"), "apex")
    ranked = lambda df, stage: df.where(strong).select("startup_id", F.col("apex").alias("domain"), F.lit(stage).alias("stage"), F.row_number().over(by_score).alias("rank"))
    text = texts.select("startup_id", extract_domain(F.col("text")).alias("domain"), F.lit(1).alias("stage"), F.lit(1).alias("rank")).where(F.col("domain").isNotNull())
    checked = ranked(search_scores, 2).unionByName(ranked(link_scores, 3)).unionByName(candidates.select("startup_id", "domain", F.lit(4).alias("stage"), "rank"))
    live = dns.select("domain").distinct()
    checked = checked.join(live, "domain", "left_semi").join(homepages, ["startup_id", "domain"], "left_semi")
    said = replies.select("startup_id", F.lower(F.trim("domain")).alias("domain"), F.lit(5).alias("stage"), F.lit(1).alias("rank")).where(is_valid_domain(F.col("domain"))).join(live, "domain", "left_semi")
    every = text.unionByName(checked).unionByName(said)
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy("startup_id").orderBy("stage", "rank"))).where("_n = 1").select("startup_id", "domain", "stage")
    return first if pages is None else canonical_redirect(first, pages).select("startup_id", "domain", "stage")


def canonical_redirect(resolved: DataFrame, pages: DataFrame) -> DataFrame:
    """A domain whose page ended on another registrable name takes that host."""
    final = pages.where("path = '/'").select("domain", F.regexp_replace(F.lower(F.try_parse_url("final_url", F.lit("HOST"))), r"^www\.", "").alias("_final"))
    moved = F.col("_final").isNotNull() & (apex_domain(F.col("_final")) != apex_domain(F.col("domain")))
    return resolved.join(final.dropDuplicates(["domain"]), "domain", "left").withColumn("domain", F.when(moved, F.col("_final")).otherwise(F.col("domain"))).drop("_final")


def resolve_missing(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """Events without a website take the resolved one of their startup_id."""
    return events.join(resolved.select("startup_id", F.col("domain").alias("_d")), "startup_id", "left").withColumn("website", F.coalesce("website", "_d")).drop("_d")


def domain_health(startups: DataFrame, pages: DataFrame) -> DataFrame:
    """(startup_id, is_valid, reason): the first rule that fires on a startup's home page; no page is invalid."""
    name, low = F.lower("canonical_name"), F.lower(F.coalesce("html", F.lit("")))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, " ai", ""), " ", ""), "ai", "")
    slug = F.substring(F.when(F.length(slug) < 4, F.regexp_replace(name, " ", "")).otherwise(slug), 1, 5)
    host = F.regexp_replace(F.lower(F.try_parse_url("final_url", F.lit("HOST"))), r"www\.", "")
    size = F.length(F.trim(F.coalesce("html", F.lit(""))))
    joined = startups.select(F.col("id").alias("startup_id"), "canonical_name", F.col("website").alias("domain")).join(pages.where("path = '/'"), "domain", "left")
    reason = (
        F.when(F.col("final_url").isNull(), "no response")
        .when(contains_any(host, rules.BAD_REDIRECTS), F.concat(F.lit("redirects to bad host: "), host))
        .when(~F.contains(host, F.col("domain")) & ~F.contains(host, slug), F.concat(F.lit("redirected to unrelated host: "), host))
        .when((F.col("status") == 404) | (F.col("status") >= 500), F.concat(F.lit("HTTP "), F.col("status")))
        .when((size < 300) & contains_any(low, rules.SHORT_PAGE_REDIRECTS), "JS redirect shell")
        .when(size < 300, "near-empty response")
        .when(contains_any(low, rules.PARKING_SNIPPETS), "parking/redirect shell detected")
        .when(~F.contains(low, slug) & ~F.contains(low, name), "OK (name not in page)")
        .otherwise("OK")
    )
    return joined.select("startup_id", reason.alias("reason")).withColumn("is_valid", F.startswith("reason", F.lit("OK")))
