"""Queries of the signal builders and the attribution run over pages, records and replies that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import attribution as R
from ..operators import scoring as S
from ..operators import signals as G
from ..sources import upsert as U
from . import bindings as B
from .registry import query

SIGNAL = ["startup_id", "provider_type", "provider_name", "CAST(confidence_weight AS DOUBLE) AS weight"]

PAGES = (
    "c_custkey AS startup_id, concat('https://nova', CAST(c_custkey AS STRING), '.com', CASE c_custkey % 5 WHEN 0 THEN '/' WHEN 1 THEN '/docs' WHEN 2 THEN '/security' WHEN 3 THEN '/.well-known/security.txt' ELSE '/careers' END) AS url, "
    "CASE c_custkey % 5 WHEN 0 THEN '/' WHEN 1 THEN '/docs' WHEN 2 THEN '/security' WHEN 3 THEN '/.well-known/security.txt' ELSE '/careers' END AS path, CASE WHEN c_custkey % 7 = 0 THEN 404 ELSE 200 END AS status, CAST(0 AS INT) AS ord, "
    "CASE c_custkey % 5 WHEN 0 THEN '<p>Built natively on AWS.</p><p>Backed by M12 and GV.</p><a href=\"https://aws.amazon.com/marketplace/pp/x\">m</a>' WHEN 1 THEN '<nav>azure devops</nav><p>Docs for Google Cloud. We use Cohere.</p>' "
    "WHEN 2 THEN '<p>We secure your Azure environment</p><script>openai</script><a href=\"https://cloud.google.com/marketplace/product/y\">m</a>' WHEN 3 THEN 'Policy: https aws cloudfront' ELSE '<p>none</p>' END AS html"
)


def _pages(spark, d):
    return B.derived(spark, d, "customer", PAGES)


def _answers(k: int) -> str:
    return f"c_custkey % 5 = {k} AND c_custkey % 7 <> 0"


@query(
    f"SELECT c_custkey AS startup_id, t AS provider_type, p AS provider_name, 1.0::DOUBLE AS weight FROM customer, (VALUES (0, 'cloud', 'AWS'), (1, 'cloud', 'GCP'), (1, 'ai', 'Cohere'), (2, 'cloud', 'Azure'), (3, 'cloud', 'AWS')) v(k, t, p) WHERE c_custkey % 5 = k AND c_custkey % 7 <> 0"
)
def g3_evidence_pages(spark, d):
    p = _pages(spark, d)
    return G.evidence_pages(p.select("startup_id", "url", "ord"), p).selectExpr(*SIGNAL)


VENDOR_ROWS = (
    "c_custkey AS startup_id, CASE c_custkey % 6 WHEN 0 THEN 'Microsoft Corp' WHEN 1 THEN 'OpenAI' WHEN 2 THEN 'Amazon Web Services' WHEN 3 THEN 'Google LLC' WHEN 4 THEN 'Anthropic' ELSE 'Stripe' END AS name, "
    "CASE c_custkey % 6 WHEN 0 THEN 'AI provider and cloud provider' WHEN 1 THEN 'AI service provider' WHEN 2 THEN 'AI service provider' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE 'hosting' END AS purpose, 'u' AS source_url, CAST(0 AS INT) AS ord"
)


@query("SELECT c_custkey AS startup_id, t AS provider_type, p AS provider_name, w::DOUBLE AS weight FROM customer, (VALUES (0, 'cloud', 'Azure', 1.0), (1, 'ai', 'OpenAI', 1.0), (2, 'ai', 'AWS Bedrock', 1.0), (3, 'cloud', 'GCP', 0.6), (4, 'ai', 'Anthropic', 1.0)) v(k, t, p, w) WHERE c_custkey % 6 = k")
def g4_subprocessors(spark, d):
    return G.subprocessors(B.derived(spark, d, "customer", VENDOR_ROWS)).selectExpr(*SIGNAL)


@query(
    "SELECT id AS startup_id, 'cloud' AS provider_type, CASE WHEN id % 2 = 0 THEN 'AWS' ELSE 'GCP' END AS provider_name, 1.0::DOUBLE AS weight FROM companies WHERE NOT (canonical_name LIKE 'Nova%' AND id % 4 = 3)",
    "companies",
)
def g5_case_studies(spark, d):
    """Result cards name a company whole or in part; what stands around the cards names everyone."""
    named = B.companies(spark, d)
    pages = named.selectExpr(
        "CASE WHEN id % 2 = 0 THEN 'AWS' ELSE 'GCP' END AS provider_name", "concat('<p>Searched for ', canonical_name, '</p><div class=\"result-card\"><b>How ', CASE WHEN id % 4 = 3 THEN replace(canonical_name, ' Labs', '') ELSE canonical_name END, ' grew</b></div>') AS html", "concat('u', id) AS url", "CAST(0 AS INT) AS ord"
    )
    return G.case_studies(pages, named).selectExpr(*SIGNAL)


NEWS = (
    "c_custkey AS startup_id, CAST(0 AS INT) AS stage, CAST(0 AS INT) AS batch, CAST(1 AS INT) AS rank, CASE c_custkey % 6 WHEN 0 THEN 'Nova Labs signs with Microsoft Azure' WHEN 1 THEN 'Nova Labs and Google team up' WHEN 2 THEN 'The Nova Labs of Amazon' WHEN 3 THEN 'Other firm uses Azure; Nova Labs picks OpenAI' "
    "WHEN 4 THEN 'Nova Labs builds on OpenAI and bare metal' ELSE 'Somebody on Azure' END AS title, '' AS snippet, 'u' AS url, CASE c_custkey % 4 WHEN 0 THEN '2 days ago' WHEN 1 THEN '1 year ago' WHEN 2 THEN '' ELSE '2 years ago' END AS date_str"
)


@query(
    "SELECT startup_id, t AS provider_type, p AS provider_name, w::DOUBLE AS weight FROM (SELECT c_custkey AS startup_id, t, p, round(CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 3 THEN 0.3 ELSE 0.6 END * m, 2) AS w "
    "FROM customer, (VALUES (0, 'cloud', 'Azure', 1.0), (1, 'cloud', 'GCP', 0.5), (3, 'ai', 'OpenAI', 1.0), (4, 'ai', 'OpenAI', 1.0), (4, 'cloud', 'On-Premises', 0.6)) v(k, t, p, m) WHERE c_custkey % 6 = k) WHERE w IN (1.0, 0.6, 0.3)"
)
def g6_partnerships(spark, d):
    named = B.derived(spark, d, "customer", "c_custkey AS id, 'Nova Labs' AS canonical_name, 'novalabs.ai' AS website")
    return G.partnerships(B.derived(spark, d, "customer", NEWS), named, B.AS_OF_EVENTS).selectExpr(*SIGNAL)


LISTINGS = (
    "c_custkey AS startup_id, CAST(c_custkey % 3 AS INT) AS rank, concat('https://aws.amazon.com/marketplace/pp/', CAST(c_custkey AS STRING)) AS url, CASE WHEN c_custkey % 5 = 0 THEN 404 ELSE 200 END AS status, "
    "CASE WHEN c_custkey % 4 = 0 THEN '<p>somebody else</p>' ELSE concat('<p>NOVA', CAST(c_custkey AS STRING), ' LABS on sale</p>') END AS html"
)


@query("SELECT id AS startup_id, 'cloud' AS provider_type, 'AWS' AS provider_name, 1.0::DOUBLE AS weight FROM companies WHERE canonical_name LIKE 'Nova%' AND id % 5 <> 0 AND id % 4 <> 0 AND id % 7 <> 0", "companies")
def g5_marketplace_listings(spark, d):
    told = B.companies(spark, d).where("id % 7 = 0").selectExpr("id AS startup_id", "'AWS' AS provider_name")
    return G.marketplace_listings(B.derived(spark, d, "customer", LISTINGS), B.companies(spark, d), told).selectExpr(*SIGNAL)


PRESS = "o_custkey AS startup_id, o_orderkey AS rank, concat('u', CAST(o_orderkey AS STRING)) AS url, CASE o_orderkey % 3 WHEN 0 THEN concat('Cloud news of nova', CAST(o_custkey AS STRING), '.ai') WHEN 1 THEN concat('NOVA', CAST(o_custkey AS STRING), ' Labs goes far') ELSE 'Other' END AS title"


@query(
    "SELECT startup_id, 'GCP' AS provider_name, arg_min(url, rank) AS evidence_url FROM (SELECT o_custkey AS startup_id, o_orderkey AS rank, 'u' || o_orderkey AS url, o_orderkey % 3 AS k FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 20) "
    "JOIN companies ON id = startup_id WHERE (k = 0 AND id % 3 = 0) OR (k = 1 AND canonical_name LIKE 'Nova%') GROUP BY 1",
    "companies",
)
def g5_press_titles(spark, d):
    return G.press_titles(B.derived(spark, d, "orders", PRESS), B.companies(spark, d)).select("startup_id", "provider_name", "evidence_url")


@query(
    "WITH c AS (SELECT c_custkey AS id FROM customer), r AS (SELECT id, 0 AS o, 'ai' AS t, 'OpenAI' AS p, CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.3 END AS w FROM c WHERE id % 3 = 0 UNION ALL SELECT id, 1, 'cloud', 'Azure', 1.0 FROM c WHERE id % 4 = 0 UNION ALL SELECT id, 1, 'ai', 'OpenAI', 1.0 FROM c WHERE id % 4 = 0 "
    "UNION ALL SELECT id, 2, 'cloud', p, 0.6 FROM c, (VALUES ('AWS'), ('Azure')) v(p) WHERE id % 5 <> 0 UNION ALL SELECT id, 3, t, p, 0.6 FROM c, (VALUES ('cloud', 'AWS'), ('ai', 'Cohere')) v(t, p) WHERE id % 7 = 0) "
    "SELECT id AS startup_id, t AS provider_type, p AS provider_name, w::DOUBLE AS weight FROM r QUALIFY row_number() OVER (PARTITION BY id, t, p ORDER BY o) = 1"
)
def g6_partnership_sources(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS startup_id")
    known = c.selectExpr("startup_id AS id", "'Nova Labs' AS canonical_name", "'novalabs.ai' AS website")
    hit = lambda *more: c.selectExpr("startup_id", "1 AS rank", "'u' AS url", *more)
    feed = hit("CASE WHEN startup_id % 3 = 0 THEN 'Nova Labs picks OpenAI' ELSE 'Nova Labs grows' END AS title", "CASE WHEN startup_id % 2 = 0 THEN DATE'2024-01-01' ELSE DATE'2020-01-01' END AS published")
    batches = hit("0 AS batch", "'Nova Labs grows' AS title", "CASE WHEN startup_id % 4 = 0 THEN 'on Microsoft Azure with OpenAI' END AS snippet", "'2 days ago' AS date_str")
    sites = hit("explode(array('AWS', 'Azure')) AS provider_name", "CASE WHEN startup_id % 5 = 0 THEN 'The Nova Labs' ELSE 'Nova Labs story' END AS title", "'' AS snippet", "'' AS date_str")
    articles = hit("'Nova Labs raises' AS title", "CASE WHEN startup_id % 7 = 0 THEN concat('Runs on AWS with Cohere. ', repeat('x ', 2000), ' google cloud') ELSE 'none' END AS body", "'1 year ago' AS date_str")
    return G.partnership_sources(known, B.AS_OF_EVENTS, feed, batches, sites, articles).selectExpr(*SIGNAL)


RECORDS = (
    "c_custkey AS startup_id, CASE WHEN c_custkey % 8 = 7 THEN 'A' ELSE 'CNAME' END AS rtype, CASE c_custkey % 8 WHEN 0 THEN 'x.elb.amazonaws.com.' WHEN 1 THEN 'GHS.googlehosted.com' WHEN 2 THEN 'app.azurewebsites.net.' WHEN 3 THEN 'a.wixdns.net' WHEN 4 THEN 'x.vercel-dns.com' "
    "WHEN 5 THEN 'plain.example.com' WHEN 6 THEN 'y.onrender.com' ELSE 'x.amazonaws.com' END AS target"
)


@query("SELECT c_custkey AS startup_id, 'cloud' AS provider_type, CASE c_custkey % 8 WHEN 0 THEN 'AWS' WHEN 1 THEN 'GCP' ELSE 'Azure' END AS provider_name, 1.0::DOUBLE AS weight FROM customer WHERE c_custkey % 8 IN (0, 1, 2)")
def g7_dns_cnames(spark, d):
    return G.dns_cnames(B.derived(spark, d, "customer", RECORDS)).selectExpr(*SIGNAL)


@query("SELECT c_custkey AS startup_id, 'cloud' AS provider_type, CASE c_custkey % 5 WHEN 0 THEN 'AWS' ELSE 'GCP' END AS provider_name, 0.6::DOUBLE AS weight FROM customer WHERE c_custkey % 5 IN (0, 2)")
def g8_marketplaces(spark, d):
    return G.marketplaces(_pages(spark, d)).selectExpr(*SIGNAL)


HEADERS = (
    "c_custkey AS startup_id, 'u' AS url, CASE c_custkey % 6 WHEN 0 THEN map('X-Amz-Cf-Id', '1', 'x-amz-cf-id', '2', 'Server', 'CloudFront') WHEN 1 THEN map('SERVER', 'Google Frontend') WHEN 2 THEN map('x-azure-ref', 'a') "
    "WHEN 3 THEN map('server', 'Vercel') WHEN 4 THEN map('CF-Ray', 'x') ELSE map('server', 'nginx') END AS headers"
)


def _headed(spark, d):
    return B.derived(spark, d, "customer", HEADERS)


@query(
    "SELECT c_custkey AS startup_id, 'cloud' AS provider_type, p AS provider_name, 0.6::DOUBLE AS weight FROM customer, (VALUES (0, 'AWS'), (0, 'AWS'), (1, 'GCP'), (2, 'Azure')) v(k, p) WHERE c_custkey % 6 = k AND c_custkey % 8 <> 3"
)
def g9_http_headers(spark, d):
    """Names that differ by case are one header; startups on hosting platforms are left out (J6)."""
    return G.http_headers(_headed(spark, d), G.hosted_startups(B.derived(spark, d, "customer", RECORDS))).selectExpr(*SIGNAL)


POSTS = (
    "o_custkey AS startup_id, concat('u', CAST(o_orderkey AS STRING)) AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'Software Engineer' ELSE 'Sales' END AS title, 200 AS status, o_orderkey AS ord, "
    "CASE o_orderkey % 4 WHEN 0 THEN '<p>We migrated to AWS</p>' WHEN 1 THEN '<p>We call OpenAI daily</p>' WHEN 2 THEN '<p>GCP primarily, with AWS too</p>' ELSE '<p>no cloud</p>' END AS html"
)


@query(
    "WITH p AS (SELECT o_custkey AS startup_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END, o_orderkey) AS place FROM orders), e AS (SELECT * FROM p WHERE place <= 8), "
    "d AS (SELECT *, coalesce(bool_or(k % 4 IN (0, 2)) OVER w, false) AND coalesce(bool_or(k % 4 = 1) OVER w, false) AS done FROM e WINDOW w AS (PARTITION BY startup_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "h AS (SELECT startup_id, place, CASE k % 4 WHEN 1 THEN 'ai' ELSE 'cloud' END AS provider_type, CASE k % 4 WHEN 0 THEN 'AWS' WHEN 1 THEN 'OpenAI' ELSE 'GCP' END AS provider_name, CASE k % 4 WHEN 2 THEN 1.0 ELSE 0.6 END::DOUBLE AS weight FROM d WHERE NOT done AND k % 4 <> 3) "
    "SELECT startup_id, provider_type, provider_name, weight FROM h QUALIFY row_number() OVER (PARTITION BY startup_id, provider_type, provider_name ORDER BY place) = 1"
)
def g10_job_postings(spark, d):
    return G.job_postings(B.derived(spark, d, "orders", POSTS)).selectExpr(*SIGNAL)


@query(
    "SELECT c_custkey AS startup_id, t AS provider_type, p AS provider_name, s AS signal_source, w::DOUBLE AS weight FROM customer, (VALUES (0, 'cloud', 'AWS', 'ownership_declaration', 1.0), (1, 'cloud', 'GCP', 'tech_docs', 0.6), (1, 'ai', 'Cohere', 'tech_docs', 0.6)) v(k, t, p, s, w) WHERE c_custkey % 5 = k AND c_custkey % 7 <> 0"
)
def g11_site_pages(spark, d):
    return G.site_pages(_pages(spark, d)).selectExpr(*SIGNAL, "signal_source")


@query("SELECT c_custkey AS startup_id, 'cloud' AS provider_type, p AS provider_name, 0.3::DOUBLE AS weight FROM customer, (VALUES ('GCP')) v(p) WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0")
def g12_homepage_investors(spark, d):
    return G.homepage_investor_signals(_pages(spark, d)).selectExpr(*SIGNAL)


BLOG = "c_custkey AS startup_id, concat('https://x.example/', CASE c_custkey % 3 WHEN 0 THEN 'best-llm' ELSE 'post' END, CAST(c_custkey AS STRING)) AS url, CAST(c_custkey % 2 AS INT) AS ord, 200 AS status, '<p>Our BigQuery story</p>' AS html"


@query("SELECT c_custkey AS startup_id, 'cloud' AS provider_type, 'GCP' AS provider_name, 0.6::DOUBLE AS weight FROM customer WHERE c_custkey % 3 <> 0")
def g13_blog_posts(spark, d):
    posts = B.derived(spark, d, "customer", BLOG)
    return G.blog_posts(posts.select("startup_id", "url", "ord").unionByName(posts.select("startup_id", "url", "ord")), posts).selectExpr(*SIGNAL)


@query(f"SELECT c_custkey AS startup_id, 'cloud' AS provider_type, 'AWS' AS provider_name, 0.6::DOUBLE AS weight FROM customer WHERE {_answers(3)}")
def g14_security_txt(spark, d):
    return G.security_txt(_pages(spark, d)).selectExpr(*SIGNAL)


FOUNDERS = "c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN array('Google Brain', 'AWS') WHEN 1 THEN array('DeepMind', 'ex-Google Brain') WHEN 2 THEN array('Stanford PhD') ELSE array('OpenAI') END AS founder_background"


@query("SELECT c_custkey AS startup_id, 'cloud' AS provider_type, CASE c_custkey % 4 WHEN 1 THEN 'GCP' ELSE 'Azure' END AS provider_name, 0.3::DOUBLE AS weight FROM customer WHERE c_custkey % 4 IN (1, 3)")
def g17_founder_priors(spark, d):
    return G.founder_priors(B.derived(spark, d, "customer", FOUNDERS)).selectExpr(*SIGNAL)


@query(
    "SELECT c_custkey AS startup_id, 'cloud' AS provider_type, CASE WHEN c_custkey % 6 = 3 THEN 'Vercel' WHEN c_custkey % 6 = 4 THEN 'Cloudflare' WHEN c_custkey % 8 = 4 THEN 'Vercel' ELSE 'Render' END AS provider_name, 0.3::DOUBLE AS weight FROM customer "
    "WHERE c_custkey % 8 NOT IN (0, 1, 2) AND (c_custkey % 6 IN (3, 4) OR c_custkey % 8 IN (4, 6))"
)
def g18_other_platforms(spark, d):
    """Only startups without a cloud signal (J7); CNAMEs only where headers found none."""
    records = B.derived(spark, d, "customer", RECORDS)
    return G.other_platforms(_headed(spark, d), records, G.dns_cnames(records)).selectExpr(*SIGNAL)


REPLY = (
    "c_custkey AS startup_id, CASE WHEN c_custkey % 2 = 0 THEN '4a' ELSE '4b' END AS tier, c_custkey % 3 <> 0 AS need_cloud, c_custkey % 5 <> 0 AS need_ai, CASE WHEN c_custkey % 11 = 0 THEN '[broken' ELSE concat('Here: [{\"provider_type\": \"ai\", \"provider_name\": \"OpenAI\", \"confidence\": ', CAST(c_custkey % 100 AS STRING), "
    "', \"evidence\": \"e\"}, {\"provider_type\": \"cloud\", \"provider_name\": \"AWS\", \"confidence\": ', CAST(c_custkey % 97 AS STRING), '}, {\"provider_type\": \"ai\", \"provider_name\": \"Nobody\", \"confidence\": 99}]') END AS raw"
)


@query(
    "SELECT c_custkey AS startup_id, t AS provider_type, CASE t WHEN 'ai' THEN 'OpenAI' ELSE 'AWS' END AS provider_name, CASE WHEN c >= 80 THEN 1.0 WHEN c >= 50 THEN 0.6 ELSE 0.3 END::DOUBLE AS weight, CASE WHEN c_custkey % 2 = 0 THEN 'perplexity_search' ELSE 'llm_inference' END AS signal_source "
    "FROM (SELECT c_custkey, 'ai' AS t, c_custkey % 100 AS c FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 100 >= 60 UNION ALL SELECT c_custkey, 'cloud', c_custkey % 97 FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 97 >= 30) WHERE c_custkey % 11 <> 0"
)
def g19_llm_findings(spark, d):
    return G.llm_findings(B.derived(spark, d, "customer", REPLY), ["OpenAI", "AWS"]).selectExpr(*SIGNAL, "signal_source")


@query("SELECT user_id AS startup_id, event_id FROM events WHERE NOT (user_id % 3 = 0 AND user_id % 4 <> 0 AND event_id % 5 = 1)")
def g20_relevance_filter(spark, d):
    items = B.derived(spark, d, "events", "user_id AS startup_id, event_id, CAST(event_id % 5 AS INT) AS item_no")
    verdict = "CASE WHEN startup_id % 4 = 0 THEN 'no json' ELSE concat('[{\"index\": 1, \"keep\": ', CASE WHEN startup_id % 3 = 0 THEN 'false' ELSE 'true' END, '}, {\"index\": 2, \"keep\": true}]') END AS raw"
    replies = items.select("startup_id").distinct().selectExpr("startup_id", verdict)
    return G.relevance_filter(items, replies).select("startup_id", "event_id")


# ---- tables that decide, and the whole run


@query(
    "SELECT id AS startup_id, 'cloud' AS provider_type, id % 50 = 0 AS is_multi, CASE id % 50 WHEN 1 THEN 'CoreWeave' WHEN 3 THEN 'AWS' END AS primary_provider, CASE id % 50 WHEN 0 THEN 'GCP + AWS' WHEN 1 THEN 'CoreWeave' ELSE 'AWS' END AS names FROM companies WHERE id % 50 IN (0, 1, 3)",
    "companies",
)
def g1_overrides(spark, d):
    return G.override_attributions(B.companies(spark, d)).select("startup_id", "provider_type", "is_multi", "primary_provider", F.array_join("names", " + ").alias("names"))


@query("SELECT id AS startup_id, CASE id % 50 WHEN 2 THEN 'cloud' ELSE 'ai' END AS provider_type FROM companies WHERE id % 50 IN (0, 2, 3)", "companies")
def g2_not_applicable(spark, d):
    return G.not_applicable(B.companies(spark, d)).select("startup_id", "provider_type")


def _found(spark, d):
    """Findings for all startups but every seventh: tier 4a says Vultr, 4b says AWS for every third."""
    rows = B.companies(spark, d).where("id % 7 <> 0").selectExpr("id AS startup_id", "explode(CASE WHEN id % 3 = 0 THEN array('4a', '4b') ELSE array('4a') END) AS tier")
    return rows.selectExpr(
        "startup_id", "tier", "'cloud' AS provider_type", "CASE tier WHEN '4a' THEN 'Vultr' ELSE 'AWS' END AS provider_name", "'llm' AS signal_source", "'STRONG' AS signal_strength",
        "CAST(NULL AS STRING) AS evidence_text", "CAST(NULL AS STRING) AS evidence_url", "CAST(1.0 AS DECIMAL(3,1)) AS confidence_weight", "CAST(0 AS BIGINT) AS ord",
    )


_RUN = (
    "WITH raw AS (SELECT startup_id, provider_type, provider_name, signal_source, tenths FROM signals), na AS (SELECT id, CASE id % 50 WHEN 2 THEN 'cloud' ELSE 'ai' END AS side FROM companies WHERE id % 50 IN (0, 2, 3)), "
    "fixed AS (SELECT id, CASE id % 50 WHEN 0 THEN ['GCP', 'AWS'] WHEN 1 THEN ['CoreWeave'] ELSE ['AWS'] END AS names FROM companies WHERE id % 50 IN (0, 1, 3)), free AS (SELECT id, industry FROM companies WHERE id % 50 > 3), "
    "hard AS (SELECT id FROM free LEFT JOIN (SELECT startup_id, max(tenths) AS best FROM raw WHERE provider_type = 'cloud' GROUP BY 1) ON startup_id = id WHERE lower(industry) = 'machinery' AND coalesce(best, 0) < 6), "
    "kept AS (SELECT * FROM raw WHERE startup_id IN (SELECT id FROM free) AND NOT (provider_type = 'cloud' AND startup_id IN (SELECT id FROM hard)) UNION ALL SELECT * FROM raw WHERE startup_id % 50 = 2 AND provider_type = 'ai'), "
)


def _decide(source: str, name: str) -> str:
    """CTEs that attribute the signals of a CTE, as the derived table attributed does."""
    scores = B.SQL["scores"].replace("FROM signals", f"FROM {source}")
    return f"s_{name} AS ({scores}), a_{name} AS ({B.SQL['attributed'].replace('FROM scores', f'FROM s_{name}')})"


@query(
    "WITH companies AS (" + B.SQL["companies"] + "), signals AS (" + B.SQL["signals"] + "), " + _RUN[5:] + _decide("kept", "first") + ", "
    "weak AS (SELECT f.id FROM free f LEFT JOIN a_first a ON a.startup_id = f.id AND a.provider_type = 'cloud' WHERE coalesce(a.confidence, 0) < 0.6), "
    "extra AS (SELECT id AS startup_id, 'cloud' AS provider_type, CASE WHEN id % 3 = 0 THEN 'AWS' ELSE 'Vultr' END AS provider_name, 'llm' AS signal_source, 10 AS tenths FROM weak WHERE id % 7 <> 0), "
    "again AS (SELECT * FROM kept UNION ALL SELECT * FROM extra), " + _decide("again", "last") + " "
    "SELECT startup_id, provider_type, is_multi, primary_provider, provider_names, confidence, evidence_count::BIGINT AS evidence_count, false AS is_not_applicable FROM a_last "
    "UNION ALL SELECT id, 'cloud', len(names) > 1, CASE WHEN len(names) = 1 THEN names[1] END, array_to_string(names, ' + '), 1.0, len(names)::BIGINT, false FROM fixed "
    "UNION ALL SELECT id, side, false, NULL, '', 0.0, 0, true FROM na UNION ALL SELECT id, 'cloud', false, 'On-Premises', 'On-Premises', 0.15, 0, false FROM hard WHERE id NOT IN (SELECT startup_id FROM a_last WHERE provider_type = 'cloud')",
)
def a7_run_attribution(spark, d):
    """Overrides, not-applicable sides, scoring, hardware prior and both fallback tiers in one run."""
    out = R.run_attribution(B.companies(spark, d), B.signals(spark, d), _found(spark, d), hardware=["machinery"])
    names = F.array_join(F.transform("providers", lambda p: p["provider_name"]), " + ")
    return out.select("startup_id", "provider_type", "is_multi", "primary_provider", names.alias("provider_names"), "confidence", "evidence_count", "is_not_applicable")


@query(
    "SELECT startup_id, 'cloud' AS provider_type, p AS provider_name, t AS tenths, n AS signals FROM (SELECT startup_id, p, sum(w)::BIGINT AS t, count(*) AS n FROM ("
    "SELECT c_custkey AS startup_id, CASE c_custkey % 8 WHEN 0 THEN 'AWS' WHEN 1 THEN 'GCP' ELSE 'Azure' END AS p, 10 AS w FROM customer WHERE c_custkey % 8 IN (0, 1, 2) "
    "UNION ALL SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'AWS' ELSE 'GCP' END, 6 FROM customer WHERE c_custkey % 5 IN (0, 2) "
    "UNION ALL SELECT c_custkey, p, w FROM customer, (VALUES (0, 'AWS', 10), (1, 'GCP', 6), (0, 'GCP', 3), (3, 'AWS', 6)) v(k, p, w) WHERE c_custkey % 5 = k AND c_custkey % 7 <> 0) GROUP BY 1, 2) "
    "UNION ALL SELECT c_custkey, 'ai', 'Cohere', 6, 1 FROM customer WHERE c_custkey % 5 = 1 AND c_custkey % 7 <> 0 "
    "UNION ALL SELECT c_custkey, 'cloud', CASE c_custkey % 8 WHEN 4 THEN 'Vercel' ELSE 'Render' END, 3, 1 FROM customer WHERE c_custkey % 8 IN (4, 6) AND NOT (c_custkey % 5 IN (0, 2) OR (c_custkey % 5 IN (0, 1, 3) AND c_custkey % 7 <> 0))"
)
def u1_gather_signals(spark, d):
    """All builders whose tables are given (U1), scored by provider; U2 splits them by type."""
    pages = _pages(spark, d).withColumn("headers", F.expr("map('server', 'nginx')"))
    lists = F.array().cast("array<string>")
    startups = B.companies(spark, d).withColumn("lead_investors", lists).withColumn("founder_background", lists)
    found = R.gather_signals({"startups": startups, "pages": pages, "dns_records": B.derived(spark, d, "customer", RECORDS)}, B.AS_OF_EVENTS)
    parts = [R.side(found, k) for k in ("cloud", "ai")]
    scored = S.score_providers(R.union_signals(parts))
    return scored.select("startup_id", "provider_type", "provider_name", (F.col("score") * 10).cast("long").alias("tenths"), F.col("n").alias("signals"))


_GATHERED = (
    "SELECT c_custkey AS startup_id, 'cloud' AS provider_type, CASE c_custkey % 8 WHEN 0 THEN 'AWS' WHEN 1 THEN 'GCP' ELSE 'Azure' END AS provider_name, 'found' AS signal_source, 10 AS tenths FROM customer WHERE c_custkey % 8 IN (0, 1, 2) "
    "UNION ALL SELECT c_custkey, 'cloud', CASE c_custkey % 5 WHEN 0 THEN 'AWS' ELSE 'GCP' END, 'found', 6 FROM customer WHERE c_custkey % 5 IN (0, 2) "
    "UNION ALL SELECT c_custkey, 'cloud', p, 'found', w FROM customer, (VALUES (0, 'AWS', 10), (1, 'GCP', 6), (0, 'GCP', 3), (3, 'AWS', 6)) v(k, p, w) WHERE c_custkey % 5 = k AND c_custkey % 7 <> 0 "
    "UNION ALL SELECT c_custkey, 'ai', 'Cohere', 'found', 6 FROM customer WHERE c_custkey % 5 = 1 AND c_custkey % 7 <> 0 "
    "UNION ALL SELECT c_custkey, 'cloud', CASE c_custkey % 8 WHEN 4 THEN 'Vercel' ELSE 'Render' END, 'found', 3 FROM customer WHERE c_custkey % 8 IN (4, 6) AND NOT (c_custkey % 5 IN (0, 2) OR (c_custkey % 5 IN (0, 1, 3) AND c_custkey % 7 <> 0))"
)


@query(
    "WITH companies AS (" + B.SQL["companies"] + "), signals AS (" + _GATHERED + "), " + _RUN[5:].replace("'machinery'", "'no such'") + _decide("kept", "own") + ", "
    "told AS (SELECT startup_id, provider_type, is_multi, primary_provider, evidence_count::BIGINT AS evidence_count, confidence, false AS na FROM a_own UNION ALL SELECT id, 'cloud', len(names) > 1, CASE WHEN len(names) = 1 THEN names[1] END, len(names)::BIGINT, 1.0, false FROM fixed "
    "UNION ALL SELECT id, side, false, NULL, 0, 0.0, true FROM na) "
    "SELECT id AS startup_id, coalesce(c.is_multi, false) AS cloud_is_multi, c.primary_provider AS cloud_primary_provider, coalesce(c.evidence_count, 0) AS cloud_evidence_count, coalesce(c.na, false) AS cloud_not_applicable, "
    "a.primary_provider AS ai_primary_provider, a.confidence AS ai_confidence, coalesce(a.na, false) AS ai_not_applicable FROM companies LEFT JOIN (SELECT * FROM told WHERE provider_type = 'cloud') c ON c.startup_id = id LEFT JOIN (SELECT * FROM told WHERE provider_type = 'ai') a ON a.startup_id = id"
)
def u2_run_everything(spark, d):
    """From pages and DNS records to one snapshot row per company."""
    pages = _pages(spark, d).withColumn("headers", F.expr("map('server', 'nginx')"))
    lists = F.array().cast("array<string>")
    startups = B.companies(spark, d).withColumn("lead_investors", lists).withColumn("founder_background", lists)
    run = R.run_everything({"startups": startups, "pages": pages, "dns_records": B.derived(spark, d, "customer", RECORDS)}, B.AS_OF_EVENTS)
    return run["snapshots"].select("startup_id", "cloud_is_multi", "cloud_primary_provider", "cloud_evidence_count", "cloud_not_applicable", "ai_primary_provider", "ai_confidence", "ai_not_applicable")


@query(
    "SELECT id AS startup_id, coalesce(c.is_multi, false) AS cloud_is_multi, c.primary_provider AS cloud_primary_provider, coalesce(c.evidence_count, 0)::BIGINT AS cloud_evidence_count, coalesce(c.provider_names, '') AS cloud_providers, a.primary_provider AS ai_primary_provider, a.confidence AS ai_confidence, "
    "industry AS vertical, CAST(CASE WHEN fd IS NULL THEN 3 WHEN DATE '2001-08-01' - fd <= 90 AND id % 3 = 0 AND coalesce(lead, 0) < 10 THEN 1 WHEN DATE '2001-08-01' - fd <= 180 AND id % 3 IN (0, 1) THEN 2 ELSE 3 END AS INT) AS engagement_tier "
    "FROM startups LEFT JOIN (SELECT * FROM attributed WHERE provider_type = 'cloud') c ON c.startup_id = id LEFT JOIN (SELECT * FROM attributed WHERE provider_type = 'ai') a ON a.startup_id = id "
    "LEFT JOIN (SELECT startup_id AS fid, max(announcement_date) AS fd FROM funding GROUP BY 1) ON fid = id LEFT JOIN (SELECT startup_id AS sid, max(t) AS lead FROM scores WHERE provider_type = 'cloud' GROUP BY 1) ON sid = id AND c.startup_id IS NOT NULL",
    "startups", "attributed", "funding",
)
def s6_snapshot_of_all(spark, d):
    """A row for every startup, attributed or not, with its engagement tier."""
    classes = B.startups(spark, d).selectExpr("id AS startup_id", "industry AS vertical", "CASE id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS cloud_propensity")
    snap = U.build_snapshot(S.attribute(B.signals(spark, d)), classes, B.AS_OF_ORDERS, B.startups(spark, d), B.funding(spark, d))
    return snap.select("startup_id", "cloud_is_multi", "cloud_primary_provider", "cloud_evidence_count", F.array_join("cloud_providers", " + ").alias("cloud_providers"), "ai_primary_provider", "ai_confidence", "vertical", "engagement_tier")


RUNS = "o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS run_date, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'running' END AS status"


@query(
    "SELECT (SELECT count(*) FROM latest) AS total_startups, run_date AS last_run_date, run_id AS last_run_id, status AS last_run_status FROM " + B.duck("orders", RUNS) + " ORDER BY run_date DESC, run_id DESC LIMIT 1",
    "latest",
)
def a15_latest_run(spark, d):
    latest = A.latest_attributions(B.startups(spark, d), B.funding(spark, d), B.snapshots(spark, d))
    return A.summary(latest, B.triggers(spark, d), B.derived(spark, d, "orders", RUNS)).select("total_startups", "last_run_date", "last_run_id", "last_run_status")


@query(f"SELECT run_id, run_date FROM {B.duck('orders', RUNS)} ORDER BY run_date DESC, run_id LIMIT 20")
def w4_top_runs(spark, d):
    return A.top_rows(B.derived(spark, d, "orders", RUNS), "run_date", ["run_id"], 20).select("run_id", "run_date")
