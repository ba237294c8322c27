"""Queries of triggers, replies and queues over hits that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import engagement as K
from ..sources import upsert as U
from . import bindings as B
from .registry import query

TRIGGER = ["company_id", "trigger_type", "source_url", "signal_strength"]
POSTED = "o_custkey AS startup_id, concat('u', CAST(o_orderkey AS STRING)) AS url, CASE o_orderkey % 4 WHEN 0 THEN 'Backend dev' WHEN 1 THEN '' WHEN 2 THEN 'Account manager' ELSE 'DevOps lead' END AS title, o_orderkey AS ord"


@query("SELECT o_custkey AS company_id, 'hiring_surge' AS trigger_type, 'u' || min(o_orderkey) AS source_url, 'strong' AS signal_strength, count(*) || ' infrastructure/engineering roles posted' AS trigger_label FROM orders WHERE o_orderkey % 4 IN (0, 3) GROUP BY 1 HAVING count(*) >= 3")
def k4_hiring_surge(spark, d):
    return K.hiring_surge(B.derived(spark, d, "orders", POSTED)).select(*TRIGGER, "trigger_label")


HITS = (
    "user_id AS startup_id, concat('https://', CASE event_id % 4 WHEN 0 THEN 'www.techcrunch.com' WHEN 1 THEN 'wired.com' WHEN 2 THEN 'forbes.com' ELSE 'blog.example' END, '/', CAST(event_id AS STRING)) AS url, CAST(event_id % 3 AS INT) AS batch, event_id AS rank, "
    "CASE event_id % 5 WHEN 0 THEN 'New CTO named' WHEN 1 THEN 'Creative director joins' WHEN 2 THEN 'VP of Engineering hired' WHEN 3 THEN 'Nova ships' ELSE 'Other news' END AS title, CAST(NULL AS STRING) AS snippet, concat(CAST(event_id % 90 AS STRING), ' days ago') AS date_str, event_id % 7 <> 0 AS confirmed"
)
_HITS = "SELECT user_id AS company_id, event_id, event_id % 5 AS said, event_id % 90 AS age, event_id % 3 AS batch, 'https://' || CASE event_id % 4 WHEN 0 THEN 'www.techcrunch.com' WHEN 1 THEN 'wired.com' WHEN 2 THEN 'forbes.com' ELSE 'blog.example' END || '/' || event_id AS source_url FROM events"


@query(
    f"SELECT company_id, 'leadership_hire' AS trigger_type, source_url, CASE said WHEN 2 THEN 'moderate' ELSE 'strong' END AS signal_strength FROM ({_HITS}) WHERE age <= 60 AND said < 3 AND event_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY event_id) = 1"
)
def k5_leadership_hire(spark, d):
    """'director' holds 'cto' unless words are asked for."""
    return K.leadership_hire(B.derived(spark, d, "events", HITS), B.AS_OF_EVENTS).select(*TRIGGER)


@query(
    f"SELECT company_id, 'leadership_hire' AS trigger_type, source_url, CASE said WHEN 2 THEN 'moderate' ELSE 'strong' END AS signal_strength FROM ({_HITS}) WHERE age <= 60 AND said IN (0, 2) AND event_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY event_id) = 1"
)
def k5_leadership_words(spark, d):
    return K.leadership_hire(B.derived(spark, d, "events", HITS), B.AS_OF_EVENTS, word_boundaries=True).select(*TRIGGER)


def _named(spark, d):
    return B.derived(spark, d, "events", "user_id AS id").distinct().withColumn("canonical_name", F.lit("Nova Labs"))


@query(f"SELECT company_id, 'product_launch' AS trigger_type, source_url, 'moderate' AS signal_strength FROM ({_HITS}) WHERE age <= 30 AND said = 3 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY batch, event_id) = 1")
def k6_product_launch(spark, d):
    return K.news_trigger(B.derived(spark, d, "events", HITS), _named(spark, d), B.AS_OF_EVENTS).select(*TRIGGER)


@query(f"SELECT company_id, 'partnership' AS trigger_type, source_url, 'moderate' AS signal_strength FROM ({_HITS}) WHERE age <= 60 AND said = 3 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY batch, event_id) = 1")
def k7_vendor_partnership(spark, d):
    return K.news_trigger(B.derived(spark, d, "events", HITS), _named(spark, d), B.AS_OF_EVENTS, "partnership", 60).select(*TRIGGER)


@query("SELECT id AS startup_id, b AS batch, '\"' || canonical_name || '\" (partnership OR integration) (' || q || ')' AS query FROM companies, (VALUES (0, '\"A\" OR \"B\"'), (1, '\"C\"')) v(b, q)", "companies")
def k7_vendor_batches(spark, d):
    return K.vendor_batches(B.companies(spark, d), ["A", "B", "C"], 2)


@query(
    f"SELECT company_id, 'press_feature' AS trigger_type, arg_min(source_url, event_id) AS source_url, 'moderate' AS signal_strength, count(*) || ' major press mentions in 14 days' AS trigger_label FROM ({_HITS}) WHERE age <= 14 AND event_id % 4 IN (0, 2) GROUP BY 1 HAVING count(*) >= 3"
)
def k8_press_feature(spark, d):
    """wired.com never counts, as leading w and . are stripped."""
    return K.press_feature(B.derived(spark, d, "events", HITS), B.AS_OF_EVENTS).select(*TRIGGER, "trigger_label")


TAXONOMY = {"Data Infrastructure": {"propensity": "High", "sub_verticals": {"Data pipelines": "High", "Warehouses": "Medium"}}, "Legal Tech": {"propensity": "Low", "sub_verticals": {"Contracts": "High"}}}
ANSWERS = (
    "c_custkey AS startup_id, CASE c_custkey % 7 WHEN 0 THEN '{\"vertical\": \"Data Infrastructure\", \"sub_vertical\": \"Warehouses\", \"confidence\": \"HIGH\"}' WHEN 1 THEN concat('```json', chr(10), '{\"vertical\": \"legal tech\", \"sub_vertical\": \"zzzz\"}', chr(10), '```') "
    "WHEN 2 THEN 'not json' WHEN 3 THEN '{\"vertical\": \"\"}' WHEN 4 THEN '{\"vertical\": \"Legal\", \"sub_vertical\": \"contracts law\", \"confidence\": \"sure\"}' WHEN 5 THEN '{\"vertical\": \"Nothing like it\"}' ELSE '{\"vertical\": \"DATA INFRASTRUCTURE\", \"sub_vertical\": \"Data\", \"confidence\": \"medium\"}' END AS raw"
)


@query(
    "SELECT c_custkey AS startup_id, v AS vertical, s AS sub_vertical, p AS cloud_propensity, c AS classification_confidence FROM customer JOIN (VALUES (0, 'Data Infrastructure', 'Warehouses', 'Medium', 'high'), (1, 'Legal Tech', NULL, 'Low', 'low'), (2, NULL, NULL, NULL, NULL), "
    "(3, 'Data Infrastructure', 'Data pipelines', 'High', 'low'), (4, 'Legal Tech', 'Contracts', 'High', 'low'), (5, NULL, NULL, NULL, 'low'), (6, 'Data Infrastructure', 'Data pipelines', 'High', 'medium')) t(k, v, s, p, c) ON c_custkey % 7 = k"
)
def k3_validate_classification(spark, d):
    return K.validate_classification(B.derived(spark, d, "customer", ANSWERS), TAXONOMY).drop("classification_source")


SAID = "c_custkey AS startup_id, CASE c_custkey % 3 WHEN 0 THEN concat('Sure: {\"recommended_angle\": \"angle ', CAST(c_custkey AS STRING), '\", \"key_signals\": [\"a\", \"b\"]} bye') WHEN 1 THEN '{\"recommended_angle\": \"x\"}' ELSE 'no' END AS raw"


@query("SELECT c_custkey AS startup_id, CASE c_custkey % 3 WHEN 0 THEN 'angle ' || c_custkey WHEN 1 THEN 'x' END AS recommended_angle, CASE c_custkey % 3 WHEN 0 THEN 'a,b' ELSE '' END AS key_signals FROM customer")
def k13_parse_outreach(spark, d):
    out = K.parse_outreach(B.derived(spark, d, "customer", SAID))
    return out.select("startup_id", "recommended_angle", F.array_join("key_signals", ",").alias("key_signals"))


QUEUE = "c_custkey AS startup_id, c_custkey % 3 = 0 AS re_attribution_requested"


@query("SELECT c_custkey AS startup_id, c_custkey % 2 = 0 AS fulfilled, c_custkey % 2 <> 0 AS still_requested FROM customer WHERE c_custkey % 3 = 0")
def k14_reattribution_queue(spark, d):
    overrides = B.derived(spark, d, "customer", QUEUE)
    queue = K.reattribution_queue(overrides)
    done = K.mark_fulfilled(overrides, queue.where("startup_id % 2 = 0")).select("startup_id", F.col("re_attribution_requested").alias("still_requested"))
    return queue.select("startup_id").join(done, "startup_id").select("startup_id", (~F.col("still_requested")).alias("fulfilled"), "still_requested")


@query(
    "SELECT startup_id, snapshot_date, CASE WHEN snapshot_date = max(snapshot_date) OVER (PARTITION BY startup_id) THEN coalesce(t, engagement_tier) ELSE engagement_tier END AS engagement_tier FROM snapshots LEFT JOIN (SELECT id, CAST(CASE WHEN fd IS NULL THEN 3 WHEN DATE '2001-08-01' - fd <= 90 AND cloud_propensity = 'High' "
    "AND (cloud_entrenchment IS NULL OR cloud_entrenchment IN ('WEAK', 'UNKNOWN')) THEN 1 WHEN DATE '2001-08-01' - fd <= 180 AND cloud_propensity IN ('High', 'Medium') THEN 2 ELSE 3 END AS INT) AS t FROM latest LEFT JOIN (SELECT startup_id AS sid, max(announcement_date) AS fd FROM funding GROUP BY 1) ON id = sid) ON id = startup_id",
    "snapshots", "latest",
)
def k2_patch_latest(spark, d):
    """Recalculated tiers put on each startup's newest snapshot only (S7 with latest_only)."""
    from ..operators import analytics as A

    snaps = B.snapshots(spark, d)
    latest = A.latest_attributions(B.startups(spark, d), B.funding(spark, d), snaps)
    patch = K.recalculate_tiers(latest, B.funding(spark, d), B.AS_OF_ORDERS).select("startup_id", "engagement_tier")
    return U.patch_snapshots(snaps, patch, latest_only=True).select("startup_id", "snapshot_date", "engagement_tier")
