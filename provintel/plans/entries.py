"""Queries of the library's operators over tables derived from the given ones, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import discovery as D
from ..operators import engagement as K
from ..operators import scoring as S
from ..operators import signals as G
from ..session import remove_at_end, shared_dir
from ..sources import upsert as U
from ..sources.keyed import KeyedTable
from ..sources.pages import page_after, write_pages
from . import bindings as B
from .registry import ORACLES, QUERIES, Query, query

def _latest(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_attributions(B.startups(spark, d), B.funding(spark, d), B.snapshots(spark, d))


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- scoring


@query("SELECT startup_id, provider_type, provider_name, t / 10.0::DOUBLE AS score, n FROM scores", "scores")
def a1_score_providers(spark, d):
    return S.score_providers(B.signals(spark, d)).select("startup_id", "provider_type", "provider_name", F.col("score").cast("double").alias("score"), "n")


@query("SELECT * FROM attributed", "attributed")
def a2_attribute(spark, d):
    a = S.attribute(B.signals(spark, d))
    return a.select("startup_id", "provider_type", "is_multi", "primary_provider", F.array_join(F.transform("providers", lambda p: p["provider_name"]), " + ").alias("provider_names"), "confidence", "evidence_count")


@query("SELECT primary_provider, count(*) AS n FROM attributed WHERE primary_provider = 'Hybrid' GROUP BY 1", "attributed")
def a3_hybrid(spark, d):
    return S.attribute(B.signals(spark, d)).where("primary_provider = 'Hybrid'").groupBy("primary_provider").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN t >= 20 THEN 'STRONG' WHEN t >= 10 THEN 'MODERATE' WHEN t >= 3 THEN 'WEAK' ELSE 'UNKNOWN' END AS level, count(*) AS n FROM scores GROUP BY 1", "scores")
def a4_entrenchment(spark, d):
    return S.score_providers(B.signals(spark, d)).groupBy(S.entrenchment(F.col("score")).alias("level")).agg(F.count("*").alias("n"))


@query(
    "SELECT id AS startup_id, 'On-Premises' AS primary_provider, 0.15::DOUBLE AS confidence FROM startups LEFT JOIN (SELECT startup_id, max(tenths) AS best FROM signals WHERE provider_type = 'cloud' AND signal_source = 'tech_blog' GROUP BY 1) ON startup_id = id "
    "WHERE lower(industry) = 'machinery' AND coalesce(best, 0) < 6",
    "startups", "signals",
)
def a5_hardware_prior(spark, d):
    return S.hardware_prior(B.signals(spark, d).where("signal_source = 'tech_blog'"), B.startups(spark, d), ["machinery"]).select("startup_id", "primary_provider", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT provider_type, provider_name, CASE WHEN provider_type = 'cloud' THEN 'Cloud infrastructure' ELSE 'AI service provider' END AS role, count(*) AS n FROM scores GROUP BY ALL", "scores")
def a6_infer_role(spark, d):
    return S.score_providers(B.signals(spark, d)).groupBy("provider_type", "provider_name", "role").agg(F.count("*").alias("n"))


@query(
    "SELECT id AS startup_id, coalesce(c, 0) < 0.6 AS need_cloud, coalesce(a, 0) < 0.6 AS need_ai FROM startups LEFT JOIN (SELECT startup_id, max(confidence) FILTER (provider_type = 'cloud') AS c, "
    "max(confidence) FILTER (provider_type = 'ai') AS a FROM attributed GROUP BY 1) x ON id = x.startup_id WHERE coalesce(c, 0) < 0.6 OR coalesce(a, 0) < 0.6",
    "startups", "attributed",
)
def a7_fallback_needed(spark, d):
    return S.fallback_needed(B.startups(spark, d), S.attribute(B.signals(spark, d)))


# ---- analytics


@query("SELECT startup_id, max(funding_amount_usd) AS max_funding_usd FROM funding GROUP BY 1", "funding")
def a8_max_funding(spark, d):
    return A.max_funding(B.funding(spark, d))


@query("SELECT startup_id, funding_amount_usd, announcement_date FROM funding QUALIFY row_number() OVER (PARTITION BY startup_id ORDER BY funding_amount_usd DESC, announcement_date DESC) = 1", "funding")
def a9_best_round(spark, d):
    return A.best_round(B.funding(spark, d))


@query(
    "SELECT CASE WHEN coalesce(cloud_is_multi, false) AND cloud_primary_provider = 'Hybrid' THEN 'Hybrid' WHEN cloud_is_multi THEN 'Multi-Cloud' WHEN cloud_primary_provider IN ('AWS', 'GCP', 'Azure', 'On-Premises') THEN cloud_primary_provider "
    "WHEN cloud_primary_provider IS NOT NULL THEN 'Other' ELSE 'Unknown' END AS provider, count(*) AS startup_count, round(avg(cloud_confidence), 2) AS avg_confidence FROM latest GROUP BY 1",
    "latest",
)
def a10_cloud_distribution(spark, d):
    return A.cloud_distribution(_latest(spark, d))


@query("SELECT CASE WHEN coalesce(ai_is_multi, false) THEN 'Multi-Provider' ELSE coalesce(ai_primary_provider, 'Unknown') END AS provider, count(*) AS startup_count, round(avg(ai_confidence), 2) AS avg_confidence FROM latest GROUP BY 1", "latest")
def a11_ai_distribution(spark, d):
    return A.ai_distribution(_latest(spark, d))


@query("SELECT array_to_string(cloud_providers, ' + ') AS combination, count(*) AS startup_count, cloud_is_multi FROM latest WHERE cloud_providers IS NOT NULL GROUP BY cloud_providers, cloud_is_multi", "latest")
def a12_provider_combinations(spark, d):
    return A.provider_combinations(_latest(spark, d))


@query("SELECT provider_type, signal_source, signal_strength, count(*) AS signal_count, count(DISTINCT startup_id) AS startup_count, round(sum(tenths) / 10.0 / count(*), 2)::DOUBLE AS avg_weight FROM signals GROUP BY ALL", "signals")
def a13_signal_effectiveness(spark, d):
    return A.signal_effectiveness(B.signals(spark, d))


@query(
    "SELECT provider_type, signal_source, signal_strength, count(*) AS signal_count, true AS close, round(sum(tenths) / 10.0 / count(*), 2)::DOUBLE AS avg_weight FROM (SELECT *, DATE '2024-01-01' + CAST(startup_id % 28 AS INT) AS day FROM signals) WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2, 3",
    "signals",
)
def a13_merged_sketches(spark, d):
    """Days' sketches merged over a range; close: the estimate is within three standard errors of the exact count, or one startup."""
    rows = B.signals(spark, d).withColumn("signal_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("startup_id") % 28).cast("int")))
    merged = A.effectiveness_between(A.effectiveness_sketches(rows), "2024-01-05", "2024-01-20")
    keys = ["provider_type", "signal_source", "signal_strength"]
    exact = A.signal_effectiveness(rows.where("signal_date BETWEEN DATE'2024-01-05' AND DATE'2024-01-20'")).select(*keys, F.col("startup_count").alias("_exact"))
    close = F.abs(F.col("startup_count") - F.col("_exact")) <= F.greatest(F.lit(1.0), 3 * 0.0065 * F.col("_exact"))
    return merged.join(exact, keys).select(*keys, "signal_count", close.alias("close"), "avg_weight")


@query("SELECT vertical, count(*) AS startup_count FROM latest WHERE vertical IS NOT NULL GROUP BY 1", "latest")
def a14_vertical_distribution(spark, d):
    return A.vertical_distribution(_latest(spark, d))


@query(
    "SELECT (SELECT count(*) FROM latest) AS total_startups, (SELECT count(*) FROM latest WHERE engagement_tier = 1) AS tier1_count, (SELECT count(*) FROM triggers) AS trigger_count, p AS top_provider, n AS top_count FROM ("
    "SELECT CASE WHEN coalesce(cloud_is_multi, false) AND cloud_primary_provider = 'Hybrid' THEN 'Hybrid' WHEN cloud_is_multi THEN 'Multi-Cloud' WHEN cloud_primary_provider IN ('AWS', 'GCP', 'Azure', 'On-Premises') THEN cloud_primary_provider "
    "WHEN cloud_primary_provider IS NOT NULL THEN 'Other' ELSE 'Unknown' END AS p, count(*) AS n FROM latest GROUP BY 1) WHERE p <> 'Unknown' ORDER BY n DESC, p DESC LIMIT 1",
    "latest", "triggers",
)
def a15_summary(spark, d):
    return A.summary(_latest(spark, d), B.triggers(spark, d))


def _usage_events(spark, d):
    return _table(spark, d, "events").select("ts", F.col("event_type").alias("source"))


@query(
    "WITH u AS (SELECT CAST(ts AS DATE) AS usage_date, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT * FROM u WHERE usage_date > DATE '2024-01-31' - 30), "
    "s AS (SELECT source, sum(n) AS source_total, row_number() OVER (ORDER BY sum(n) DESC, source) AS source_rank FROM r GROUP BY 1), d AS (SELECT usage_date, sum(n) AS total FROM r GROUP BY 1) "
    "SELECT d.usage_date, s.source, s.source_rank, s.source_total::BIGINT AS source_total, d.total::BIGINT AS total, coalesce(r.n, 0)::BIGINT AS query_count, (SELECT sum(n) FROM r)::BIGINT AS grand_total, round(d.total::DOUBLE * 0.0003::DOUBLE, 4) AS cost_usd "
    "FROM d CROSS JOIN s LEFT JOIN r ON r.usage_date = d.usage_date AND r.source = s.source"
)
def a16_search_usage(spark, d):
    out = A.search_usage(A.usage_rollup(_usage_events(spark, d)), 30, B.AS_OF_EVENTS)
    return out.withColumn("source_rank", F.col("source_rank").cast("long"))


@query("SELECT CAST(ts AS DATE) AS usage_date, event_type AS source, count(*) AS query_count FROM events GROUP BY 1, 2")
def a17_usage_rollup(spark, d):
    return A.usage_rollup(_usage_events(spark, d))


@query(
    "WITH r AS (SELECT o_orderstatus AS run_id, o_custkey AS s, count(*) AS n, count(*) FILTER (o_totalprice > 5000) AS a, count(*) FILTER (o_totalprice <= 50000) AS e, max(CASE WHEN o_totalprice <= 25000 THEN 'too small' WHEN o_totalprice <= 50000 THEN 'small' END) AS err FROM orders GROUP BY 1, 2) "
    "SELECT run_id, sum(n)::BIGINT AS startups_discovered, sum(a)::BIGINT AS startups_attributed, sum(e)::BIGINT AS errors_count, CASE WHEN sum(e) = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status, "
    "coalesce(string_agg(s || '=' || err, ',' ORDER BY CAST(s AS VARCHAR)) FILTER (err IS NOT NULL), '') AS errors FROM r GROUP BY 1"
)
def a18_run_metrics(spark, d):
    runs = _table(spark, d, "orders").selectExpr(
        "o_orderstatus AS run_id", "o_custkey AS startup_id", "o_totalprice > 5000 AS attributed", "CASE WHEN o_totalprice <= 25000 THEN 'too small' WHEN o_totalprice <= 50000 THEN 'small' END AS error"
    )
    errors = F.transform(F.array_sort(F.map_entries("error_log")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return A.run_metrics(runs).withColumn("errors", F.array_join(errors, ",")).drop("error_log")


@query("SELECT engagement_tier, count(*) AS startup_count FROM latest GROUP BY 1", "latest")
def a19_tier_counts(spark, d):
    return A.tier_counts(_latest(spark, d))


@query("SELECT CASE WHEN vertical IN ('click') THEN vertical ELSE 'Other' END AS provider, count(*)::BIGINT AS startup_count, false AS is_last FROM latest WHERE vertical IS NOT NULL GROUP BY 1", "latest")
def a20_fold_other(spark, d):
    return A.fold_other(A.vertical_distribution(_latest(spark, d)).withColumnRenamed("vertical", "provider"), ["click"])


@query(
    "SELECT CASE WHEN r <= 2 THEN vertical ELSE 'Other' END AS vertical, sum(n)::BIGINT AS startup_count, coalesce(string_agg(CASE WHEN r > 2 THEN vertical END, ', ' ORDER BY vertical), '') AS folded FROM ("
    "SELECT vertical, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, vertical) AS r FROM latest WHERE vertical IS NOT NULL GROUP BY 1) GROUP BY 1",
    "latest",
)
def a20_top_n_other(spark, d):
    return A.top_n_other(A.vertical_distribution(_latest(spark, d)), "vertical", 2)


# ---- joins, windows, sets


@query("SELECT id, canonical_name, website, snapshot_date, cloud_primary_provider, engagement_tier FROM latest", "latest")
def j2_latest_attributions(spark, d):
    return _latest(spark, d).select("id", "canonical_name", "website", "snapshot_date", "cloud_primary_provider", "engagement_tier")


@query(
    "SELECT f.startup_id, f.funding_id, f.funding_amount_usd, f.announcement_date, s.canonical_name, l.cloud_primary_provider FROM funding f JOIN startups s ON s.id = f.startup_id LEFT JOIN latest l ON l.id = f.startup_id WHERE f.funding_amount_usd >= 10 "
    "ORDER BY f.announcement_date DESC, f.funding_amount_usd DESC, f.startup_id, f.funding_id LIMIT 50",
    "funding", "startups", "latest",
)
def j3_recent_funding(spark, d):
    return A.recent_funding(B.funding(spark, d), B.startups(spark, d), _latest(spark, d)).select("startup_id", "funding_id", "funding_amount_usd", "announcement_date", "canonical_name", "cloud_primary_provider")


@query(
    "SELECT b.startup_id, a.snapshot_date AS old_date, b.snapshot_date AS new_date, array_to_string(a.cloud_providers, ' + ') AS old_providers, array_to_string(b.cloud_providers, ' + ') AS new_providers "
    "FROM snapshots a JOIN snapshots b ON a.startup_id = b.startup_id AND b.snapshot_date > a.snapshot_date WHERE a.cloud_providers IS DISTINCT FROM b.cloud_providers",
    "snapshots",
)
def j4_attribution_changes(spark, d):
    return A.attribution_changes(B.snapshots(spark, d))


@query(
    "SELECT startup_id, old_date, snapshot_date AS new_date, array_to_string(old, ' + ') AS old_providers, array_to_string(cloud_providers, ' + ') AS new_providers FROM (SELECT *, lag(snapshot_date) OVER w AS old_date, lag(cloud_providers) OVER w AS old "
    "FROM snapshots WINDOW w AS (PARTITION BY startup_id ORDER BY snapshot_date)) WHERE old_date IS NOT NULL AND old IS DISTINCT FROM cloud_providers",
    "snapshots",
)
def j4_consecutive_changes(spark, d):
    return A.attribution_changes(B.snapshots(spark, d), "consecutive")


@query(
    "SELECT * FROM (WITH o AS (SELECT startup_id, snapshot_date, cloud_providers AS p, row_number() OVER w AS k, lag(snapshot_date) OVER w IS NOT NULL AND lag(cloud_providers) OVER w IS NOT DISTINCT FROM cloud_providers AS same FROM snapshots WINDOW w AS (PARTITION BY startup_id ORDER BY snapshot_date)), "
    "r AS (SELECT *, count(*) FILTER (NOT same) OVER (PARTITION BY startup_id ORDER BY k) AS run FROM o) "
    "SELECT a.startup_id, array_to_string(b.p, ' + ') AS old_providers, array_to_string(a.p, ' + ') AS new_providers, min(b.snapshot_date) AS old_first_date, max(b.snapshot_date) AS old_last_date, min(a.snapshot_date) AS new_first_date, max(a.snapshot_date) AS new_last_date, count(*) AS n_pairs "
    "FROM r a JOIN r b ON a.startup_id = b.startup_id AND a.snapshot_date > b.snapshot_date WHERE a.p IS DISTINCT FROM b.p GROUP BY a.startup_id, a.run, b.run, a.p, b.p)",
    "snapshots",
)
def j4_change_runs(spark, d):
    """All pairs of snapshots, counted by the runs they lie in."""
    return A.change_runs(B.snapshots(spark, d))


@query("SELECT f.funding_id, s.id AS startup_id FROM funding f LEFT JOIN startups s ON f.startup_id = s.id", "funding", "startups")
def j10_link_startup(spark, d):
    rows = B.funding(spark, d).selectExpr("funding_id", "concat('c', startup_id, '.com') AS website")
    return D.link_startup(rows, B.startups(spark, d)).select("funding_id", "startup_id")


@query("SELECT company_id, trigger_type, source_url, event_id FROM triggers a WHERE detected_date >= TIMESTAMP '2024-01-25' AND NOT EXISTS (SELECT 1 FROM triggers b WHERE b.detected_date < TIMESTAMP '2024-01-25' AND a.company_id = b.company_id AND a.trigger_type = b.trigger_type AND a.source_url IS NOT DISTINCT FROM b.source_url)", "triggers")
def j8_new_triggers(spark, d):
    t = B.triggers(spark, d)
    found, known = t.where("detected_date >= TIMESTAMP '2024-01-25'"), t.where("detected_date < TIMESTAMP '2024-01-25'")
    return K.new_triggers(found, known).select("company_id", "trigger_type", "source_url", "event_id")


@query("SELECT startup_id, snapshot_date, event_id FROM snapshots", "snapshots")
def s3_upsert(spark, d):
    rows = B.snapshot_events(spark, d)
    morning, keys, order = F.coalesce(F.hour("ts") < 12, F.lit(False)), ["startup_id", "snapshot_date"], ["ts", "event_id"]
    both = U.upsert(U.last_per_key(rows.where(morning), keys, order), rows.where(~morning), keys, order)
    return both.select("startup_id", "snapshot_date", "event_id")


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) END, c_mktsegment) AS industry FROM customer")
def s4_upsert_keep_nonnull(spark, d):
    base = _table(spark, d, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS industry")
    return U.upsert_keep_nonnull(base, base.selectExpr("id", "CASE WHEN id % 2 = 0 THEN upper(industry) END AS industry"), "id")


@query("SELECT startup_id, provider_name, count(*) AS n FROM signals WHERE startup_id % 10 <> 0 OR tenths = 10 GROUP BY ALL", "signals")
def s5_replace_signals(spark, d):
    s = B.signals(spark, d)
    gone = s.where("startup_id % 10 = 0")
    return U.replace_signals(s, gone.where("confidence_weight = 1.0"), gone.select("startup_id")).groupBy("startup_id", "provider_name").agg(F.count("*").alias("n"))


@query(
    "SELECT coalesce(c.startup_id, a.startup_id) AS startup_id, coalesce(c.is_multi, false) AS cloud_is_multi, c.primary_provider AS cloud_primary_provider, coalesce(c.evidence_count, 0)::BIGINT AS cloud_evidence_count, a.primary_provider AS ai_primary_provider, a.confidence AS ai_confidence "
    "FROM (SELECT * FROM attributed WHERE provider_type = 'cloud') c FULL JOIN (SELECT * FROM attributed WHERE provider_type = 'ai') a ON c.startup_id = a.startup_id",
    "attributed",
)
def s6_build_snapshot(spark, d):
    classes = B.startups(spark, d).selectExpr("id AS startup_id", "industry AS vertical")
    return U.build_snapshot(S.attribute(B.signals(spark, d)), classes, B.AS_OF_EVENTS).select("startup_id", "cloud_is_multi", "cloud_primary_provider", "cloud_evidence_count", "ai_primary_provider", "ai_confidence")


@query("SELECT startup_id, snapshot_date, CASE WHEN startup_id % 2 = 0 THEN 1 ELSE engagement_tier END AS engagement_tier FROM snapshots", "snapshots")
def s7_patch_snapshots(spark, d):
    snaps = B.snapshots(spark, d)
    patch = snaps.select("startup_id").distinct().where("startup_id % 2 = 0").withColumn("engagement_tier", F.lit(1))
    return U.patch_snapshots(snaps, patch).select("startup_id", "snapshot_date", "engagement_tier")


@query(
    "WITH e AS (SELECT *, coalesce(hour(ts) < 12, false) AS morning FROM (SELECT " + B.SNAPSHOTS + " FROM events)), l AS (SELECT startup_id, snapshot_date, morning, arg_max(engagement_tier, (ts, event_id)) AS tier FROM e GROUP BY 1, 2, 3) "
    "SELECT startup_id, snapshot_date, CASE WHEN n.tier IS NOT NULL THEN n.tier WHEN startup_id % 2 = 0 THEN 9 ELSE m.tier END AS engagement_tier FROM (SELECT * FROM l WHERE morning) m FULL JOIN (SELECT * FROM l WHERE NOT morning) n USING (startup_id, snapshot_date)"
)
def s7_keyed_snapshots(spark, d):
    """The morning's snapshots are stored, even startups patched, the afternoon's stored; the log is taken in."""
    rows = B.snapshot_events(spark, d).select("startup_id", "snapshot_date", "engagement_tier", "ts", "event_id", F.coalesce(F.hour("ts") < 12, F.lit(False)).alias("morning")).persist()
    stored = rows.select("startup_id", "snapshot_date", "engagement_tier")
    table = KeyedTable(spark, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", stored.schema, ["startup_id", "snapshot_date"], "startup_id", "date_format(snapshot_date, 'yyyy-MM')", buckets=8)
    table.upsert(rows.where("morning"), ["ts", "event_id"])
    table.patch(stored.select("startup_id").distinct().where("startup_id % 2 = 0").withColumn("engagement_tier", F.lit(9)))
    table.upsert(rows.where("not morning"), ["ts", "event_id"])
    table.compact()
    rows.unpersist()
    remove_at_end(spark, table.path)
    return table.read()


@query("SELECT startup_id, snapshot_date FROM snapshots QUALIFY row_number() OVER (PARTITION BY startup_id ORDER BY snapshot_date DESC) = 1", "snapshots")
def w1_newest(spark, d):
    return A.newest(B.snapshots(spark, d).select("startup_id", "snapshot_date", "event_id"), "startup_id", "snapshot_date").select("startup_id", "snapshot_date")


@query("SELECT startup_id, count(*) AS n, string_agg(CAST(snapshot_date AS VARCHAR), ',' ORDER BY snapshot_date DESC) AS dates FROM snapshots GROUP BY 1", "snapshots")
def w2_company_history(spark, d):
    h = A.company_history(B.snapshots(spark, d), ["snapshot_date", "engagement_tier"])
    return h.select("startup_id", F.size("history").cast("long").alias("n"), F.array_join(F.transform("history", lambda x: x["snapshot_date"].cast("string")), ",").alias("dates"))


@query("SELECT id, snapshot_date FROM latest ORDER BY snapshot_date DESC NULLS LAST, id LIMIT 20 OFFSET 40", "latest")
def w3_page(spark, d):
    return A.page_of(_latest(spark, d), 40, 20).select("id", "snapshot_date")


@query("SELECT id, snapshot_date FROM latest ORDER BY snapshot_date DESC NULLS LAST, id LIMIT 20 OFFSET 40", "latest")
def w3_keyset_page(spark, d):
    """The third page of twenty, each found from the last row of the one before."""
    latest = _latest(spark, d).select("id", "snapshot_date")
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    write_pages(latest, path, "snapshot_date", "id", 200)
    remove_at_end(spark, path)
    cursor = None
    for _ in range(2):
        last = page_after(spark, path, latest.schema, "snapshot_date", "id", 20, cursor).collect()[-1]
        cursor = (last["snapshot_date"], last["id"])
    return page_after(spark, path, latest.schema, "snapshot_date", "id", 20, cursor)



@query("SELECT l.id, engagement_timing, CAST(CASE engagement_timing WHEN 'Hot' THEN 0 WHEN 'Warm' THEN 1 ELSE 2 END AS INT) AS heat FROM latest l WHERE engagement_tier IN (1, 2)", "latest")
def w5_ready_to_engage(spark, d):
    dates = B.funding(spark, d).groupBy(F.col("startup_id").alias("id")).agg(F.max("announcement_date").alias("funding_date"))
    return A.ready_to_engage(_latest(spark, d).join(dates, "id", "left")).select("id", "engagement_timing", "heat")


@query("SELECT id, coalesce(max_funding_usd, -1) AS funding FROM startups LEFT JOIN (SELECT startup_id, max(funding_amount_usd) AS max_funding_usd FROM funding GROUP BY 1) ON id = startup_id", "startups", "funding")
def w6_by_funding(spark, d):
    m = A.max_funding(B.funding(spark, d)).withColumnRenamed("startup_id", "id")
    return B.startups(spark, d).join(m, "id", "left").select("id", F.coalesce("max_funding_usd", F.lit(-1)).alias("funding")).orderBy(F.desc("funding"), "id")


@query("SELECT usage_date, sum(n) OVER (ORDER BY usage_date ROWS 6 PRECEDING)::BIGINT AS last_rows FROM (SELECT CAST(ts AS DATE) AS usage_date, count(*) AS n FROM events GROUP BY 1)")
def w7_usage_last_rows(spark, d):
    days = A.usage_rollup(_usage_events(spark, d)).groupBy("usage_date").agg(F.sum("query_count").alias("query_count"))
    return A.usage_last_rows(days).select("usage_date", "last_rows")


# ---- engagement


@query(
    "SELECT id AS startup_id, CAST(CASE WHEN fd IS NULL THEN 3 WHEN DATE '2001-08-01' - fd <= 90 AND cloud_propensity = 'High' AND (cloud_entrenchment IS NULL OR cloud_entrenchment IN ('WEAK', 'UNKNOWN')) THEN 1 "
    "WHEN DATE '2001-08-01' - fd <= 180 AND cloud_propensity IN ('High', 'Medium') THEN 2 ELSE 3 END AS INT) AS engagement_tier FROM latest LEFT JOIN (SELECT startup_id AS sid, max(announcement_date) AS fd FROM funding GROUP BY 1) ON id = sid",
    "latest",
)
def k2_recalculate_tiers(spark, d):
    return K.recalculate_tiers(_latest(spark, d), B.funding(spark, d), B.AS_OF_ORDERS).select("startup_id", "engagement_tier")


@query(
    "SELECT id, engagement_tier, CASE WHEN engagement_tier = 1 AND id IN (SELECT company_id FROM triggers WHERE signal_strength = 'strong' AND DATE '2024-01-31' - CAST(detected_date AS DATE) <= 14) THEN 'Hot' WHEN engagement_tier IN (1, 2) THEN 'Warm' ELSE 'Watch' END AS engagement_timing FROM latest",
    "latest", "triggers",
)
def k10_engagement_timing(spark, d):
    return K.engagement_timing(_latest(spark, d), B.triggers(spark, d), B.AS_OF_EVENTS)


@query(
    "SELECT id, CAST(CASE WHEN cloud_propensity <> 'High' THEN engagement_tier WHEN s >= 2 THEN 1 WHEN s = 1 THEN least(engagement_tier, 2) ELSE engagement_tier END AS INT) AS engagement_tier, n AS active_trigger_count FROM latest "
    "JOIN (SELECT company_id, count(*) FILTER (signal_strength = 'strong') AS s, count(*) AS n FROM triggers GROUP BY 1) ON id = company_id WHERE engagement_tier IN (1, 2)",
    "latest", "triggers",
)
def k9_upgrade_tiers(spark, d):
    return K.upgrade_tiers(_latest(spark, d), B.triggers(spark, d))


@query(
    "SELECT id, engagement_tier FROM latest WHERE (engagement_tier = 1 AND (intelligence_generated_at IS NULL OR DATE '2024-02-08' - CAST(intelligence_generated_at AS DATE) >= 7)) OR (engagement_tier = 2 AND (intelligence_generated_at IS NULL OR DATE '2024-02-08' - CAST(intelligence_generated_at AS DATE) >= 14))",
    "latest",
)
def k11_outreach_due(spark, d):
    return K.outreach_due(_latest(spark, d), "2024-02-08").select("id", "engagement_tier")


@query(
    "SELECT id, coalesce(lines, 'None') AS trigger_lines FROM latest LEFT JOIN (SELECT company_id, string_agg('- ' || trigger_label || ' (' || signal_strength || ')', chr(10) ORDER BY detected_date, trigger_label, signal_strength) AS lines FROM triggers GROUP BY 1) ON id = company_id",
    "latest", "triggers",
)
def k12_outreach_context(spark, d):
    return K.outreach_context(_latest(spark, d), B.funding(spark, d), B.triggers(spark, d), B.AS_OF_ORDERS).select("id", "trigger_lines")


# ---- filters, text, discovery


@query("SELECT article_id FROM articles WHERE published >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY", "articles")
def p1_recent(spark, d):
    return D.recent(B.articles(spark, d), 7, B.AS_OF_ARTICLES).select("article_id")


@query("SELECT article_id FROM articles WHERE lower(title) LIKE '%and %' OR lower(title) LIKE '%est%'", "articles")
def p2_funding_filter(spark, d):
    return D.funding_news(B.articles(spark, d), ["and ", "est"]).select("article_id")


@query("SELECT article_id FROM articles WHERE (lower(title) LIKE '%and %' OR lower(title) LIKE '%est%' OR lower(coalesce(summary, '')) LIKE '%and %' OR lower(coalesce(summary, '')) LIKE '%est%') AND lower(title) NOT LIKE '%the%'", "articles")
def p3_funding_wire(spark, d):
    return D.funding_wire(B.articles(spark, d), ["and ", "est"], ["the"]).select("article_id")


@query("SELECT id FROM latest WHERE list_contains(cloud_providers, 'GCP') AND engagement_tier = 2 AND canonical_name ILIKE '%1%'", "latest")
def p12_filter_companies(spark, d):
    return A.filter_companies(_latest(spark, d), cloud_provider="GCP", engagement_tier=2, search="1").select("id")


@query("SELECT id FROM startups WHERE lower(industry) LIKE '%machin%' OR lower(industry) LIKE '%auto%'", "startups")
def p14_is_hardware(spark, d):
    return B.startups(spark, d).where(S.is_hardware(F.col("industry"), ["machin", "auto"])).select("id")


@query(
    "SELECT id, CASE WHEN cloud_primary_provider = 'Hybrid' THEN 'Hybrid (' || coalesce(array_to_string(cloud_providers, ', '), '') || ')' WHEN coalesce(cloud_is_multi, false) THEN 'Multi-Cloud (' || coalesce(array_to_string(cloud_providers, ', '), '') || ')' WHEN cloud_primary_provider IS NULL THEN 'Unknown' "
    "WHEN cloud_primary_provider IN ('AWS', 'GCP', 'Azure', 'On-Premises', 'Unknown') THEN cloud_primary_provider ELSE 'Other (' || cloud_primary_provider || ')' END AS label FROM latest",
    "latest",
)
def p17_provider_label(spark, d):
    names = F.coalesce("cloud_providers", F.array().cast("array<string>"))
    return _latest(spark, d).select("id", A.provider_label(F.col("cloud_primary_provider"), F.col("cloud_is_multi"), names, F.lit(False)).alias("label"))


WORDS = {"A": [" the ", " and "], "B": [" est ", " la "], "C": [" der ", " und "]}


@query(
    "SELECT doc_id, p AS provider_name, array_to_string(k, ',') AS keywords FROM (SELECT doc_id, p, list_filter(w, lambda x: contains(t, x)) AS k FROM (SELECT doc_id, ' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', ' ', 'g') || ' ' AS t FROM documents), "
    "(VALUES ('A', [' the ', ' and ']), ('B', [' est ', ' la ']), ('C', [' der ', ' und '])) v(p, w)) WHERE len(k) > 0"
)
def t3_keyword_scan(spark, d):
    return T.keyword_scan(_table(spark, d, "documents").select("doc_id", "text"), "text", WORDS).select("doc_id", "provider_name", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT article_id, trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))[:60] AS title_key FROM articles", "articles")
def t11_title_key(spark, d):
    return B.articles(spark, d).select("article_id", T.title_key(F.col("title")).alias("title_key"))


@query("SELECT doc_id, len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\n+|\\.\\s{2,}'), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n FROM (SELECT doc_id, regexp_replace(text, '\\.\\s+([A-Z])', chr(10) || '\\1', 'g') AS text FROM documents)")
def t4_split_sentences(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.size(T.split_sentences(F.col("text"))).cast("long").alias("n"))


@query("SELECT article_id FROM articles QUALIFY row_number() OVER (PARTITION BY url ORDER BY query_id, ord) = 1", "articles")
def d1_dedup_urls(spark, d):
    return D.dedup_urls(B.articles(spark, d)).select("article_id")


@query(
    "SELECT article_id FROM articles QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))[:60] "
    "ORDER BY CASE source WHEN 'vcnewsdaily' THEN 4 WHEN 'prnewswire' THEN 3 ELSE 1 END DESC, ord) = 1",
    "articles",
)
def d2_dedup_titles(spark, d):
    return D.dedup_titles(B.articles(spark, d)).select("article_id")


SAID = "CASE c_custkey % 6 WHEN 0 THEN concat('c', CAST(c_custkey AS STRING), 'i semi-conductors inc.') WHEN 1 THEN concat('ACME ', CAST(c_custkey AS STRING), ' LLC') WHEN 2 THEN concat('o''neil', CAST(c_custkey AS STRING), ' labs Ltd') WHEN 3 THEN concat(' north ', CAST(c_custkey AS STRING), 'th Corp. ') WHEN 4 THEN concat('Incline', CAST(c_custkey AS STRING)) ELSE concat('two Corporation LLC', CAST(c_custkey AS STRING)) END"


@query(
    "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'C' || c_custkey || 'I Semi-Conductors' WHEN 1 THEN 'Acme ' || c_custkey WHEN 2 THEN 'O''Neil' || c_custkey || ' Labs' WHEN 3 THEN 'North ' || c_custkey || 'Th Corp.' "
    "WHEN 4 THEN 'Incline' || c_custkey ELSE 'Two Corporation Llc' || c_custkey END AS name FROM customer"
)
def p9_company_name(spark, d):
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.normalize_company_name(F.expr(SAID)).alias("name"))


ROUND_SAID = "CASE o_orderkey % 8 WHEN 0 THEN 'seed' WHEN 1 THEN ' pre-seed ' WHEN 2 THEN 'Pre-Seed round' WHEN 3 THEN 'series b extension' WHEN 4 THEN 'Series A' WHEN 5 THEN concat('SERIES E-', CAST(o_orderkey % 3 AS STRING)) WHEN 6 THEN 'bridge' ELSE o_orderpriority END"


@query(
    "SELECT round, count(*) AS n FROM (SELECT CASE o_orderkey % 8 WHEN 0 THEN 'Seed' WHEN 1 THEN 'Pre-Seed' WHEN 2 THEN 'Seed' WHEN 3 THEN 'Series B' WHEN 4 THEN 'Series A' WHEN 5 THEN 'Series E' WHEN 6 THEN 'BRIDGE' ELSE upper(trim(o_orderpriority)) END AS round FROM orders) GROUP BY 1"
)
def p8_normalize_round(spark, d):
    return _table(spark, d, "orders").groupBy(T.normalize_round(F.expr(ROUND_SAID)).alias("round")).agg(F.count("*").alias("n"))


@query(
    "SELECT page_id, CASE WHEN regexp_matches(h, '^[a-z0-9-]+\\.[a-z]{2,}$') THEN h END AS domain FROM (SELECT page_id, lower(trim(split_part(regexp_replace(url, 'https?://', ''), '/', 1))) AS h FROM pages)"
)
def p7_clean_website(spark, d):
    return _table(spark, d, "pages").select("page_id", T.clean_website_startup(F.col("url")).alias("domain"))


@query("SELECT page_id, CASE WHEN len(p) >= 2 THEN p[-2] || '.' || p[-1] ELSE h END AS apex FROM (SELECT *, string_split(h, '.') AS p FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS h FROM pages))")
def p11_apex_domain(spark, d):
    return _table(spark, d, "pages").select("page_id", T.apex_domain(F.try_parse_url("url", F.lit("HOST"))).alias("apex"))


TERMS = [(" the ", "cloud", "A", 1.0), ("and", "cloud", "A", 0.5), (" la ", "cloud", "B", 1.0), ("en", "ai", "C", 0.6)]


@query(
    "SELECT id, provider_name, term, multiplier FROM (SELECT article_id AS id, ' ' || CASE WHEN article_id % 2 = 0 THEN trim(lower(title)) || ' acme' WHEN article_id % 3 = 0 THEN 'la la acme la; and the' ELSE lower(title) END || ' ' || lower(coalesce(summary, '')) || ' ' AS t FROM articles), "
    "(VALUES (0, ' the ', 'A', 1.0::DOUBLE), (1, 'and', 'A', 0.5::DOUBLE), (2, ' la ', 'B', 1.0::DOUBLE), (3, 'en', 'C', 0.6::DOUBLE)) v(o, term, provider_name, multiplier) "
    "WHERE contains(t, term) QUALIFY row_number() OVER (PARTITION BY id, provider_name ORDER BY o) = 1",
    "articles",
)
def t8_term_classify(spark, d):
    # Even articles name the company in the first clause only; every third of the others names another company in one clause.
    title = F.when(F.expr("article_id % 2 = 0"), F.concat(F.regexp_replace("title", ";", ","), F.lit(" Acme; and the la"))).when(F.expr("article_id % 3 = 0"), "la la acme la; and the").otherwise(F.regexp_replace("title", ";", ","))
    company = F.when(F.expr("article_id % 2 = 0"), "Acme").otherwise("zzzz")
    rows = B.articles(spark, d).select(F.col("article_id").alias("id"), title.alias("title"), "summary", company.alias("company"), F.lit(None).cast("string").alias("domain"))
    return T.term_classify(rows, TERMS).select("id", "provider_name", "term", "multiplier")


@query("SELECT c_custkey AS startup_id, CASE WHEN c_custkey % 2 = 0 THEN 'GCP' ELSE 'Azure' END AS provider_name FROM customer WHERE c_custkey % 5 <> 4")
def g16_investor_priors(spark, d):
    c = _table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 5 = 4 THEN array('Sequoia') WHEN c_custkey % 2 = 0 THEN array('Sequoia', 'GV', 'Google') ELSE array('M12') END AS lead_investors")
    return G.investor_priors(c).select("startup_id", "provider_name")


@query(
    "SELECT s_suppkey AS startup_id, CASE WHEN s_suppkey % 2 = 0 THEN 'AWS' ELSE 'GCP' END AS provider_name FROM supplier WHERE s_suppkey % 3 <> 0"
)
def g15_ip_ranges(spark, d):
    hosts = _table(spark, d, "supplier").selectExpr("s_suppkey AS startup_id", "CASE WHEN s_suppkey % 3 = 0 THEN '192.168.0.1' WHEN s_suppkey % 2 = 0 THEN concat('52.', s_suppkey % 30, '.0.9') ELSE concat('34.64.', s_suppkey % 200, '.1') END AS ip")
    nets = spark.createDataFrame([("AWS", "52.0.0.0/11", 0), ("GCP", "34.64.0.0/10", 1)], "provider string, cidr string, prio int")
    return G.ip_ranges(hosts, nets, hosts.select("startup_id").limit(0)).select("startup_id", "provider_name")


def queries() -> dict[str, Query]:
    from . import discovery_entries, engagement_entries, signal_entries, text_entries  # noqa: F401 - they register theirs

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
