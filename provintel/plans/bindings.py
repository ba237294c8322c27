"""The library's tables, derived by Spark from the given ones, with the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF_EVENTS, AS_OF_ORDERS, AS_OF_ARTICLES = "2024-01-31", "2001-08-01", "2024-01-31"

# Each derivation is an expression list that both Spark SQL and DuckDB take.
STARTUPS = "c_custkey AS id, c_name AS canonical_name, concat('c', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 3 = 0 THEN '.ai' ELSE '.com' END) AS website, c_mktsegment AS industry"
FUNDING = (
    "o_orderkey AS funding_id, o_custkey AS startup_id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS funding_amount_usd, "
    "CAST(o_orderdate AS DATE) AS announcement_date, o_orderpriority AS funding_round, o_orderstatus AS source_name"
)
SIGNALS = (
    "o_custkey AS startup_id, CASE WHEN l_partkey % 2 = 0 THEN 'cloud' ELSE 'ai' END AS provider_type, "
    "CASE WHEN l_partkey % 2 = 0 THEN CASE l_suppkey % 5 WHEN 0 THEN 'AWS' WHEN 1 THEN 'GCP' WHEN 2 THEN 'Azure' WHEN 3 THEN 'On-Premises' ELSE 'Vultr' END "
    "ELSE CASE l_suppkey % 4 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Anthropic' WHEN 2 THEN 'Cohere' ELSE 'Mistral' END END AS provider_name, "
    "CASE WHEN l_returnflag = 'R' THEN 'dns_cname' WHEN l_returnflag = 'A' THEN 'http_headers' WHEN l_quantity < 3 THEN 'job_posting' ELSE 'tech_blog' END AS signal_source, "
    "CASE l_linenumber % 3 WHEN 0 THEN 'STRONG' WHEN 1 THEN 'MEDIUM' ELSE 'WEAK' END AS signal_strength, "
    "CASE l_linenumber % 3 WHEN 0 THEN 10 WHEN 1 THEN 6 ELSE 3 END AS tenths"
)
SNAPSHOTS = (
    "user_id AS startup_id, CAST(ts AS DATE) AS snapshot_date, event_id, ts, "
    "CASE event_id % 6 WHEN 0 THEN 'AWS' WHEN 1 THEN 'GCP' WHEN 2 THEN 'Azure' WHEN 3 THEN 'On-Premises' WHEN 4 THEN 'Vercel' ELSE NULL END AS base_provider, "
    "event_id % 7 = 0 AS cloud_is_multi, CAST(event_id % 101 AS DOUBLE) / 100 AS cloud_confidence, "
    "CASE event_id % 3 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Anthropic' ELSE NULL END AS ai_primary_provider, event_id % 5 = 0 AS ai_is_multi, "
    "CAST(event_id % 97 AS DOUBLE) / 100 AS ai_confidence, CASE event_id % 5 WHEN 4 THEN NULL ELSE event_type END AS vertical, "
    "CASE event_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS cloud_propensity, "
    "CASE event_id % 4 WHEN 0 THEN 'WEAK' WHEN 1 THEN 'STRONG' WHEN 2 THEN 'UNKNOWN' ELSE NULL END AS cloud_entrenchment, "
    "CAST(1 + event_id % 3 AS INT) AS engagement_tier, CASE event_id % 3 WHEN 0 THEN 'Hot' WHEN 1 THEN 'Warm' ELSE 'Watch' END AS engagement_timing, "
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS intelligence_generated_at"
)
TRIGGERS = (
    "user_id AS company_id, event_type AS trigger_type, concat('Trigger ', event_type) AS trigger_label, "
    "CASE event_id % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'weak' END AS signal_strength, "
    "CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('https://news.example/', CAST(event_id % 50 AS STRING)) END AS source_url, ts AS detected_date, event_id"
)
ARTICLES = (
    "doc_id AS article_id, CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, 1, instr(text, chr(10)) - 1) ELSE text END AS title, "
    "CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, instr(text, chr(10)) + 1) END AS summary, concat('https://', source, '.example/', CAST(doc_id % 700 AS STRING)) AS url, "
    "text AS body, CASE WHEN doc_id % 4 = 0 THEN 'vcnewsdaily' WHEN doc_id % 4 = 1 THEN 'prnewswire' ELSE 'google_news' END AS source, CAST(doc_id % 3 AS INT) AS query_id, doc_id AS ord"
)

COMPANIES = (
    "c_custkey AS id, CASE c_custkey % 50 WHEN 0 THEN 'Anthropic' WHEN 1 THEN 'Runway' WHEN 2 THEN 'Vultr' WHEN 3 THEN 'Cohere' ELSE concat('Nova', CAST(c_custkey AS STRING), ' Labs') END AS canonical_name, "
    "concat('nova', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 3 = 0 THEN '.ai' ELSE '.com' END) AS website, c_mktsegment AS industry"
)

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derive(df: DataFrame, exprs: str) -> DataFrame:
    plain = exprs.replace("{", "{{").replace("}", "}}")
    return df.sparkSession.sql(f"SELECT {plain} FROM {{source}}", source=df)


def startups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(_read(spark, sf_dir, "customer"), STARTUPS)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Startups with names of which some are in the rule tables."""
    return _derive(_read(spark, sf_dir, "customer"), COMPANIES)


def derived(spark: SparkSession, sf_dir: str, table: str, exprs: str) -> DataFrame:
    """A given table under expressions that DuckDB takes too (see duck())."""
    return _derive(_read(spark, sf_dir, table), exprs)


def duck(table: str, exprs: str) -> str:
    return f"(SELECT {_duck(exprs)} FROM {table})"


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(_read(spark, sf_dir, "orders"), FUNDING)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").dropDuplicates(["o_orderkey"]), _eq())
    return _derive(joined, SIGNALS).selectExpr(
        "startup_id", "provider_type", "provider_name", "signal_source", "signal_strength", "CAST(NULL AS STRING) AS evidence_text", "CAST(NULL AS STRING) AS evidence_url",
        "CAST(tenths / 10.0 AS DECIMAL(3,1)) AS confidence_weight", "CAST(0 AS BIGINT) AS ord",
    )


def _eq():
    from pyspark.sql import functions as F

    return F.col("l_orderkey") == F.col("o_orderkey")


def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _derive(_read(spark, sf_dir, "events"), SNAPSHOTS)
    return base.selectExpr(
        "*", "CASE WHEN cloud_is_multi AND event_id % 2 = 0 THEN 'Hybrid' ELSE base_provider END AS cloud_primary_provider",
        "CASE event_id % 4 WHEN 0 THEN array('AWS') WHEN 1 THEN array('GCP', 'AWS') WHEN 2 THEN array('AWS', 'GCP') ELSE NULL END AS cloud_providers",
    ).drop("base_provider")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per startup and day: the last event of the day wins."""
    from ..sources.upsert import last_per_key

    return last_per_key(snapshot_events(spark, sf_dir), ["startup_id", "snapshot_date"], ["ts", "event_id"])


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(_read(spark, sf_dir, "events"), TRIGGERS)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return _derive(_read(spark, sf_dir, "documents"), ARTICLES).withColumn("published", F.expr("CAST(date_add(DATE'2024-01-01', CAST(article_id % 30 AS INT)) AS TIMESTAMP)"))


def _duck(exprs: str) -> str:
    return exprs.replace("AS STRING)", "AS VARCHAR)")


SQL = {
    "startups": f"SELECT {_duck(STARTUPS)} FROM customer",
    "companies": f"SELECT {_duck(COMPANIES)} FROM customer",
    "funding": f"SELECT {_duck(FUNDING)} FROM orders",
    "signals": f"SELECT {_duck(SIGNALS)} FROM lineitem JOIN (SELECT DISTINCT ON (o_orderkey) o_orderkey, o_custkey FROM orders) o ON l_orderkey = o_orderkey",
    "snapshots": (
        f"SELECT * EXCLUDE (base_provider), CASE WHEN cloud_is_multi AND event_id % 2 = 0 THEN 'Hybrid' ELSE base_provider END AS cloud_primary_provider, "
        "CASE event_id % 4 WHEN 0 THEN ['AWS'] WHEN 1 THEN ['GCP', 'AWS'] WHEN 2 THEN ['AWS', 'GCP'] ELSE NULL END AS cloud_providers "
        f"FROM (SELECT {_duck(SNAPSHOTS)} FROM events) QUALIFY row_number() OVER (PARTITION BY startup_id, snapshot_date ORDER BY ts DESC, event_id DESC) = 1"
    ),
    "latest": (
        "SELECT s.*, n.* EXCLUDE (startup_id) FROM startups s LEFT JOIN (SELECT startup_id AS fid, max(funding_amount_usd) AS mf FROM funding GROUP BY 1) f ON s.id = f.fid "
        "LEFT JOIN (SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY startup_id ORDER BY snapshot_date DESC) = 1) n ON s.id = n.startup_id WHERE mf IS NULL OR mf >= 10"
    ),
    "triggers": f"SELECT {_duck(TRIGGERS)} FROM events",
    "articles": f"SELECT {_duck(ARTICLES)}, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS TIMESTAMP) AS published FROM documents",
    "scores": "SELECT startup_id, provider_type, provider_name, sum(tenths) AS t, count(*) AS n, max(CASE WHEN signal_source IN ('dns', 'ip_asn', 'job_posting', 'subprocessors') THEN 1 ELSE 0 END) AS owned FROM signals GROUP BY ALL",
    "attributed": (
        "SELECT startup_id, provider_type, CASE WHEN k = 1 THEN false ELSE top - second < gap OR hybrid END AS is_multi, "
        "CASE WHEN hybrid THEN 'Hybrid' WHEN k = 1 OR top - second >= gap THEN names[1] END AS primary_provider, array_to_string(names, ' + ') AS provider_names, "
        "least(CASE WHEN k = 1 THEN (top * 5 * 2 + 1) // 2 * 1.0 / 100 WHEN top - second < gap THEN ((total * 10 * 2 + k) // (2 * k)) / 100.0 ELSE ((top * 100 * 2 + total) // (2 * total)) / 100.0 END, 1.0)::DOUBLE AS confidence, evidence_count "
        "FROM (SELECT *, CASE WHEN provider_type = 'ai' THEN 5 ELSE 3 END AS gap, provider_type = 'cloud' AND k > 1 AND list_contains(names, 'On-Premises') AS hybrid "
        "FROM (SELECT startup_id, provider_type, list(provider_name ORDER BY t DESC, provider_name) AS names, max(t)::BIGINT AS top, coalesce(list(t ORDER BY t DESC)[2], 0)::BIGINT AS second, "
        "sum(t)::BIGINT AS total, sum(n)::BIGINT AS evidence_count, count(*) AS k, count(*) FILTER (provider_name IN ('AWS', 'GCP', 'Azure')) AS big, coalesce(max(owned) FILTER (provider_name IN ('AWS', 'GCP', 'Azure')), 0) AS big_owned "
        "FROM scores GROUP BY 1, 2) WHERE NOT (provider_type = 'cloud' AND big = 3 AND big_owned = 0))"
    ),
}
NEEDS = {"latest": ["startups", "funding", "snapshots"], "scores": ["signals"], "attributed": ["signals", "scores"]}


def with_tables(sql: str, *names: str) -> str:
    """The SQL with the named derived tables in front."""
    order = list(dict.fromkeys(x for n in names for x in [*NEEDS.get(n, []), n]))
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + sql
