"""Typed readers of the input tables and the seed list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "articles": "article_id bigint, title string, url string, published timestamp, summary string, body string, source string, query_id int, ord bigint",
    "extractions": "article_id bigint, raw_json string",
    "pages": "domain string, url string, path string, status int, final_url string, html string, headers map<string,string>, page_kind string, ord int",
    "dns_records": "domain string, rtype string, target string",
    "host_ips": "domain string, ip string",
    "ip_ranges": "provider string, cidr string, prio int",
    "search_hits": "startup_id bigint, query_kind string, batch int, rank int, title string, url string, snippet string, date_str string",
    "job_posts": "startup_id bigint, url string, title string, html string, status int, ord int",
    "subprocessor_rows": "domain string, name string, purpose string, location string, source_url string",
    "llm_findings": "startup_id bigint, tier string, need_cloud boolean, need_ai boolean, raw string, citations array<string>",
    "class_replies": "startup_id bigint, raw string",
    "usage_events": "ts timestamp, source string",
}


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A table with its declared schema, so nothing is inferred and columns are pruned at the scan."""
    reader = spark.read.schema(SCHEMAS[name])
    return reader.format(fmt).option("header", "true").load(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_seed_csv(spark: SparkSession, path: str) -> DataFrame:
    """company, website, evidence_urls, investors, founder_background; header row or not, pipe-separated lists, http urls only."""
    names = ["company_name", "website", "evidence_urls", "investors", "founder_background"]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).option("quote", '"').option("escape", '"').csv(path)
    head = F.lower(F.trim("company_name")).isin("company", "company_name", "name")
    items = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.where(F.col("company_name").isNotNull() & (F.trim("company_name") != "") & ~head).select(
        F.trim("company_name").alias("company_name"),
        F.trim("website").alias("website"),
        F.filter(items(F.col("evidence_urls")), lambda u: F.startswith(u, F.lit("http"))).alias("evidence_urls"),
        items(F.col("investors")).alias("investors"),
        items(F.col("founder_background")).alias("founder_background"),
    )
