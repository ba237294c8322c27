"""Text and domain expressions against their documented cases."""

import pytest
from pyspark.sql import functions as F

from provintel.functions import rules
from provintel.functions import text as T
from provintel.functions import sentences as SE


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "days"),
    [("3 hours ago", 0), ("2 days ago", 2), ("1 week ago", 7), ("Jan 15, 2024", 16), ("2024-01-15", 16), ("yesterday", 999), ("", 999), (None, 999)],
)
def test_result_age(spark, value, days):
    assert one(spark, lambda c: T.parse_result_age(c, F.lit("2024-01-31").cast("date")), value) == days


@pytest.mark.parametrize(
    ("value", "ok"),
    [("harvey.ai", True), ("x.com", False), ("netflix.com", False), ("harvey", False), ("app.harvey.ai", False), ("www.harvey.ai", True), ("company.co.uk", True)],
)
def test_valid_domain(spark, value, ok):
    assert one(spark, T.is_valid_domain, value) is ok


@pytest.mark.parametrize(
    ("value", "hint"),
    [("Seasats Scoops Up $20M Series A", "seasats"), ("Temporal Pulls In $300M", "temporal"), ("Code Metal raises $36M now", "code metal"), ("AI funding slows in Q4 2025", None)],
)
def test_company_hint(spark, value, hint):
    assert one(spark, T.company_hint, value) == hint


@pytest.mark.parametrize(("value", "name"), [("c2i inc.", "C2I"), ("acme LLC", "Acme"), ("harvey", "Harvey"), ("o'neil labs", "O'Neil Labs")])
def test_company_name(spark, value, name):
    assert one(spark, T.normalize_company_name, value) == name


@pytest.mark.parametrize(("value", "name"), [("seed", "Seed"), ("pre-seed", "Pre-Seed"), ("PRE-SEED ROUND", "Seed"), ("Series B extension", "Series B"), ("bridge", "BRIDGE")])
def test_round(spark, value, name):
    assert one(spark, T.normalize_round, value) == name


def test_extract_domain_and_title_key(spark):
    assert one(spark, T.extract_domain, "see https://linkedin.com and visit harvey.ai today") == "harvey.ai"
    assert one(spark, T.title_key, "Harvey raises   $100M!") == "harvey raises 100m"


def test_keyword_scan_never_matches_punctuated_keywords(spark):
    df = spark.createDataFrame([("we use gpt-4 and amazon web services",)], "t string")
    got = {r["provider_name"] for r in T.keyword_scan(df, "t", {**rules.CLOUD_KEYWORDS, **rules.AI_KEYWORDS}).collect()}
    assert got == {"AWS"}


def test_job_sentences(spark):
    def names(text, table=rules.CLOUD_KEYWORDS, ai=()):
        df = spark.createDataFrame([(text,)], "v string")
        return {h["provider_name"]: h["is_primary"] for h in SE.with_job_hits(df, "h", F.col("v"), table, ai).first()["h"]}

    assert names("AWS, Azure, or GCP experience preferred") == {}
    assert names("We migrated from Azure to AWS") == {"AWS": False, "Azure": False}
    assert names("AWS primarily, with Azure and GCP support for enterprise customers") == {"AWS": True}
    assert set(names("our internal AWS environment, plus Azure and GCP")) == {"AWS", "Azure", "GCP"}
    assert names("Experience with OpenAI API required", rules.AI_KEYWORDS, tuple(rules.AI_KEYWORDS)) == {}
    assert names("We call OpenAI.\nExperience with OpenAI API required", rules.AI_KEYWORDS, tuple(rules.AI_KEYWORDS)) == {"OpenAI": False}
    assert names(None) == {}


def test_site_sentences(spark):
    def hits(text):
        df = spark.createDataFrame([(text,)], "v string")
        return [h.asDict() for h in SE.with_site_hits(df, "h", F.col("v"), rules.CLOUD_KEYWORDS).first()["h"]]

    assert hits("Our platform is built natively on AWS today") == [{"provider_name": "AWS", "keywords": [" aws "], "is_ownership": True}]
    assert hits("We secure your AWS environment") == []
    assert hits("We like EC2 and AWS.\nIt runs on AWS.") == [{"provider_name": "AWS", "keywords": [" aws "], "is_ownership": True}]
