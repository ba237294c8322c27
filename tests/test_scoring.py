"""Scoring on hand-made signals: thresholds, ties, hybrids and guards."""

from decimal import Decimal

import pytest

from provintel.operators import scoring as S

SCHEMA = "startup_id long, provider_type string, provider_name string, signal_source string, evidence_text string, confidence_weight decimal(3,1), ord long"


def signals(spark, *rows, kind="cloud"):
    return spark.createDataFrame([(1, kind, p, src, None, Decimal(str(w)), i) for i, (p, src, w) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(
    ("rows", "multi", "primary", "confidence"),
    [
        ([("AWS", "dns_cname", 1.0)], False, "AWS", 0.5),
        ([("AWS", "dns_cname", 1.0), ("AWS", "job_posting", 0.6), ("AWS", "ip_asn", 0.3)], False, "AWS", 0.95),
        ([("AWS", "x", 1.0), ("GCP", "x", 1.0)], True, None, 1.0),
        ([("AWS", "x", 1.0), ("AWS", "x", 1.0), ("GCP", "x", 0.3)], False, "AWS", 0.87),
        ([("AWS", "x", 1.0), ("AWS", "x", 0.3), ("GCP", "x", 1.0)], False, "AWS", 0.57),
        ([("AWS", "x", 1.0), ("GCP", "x", 0.3), ("GCP", "x", 0.6)], True, None, 0.95),
        ([("AWS", "x", 1.0)] * 10, False, "AWS", 1.0),
        ([("AWS", "x", 0.3)] * 3 + [("GCP", "x", 0.6)], False, "AWS", 0.6),
        ([("On-Premises", "x", 0.6), ("AWS", "x", 1.0)], True, "Hybrid", 0.63),
    ],
)
def test_attribute(spark, rows, multi, primary, confidence):
    r = S.attribute(signals(spark, *rows)).first()
    assert (r["is_multi"], r["primary_provider"], r["confidence"], r["evidence_count"]) == (multi, primary, confidence, len(rows))


def test_ai_gap_is_wider(spark):
    assert S.attribute(signals(spark, ("OpenAI", "x", 1.0), ("Cohere", "x", 0.6), kind="ai")).first()["is_multi"]


def test_big_three_need_an_owned_source(spark):
    three = [("AWS", "tech_blog", 0.6), ("GCP", "tech_blog", 0.6), ("Azure", "tech_blog", 0.6)]
    assert S.attribute(signals(spark, *three)).count() == 0
    assert S.attribute(signals(spark, *three, ("AWS", "job_posting", 0.6))).count() == 1


def test_ties_rank_by_first_seen(spark):
    r = S.attribute(signals(spark, ("GCP", "x", 1.0), ("AWS", "x", 1.0))).first()
    assert [p["provider_name"] for p in r["providers"]] == ["GCP", "AWS"]


def test_no_signals_no_row(spark):
    assert S.attribute(signals(spark, ("AWS", "x", 1.0)).limit(0)).count() == 0


def test_hardware_prior_and_fallback(spark):
    companies = spark.createDataFrame([(1, "AI Chip Design"), (2, "Fintech")], "id long, industry string")
    weak = signals(spark, ("GCP", "ip_asn", 0.3))
    assert [r["startup_id"] for r in S.hardware_prior(weak, companies).collect()] == [1]
    need = {r["startup_id"]: (r["need_cloud"], r["need_ai"]) for r in S.fallback_needed(companies, S.attribute(weak)).collect()}
    assert need == {1: (True, True), 2: (True, True)}
