"""The whole run on small tables: every source of signals, guards and snapshots; how often signals are exchanged."""

import datetime as dt

from pyspark.sql import functions as F

from provintel.operators import attribution as R
from provintel.operators import scoring as S

AS_OF = "2024-01-31"
PAGE = "startup_id long, path string, url string, html string, status int, ord int, headers map<string,string>"


def tables(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    startups = t(
        [(1, "Nova", "nova.ai", "software", ["GV"], []), (2, "Chipworks", "chip.com", "AI Chip Design", [], []), (3, "Quiet", "quiet.io", None, None, None), (4, "Shop", "shop.com", "retail", [], ["ex-Google Brain"])],
        "id long, canonical_name string, website string, industry string, lead_investors array<string>, founder_background array<string>",
    )
    pages = t([
        (1, "/", "https://nova.ai/", "<p>Built natively on AWS.</p>", 200, 0, {"server": "x"}), (1, "/docs", "https://nova.ai/docs", "<p>We use Cohere and BigQuery.</p>", 200, 1, {}),
        (4, "/", "https://shop.com/", "<p>hello</p>", 200, 0, {"x-vercel-id": "1", "server": "Vercel"}), (3, "/", None, None, None, None, None),
    ], PAGE)
    return {
        "startups": startups, "pages": pages,
        "evidence_urls": t([(1, "https://nova.ai/docs", 0)], "startup_id long, url string, ord int"),
        "subprocessor_pages": t([(1, "https://nova.ai/sub", "<h1>Subprocessors</h1><table><tr><th>Name</th><th>Purpose</th></tr><tr><td>Amazon Web Services</td><td>hosting infrastructure</td></tr><tr><td>OpenAI</td><td>AI</td></tr></table>")], "startup_id long, url string, html string"),
        "provider_pages": t([("GCP", "https://cloud.google.com/c", "<div class='card'>How Nova grew</div>", 0)], "provider_name string, url string, html string, ord int"),
        "listings": t([(4, 0, "https://aws.amazon.com/marketplace/pp/1", "<p>Shop</p>", 200)], "startup_id long, rank int, url string, html string, status int"),
        "press_hits": t([(1, 1, "Nova and the cloud", "https://press/1")], "startup_id long, rank int, title string, url string"),
        "feed": t([(4, 1, "Shop picks Microsoft Azure", "https://news/1", dt.date(2024, 1, 2))], "startup_id long, rank int, title string, url string, published date"),
        "dns_records": t([(1, "CNAME", "d1.cloudfront.net."), (2, None, None)], "startup_id long, rtype string, target string"),
        "job_posts": t([(1, "https://jobs/1", "Backend Engineer", "<p>Our production environment runs on AWS.</p>", 200, 0), (2, None, None, None, 404, 1)], "startup_id long, url string, title string, html string, status int, ord int"),
        "llm_findings": t([(3, "4b", True, True, '[{"provider_type": "cloud", "provider_name": "GCP", "confidence": 90, "evidence": "e", "url": "u"}]'), (3, "4a", True, True, "broken")], "startup_id long, tier string, need_cloud boolean, need_ai boolean, raw string"),
        "classification": t([(1, "High")], "startup_id long, cloud_propensity string"),
        "funding": t([(1, dt.date(2024, 1, 1))], "startup_id long, announcement_date date"),
    }


def test_run_everything(spark):
    out = R.run_everything(tables(spark), AS_OF)
    sources = {(r["startup_id"], r["signal_source"], r["provider_name"]) for r in out["signals"].collect()}
    assert {
        (1, "evidence_url", "GCP"), (1, "evidence_url", "Cohere"), (1, "subprocessors_page", "AWS"), (1, "case_study", "GCP"), (4, "aws_marketplace", "AWS"), (4, "partnership_announcement", "Azure"),
        (1, "dns_cname", "AWS"), (1, "job_posting", "AWS"), (1, "investor_prior", "GCP"), (4, "founder_prior", "GCP"),
    } <= sources
    assert out["signals"].where("startup_id = 1 and signal_source = 'case_study'").count() == 1  # a card and a press title of one provider
    snaps = {r["startup_id"]: r for r in out["snapshots"].collect()}
    assert set(snaps) == {1, 2, 3, 4}
    assert snaps[1]["cloud_primary_provider"] == "AWS" and snaps[1]["engagement_tier"] in (1, 2)
    assert (snaps[2]["cloud_primary_provider"], snaps[2]["cloud_confidence"], snaps[2]["cloud_evidence_count"]) == ("On-Premises", 0.15, 0)
    assert (snaps[3]["cloud_primary_provider"], snaps[3]["ai_primary_provider"]) == ("GCP", None)
    assert (snaps[4]["cloud_primary_provider"], snaps[4]["cloud_evidence_count"]) == (None, 0)  # all of the big three, none by an owned source


def test_few_exchanges(spark):
    signals = spark.range(1000).selectExpr("id % 50 AS startup_id", "if(id % 2 = 0, 'cloud', 'ai') AS provider_type", "concat('p', id % 3) AS provider_name", "'x' AS signal_source", "CAST(NULL AS STRING) AS evidence_text", "CAST(0.6 AS DECIMAL(3,1)) AS confidence_weight", "id AS ord").repartition(4)
    startups = spark.range(50).selectExpr("id", "concat('n', id) AS canonical_name", "CAST(NULL AS STRING) AS industry")
    text = S.provider_entries(S.score_providers(signals), ["startup_id", "provider_type"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 2
    assert R.run_attribution(startups, signals).count() == 50
    merged = S.merged(F.col("a"), F.col("b"))
    r = S.provider_entries(S.score_providers(signals), ["startup_id", "provider_type"])
    both = r.withColumnRenamed("r", "a").withColumn("b", F.col("a")).withColumn("m", merged).where("startup_id = 0").first()
    assert [x["score"] for x in both["m"]] == [2 * x["score"] for x in both["a"]] and [x["n"] for x in both["m"]] == [2 * x["n"] for x in both["a"]]
