"""Upserts, discovery passes, signal builders and the streaming ingest on small tables."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from provintel.operators import discovery as D
from provintel.operators import engagement as K
from provintel.operators import resolution as R
from provintel.operators import signals as G
from provintel.sources import upsert as U
from provintel.sources.tables import SCHEMAS, read_seed_csv
from provintel.streaming.articles import entries_of, joined_entries, start_ingest, store_batch, stored_entries, versions


def articles(spark, *rows):
    now = dt.datetime(2024, 1, 30)
    return spark.createDataFrame([(i, t, f"u{i}", now, None, None, s, 0, i) for i, (t, s) in enumerate(rows)], SCHEMAS["articles"])


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, n long")
    new = spark.createDataFrame([(2, None, 2), (3, "c", 2), (2, "x", 3)], "k long, v string, n long")
    assert sorted((r["k"], r["v"]) for r in U.upsert(old, new, ["k"], ["n"]).collect()) == [(1, "a"), (2, "x"), (3, "c")]
    merged = U.upsert_keep_nonnull(old, new.where("n = 2"), "k")
    assert sorted((r["k"], r["v"]) for r in merged.collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_dedup_titles_and_hints(spark):
    rows = [("C2i raises $15M Series A", "google_news"), ("C2i Semiconductors raises $15 million", "prnewswire"), ("Linear raises $35M now", "google_news"), ("AI funding slows", "google_news")]
    for order in (rows, rows[::-1]):
        kept = {r["title"] for r in D.dedup_hints(articles(spark, *order)).collect()}
        assert kept == {rows[1][0], rows[2][0], rows[3][0]}
    same = articles(spark, ("Harvey raises $100M!", "google_news"), ("Harvey raises 100M", "vcnewsdaily"))
    assert [r["source"] for r in D.dedup_titles(same).collect()] == ["vcnewsdaily"]
    assert D.dedup_titles(same.limit(0)).count() == 0


def test_extractions(spark):
    a = articles(spark, ("t", "s"), ("t2", "s"), ("t3", "s"))
    replies = [(0, '```json\n{"company_name": "Acme", "funding_amount_usd": 12.7}\n```'), (1, '{"not_funding": true}'), (2, '{"company_name": "TBD", "funding_amount_usd": 50}')]
    got = D.parse_extractions(spark.createDataFrame(replies, SCHEMAS["extractions"]), a).collect()
    assert [(r["company_name"], r["funding_amount_usd"], r["funding_round"]) for r in got] == [("Acme", 12, "Unknown")]


def test_subprocessor_signals(spark):
    rows = [(1, "Microsoft Corp", "AI provider and cloud provider"), (1, "OpenAI", "AI service provider"), (1, "Google Cloud", "")]
    df = spark.createDataFrame([(*r, None, i) for i, r in enumerate(rows)], "startup_id long, name string, purpose string, source_url string, ord int")
    got = {(r["provider_type"], r["provider_name"], float(r["confidence_weight"])) for r in G.subprocessors(df).collect()}
    assert ("ai", "OpenAI", 1.0) in got and ("cloud", "GCP", 0.6) in got
    assert ("cloud", "Azure", 1.0) in got and not any(t == "ai" and p != "OpenAI" for t, p, _ in got)


def test_ip_ranges_and_dns(spark):
    hosts = spark.createDataFrame([(1, "52.10.0.9"), (2, "8.8.8.8"), (3, "bad")], "startup_id long, ip string")
    nets = spark.createDataFrame([("AWS", "52.0.0.0/11", 0), ("GCP", "8.8.8.0/24", 1)], SCHEMAS["ip_ranges"])
    none = spark.createDataFrame([], "startup_id long")
    assert {(r["startup_id"], r["provider_name"]) for r in G.ip_ranges(hosts, nets, none).collect()} == {(1, "AWS"), (2, "GCP")}
    records = spark.createDataFrame([(1, "CNAME", "x.elb.amazonaws.com."), (2, "CNAME", "a.wixdns.net")], "startup_id long, rtype string, target string")
    assert [(r["startup_id"], r["provider_name"]) for r in G.dns_cnames(records).collect()] == [(1, "AWS")]


def test_priors(spark):
    companies = spark.createDataFrame([(1, ["GV", "Google"], ["Google Brain", "AWS"]), (2, ["Sequoia"], ["DeepMind", "Google Brain"])], "id long, lead_investors array<string>, founder_background array<string>")
    assert [(r["startup_id"], r["provider_name"]) for r in G.investor_priors(companies).collect()] == [(1, "GCP")]
    assert [(r["startup_id"], r["provider_name"]) for r in G.founder_priors(companies).collect()] == [(2, "GCP")]


def test_job_postings_read_from_html(spark):
    html = "<html><body><nav>GCP</nav><p>You will run our primary AWS stack.</p></body></html>"
    posts = spark.createDataFrame([(1, "u", "Software Engineer", html, 200, 0)], SCHEMAS["job_posts"])
    assert [(r["provider_name"], float(r["confidence_weight"])) for r in G.job_postings(posts).collect()] == [("AWS", 0.6)]


def test_llm_findings_floors(spark):
    raw = '[{"provider_type":"ai","provider_name":"OpenAI","confidence":59},{"provider_type":"cloud","provider_name":"AWS","confidence":30},{"provider_type":"ai","provider_name":"Nobody","confidence":99}]'
    df = spark.createDataFrame([(1, "4b", True, True, "Here: " + raw, None), (2, "4b", True, True, "[broken", None)], SCHEMAS["llm_findings"])
    assert [(r["startup_id"], r["provider_name"], float(r["confidence_weight"])) for r in G.llm_findings(df, ["OpenAI", "AWS"]).collect()] == [(1, "AWS", 0.3)]


def test_classification(spark):
    v, t = next(iter(K.rules.TAXONOMY.items()))
    sub = next(iter(t["sub_verticals"]))
    raws = [f'{{"vertical": "{v}", "sub_vertical": "{sub}", "confidence": "HIGH"}}', f'```json\n{{"vertical": "{v.lower()}", "sub_vertical": "zzzz"}}\n```', "not json", '{"vertical": ""}']
    got = K.validate_classification(spark.createDataFrame(list(enumerate(raws)), SCHEMAS["class_replies"])).orderBy("startup_id").collect()
    assert [(r["vertical"], r["sub_vertical"], r["classification_confidence"]) for r in got[:3]] == [(v, sub, "high"), (v, None, "low"), (None, None, None)]
    assert got[3]["vertical"] == v


def test_candidates_and_health(spark):
    companies = spark.createDataFrame([(1, "Code Metal", "codemetal.com"), (2, "Harvey", "harvey.ai")], "id long, canonical_name string, website string")
    got = [r["domain"] for r in R.domain_candidates(companies).orderBy("rank").collect()]
    assert got[0] == "codemetal.com" and {"code-metal.com", "code.ai"} <= set(got) and not any("harvey" in x for x in got)
    pages = spark.createDataFrame([("codemetal.com", None, "/", 200, "https://codemetal.com/", "code metal " * 50, None, None, 0)], SCHEMAS["pages"])
    assert {r["startup_id"]: r["reason"] for r in R.domain_health(companies, pages).collect()} == {1: "OK", 2: "no response"}


def test_seed_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("company_name,website,evidence_urls,investors,founder_background\nAcme,acme.ai,https://a|ftp://b,GV|M12,\n,x,,,\n")
    rows = read_seed_csv(spark, str(tmp_path / "s.csv")).collect()
    assert [(r["company_name"], r["evidence_urls"], r["investors"]) for r in rows] == [("Acme", ["https://a"], ["GV", "M12"])]


def story(i, title, day, source="google_news", url=None):
    return (i, title, url or f"u{i}", dt.datetime(2024, 1, day), None, None, source, 0, i)


def test_stream_of_batches(spark, tmp_path):
    """Titles over several batches, a url that comes again, a late row, an empty batch, a batch that is run again, one cut off before it was whole."""
    batches = [
        [story(1, "Harvey raises $1M!", 5), story(2, "Nothing here", 5)],
        [story(3, "Harvey raises 1M", 7, "vcnewsdaily"), story(4, "Acme raises 2M", 7, url="u1")],
        [],
        [story(5, "Harvey raises $1M", 20), story(6, "Zed raises 3M", 20), story(7, "Late raises 1M", 21)],
        [story(8, "Old raises 1M", 3), story(9, "Zed raises 3M", 22, "prnewswire"), story(10, "Late raises 1M", 25)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMAS["articles"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = spark.readStream.schema(SCHEMAS["articles"]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    start_ingest(stream, out, str(tmp_path / "cp")).awaitTermination(240)
    read = lambda: sorted((r["article_id"], r["first"].day, r["last"].day) for r in stored_entries(spark, out, SCHEMAS["articles"]).collect())
    want = [(3, 5, 7), (5, 20, 20), (7, 21, 21), (9, 20, 22), (10, 25, 25)]
    assert read() == want
    closed = {p.name for p in (tmp_path / "out" / "closed").iterdir()}
    last = versions(spark, out)[-1]
    assert len(versions(spark, out)) == 2 and f"batch={last}" in closed

    again = spark.createDataFrame(batches[4][1:], SCHEMAS["articles"])
    store_batch(again, last, out, SCHEMAS["articles"])
    assert read() == want
    (tmp_path / "out" / "open" / f"batch={last}" / "_SUCCESS").unlink()  # as if the job ended between both folders
    assert versions(spark, out)[-1] < last
    store_batch(again, last, out, SCHEMAS["articles"])
    assert read() == want
    assert stored_entries(spark, str(tmp_path / "nothing"), SCHEMAS["articles"]).collect() == []


def test_entries_join_in_any_order(spark):
    rng = random.Random(3)
    rows = [story(i, f"T{rng.randint(0, 3)} raises 1M", rng.randint(1, 28), rng.choice(["google_news", "vcnewsdaily"])) for i in range(60)]
    every = joined_entries(entries_of(spark.createDataFrame(rows, SCHEMAS["articles"])))
    want = sorted((r["key"], r["first"], r["last"], r["article_id"]) for r in every.collect())
    rng.shuffle(rows)
    held = None
    for k in range(0, 60, 20):
        part = entries_of(spark.createDataFrame(rows[k : k + 20], SCHEMAS["articles"]))
        held = joined_entries(part if held is None else held.unionByName(part))
    assert sorted((r["key"], r["first"], r["last"], r["article_id"]) for r in held.collect()) == want
