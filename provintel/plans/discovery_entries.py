"""Queries of sources, discovery, domain resolution and the streaming ingest over rows that Spark derives from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import discovery as D
from ..operators import resolution as R
from ..session import materialize, remove, remove_at_end, shared_dir
from ..sources import tables as TB
from ..streaming.articles import start_ingest, stored_entries
from . import bindings as B
from .registry import query

PRECISE = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
SEED = (
    "c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE concat('Nova \"', CAST(c_custkey AS STRING), '\", Inc') END AS company_name, concat(' nova', CAST(c_custkey AS STRING), '.ai') AS website, "
    "CASE c_custkey % 3 WHEN 0 THEN 'https://a|ftp://b| http://c' WHEN 1 THEN NULL ELSE 'x' END AS evidence_urls, CASE WHEN c_custkey % 2 = 0 THEN 'GV| M12|' ELSE '' END AS investors, 'AWS' AS founder_background"
)


@query(
    "SELECT 'Nova \"' || c_custkey || '\", Inc' AS company_name, 'nova' || c_custkey || '.ai' AS website, CASE WHEN c_custkey % 3 = 0 THEN 'https://a,http://c' ELSE '' END AS evidence_urls, CASE WHEN c_custkey % 2 = 0 THEN 'GV,M12' ELSE '' END AS investors, 'AWS' AS founder_background FROM customer WHERE c_custkey % 9 <> 0"
)
def s1_seed_csv(spark, d):
    path = f"{shared_dir(spark)}/seed-{uuid.uuid4().hex}"
    B.derived(spark, d, "customer", SEED).drop("k").write.option("quote", '"').option("escape", '"').csv(path)
    rows = TB.read_seed_csv(spark, path)
    remove_at_end(spark, path)
    return rows.select("company_name", "website", *[F.array_join(c, ",").alias(c) for c in ("evidence_urls", "investors", "founder_background")])


@query("SELECT event_type AS source, count(*) AS n, max(ts) AS last FROM events GROUP BY 1")
def s2_read_json(spark, d):
    path = f"{shared_dir(spark)}/usage-{uuid.uuid4().hex}"
    spark.read.parquet(f"{d}/events.parquet").select("ts", F.col("event_type").alias("source"), "value").write.option("timestampFormat", PRECISE).option("timestampNTZFormat", PRECISE).json(path)
    remove_at_end(spark, path)
    return TB.read_table(spark, "usage_events", path, "json").groupBy("source").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


REPLIES = (
    "o_orderkey AS article_id, CASE o_orderkey % 7 WHEN 0 THEN '{\"not_funding\": true}' WHEN 1 THEN concat('```json', chr(10), '{\"company_name\": \"Acme ', CAST(o_orderkey AS STRING), '\", \"funding_amount_usd\": ', CAST(o_orderkey % 50 AS STRING), '.7, \"funding_round\": \"\"}', chr(10), '```') "
    "WHEN 2 THEN '{\"company_name\": \"TBD\", \"funding_amount_usd\": 50}' WHEN 3 THEN '{broken' WHEN 4 THEN '{\"company_name\": \"No amount\"}' ELSE concat('{\"company_name\": \"Beta ', CAST(o_orderkey AS STRING), '\", \"funding_amount_usd\": ', CAST(10 + o_orderkey % 3 * 600000 AS STRING), "
    "', \"funding_round\": \"series a\", \"announcement_date\": \"2000-02-03\", \"lead_investors\": [\"GV\"], \"website\": \"https://beta', CAST(o_orderkey AS STRING), '.com/\"}') END AS raw_json"
)
REPLIED = "o_orderkey AS article_id, CAST('t' AS STRING) AS title, concat('u', CAST(o_orderkey AS STRING)) AS url, o_orderdate AS published, CAST(NULL AS STRING) AS summary, repeat('word ', 500) AS body, 'prnewswire' AS source, o_orderkey AS ord"
_EVENTS = (
    "SELECT o_orderkey AS ord, 'Acme ' || o_orderkey AS company_name, CAST(o_orderkey % 50 AS BIGINT) AS amount, 'Unknown' AS funding_round, CAST(o_orderdate AS DATE) AS announcement_date, 0 AS investors, NULL AS website FROM orders WHERE o_orderkey % 7 = 1 AND o_orderkey % 50 >= 10 "
    "UNION ALL SELECT o_orderkey, 'Beta ' || o_orderkey, 10 + o_orderkey % 3 * 600000, 'series a', DATE '2000-02-03', 1, 'https://beta' || o_orderkey || '.com/' FROM orders WHERE o_orderkey % 7 > 4"
)


def _events(spark, d):
    return D.parse_extractions(B.derived(spark, d, "orders", REPLIES), B.derived(spark, d, "orders", REPLIED))


@query(f"SELECT *, 2000 AS body_chars FROM ({_EVENTS})")
def p4_parse_extractions(spark, d):
    e = _events(spark, d)
    return e.select("ord", "company_name", F.col("funding_amount_usd").alias("amount"), "funding_round", "announcement_date", F.size("lead_investors").alias("investors"), "website", F.length("raw_article_text").alias("body_chars"))


@query(f"SELECT ord, amount <= 1000000 AS valid, CASE WHEN amount <= 1000000 THEN CASE WHEN website IS NOT NULL THEN 'beta' || ord || '.com' END ELSE website END AS website, CASE WHEN amount > 1000000 THEN funding_round WHEN funding_round = 'Unknown' THEN 'UNKNOWN' ELSE 'Series A' END AS funding_round FROM ({_EVENTS})")
def p5_validate_events(spark, d):
    good, bad = D.validate_events(_events(spark, d))
    pick = lambda df, ok: df.select("ord", F.lit(ok).alias("valid"), "website", "funding_round")
    return pick(good, True).unionByName(pick(bad, False))


HINTED = (
    "c_custkey AS article_id, c_custkey AS ord, CASE c_custkey % 4 WHEN 0 THEN 'vcnewsdaily' WHEN 1 THEN 'prnewswire' ELSE 'google_news' END AS source, CASE c_custkey % 3 WHEN 0 THEN concat('Zeta', CAST(floor(c_custkey / 6) AS BIGINT), 'z raises $15M Series A') "
    "WHEN 1 THEN concat('Zeta', CAST(floor(c_custkey / 6) AS BIGINT), 'z Semiconductors raises $15 million') ELSE 'Nothing of note' END AS title"
)


@query(
    "WITH a AS (SELECT c_custkey AS article_id, floor(c_custkey / 6) AS family, c_custkey % 3 AS k, CASE c_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS prio FROM customer) "
    "SELECT article_id FROM a WHERE k = 2 UNION ALL SELECT article_id FROM (SELECT article_id FROM a WHERE k < 2 QUALIFY row_number() OVER (PARTITION BY family ORDER BY prio DESC, article_id) = 1)"
)
def d3_dedup_hints(spark, d):
    """Six headlines a family: the short name leads or follows the long one."""
    return D.dedup_hints(B.derived(spark, d, "customer", HINTED)).select("article_id")


NAMED = (
    "c_custkey AS ord, concat(CASE c_custkey % 3 WHEN 0 THEN 'Kappa' WHEN 1 THEN ' KAPPA' ELSE 'kappa' END, CAST(floor(c_custkey / 4) AS BIGINT), 'k', CASE WHEN c_custkey % 4 = 2 THEN ' technologies' ELSE '' END) AS company_name, CASE WHEN c_custkey % 4 = 1 THEN 'Seed' ELSE 'Unknown' END AS funding_round, "
    "CASE WHEN c_custkey % 4 IN (1, 2) THEN 'x.com' END AS website, CASE WHEN c_custkey % 4 = 3 THEN array('GV') END AS lead_investors, repeat('d', CAST(c_custkey % 7 AS INT)) AS description"
)


@query(
    "SELECT ord FROM (SELECT c_custkey AS ord, floor(c_custkey / 4) AS family, CASE WHEN c_custkey % 4 = 1 THEN 10 ELSE 0 END + CASE WHEN c_custkey % 4 IN (1, 2) THEN 5 ELSE 0 END + CASE WHEN c_custkey % 4 = 3 THEN 3 ELSE 0 END + c_custkey % 7 AS score FROM customer) "
    "QUALIFY row_number() OVER (PARTITION BY family ORDER BY score DESC, ord) = 1"
)
def d4_dedup_events(spark, d):
    return D.dedup_events(B.derived(spark, d, "customer", NAMED)).select("ord")


WEBBED = "o_orderkey AS ord, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('n', CAST(o_custkey AS STRING), '.com') END AS website"


@query(f"SELECT ord FROM {B.duck('orders', WEBBED)} WHERE website IS NULL UNION ALL SELECT min(ord) FROM {B.duck('orders', WEBBED)} WHERE website IS NOT NULL GROUP BY website")
def d5_dedup_websites(spark, d):
    return D.dedup_websites(B.derived(spark, d, "orders", WEBBED)).select("ord")


PAIRED = "c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN concat('Solo', CAST(c_custkey AS STRING), ' Inc') ELSE concat('Code Metal', CAST(c_custkey AS STRING), ' LLC') END AS canonical_name"


@query(
    "SELECT c_custkey AS startup_id, r AS rank, replace(x, '#', CAST(c_custkey AS VARCHAR)) AS domain FROM customer, (VALUES (0, 'codemetal#.com'), (1, 'codemetal#.ai'), (2, 'codemetal#.io'), (3, 'code-metal#.com'), (4, 'code-metal#.ai'), (5, 'code.com'), (6, 'code.ai')) v(r, x) WHERE c_custkey % 3 <> 0"
)
def d6_domain_candidates(spark, d):
    return R.domain_candidates(B.derived(spark, d, "customer", PAIRED)).select("startup_id", "rank", "domain")


LINKED = (
    "c_custkey AS startup_id, 'Code Metal' AS canonical_name, 'news.example' AS domain, concat('<a href=\"https://www.codemetal.ai/x\">site</a><a href=\"https://other', CAST(c_custkey AS STRING), '.com\">Code Metal home</a><a href=\"https://other', CAST(c_custkey AS STRING), '.com/b\">more</a>"
    "<a href=\"https://getcodemetal.com\">get</a><a href=\"https://twitter.com/cm\">tw</a><a href=\"/local\">l</a><a href=\"https://news.example/z\">own</a><a href=\"https://techcrunch.com\">tc</a>') AS html"
)


@query("SELECT c_custkey AS startup_id, replace(x, '#', CAST(c_custkey AS VARCHAR)) AS apex, a AS anchor_hits, p AS pattern_hits, f AS freq FROM customer, (VALUES ('codemetal.ai', 0, 1, 1), ('other#.com', 1, 0, 2), ('getcodemetal.com', 0, 1, 1)) v(x, a, p, f)")
def d7_score_links(spark, d):
    s = R.score_links(B.derived(spark, d, "customer", LINKED))
    return s.select("startup_id", "apex", *[F.col(c).cast("int").alias(c) for c in ("anchor_hits", "pattern_hits", "freq")])


def _resolved(spark, d):
    """Startups by id % 6: named in a text, in search hits, in links, by a candidate, by a reply, by nothing."""
    c = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS startup_id")
    at = lambda k: c.where(f"startup_id % 6 = {k}")
    texts = at(0).selectExpr("startup_id", "concat('see https://text', startup_id, '.ai') AS text")
    scores = "startup_id", "inline(array(struct(concat('weak', startup_id, '.com') AS apex, 0 AS anchor_hits, 0 AS pattern_hits, 1 AS freq), struct(concat('good', startup_id, '.com') AS apex, 0 AS anchor_hits, 1 AS pattern_hits, 1 AS freq)))"
    replies = c.where("startup_id % 6 IN (4, 5)").selectExpr("startup_id", "concat(' Reply', startup_id, CASE startup_id % 6 WHEN 4 THEN '.com' ELSE '.dead' END) AS domain")
    candidates = at(3).selectExpr("startup_id", "concat('cand', startup_id, '.com') AS domain", "0 AS rank").unionByName(at(4).selectExpr("startup_id", "concat('nopage', startup_id, '.com') AS domain", "0 AS rank"))
    homes = c.where("startup_id % 6 IN (1, 2, 3)").selectExpr("startup_id", "concat(CASE startup_id % 6 WHEN 3 THEN 'cand' ELSE 'good' END, startup_id, '.com') AS domain")
    dns = homes.select("domain").unionByName(at(4).selectExpr("explode(array(concat('reply', startup_id, '.com'), concat('nopage', startup_id, '.com'))) AS domain"))
    return R.resolve_domains(texts, at(1).selectExpr(*scores), at(2).selectExpr(*scores), candidates, replies, dns, homes)


@query(
    "SELECT c_custkey AS startup_id, CASE c_custkey % 6 WHEN 0 THEN 'text' || c_custkey || '.ai' WHEN 3 THEN 'cand' || c_custkey || '.com' WHEN 4 THEN 'reply' || c_custkey || '.com' ELSE 'good' || c_custkey || '.com' END AS domain, 1 + CAST(c_custkey % 6 AS INT) AS stage FROM customer WHERE c_custkey % 6 < 5"
)
def d8_resolve_domains(spark, d):
    return _resolved(spark, d)


@query("SELECT c_custkey AS startup_id, CASE WHEN c_custkey % 4 = 0 THEN 'own.com' WHEN c_custkey % 6 = 0 THEN 'text' || c_custkey || '.ai' WHEN c_custkey % 6 = 3 THEN 'cand' || c_custkey || '.com' WHEN c_custkey % 6 = 4 THEN 'reply' || c_custkey || '.com' WHEN c_custkey % 6 < 5 THEN 'good' || c_custkey || '.com' END AS website FROM customer")
def d9_resolve_missing(spark, d):
    events = B.derived(spark, d, "customer", "c_custkey AS startup_id, CASE WHEN c_custkey % 4 = 0 THEN 'own.com' END AS website")
    return R.resolve_missing(events, _resolved(spark, d)).select("startup_id", "website")


MOVED = "c_custkey AS startup_id, concat('d', CAST(c_custkey AS STRING), '.com') AS domain, '/' AS path, CASE c_custkey % 3 WHEN 0 THEN concat('https://www.new', CAST(c_custkey AS STRING), '.ai/') WHEN 1 THEN concat('https://app.d', CAST(c_custkey AS STRING), '.com/') ELSE NULL END AS final_url"


@query("SELECT c_custkey AS startup_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' || c_custkey || '.ai' ELSE 'd' || c_custkey || '.com' END AS domain FROM customer")
def j11_canonical_redirect(spark, d):
    pages = B.derived(spark, d, "customer", MOVED)
    return R.canonical_redirect(pages.select("startup_id", "domain"), pages.select("domain", "path", "final_url")).select("startup_id", "domain")


@query(
    "SELECT o_orderkey AS ord, c_custkey AS startup_id, CASE WHEN o_orderkey % 3 = 0 THEN 'given' ELSE c_mktsegment END AS industry, CASE WHEN o_orderkey % 2 = 0 THEN 'M12' ELSE 'GV' END AS investors, CASE WHEN o_custkey % 5 = 0 AND c_custkey IS NOT NULL THEN 'https://a,https://b' ELSE 'https://a' END AS urls FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
)
def j1_enrich_events(spark, d):
    sites = "concat('N', CAST({} AS STRING), '.com')"
    events = B.derived(spark, d, "orders", f"o_orderkey AS ord, {sites.format('o_custkey')} AS website, CASE WHEN o_orderkey % 3 = 0 THEN 'given' ELSE '' END AS industry, CASE WHEN o_orderkey % 2 = 0 THEN array('M12') END AS lead_investors, CAST(NULL AS array<string>) AS founder_background, array('https://a') AS evidence_urls")
    startups = B.derived(spark, d, "customer", f"c_custkey AS id, lower({sites.format('c_custkey')}) AS website, c_mktsegment AS industry, array('GV') AS lead_investors, array('AWS') AS founder_background")
    extra = B.derived(spark, d, "customer", "c_custkey AS startup_id, array('https://b', 'https://a') AS evidence_urls").where("startup_id % 5 = 0")
    out = D.enrich_events(events, startups, extra)
    return out.select("ord", "startup_id", "industry", F.array_join("lead_investors", ",").alias("investors"), F.array_join("evidence_urls", ",").alias("urls"))


@query("SELECT article_id, ord FROM articles ORDER BY ord LIMIT 100", "articles")
def w8_cap_articles(spark, d):
    return D.cap_articles(B.articles(spark, d), 100).select("article_id", "ord")


@query(
    "SELECT n.startup_id, n.snapshot_date, b.chars FROM (SELECT * FROM snapshots WHERE vertical IS NULL QUALIFY row_number() OVER (PARTITION BY startup_id ORDER BY snapshot_date DESC) = 1) n "
    "LEFT JOIN (SELECT article_id % 300 AS startup_id, max(length(body)) AS chars FROM articles GROUP BY 1) b ON b.startup_id = n.startup_id",
    "snapshots", "articles",
)
def w9_backfill_pick(spark, d):
    texts = B.articles(spark, d).selectExpr("article_id % 300 AS startup_id", "body")
    return D.backfill_pick(B.snapshots(spark, d), texts).select("startup_id", "snapshot_date", F.length("article_text").cast("long").alias("chars"))


# ---- the whole of discovery, in batch and as a stream

FEED = (
    "o_orderkey AS article_id, o_orderkey AS ord, concat('u', CAST(floor(o_orderkey / 2) AS BIGINT)) AS url, CAST(0 AS INT) AS query_id, CAST(date_add(DATE'2024-01-01', CAST(o_orderkey % 30 AS INT)) AS TIMESTAMP) AS published, CAST(NULL AS STRING) AS summary, 'b' AS body, "
    "CASE o_orderkey % 4 WHEN 0 THEN 'vcnewsdaily' WHEN 1 THEN 'prnewswire' ELSE 'google_news' END AS source, concat('Firm', CAST(floor(o_orderkey / 64) AS BIGINT), CASE o_orderkey % 5 WHEN 0 THEN 'f raises $20M now' WHEN 1 THEN 'f raises $20M now!' WHEN 2 THEN 'f closes IPO' ELSE 'f says hello' END) AS title"
)
_PUBLISHED = "DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT)"
_FEED = f"SELECT o_orderkey AS id, floor(o_orderkey / 64) AS firm, floor(o_orderkey / 2) AS url, {_PUBLISHED} AS day, o_orderkey % 4 AS src, CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS prio, o_orderkey % 5 AS said FROM orders"


@query(
    f"WITH a AS ({_FEED}), u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1), f AS (SELECT * FROM u WHERE day >= DATE '2024-01-31' - 10), "
    "p AS (SELECT * FROM f WHERE CASE src WHEN 0 THEN true WHEN 1 THEN said IN (0, 1) ELSE said IN (0, 1, 2) END), "
    "k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY firm, CASE WHEN said IN (0, 1) THEN 0 WHEN said = 2 THEN 2 ELSE 3 END ORDER BY prio DESC, id) = 1), "
    "g AS (SELECT * FROM k WHERE said > 2 UNION ALL SELECT * FROM (SELECT * FROM k WHERE said <= 2 QUALIFY row_number() OVER (PARTITION BY firm ORDER BY prio DESC, id) = 1)) "
    "SELECT id AS ord, 10 + id % 2000000 AS amount FROM g WHERE id % 3 <> 0 AND 10 + id % 2000000 <= 1000000"
)
def d9_run_discovery(spark, d):
    """Filters, all four de-duplications, replies, validation; every third reply is no funding and company names all differ."""
    articles = B.derived(spark, d, "orders", FEED)
    reply = "o_orderkey AS article_id, CASE WHEN o_orderkey % 3 = 0 THEN '{\"not_funding\": true}' ELSE concat('{\"company_name\": \"x', CAST(o_orderkey AS STRING), 'x\", \"funding_amount_usd\": ', CAST(10 + o_orderkey % 2000000 AS STRING), '}') END AS raw_json"
    events, _ = D.run_discovery(articles, B.derived(spark, d, "orders", reply), B.AS_OF_EVENTS, 10)
    return events.select("ord", F.col("funding_amount_usd").alias("amount"))


# Seven micro-batches, the fourth empty; in the later ones every fiftieth article is twelve days old, and its title may be one that an earlier batch has.
_BATCH = "CASE WHEN o_orderkey % 6 < 3 THEN o_orderkey % 6 ELSE o_orderkey % 6 + 1 END"
_DAYS = f"2 * ({_BATCH}) + CAST(floor(o_orderkey / 6) AS BIGINT) % 2 - CASE WHEN o_orderkey % 50 = 0 AND o_orderkey % 6 <> 0 THEN 12 ELSE 0 END"
_AGAIN = f"CAST(floor(o_orderkey / 64) AS BIGINT) % 3 = 0 AND {_BATCH} IN (1, 2, 4)"
BATCHED = FEED.replace("date_add(DATE'2024-01-01', CAST(o_orderkey % 30 AS INT))", f"date_add(DATE'2024-01-01', CAST({_DAYS} AS INT))").replace("END) AS title", f"END, CASE WHEN {_AGAIN} THEN ' again' ELSE '' END) AS title") + f", {_BATCH} AS batch"


@query(
    f"WITH a AS (SELECT o_orderkey AS id, floor(o_orderkey / 64) AS firm, floor(o_orderkey / 2) AS url, DATE '2024-01-01' + CAST({_DAYS} AS INT) AS day, o_orderkey % 4 AS src, CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS prio, o_orderkey % 5 AS said, {_AGAIN} AS again, {_BATCH} AS batch FROM orders), "
    "p AS (SELECT * FROM a WHERE CASE src WHEN 0 THEN true WHEN 1 THEN said IN (0, 1) ELSE said IN (0, 1, 2) END), "
    "w AS (SELECT b AS batch, (SELECT max(day) - 3 FROM p WHERE p.batch < b) AS mark FROM range(7) t(b)), "
    "f AS (SELECT p.* FROM p JOIN w USING (batch) WHERE mark IS NULL OR day > mark), u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch) = 1), "
    "k AS (SELECT *, CASE WHEN said IN (0, 1) THEN 0 WHEN said = 2 THEN 2 ELSE 3 END AS kind FROM u), s AS (SELECT *, coalesce(day > lag(day) OVER t + 3, false)::INT AS opens FROM k WINDOW t AS (PARTITION BY firm, kind, again ORDER BY day, id)), "
    "r AS (SELECT *, sum(opens) OVER (PARTITION BY firm, kind, again ORDER BY day, id) AS run FROM s) "
    "SELECT arg_max(id, prio * 1000000000000 - id) AS article_id, CAST(min(day) AS TIMESTAMP) AS first, CAST(max(day) AS TIMESTAMP) AS last FROM r GROUP BY firm, kind, again, run"
)
def st1_stream_articles(spark, d):
    """The feed as a stream of seven micro-batches: urls and titles come again in later ones, some rows are late, and one batch is empty."""
    feed = B.derived(spark, d, "orders", BATCHED).persist()
    columns = [c.split()[0] for c in TB.SCHEMAS["articles"].split(", ")]
    folder = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    for k in range(7):
        feed.where(f"batch = {k}").select(*columns).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(TB.SCHEMAS["articles"]).option("maxFilesPerTrigger", 1).parquet(folder)
    start_ingest(stream, f"{folder}/_stored", f"{folder}/_state").awaitTermination()
    feed.unpersist()
    found = materialize(stored_entries(spark, f"{folder}/_stored", TB.SCHEMAS["articles"]).select("article_id", "first", "last"), "entries")
    remove(spark, folder)
    return found
