"""Signal builders: each returns rows of ``signals``; the first hit per provider wins inside a builder.

``ord`` is builder number x 10^6 plus the rank in the builder, so that a union keeps the builders' order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, rules, sentences
from ..session import broadcast_if_small, materialize
from ..functions.text import age_to_weight, homepage_investors, is_competitor_url, keyword_hits, keyword_scan, pub_date_weight, strength_of, term_classify, valid_title

STEP = 1_000_000
ALLOWED_WEIGHTS = (1.0, 0.6, 0.3)


def signal_rows(df: DataFrame, builder: int, source: str, weight: Column, kind: Column, rank: Column, evidence: Column, url: Column | None = None, per: list[str] | None = None) -> DataFrame:
    """Typed signals of df (startup_id, provider_name, ...), the first by rank per provider (and per, if given)."""
    key = ["startup_id", "provider_type", "provider_name", *(per or [])]
    rows = df.withColumn("provider_type", kind).withColumn("_rank", rank)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_rank"))).where("_n = 1")
    return first.select(
        "startup_id", "provider_type", "provider_name", F.lit(source).alias("signal_source") if source else F.col("signal_source"), strength_of(weight).alias("signal_strength"),
        evidence.alias("evidence_text"), (url if url is not None else F.lit(None).cast("string")).alias("evidence_url"), weight.cast("decimal(3,1)").alias("confidence_weight"), (F.lit(builder * STEP) + F.col("_rank")).cast("long").alias("ord"),
    )


def _ordered_table(df: DataFrame, pairs: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(pairs)], f"map_ord int, {schema}"))


def override_attributions(startups: DataFrame, overrides: dict = rules.PARTNERSHIP_OVERRIDES) -> DataFrame:
    """Fixed attributions of named companies: confidence 1, entries STRONG; a list of providers is multi."""
    rows = [(c, side, list(v[side]) if isinstance(v[side], list) else [v[side]], v["source_url"]) for c, v in overrides.items() for side in ("cloud", "ai") if v[side]]
    table = F.broadcast(startups.sparkSession.createDataFrame(rows, "canonical_name string, provider_type string, names array<string>, source_url string"))
    return startups.join(table, "canonical_name").select(
        F.col("id").alias("startup_id"), "provider_type", (F.size("names") > 1).alias("is_multi"), F.when(F.size("names") == 1, F.col("names")[0]).alias("primary_provider"), "names", F.lit(1.0).alias("confidence"), F.lit("partnership_override").alias("signal_source"), "source_url",
    )


def not_applicable(startups: DataFrame, table: dict = rules.NOT_APPLICABLE) -> DataFrame:
    """(startup_id, provider_type, note) of sides that don't apply."""
    rows = [(c, side, v[side]) for c, v in table.items() for side in ("cloud", "ai") if v[side]]
    small = F.broadcast(startups.sparkSession.createDataFrame(rows, "canonical_name string, provider_type string, note string"))
    return startups.join(small, "canonical_name").select(F.col("id").alias("startup_id"), "provider_type", "note")


def scan_both(df: DataFrame, text_col: str, cloud: dict = rules.CLOUD_KEYWORDS, ai: dict = rules.AI_KEYWORDS) -> DataFrame:
    """keyword_scan of cloud and AI tables, with provider_type; df is read once."""
    tagged = lambda side, table: F.transform(keyword_hits(F.col(text_col), table), lambda h: F.struct(F.lit(side).alias("provider_type"), h["provider_name"].alias("provider_name"), h["keywords"].alias("keywords")))
    return df.withColumn("_hit", F.explode(F.concat(tagged("cloud", cloud), tagged("ai", ai)))).select(*df.columns, "_hit.*")


def page_texts(pages: DataFrame, cloud: dict = rules.CLOUD_KEYWORDS, ai: dict = rules.AI_KEYWORDS) -> DataFrame:
    """Pages that answered 200, with text and facts of its sentences (cloud) instead of html: one Python pass for all builders that read texts.

    Pages but the first one of a site have no text unless their source can name a provider.
    """
    words = [k for table in (cloud, ai) for ks in table.values() for k in ks]
    wanted = html.may_name(F.col("html"), words)
    if "path" in pages.columns:
        wanted = wanted | F.coalesce(F.col("path") == "/", F.lit(False))
    read = html.page_view(F.when(wanted, F.col("html")), ("text", "facts"), tables={"cloud": cloud})
    return pages.where("status = 200").withColumn("_v", read).select(*[c for c in pages.columns if c != "html"], "_v.text", "_v.facts")


def _texts(pages: DataFrame, **tables) -> DataFrame:
    """pages with text and facts, read before or now."""
    return pages if "text" in pages.columns else page_texts(pages, **tables)


def evidence_pages(urls: DataFrame, pages: DataFrame, source: str = "evidence_url", builder: int = 3, weight: float = 1.0, **tables) -> DataFrame:
    """Keyword hits of given pages (startup_id, url, ord) that answered 200."""
    wanted = pages.join(broadcast_if_small(urls.select("url").distinct()), "url", "left_semi")
    got = urls.join(_texts(wanted, **tables).where("status = 200").select("url", "text"), "url")  # texts cross the join, html does not
    hits = scan_both(got, "text", **tables)
    return signal_rows(hits, builder, source, F.lit(weight), F.col("provider_type"), F.col("ord"), F.concat(F.lit("Keywords: "), F.array_join("keywords", ", ")), F.col("url"))


def _first_in_map(name: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.contains(name, F.lit(k)), p) for k, p in table.items()])


def subprocessors(rows: DataFrame, cloud: dict = rules.SUBPROCESSOR_CLOUD, ai: dict = rules.SUBPROCESSOR_AI) -> DataFrame:
    """Signals of vendor rows (startup_id, name, purpose, source_url, ord): infrastructure purpose makes a cloud signal, which rules out an AI one of the same name."""
    name, purpose = F.lower("name"), F.lower(F.coalesce("purpose", F.lit("")))
    infra = F.exists(F.array(*map(F.lit, rules.INFRASTRUCTURE_PURPOSES)), lambda w: F.contains(purpose, w))
    for_ai = F.exists(F.array(*map(F.lit, rules.AI_PURPOSES)), lambda w: F.contains(purpose, w))
    pure_ai = _first_in_map(name, {k: v for k, v in ai.items() if k not in cloud}).isNotNull()
    so_far = Window.partitionBy("startup_id", name).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    f = rows.withColumn("_cloud", _first_in_map(name, cloud)).withColumn("_ai", _first_in_map(name, ai)).withColumn("_is_cloud", F.col("_cloud").isNotNull() & infra)
    f = f.withColumn("_seen", F.max("_is_cloud").over(so_far))
    signals = F.array(
        F.when(F.col("_is_cloud"), F.struct(F.lit("cloud").alias("t"), F.col("_cloud").alias("p"), F.lit(1.0).alias("w"))),
        F.when(~F.col("_seen") & F.col("_ai").isNotNull() & (for_ai | pure_ai), F.struct(F.lit("ai").alias("t"), F.col("_ai").alias("p"), F.lit(1.0).alias("w"))),
        F.when(~F.col("_seen") & F.col("_cloud").isNotNull() & (purpose == ""), F.struct(F.lit("cloud").alias("t"), F.col("_cloud").alias("p"), F.lit(0.6).alias("w"))),
    )
    found = f.select("startup_id", "name", "purpose", "source_url", "ord", F.explode(F.filter(signals, lambda s: s.isNotNull())).alias("s")).withColumn("provider_name", F.col("s.p"))
    evidence = F.concat(F.col("name"), F.lit(" listed as subprocessor with purpose: '"), F.coalesce("purpose", F.lit("")), F.lit("'"))
    return signal_rows(found, 4, "subprocessors_page", F.col("s.w"), F.col("s.t"), F.col("ord"), evidence, F.col("source_url"), ["name", "ord"])


def case_studies(pages: DataFrame, startups: DataFrame) -> DataFrame:
    """Companies named in result cards of provider pages (provider_name, html, url, ord): names and pages meet by a word, then the cards' text decides.

    Each name is looked for once, and companies of one name share what is found.
    """
    text = materialize(pages.select("provider_name", "url", "ord", F.lower(html.card_text(F.col("html"), F.col("provider_name"))).alias("text")), "case-texts")
    words = text.select("provider_name", "url", "ord", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+"))).alias("_word"))
    known = startups.select(F.col("id").alias("startup_id"), F.lower("canonical_name").alias("_name"))
    names = known.select("_name").distinct().withColumn("_word", F.get(F.filter(F.split("_name", r"[^\p{L}\p{N}]+"), lambda w: w != ""), F.lit(0)))
    met = words.join(names, "_word").select("provider_name", "url", "ord", "_name").distinct()
    hits = met.join(text, ["provider_name", "url", "ord"]).where(F.contains(F.col("text"), F.col("_name")))
    first = hits.groupBy("_name", "provider_name").agg(F.min(F.struct("ord", "url")).alias("_h")).select("_name", "provider_name", "_h.ord", "_h.url").join(known, "_name")
    return signal_rows(first, 5, "case_study", F.lit(1.0), F.lit("cloud"), F.col("ord"), F.concat(F.lit("Named on "), F.col("url")), F.col("url"))


def partnerships(news: DataFrame, startups: DataFrame, as_of: str, terms: list[tuple] = rules.PROVIDER_TERMS, most: int = 100) -> DataFrame:
    """News hits (startup_id, stage, batch, rank, title, snippet, url, date_str): valid titles, provider terms, age times multiplier; products that aren't a weight are dropped."""
    capped = news.withColumn("_n", F.row_number().over(Window.partitionBy("startup_id", "stage", "batch").orderBy("rank"))).where(F.col("_n") <= most)
    named = capped.join(startups.select(F.col("id").alias("startup_id"), F.col("canonical_name").alias("company"), F.col("website").alias("domain")), "startup_id")
    valid = named.where(valid_title(F.col("title"), F.col("company"), F.col("domain"))).withColumn("summary", F.col("snippet")).withColumn("id", F.xxhash64("startup_id", "stage", "batch", "rank", "url"))
    hits = term_classify(valid, terms).withColumn("_w", F.round(age_to_weight(F.col("date_str"), F.lit(as_of).cast("date")) * F.col("multiplier"), 2)).where(F.col("_w").isin(*ALLOWED_WEIGHTS))
    rank = F.col("stage") * 100_000 + F.col("batch") * 1_000 + F.col("rank")
    return signal_rows(hits, 6, "partnership_announcement", F.col("_w"), F.col("provider_type"), rank, F.col("title"), F.col("url"))


def marketplace_listings(listings: DataFrame, startups: DataFrame, case_signals: DataFrame, most: int = 5) -> DataFrame:
    """First of the first listing pages (startup_id, rank, url, html, status) that holds the name, for startups without an AWS case study."""
    told = case_signals.where("provider_name = 'AWS'").select("startup_id").distinct()
    own = listings.join(told, "startup_id", "left_anti").join(startups.select(F.col("id").alias("startup_id"), F.lower("canonical_name").alias("_name")), "startup_id")
    place = F.row_number().over(Window.partitionBy("startup_id").orderBy("rank"))
    hits = own.where(F.contains(F.col("url"), F.lit("aws.amazon.com/marketplace"))).withColumn("_place", place).where((F.col("_place") <= most) & (F.col("status") == 200) & F.contains(F.lower("html"), F.col("_name")))
    return signal_rows(hits.withColumn("provider_name", F.lit("AWS")), 5, "aws_marketplace", F.lit(1.0), F.lit("cloud"), F.lit(500_000) + F.col("rank"), F.lit("Listed on AWS Marketplace"), F.col("url"))


def press_titles(hits: DataFrame, startups: DataFrame, most: int = 20) -> DataFrame:
    """First of the first press-corner hits (startup_id, rank, title, url) whose title holds the name or website."""
    named = hits.join(startups.select(F.col("id").alias("startup_id"), F.lower("canonical_name").alias("_name"), F.lower("website").alias("_site")), "startup_id")
    place = F.row_number().over(Window.partitionBy("startup_id").orderBy("rank"))
    title = F.lower("title")
    found = named.withColumn("_place", place).where((F.col("_place") <= most) & (F.contains(title, F.col("_name")) | F.coalesce(F.contains(title, F.nullif("_site", F.lit(""))), F.lit(False))))
    return signal_rows(found.withColumn("provider_name", F.lit("GCP")), 5, "case_study", F.lit(1.0), F.lit("cloud"), F.lit(700_000) + F.col("rank"), F.concat(F.lit("Press: "), F.substring("title", 1, 120)), F.col("url"))


def partnership_sources(
    startups: DataFrame, as_of: str, feed: DataFrame | None = None, batches: DataFrame | None = None, provider_hits: DataFrame | None = None, articles: DataFrame | None = None,
    terms: list[tuple] = rules.PROVIDER_TERMS, cloud: dict = rules.CLOUD_KEYWORDS, ai: dict = rules.AI_KEYWORDS,
) -> DataFrame:
    """Partnership news of four sources; the first hit per provider over all of them wins, so later sources only fill what is missing.

    feed (startup_id, rank, title, url, published): titles, first 100, by the age of publication. batches (startup_id,
    batch, rank, title, snippet, url, date_str): first 10 a batch. provider_hits (startup_id, provider_name, rank, title,
    snippet, url, date_str): first 5 a provider, the company in title or snippet. articles (startup_id, rank, title, url,
    date_str, body): first 10, keywords in the first 4,000 characters. Titles must be valid; a product of weight and
    multiplier that isn't a weight drops its row alone.
    """
    day = F.lit(as_of).cast("date")
    known = startups.select(F.col("id").alias("startup_id"), F.col("canonical_name").alias("company"), F.col("website").alias("domain"))
    first = lambda df, keys, n: df.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).where(F.col("_p") <= n)
    named = lambda df: df.join(known, "startup_id").where(valid_title(F.col("title"), F.col("company"), F.col("domain")))
    none = F.lit(None).cast("string")
    parts = []

    def told(df: DataFrame, weight: Column, stage: int, batch: Column = F.lit(0)) -> None:
        parts.append(df.select("startup_id", "provider_type", "provider_name", "title", "url", F.round(weight, 2).alias("_w"), (F.lit(stage * 200_000) + batch * 1_000 + F.col("rank")).alias("_at")))

    if feed is not None:
        rows = named(first(feed, ["startup_id"], 100)).withColumn("summary", none).withColumn("id", F.xxhash64("startup_id", "rank", "url"))
        told(term_classify(rows, terms), pub_date_weight(F.col("published"), day) * F.col("multiplier"), 0)
    if batches is not None:
        rows = named(first(batches, ["startup_id", "batch"], 10)).withColumn("summary", F.col("snippet")).withColumn("id", F.xxhash64("startup_id", "batch", "rank", "url"))
        told(term_classify(rows, terms), age_to_weight(F.col("date_str"), day) * F.col("multiplier"), 1, F.col("batch"))
    if provider_hits is not None:
        text = F.lower(F.concat_ws(" ", "title", "snippet"))
        stem = F.split(F.lower(F.coalesce("domain", F.lit(""))), r"\.")[0]
        rows = named(first(provider_hits, ["startup_id", "provider_name"], 5)).where(F.contains(text, F.lower("company")) | ((stem != "") & F.contains(text, stem)))
        told(rows.withColumn("provider_type", F.lit("cloud")), age_to_weight(F.col("date_str"), day), 2)
    if articles is not None:
        rows = named(first(articles, ["startup_id"], 10)).withColumn("excerpt", F.substring("body", 1, 4000))
        told(scan_both(rows, "excerpt", cloud, ai), age_to_weight(F.col("date_str"), day), 3)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return signal_rows(every.where(F.col("_w").isin(*ALLOWED_WEIGHTS)), 6, "partnership_announcement", F.col("_w"), F.col("provider_type"), F.col("_at"), F.col("title"), F.col("url"))


def hosted_startups(records: DataFrame, hosted: list[str] = rules.HOSTED_CNAMES) -> DataFrame:
    return records.where(F.exists(F.array(*map(F.lit, hosted)), lambda h: F.contains(F.lower("target"), h))).select("startup_id").distinct()


def dns_cnames(records: DataFrame, table: dict = rules.CNAME_PROVIDERS, hosted: list[str] = rules.HOSTED_CNAMES) -> DataFrame:
    """CNAME records (startup_id, target): hosted platforms skipped, one provider per record by map order."""
    target = F.regexp_replace(F.lower("target"), r"\.$", "")
    own = records.where("rtype = 'CNAME'").select("startup_id", target.alias("cname")).distinct().where(~F.exists(F.array(*map(F.lit, hosted)), lambda h: F.contains(F.col("cname"), h)))
    found = own.withColumn("provider_name", _first_in_map(F.col("cname"), table)).where(F.col("provider_name").isNotNull())
    order = F.row_number().over(Window.partitionBy("startup_id").orderBy("cname"))
    return signal_rows(found.withColumn("_o", order), 7, "dns_cname", F.lit(1.0), F.lit("cloud"), F.col("_o"), F.concat(F.lit("CNAME points to "), F.col("cname")), per=["cname"])


def marketplaces(pages: DataFrame, patterns: dict = rules.MARKETPLACE_PATTERNS) -> DataFrame:
    """Marketplace links in a startup's pages (startup_id, url, html, ord)."""
    hits = F.array(*[F.when(F.exists(F.array(*map(F.lit, ps)), lambda p: F.contains(F.lower("html"), p)), F.lit(name)) for name, ps in patterns.items()])
    found = pages.select("startup_id", "url", "ord", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("provider_name"))
    return signal_rows(found, 8, "cloud_marketplace", F.lit(0.6), F.lit("cloud"), F.col("ord"), F.lit("Marketplace listing linked"), F.col("url"))


def _lower_headers(headers: Column) -> Column:
    """Lower-case names and values; of names that differ by case the first counts."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.lower(F.get(F.filter(entries, lambda e: F.lower(e["key"]) == n), F.lit(0))["value"])))


def http_headers(pages: DataFrame, hosted: DataFrame, table: dict = rules.HEADER_PROVIDERS) -> DataFrame:
    """Header presence per provider and the Server header's rule; both may fire. Hosted startups are left out."""
    own = pages.join(hosted, "startup_id", "left_anti").withColumn("_h", _lower_headers(F.col("headers")))
    server = F.coalesce(F.get(F.array(F.try_element_at("_h", F.lit("server"))), F.lit(0)), F.lit(""))
    present = [F.when(F.arrays_overlap(F.map_keys("_h"), F.array(*map(F.lit, keys))), F.struct(F.lit(p).alias("p"), F.lit(f"{p} headers").alias("e"))) for p, keys in table.items()]
    by_server = F.when(F.contains(server, F.lit("amazons3")) | F.contains(server, F.lit("cloudfront")), "AWS").when(F.contains(server, F.lit("google")) | F.contains(server, F.lit("gws")), "GCP")
    hits = F.array(*present, F.when(by_server.isNotNull(), F.struct(by_server.alias("p"), F.concat(F.lit("Server header: "), server).alias("e"))))
    found = own.select("startup_id", "url", F.posexplode(hits).alias("ord", "hit")).where(F.col("hit").isNotNull()).withColumn("provider_name", F.col("hit.p"))
    return signal_rows(found, 9, "http_headers", F.lit(0.6), F.lit("cloud"), F.col("ord"), F.col("hit.e"), F.col("url"), ["ord"])


def job_postings(posts: DataFrame, cloud: dict = rules.CLOUD_KEYWORDS, ai: dict = rules.AI_KEYWORDS, most: int = 8) -> DataFrame:
    """Engineering titles first, first posts only; reading stops after the post where both sides have a hit."""
    role = F.lower(F.coalesce("title", F.lit(""))).rlike("|".join(rules.ROLE_KEYWORDS))
    place = F.row_number().over(Window.partitionBy("startup_id").orderBy(F.when(role, 0).otherwise(1), "ord"))
    some = posts.where("status = 200").withColumn("place", place).where(F.col("place") <= most)
    facts = html.page_view(F.col("html"), ("job_facts",), tables={"cloud": cloud, "ai": ai})["job_facts"]
    read = some.withColumn("facts", facts).select("startup_id", "url", "place", "facts")
    of = lambda side: F.filter("facts", lambda f: f["side"] == side)
    scanned = sentences.judged_jobs(sentences.judged_jobs(read, "cloud_hits", of("cloud")), "ai_hits", of("ai"), tuple(ai))
    before = Window.partitionBy("startup_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    had = lambda c: F.coalesce(F.max(F.size(c) > 0).over(before), F.lit(False))
    open_ = scanned.withColumn("_done", had("cloud_hits") & had("ai_hits")).where("not _done")
    tagged = lambda side: F.transform(f"{side}_hits", lambda h: F.struct(F.lit(side).alias("side"), h["provider_name"].alias("provider_name"), h["keywords"].alias("keywords"), h["is_primary"].alias("is_primary")))
    found = open_.select("startup_id", "url", "place", F.explode(F.concat(tagged("cloud"), tagged("ai"))).alias("h")).withColumn("provider_name", F.col("h.provider_name"))
    return signal_rows(found, 10, "job_posting", F.when(F.col("h.is_primary"), 1.0).otherwise(0.6), F.col("h.side"), F.col("place"), F.concat(F.lit("Keywords: "), F.array_join("h.keywords", ", ")), F.col("url"))


def site_pages(pages: DataFrame, groups: dict[str, tuple[str, float]] = rules.PATH_GROUPS, cloud: dict = rules.CLOUD_KEYWORDS, ai: dict = rules.AI_KEYWORDS) -> DataFrame:
    """Pages (startup_id, path, url, html, ord) by path group -> (signal source, weight); cloud by sentence rules, AI by keywords; ownership is worth 1.0."""
    table = _ordered_table(pages, [(p, g, w) for p, (g, w) in groups.items()], "path string, signal_source string, weight double")
    got = _texts(pages.where(F.col("path").isin(list(groups))), cloud=cloud, ai=ai).where("status = 200").join(table, "path")
    told = sentences.judged_sites(got, "_hits", F.col("facts"))
    hit = lambda side, name, words, owns: F.struct(F.lit(side).alias("side"), name.alias("provider_name"), words.alias("keywords"), owns.alias("owns"))
    owned = F.transform("_hits", lambda h: hit("cloud", h["provider_name"], h["keywords"], h["is_ownership"]))
    smart = F.transform(keyword_hits(F.col("text"), ai), lambda h: hit("ai", h["provider_name"], h["keywords"], F.lit(False)))
    every = told.select("startup_id", "url", "map_ord", "signal_source", "weight", F.explode(F.concat(owned, smart)).alias("h")).select("*", "h.*")
    every = every.withColumn("weight", F.when(F.col("owns"), 1.0).otherwise(F.col("weight"))).withColumn("signal_source", F.when(F.col("owns"), "ownership_declaration").otherwise(F.col("signal_source")))
    return signal_rows(every, 11, "", F.col("weight"), F.col("side"), F.col("map_ord"), F.concat(F.lit("Keywords: "), F.array_join("keywords", ", ")), F.col("url"), ["signal_source"])


def homepage_investor_signals(pages: DataFrame) -> DataFrame:
    home = _texts(pages.where("path = '/'")).where("status = 200").select("startup_id", "url", "text", "ord")
    return signal_rows(homepage_investors(home, "text"), 12, "homepage_investor", F.lit(0.3), F.lit("cloud"), F.col("ord"), F.concat(F.col("rationale"), F.lit(" (mentioned on homepage)")), F.col("url"))


def sitemap_posts(maps: DataFrame, slugs: list[str], matched: int = 15, newest: int = 10) -> DataFrame:
    """(startup_id, url) of /blog/ entries of a sitemap (startup_id, xml): those with a keyword in the slug, else the newest."""
    block = F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1)))
    posts = maps.select("startup_id", block.alias("_b")).select("startup_id", F.regexp_extract("_b", r"<loc>\s*([^<]+?)\s*</loc>", 1).alias("url"), F.regexp_extract("_b", r"<lastmod>\s*([^<]+?)\s*</lastmod>", 1).alias("lastmod"))
    posts = posts.where(F.contains(F.col("url"), F.lit("/blog/"))).withColumn("hit", F.lower("url").rlike("|".join(slugs)))
    some = posts.withColumn("any", F.max("hit").over(Window.partitionBy("startup_id"))).where(~F.col("any") | F.col("hit"))
    ranked = some.withColumn("ord", F.row_number().over(Window.partitionBy("startup_id").orderBy(F.desc("lastmod"), "url")))
    return ranked.where(F.col("ord") <= F.when(F.col("any"), matched).otherwise(newest)).select("startup_id", "url", "ord")


def feed_posts(entries: DataFrame, keywords: dict[str, list[str]], most: int = 20) -> DataFrame:
    """The first entries of a feed (startup_id, ord, title, summary, url) that hold a provider keyword."""
    first = entries.where(F.col("ord") <= most)
    words = sorted({k.strip() for ks in keywords.values() for k in ks})
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    return first.where(F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(text, k)))


def blog_posts(urls: DataFrame, pages: DataFrame, **tables) -> DataFrame:
    own = urls.dropDuplicates(["startup_id", "url"]).where(~is_competitor_url(F.col("url")))
    return evidence_pages(own, pages, "tech_blog", 13, 0.6, **tables)


def security_txt(pages: DataFrame, cloud: dict = rules.CLOUD_KEYWORDS) -> DataFrame:
    hits = keyword_scan(pages.where("path = '/.well-known/security.txt' and status = 200").select("startup_id", "url", "html", "ord"), "html", cloud)
    return signal_rows(hits, 14, "security_txt", F.lit(0.6), F.lit("cloud"), F.col("ord"), F.array_join("keywords", ", "), F.col("url"))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    parts = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(parts, lambda p: p < 256), number))


def ip_ranges(hosts: DataFrame, ranges: DataFrame, hosted: DataFrame) -> DataFrame:
    """Host addresses (startup_id, ip) in provider networks, whichever provider has the least prio; malformed addresses and networks count as none.

    Each distinct address is cut to every prefix length that a network has (at most 33), and cut addresses meet networks
    by equality, so that a wide network costs one row and a busy one no comparison.
    """
    size = F.coalesce(F.get(F.split("cidr", "/"), F.lit(1)), F.lit("32"))
    bits = F.when(size.rlike(r"^\d{1,2}$"), size.try_cast("int"))
    cut = lambda number, bits: F.floor(number / F.pow(F.lit(2.0), F.lit(32) - bits)).cast("long")
    net = ranges.select(F.col("provider").alias("provider_name"), "prio", bits.alias("bits"), ip_number(F.get(F.split("cidr", "/"), F.lit(0))).alias("_low")).where("bits <= 32 and _low is not null")
    net = net.withColumn("net", cut(F.col("_low"), F.col("bits"))).groupBy("bits", "net").agg(F.min(F.struct("prio", "provider_name")).alias("best"))
    net = broadcast_if_small(net)
    lengths = sorted(r[0] for r in net.select("bits").distinct().collect())
    own = hosts.join(hosted, "startup_id", "left_anti")
    each = own.select("ip").distinct().withColumn("_ip", ip_number(F.col("ip"))).where("_ip is not null").withColumn("bits", F.explode(F.lit(lengths).cast("array<int>")))
    found = each.withColumn("net", cut(F.col("_ip"), F.col("bits"))).join(net, ["bits", "net"]).groupBy("ip").agg(F.min("best").alias("best"))
    best = own.join(found, "ip").select("startup_id", "ip", "best.*")
    return signal_rows(best, 15, "ip_asn", F.lit(0.3), F.lit("cloud"), F.col("prio"), F.concat(F.lit("IP "), F.col("ip")))


def investor_priors(startups: DataFrame, priors: dict = rules.INVESTOR_PRIORS) -> DataFrame:
    """First match per provider of investors (id, lead_investors) that contain a prior's key."""
    table = _ordered_table(startups, [(k, p, why) for k, (p, why) in priors.items()], "prior string, provider_name string, why string")
    each = startups.select(F.col("id").alias("startup_id"), F.posexplode("lead_investors").alias("pos", "investor"))
    hits = each.join(table, F.contains(F.lower("investor"), F.col("prior")))
    return signal_rows(hits, 16, "investor_prior", F.lit(0.3), F.lit("cloud"), F.col("pos") * 1000 + F.col("map_ord"), F.col("why"))


def founder_priors(startups: DataFrame, priors: dict = rules.FOUNDER_PRIORS) -> DataFrame:
    """As investor_priors for founders; emitted only if all matches agree on a provider."""
    table = _ordered_table(startups, [(k, p, why) for k, (p, why) in priors.items()], "prior string, provider_name string, why string")
    each = startups.select(F.col("id").alias("startup_id"), F.posexplode("founder_background").alias("pos", "founder"))
    hits = each.join(table, F.contains(F.lower("founder"), F.col("prior")))
    agreed = hits.groupBy("startup_id").agg(F.count_distinct("provider_name").alias("k")).where("k = 1").select("startup_id")
    return signal_rows(hits.join(agreed, "startup_id"), 17, "founder_prior", F.lit(0.3), F.lit("cloud"), F.col("pos") * 1000 + F.col("map_ord"), F.col("why"))


def other_platforms(pages: DataFrame, records: DataFrame, cloud_signals: DataFrame) -> DataFrame:
    """Other hosting platforms of startups without any cloud signal; CNAMEs only where headers found none."""
    has = cloud_signals.where("provider_type = 'cloud'").select("startup_id").distinct()
    lonely = pages.join(has, "startup_id", "left_anti").withColumn("_h", _lower_headers(F.col("headers")))
    hit = F.array(*[
        F.when(F.try_element_at("_h", F.lit(h)).isNotNull() & (F.lit(True) if v is None else F.contains(F.try_element_at("_h", F.lit(h)), F.lit(v))), F.lit(p)) for h, v, p in rules.OTHER_PLATFORM_HEADERS
    ])
    by_header = lonely.select("startup_id", "url", F.posexplode(hit).alias("ord", "provider_name")).where(F.col("provider_name").isNotNull())
    headers = signal_rows(by_header, 18, "http_headers", F.lit(0.3), F.lit("cloud"), F.col("ord"), F.concat(F.lit("Hosted on "), F.col("provider_name")), F.col("url"))
    rest = records.where("rtype = 'CNAME'").join(has, "startup_id", "left_anti").join(headers.select("startup_id").distinct(), "startup_id", "left_anti")
    named = rest.withColumn("provider_name", _first_in_map(F.lower("target"), rules.OTHER_PLATFORM_CNAMES)).where(F.col("provider_name").isNotNull())
    cnames = signal_rows(named, 18, "dns_cname", F.lit(0.3), F.lit("cloud"), F.lit(100), F.concat(F.lit("Hosted on "), F.col("provider_name")))
    return headers.unionByName(cnames)


def llm_findings(findings: DataFrame, known: list[str], ai_floor: int = 60, cloud_floor: int = 30) -> DataFrame:
    """Signals of finding arrays in replies (startup_id, tier, raw, need_cloud, need_ai): known names, floors per side, weight by confidence."""
    body = F.regexp_extract("raw", r"(?s)(\[.*\])", 1)
    item = "array<struct<provider_type: string, provider_name: string, confidence: double, evidence: string, url: string>>"
    each = findings.select("startup_id", "tier", "need_cloud", "need_ai", F.posexplode(F.from_json(body, item)).alias("pos", "f"))
    kind, sure = F.lower("f.provider_type"), F.col("f.confidence")
    kept = each.where(F.col("f.provider_name").isin(known) & F.when(kind == "ai", (sure >= ai_floor) & F.col("need_ai")).when(kind == "cloud", (sure >= cloud_floor) & F.col("need_cloud")).otherwise(False))
    weight = F.when(sure >= 80, 1.0).when(sure >= 50, 0.6).otherwise(0.3)
    rows = kept.withColumn("provider_name", F.col("f.provider_name")).withColumn("signal_source", F.when(F.col("tier") == "4a", "perplexity_search").otherwise("llm_inference"))
    out = signal_rows(rows, 19, "", weight, kind, F.col("pos"), F.substring("f.evidence", 1, 200), F.col("f.url"), ["tier"])
    return out.withColumn("tier", F.when(F.col("signal_source") == "perplexity_search", "4a").otherwise("4b"))


def relevance_filter(items: DataFrame, replies: DataFrame) -> DataFrame:
    """Items (startup_id, item_no, ...) without those a reply's decisions array calls keep = false; unmentioned or unparseable stay."""
    decisions = F.from_json(F.regexp_extract("raw", r"(?s)(\[.*\])", 1), "array<struct<index: int, keep: boolean>>")
    dropped = replies.select("startup_id", F.explode(decisions).alias("d")).where("d.keep = false").select("startup_id", F.col("d.index").alias("item_no"))
    return items.join(dropped, ["startup_id", "item_no"], "left_anti")


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def _on_board(host: Column, boards: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, boards)), lambda b: (host == b) | F.endswith(host, F.concat(F.lit("."), b)))


def _absolute(href: Column, index: Column) -> Column:
    return F.when(F.startswith(href, F.lit("/")), F.concat(F.regexp_extract(index, r"^(https?://[^/]+)", 1), href)).otherwise(href)


def job_board_links(pages: DataFrame, boards: list[str] = rules.JOB_BOARDS) -> DataFrame:
    """(startup_id, url, title, ord) of posts an index page (startup_id, url, html) points to: deeper links of its own board, links to known boards, sitemap locations below it."""
    links = pages.select("startup_id", F.col("url").alias("index"), F.posexplode(html.extract_links(F.col("html"))).alias("ord", "l"))
    seen = links.withColumn("href", _absolute(F.col("l.href"), F.col("index"))).where(F.col("href").startswith("http"))
    deeper = (_host(F.col("href")) == _host(F.col("index"))) & F.startswith("href", F.regexp_replace("index", "/+$", "")) & (F.length("href") > F.length("index") + 1)
    anchors = seen.where(deeper | _on_board(_host(F.col("href")), boards)).select("startup_id", F.col("href").alias("url"), F.col("l.text").alias("title"), "ord")
    locs = pages.select("startup_id", F.col("url").alias("index"), F.posexplode(F.regexp_extract_all("html", F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))).alias("ord", "url"))
    mapped = locs.where(_host(F.col("url")) == _host(F.col("index"))).select("startup_id", "url", F.lit(None).cast("string").alias("title"), "ord")
    every = anchors.unionByName(mapped)
    return every.withColumn("_n", F.row_number().over(Window.partitionBy("startup_id", "url").orderBy("ord"))).where("_n = 1").drop("_n")


def board_indexes(pages: DataFrame, boards: list[str] = rules.JOB_BOARDS) -> DataFrame:
    """(startup_id, url, ord) of the boards to read that a company's own pages (startup_id, url, html, ord) name: links to
    known boards, and a page itself that links to postings embedded in it; each once, in order."""
    links = pages.where("status = 200").select("startup_id", F.col("url").alias("page"), F.col("ord").alias("at"), F.posexplode(html.extract_links(F.col("html"))).alias("pos", "l"))
    known = links.where(F.startswith("l.href", F.lit("http")) & _on_board(_host(F.col("l.href")), boards)).select("startup_id", F.col("l.href").alias("url"), "at", "pos")
    own = links.where(F.contains("l.href", F.lit("ashby_jid="))).select("startup_id", F.col("page").alias("url"), "at", "pos")
    first = known.unionByName(own).withColumn("_n", F.row_number().over(Window.partitionBy("startup_id", "url").orderBy("at", "pos"))).where("_n = 1")
    return first.select("startup_id", "url", F.row_number().over(Window.partitionBy("startup_id").orderBy("at", "pos", "url")).alias("ord"))


def board_postings(indexes: DataFrame, roles: list[str] = rules.ROLE_KEYWORDS) -> DataFrame:
    """(startup_id, url, title, ord) of the first board index (startup_id, url, html, ord) that lists any posting.

    An index lists the links that go deeper into its host; where there are none, the job list embedded in it, titles of
    engineering roles first.
    """
    views = indexes.where("status = 200").withColumn("_v", html.page_view(F.col("html"), ("links", "postings"))).select("startup_id", F.col("url").alias("index"), "ord", "_v.links", "_v.postings")
    host = F.regexp_extract("index", r"^https?://([^/]+)", 1)
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    hrefs = F.transform("links", lambda x: F.struct(_absolute(x["href"], F.col("index")).alias("url"), F.nullif(x["text"], F.lit("")).alias("title")))
    deeper = F.filter(hrefs, lambda x: F.contains(x["url"], host) & (bare(x["url"]) != bare(F.col("index"))))
    org = F.regexp_replace(F.coalesce(F.try_parse_url("index", F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    is_role = lambda p: F.exists(F.array(*map(F.lit, roles)), lambda r: F.contains(F.lower(p["title"]), r))
    sorted_ = F.concat(F.filter("postings", is_role), F.filter("postings", lambda p: ~is_role(p)))
    embedded = F.transform(sorted_, lambda p: F.struct(F.concat(F.lit("https://jobs.ashbyhq.com/"), org, F.lit("/"), p["id"]).alias("url"), F.nullif(p["title"], F.lit("")).alias("title")))
    listed = views.withColumn("_deeper", deeper).withColumn("_posts", F.when(F.size("_deeper") > 0, F.col("_deeper")).otherwise(embedded)).where(F.size("_posts") > 0)
    first = listed.withColumn("_n", F.row_number().over(Window.partitionBy("startup_id").orderBy("ord"))).where("_n = 1")
    each = first.select("startup_id", F.posexplode("_posts").alias("at", "p")).select("startup_id", "p.url", "p.title", "at")
    unique = each.groupBy("startup_id", "url").agg(F.min("at").alias("at"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("at"))).alias("title"))
    return unique.select("startup_id", "url", "title", F.row_number().over(Window.partitionBy("startup_id").orderBy("at")).alias("ord"))
