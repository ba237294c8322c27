"""Funding articles to unique, validated funding events."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..components import components
from ..functions import rules
from ..functions.text import clean_website_event, company_hint, contains_any, normalize_round, title_key
from ..session import broadcast_if_small, materialize

GRAM = 8


def recent(articles: DataFrame, days_back: int, as_of: str) -> DataFrame:
    return articles.where(F.col("published") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days_back)))


def funding_news(articles: DataFrame, words: list[str] = rules.NEWS_FUNDING_WORDS) -> DataFrame:
    return articles.where(contains_any(F.lower("title"), words))


def funding_wire(articles: DataFrame, words: list[str] = rules.WIRE_FUNDING_WORDS, skip: list[str] = rules.WIRE_SKIP_WORDS) -> DataFrame:
    title, summary = F.lower("title"), F.lower(F.coalesce("summary", F.lit("")))
    return articles.where((contains_any(title, words) | contains_any(summary, words)) & ~contains_any(title, skip))


def passes_filters(articles: DataFrame) -> DataFrame:
    """Wire and news articles that pass their own filter, and all of curated sources; one scan."""
    title, both = F.lower("title"), F.concat_ws(" ", F.lower("title"), F.lower("summary"))
    wire = contains_any(both, rules.WIRE_FUNDING_WORDS) & ~contains_any(title, rules.WIRE_SKIP_WORDS)
    return articles.where(F.when(F.col("source") == "prnewswire", wire).when(F.col("source") == "google_news", contains_any(title, rules.NEWS_FUNDING_WORDS)).otherwise(True))


def priority(source: Column, order: dict[str, int] = rules.SOURCE_PRIORITY) -> Column:
    return F.coalesce(*[F.when(source == s, p) for s, p in order.items()], F.lit(0))


def _first(df: DataFrame, keys: list, order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedup_urls(articles: DataFrame) -> DataFrame:
    return _first(articles, ["url"], ["query_id", "ord"])


def dedup_titles(articles: DataFrame) -> DataFrame:
    return _first(articles, [title_key(F.col("title"))], [F.desc(priority(F.col("source"))), "ord"])


def containment_edges(names: DataFrame, name: str, min_len: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, name), edges (outer, inner)): distinct names, and which of them holds which.

    A name of up to GRAM characters is looked up as it is, a longer one under its rarest piece of GRAM characters, among
    the pieces of all names; only longer ones are then compared. Pieces are linear in a name's length.
    """
    nodes = materialize(names.select(F.col(name).alias("name")).where(F.length(name) >= min_len).distinct().withColumn("node", F.monotonically_increasing_id()), "names")
    size = F.length("name")
    cut = lambda k: F.when(size >= k, F.transform(F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda i: F.substring(F.col("name"), i, k)))
    pieces = nodes.select(F.col("node").alias("outer"), F.explode(F.array_distinct(F.flatten(F.filter(F.array(*[cut(F.lit(k)) for k in range(min_len, GRAM + 1)]), lambda x: x.isNotNull())))).alias("piece"))
    whole = nodes.where(size > GRAM).select("node", F.explode(F.array_distinct(cut(F.lit(GRAM)))).alias("piece"))
    seen = whole.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = whole.join(seen, "piece").groupBy("node").agg(F.min(F.struct("n", "piece"))["piece"].alias("piece"))
    inner = lambda df: df.withColumnRenamed("node", "inner")
    short = pieces.join(inner(nodes.where(size <= GRAM).select("node", F.col("name").alias("piece"))), "piece")
    near = pieces.where(F.length("piece") == GRAM).join(inner(rarest), "piece").where("outer <> inner").select("outer", "inner")
    named = lambda to: nodes.select(F.col("node").alias(to), F.col("name").alias(f"_{to}"))
    long = near.join(named("outer"), "outer").join(named("inner"), "inner").where(F.contains(F.col("_outer"), F.col("_inner")))
    edges = short.where("outer <> inner").select("outer", "inner").unionByName(long.select("outer", "inner"))
    return nodes, materialize(edges, "containment")


def containment_components(names: DataFrame, name: str, min_len: int = 2) -> DataFrame:
    """(name, component) of names linked when one holds the other."""
    nodes, edges = containment_edges(names, name, min_len)
    linked = components(edges.select(F.col("outer").alias("a"), F.col("inner").alias("b")))
    return nodes.join(linked, "node", "left").select(F.col("name").alias(name), F.coalesce("component", "node").alias("component"))


def family_sizes(names: DataFrame, name: str) -> DataFrame:
    """(component, n_rows, n_names, example): how large the families of names are that dedup_events reads in order, largest first."""
    told = names.join(containment_components(names, name), name)
    return told.groupBy("component").agg(F.count("*").alias("n_rows"), F.count_distinct(name).alias("n_names"), F.min_by(name, F.length(name)).alias("example")).orderBy(F.desc("n_rows"), "component")


def first_leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, leader): in order of (at, node), a node that no leader before it is linked to leads; others follow the first such leader.

    Rounds of joins: nodes without an open neighbour before them lead, their later neighbours follow, and the links of both
    are closed. Orders that don't follow the links take few rounds.
    """
    place = lambda to: nodes.select(F.col("node").alias(to), F.struct("at", "node").alias(f"_{to}"))
    placed = edges.select(F.col("outer").alias("x"), F.col("inner").alias("y")).join(place("x"), "x").join(place("y"), "y")
    x_first = F.col("_x") < F.col("_y")
    links = materialize(placed.select(F.when(x_first, F.col("x")).otherwise(F.col("y")).alias("e"), F.when(x_first, F.col("y")).otherwise(F.col("x")).alias("l"), F.least("_x", "_y").alias("at")), "links")
    still, followers = links.select("e", "l"), None
    ends = lambda df, c: df.select(F.col(c).alias("node")).distinct()
    without = lambda df, nodes, c: df.join(nodes.withColumnRenamed("node", c), c, "left_anti")
    while True:
        leaders = materialize(ends(still, "e").join(ends(still, "l"), "node", "left_anti"), "leaders")
        if leaders.isEmpty():
            break
        taken = materialize(ends(still.join(leaders.withColumnRenamed("node", "e"), "e", "left_semi"), "l"), "followers")
        followers = taken if followers is None else followers.unionByName(taken)
        gone = leaders.unionByName(taken)
        still = materialize(without(without(still, gone, "e"), gone, "l"), "still")
    if followers is None:
        return nodes.select("node", F.col("node").alias("leader"))
    first = without(links, followers, "e").groupBy(F.col("l").alias("node")).agg(F.min("at")["node"].alias("leader"))
    return nodes.select("node").join(first, "node", "left").withColumn("leader", F.coalesce("leader", "node"))


def dedup_hints(articles: DataFrame) -> DataFrame:
    """One article per family of company hints; articles without a hint stay.

    In order, a hint that no earlier leader holds or is held by leads; rows of one hint stay together, as all are next to
    the same hints. Of each family the article of the best priority stays, of those the first.
    """
    hinted = articles.withColumn("hint", company_hint(F.col("title"))).withColumn("prio", priority(F.col("source")))
    some = materialize(hinted.where(F.col("hint").isNotNull()).select("article_id", "hint", "prio", "ord"), "hints")
    nodes, edges = containment_edges(some, "hint")
    known = broadcast_if_small(nodes.withColumnRenamed("name", "hint"))
    nodes = materialize(some.join(known, "hint").groupBy("node").agg(F.min("ord").alias("at")), "placed")
    family = broadcast_if_small(known.join(first_leaders(nodes, edges), "node").select("hint", "leader"))
    kept = _first(some.join(family, "hint"), ["leader"], [F.desc("prio"), "ord"])
    return articles.join(kept.select("article_id").unionByName(hinted.where(F.col("hint").isNull()).select("article_id")), "article_id", "left_semi")


class _Families:
    """Groups of names in order of creation; a name belongs to the first whose longest name holds it or is held by it."""

    def __init__(self):
        self.names: list[str] = []  # the longest name of each group
        self.best: list[tuple] = []
        self.exact: dict[str, list[int]] = {}
        self.sizes: dict[int, int] = {}
        self.pairs: dict[str, list[int]] = {}  # groups that hold, or held, two characters

    def _held(self, name: str) -> list[int]:
        """Groups whose name stands in this one."""
        parts = {name[i : i + k] for k in self.sizes if k <= len(name) for i in range(len(name) - k + 1)}
        return [self.exact[p][0] for p in parts if p in self.exact]

    def _holder(self, name: str) -> int | None:
        """First group whose name holds this one."""
        lists = [self.pairs.get(name[i : i + 2], []) for i in range(len(name) - 1)]
        return next((g for g in min(lists, key=len) if name in self.names[g]), None)

    def add(self, name: str, score: int, at: int) -> None:
        found = [*self._held(name), *([h] if (h := self._holder(name)) is not None else [])]
        g = min(found) if found else len(self.names)
        if not found:
            self.names.append("")
            self.best.append((score, -at))
        self.best[g] = max(self.best[g], (score, -at))
        if len(name) > len(self.names[g]):
            self._rename(g, name)

    def _rename(self, g: int, name: str) -> None:
        old = self.names[g]
        if old:
            self.sizes[len(old)] -= 1
            if not self.sizes[len(old)]:
                del self.sizes[len(old)]
            self.exact[old].remove(g)
            if not self.exact[old]:
                del self.exact[old]
        self.names[g] = name
        insort(self.exact.setdefault(name, []), g)
        self.sizes[len(name)] = self.sizes.get(len(name), 0) + 1
        for pair in {name[i : i + 2] for i in range(len(name) - 1)} - {old[i : i + 2] for i in range(len(old) - 1)}:
            insort(self.pairs.setdefault(pair, []), g)


def _best_of_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ord of the best row of each family; rows come by component, in order, and are never held together."""
    now, families = None, _Families()
    told = lambda: pa.record_batch({"ord": pa.array([-at for _, at in families.best], pa.int64())})
    for batch in batches:
        for component, name, score, at in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("component", "name", "score", "ord")], strict=True):
            if component != now:
                yield told()
                now, families = component, _Families()
            families.add(name, score, at)
    yield told()


def dedup_events(events: DataFrame) -> DataFrame:
    """One event per family of company names, the one that tells most.

    A family's name grows with its members, so where a name belongs depends on all before it: the rows of a component of
    names that hold each other stream through one task in order, which keeps a name per family.
    """
    score = (
        F.when(F.col("funding_round").isNotNull() & ~F.col("funding_round").isin("Unknown", "UNKNOWN", ""), 10).otherwise(0)
        + F.when(F.coalesce("website", F.lit("")) != "", 5).otherwise(0)
        + F.when(F.coalesce(F.size("lead_investors"), F.lit(0)) > 0, 3).otherwise(0)
        + F.length(F.coalesce("description", F.lit("")))
    )
    named = materialize(events.select(F.lower(F.trim("company_name")).alias("name"), score.cast("long").alias("score"), F.col("ord").cast("long").alias("ord")), "event-names")
    short = named.where(F.coalesce(F.length("name") < 2, F.lit(True))).select("ord")
    some = named.where(F.length("name") >= 2)
    dealt = some.join(containment_components(some, "name"), "name").repartition("component").sortWithinPartitions("component", "ord")
    return events.join(dealt.mapInArrow(_best_of_families, "ord long").unionByName(short), "ord", "left_semi")


def dedup_websites(events: DataFrame) -> DataFrame:
    """First event per website; events without one stay."""
    return _first(events.where(F.col("website").isNotNull()), ["website"], ["ord"]).unionByName(events.where(F.col("website").isNull()))


def parse_extractions(extractions: DataFrame, articles: DataFrame) -> DataFrame:
    """Funding events of extraction replies: fences off, not_funding, unnamed companies and amounts under 10 dropped."""
    fenced = F.regexp_extract("raw_json", r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    body = F.trim(F.when(F.contains(F.col("raw_json"), F.lit("```")), fenced).otherwise(F.col("raw_json")))
    fields = "not_funding boolean, company_name string, funding_amount_usd double, funding_round string, funding_date string, announcement_date string, lead_investors array<string>, website string, industry string, description string"
    r = F.col("r")
    parsed = extractions.join(articles, "article_id").withColumn("r", F.from_json(body, fields))
    named = r["company_name"].isNotNull() & ~F.lower(F.trim(r["company_name"])).isin("unknown", "n/a", "tbd", "")
    kept = parsed.where(~F.coalesce(r["not_funding"], F.lit(False)) & named & (r["funding_amount_usd"] >= 10))
    return kept.select(
        r["company_name"].alias("company_name"), r["funding_amount_usd"].try_cast("long").alias("funding_amount_usd"), F.coalesce(F.nullif(r["funding_round"], F.lit("")), F.lit("Unknown")).alias("funding_round"),
        F.try_to_date(r["funding_date"]).alias("funding_date"), F.coalesce(F.try_to_date(r["announcement_date"]), F.to_date("published")).alias("announcement_date"),
        F.coalesce(r["lead_investors"], F.array().cast("array<string>")).alias("lead_investors"), r["website"].alias("website"), r["industry"].alias("industry"), r["description"].alias("description"),
        F.col("source").alias("source_name"), F.col("url").alias("source_url"), F.substring("body", 1, 2000).alias("raw_article_text"), "ord",
    )


def validate_events(events: DataFrame, most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(valid events with clean website and round, rejected events)."""
    ok = F.coalesce(F.col("funding_amount_usd").between(0, most), F.lit(False))
    return events.where(ok).withColumn("website", clean_website_event(F.col("website"))).withColumn("funding_round", normalize_round(F.col("funding_round"))), events.where(~ok)


def attributable(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with a website, one row with the number of those skipped)."""
    has = F.col("website").isNotNull()
    return events.where(has), events.agg(F.count_if(~has).alias("skipped"))


def run_discovery(articles: DataFrame, extractions: DataFrame, as_of: str, days_back: int = 3, most: int | None = None, resolved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(unique validated funding events, rejected ones) of recent articles and their extraction replies.

    Wire and news articles pass their own filters, curated sources only the date; then urls, titles and hints are
    de-duplicated, replies parsed and validated, company names de-duplicated, missing websites filled from resolved
    (name, domain), and websites de-duplicated.
    """
    fresh = recent(dedup_urls(articles), days_back, as_of)
    unique = dedup_hints(dedup_titles(passes_filters(fresh)))
    if most is not None:
        unique = cap_articles(unique, most)
    valid, rejected = validate_events(parse_extractions(extractions, unique))
    events = dedup_events(valid)
    if resolved is not None:
        names = resolved.select(F.lower("name").alias("_name"), F.col("domain").alias("_d"))
        events = events.join(names, F.lower(F.trim("company_name")) == F.col("_name"), "left").withColumn("website", F.coalesce("website", "_d")).drop("_name", "_d")
    return dedup_websites(events), rejected


def enrich_events(events: DataFrame, startups: DataFrame, overrides: DataFrame) -> DataFrame:
    """Empty industry, investors and founders come from the startup of the website; evidence urls are given ones, then the override's."""
    known = startups.select(F.lower("website").alias("_site"), F.col("id").alias("startup_id"), F.col("industry").alias("_industry"), F.col("lead_investors").alias("_investors"), F.col("founder_background").alias("_founders"))
    extra = overrides.select("startup_id", F.col("evidence_urls").alias("_urls"))
    joined = events.join(known, F.lower("website") == F.col("_site"), "left").join(extra, "startup_id", "left")
    filled = lambda c, d: F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.col(d)).otherwise(F.col(c))
    none = F.array().cast("array<string>")
    return (
        joined.withColumn("industry", F.coalesce(F.nullif("industry", F.lit("")), F.col("_industry"))).withColumn("lead_investors", filled("lead_investors", "_investors"))
        .withColumn("founder_background", filled("founder_background", "_founders")).withColumn("evidence_urls", F.array_distinct(F.concat(F.coalesce("evidence_urls", none), F.coalesce("_urls", none))))
        .drop("_site", "_industry", "_investors", "_founders", "_urls")
    )


def link_startup(rows: DataFrame, startups: DataFrame) -> DataFrame:
    """startup_id by website, else by the other ending of .ai and .com."""
    site = F.lower("website")
    other = F.when(F.endswith(site, F.lit(".ai")), F.regexp_replace(site, r"\.ai$", ".com")).when(F.endswith(site, F.lit(".com")), F.regexp_replace(site, r"\.com$", ".ai"))
    a = startups.select(F.lower("website").alias("_site"), F.col("id").alias("_id"))
    b = startups.select(F.lower("website").alias("_site2"), F.col("id").alias("_id2"))
    joined = rows.withColumn("_w", site).withColumn("_o", other).join(a, F.col("_w") == F.col("_site"), "left").join(b, F.col("_o") == F.col("_site2"), "left")
    return joined.withColumn("startup_id", F.coalesce("_id", "_id2")).drop("_w", "_o", "_site", "_site2", "_id", "_id2")


def cap_articles(articles: DataFrame, n: int) -> DataFrame:
    return articles.orderBy("ord").limit(n)


def backfill_pick(snapshots: DataFrame, articles: DataFrame) -> DataFrame:
    """Newest snapshot without a vertical per startup, and the longest article text (startup_id, body) to classify it by."""
    todo = _first(snapshots.where(F.col("vertical").isNull()), ["startup_id"], [F.desc("snapshot_date")])
    longest = articles.groupBy("startup_id").agg(F.max_by("body", F.length("body")).alias("article_text"))
    return todo.join(longest, "startup_id", "left")
