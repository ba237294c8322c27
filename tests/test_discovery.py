"""Families of names against plain Python; rows that once failed a job give null or no row."""

import random

import pytest

from provintel.operators import discovery as D
from provintel.operators import engagement as K
from provintel.operators import resolution as R
from provintel.operators import signals as G
from provintel.sources.tables import SCHEMAS


def leaders(rows):
    """rows (hint, prio) in order -> places kept."""
    used, keep = set(), []
    for i, (lead, _) in enumerate(rows):
        if i in used:
            continue
        members = [j for j in range(i, len(rows)) if j not in used and (j == i or lead in rows[j][0] or rows[j][0] in lead)]
        used |= set(members)
        keep.append(max(members, key=lambda j: (rows[j][1], -j)))
    return sorted(keep)


def grown(rows):
    """rows (name, score) in order -> places kept."""
    groups = []
    for i, (name, _) in enumerate(rows):
        g = next((g for g in groups if name in g[0] or g[0] in name), None)
        if g is None:
            groups.append(g := [name, []])
        g[1].append(i)
        g[0] = max(g[0], name, key=len)
    return sorted(max(m, key=lambda i: (rows[i][1], -i)) for _, m in groups)


def names(seed, n, letters="ab", longest=6):
    rng = random.Random(seed)
    pick = lambda: "".join(rng.choices(letters, k=rng.randint(2, longest)))
    some = [pick() for _ in range(n)]
    return [rng.choice([x, x, f"{x} technologies {rng.randint(0, 3)}", f"the new {x}"]) for x in some]


def hinted(spark, rows):
    """Nodes and edges of hints, led in order: what dedup_hints does, for hints that no headline would give."""
    some = spark.createDataFrame([(i, h, p, i) for i, (h, p) in enumerate(rows)], "article_id long, hint string, prio int, ord long").repartition(3)
    nodes, edges = D.containment_edges(some, "hint")
    placed = some.join(nodes.withColumnRenamed("name", "hint"), "hint").groupBy("node", "hint").agg({"ord": "min"}).withColumnRenamed("min(ord)", "at")
    family = placed.join(D.first_leaders(placed.select("node", "at"), edges), "node").select("hint", "leader")
    return sorted(r["article_id"] for r in D._first(some.join(family, "hint"), ["leader"], [D.F.desc("prio"), "ord"]).collect())


@pytest.mark.parametrize("seed, n, letters", [(1, 60, "ab"), (2, 120, "abc"), (3, 200, "abcdefgh")])
def test_leaders_equal_the_ordered_pass(spark, seed, n, letters):
    rng = random.Random(seed)
    rows = [(h, rng.randint(0, 4)) for h in names(seed, n, letters)]
    assert hinted(spark, rows) == leaders(rows)


@pytest.mark.parametrize("seed, n, letters", [(4, 80, "ab"), (5, 150, "abc"), (6, 300, "abcdefgh")])
def test_events_equal_the_ordered_pass(spark, seed, n, letters):
    rng = random.Random(seed)
    rows = [(h, rng.randint(0, 30)) for h in names(seed, n, letters)]
    events = spark.createDataFrame([(i, f" {h.upper()} ", None, None, None, "d" * s) for i, (h, s) in enumerate(rows)], "ord long, company_name string, funding_round string, website string, lead_investors array<string>, description string")
    assert sorted(r["ord"] for r in D.dedup_events(events.repartition(3)).collect()) == grown(rows)


def test_families_in_plain_python():
    for seed in range(300):
        rng = random.Random(seed)
        rows = [(h, rng.randint(0, 9)) for h in names(seed, 40, "ab", 5)]
        families = D._Families()
        for i, (name, score) in enumerate(rows):
            families.add(name, score, i)
        assert sorted(-at for _, at in families.best) == grown(rows), seed


def test_edges_of_long_names_and_a_hub(spark):
    """A name of 3,000 characters, and a hub that 2,000 names hold: pieces stay linear, every link is found."""
    rng = random.Random(7)
    long = "".join(rng.choices("abcdefghijklmnop ", k=3000))
    all_names = ["ai", long, long[500:900], long[100:109], long[100:108], *[f"ai{i}x" for i in range(2000)]]
    nodes, edges = D.containment_edges(spark.createDataFrame([(x,) for x in all_names], "name string"), "name")
    ids = {r["node"]: r["name"] for r in nodes.collect()}
    got = sorted((ids[a], ids[b]) for a, b in edges.collect())
    assert got == sorted((a, b) for a in set(all_names) for b in set(all_names) if a != b and b in a)


def test_big_family(spark):
    """100,000 names that hold one short name: the hub leads them all, in a few rounds and without a task that holds them."""
    rows = spark.range(100_000).selectExpr("id AS article_id", "id AS ord", "if(id = 0, 'Ai raises $1M now', concat('Ai', id, 'x raises $1M now')) AS title", "'google_news' AS source")
    assert [r["article_id"] for r in D.dedup_hints(rows).collect()] == [0]
    sizes = D.family_sizes(spark.createDataFrame([("ai",), ("ai",), ("aix",), ("b2",)], "n string"), "n").collect()
    assert [(r["n_rows"], r["n_names"], r["example"]) for r in sizes] == [(3, 2, "ai"), (1, 1, "b2")]


BAD = ["http://a b.com/x|y", "http://[::1", "://", "", None, "http://ok.com/p"]


def test_bad_links(spark):
    links = " ".join(f'<a href="{b}">x</a>' for b in BAD if b) + '<a href="http://good.com/job1|a b">j</a><a href="http://jobs.lever.co/x/1">k</a>'
    articles = spark.createDataFrame([(1, "Good", "news.com", links)], "startup_id long, canonical_name string, domain string, html string")
    assert {r["apex"] for r in R.score_links(articles).collect()} == {"ok.com", "lever.co"}
    pages = spark.createDataFrame([("a.com", "/", b, 200, "x") for b in BAD], "domain string, path string, final_url string, status int, html string")
    resolved = spark.createDataFrame([(1, "a.com", 1)], "startup_id long, domain string, stage int")
    assert R.canonical_redirect(resolved, pages).count() == 1
    startups = spark.createDataFrame([(1, "A", "a.com")], "id long, canonical_name string, website string")
    assert R.domain_health(startups, pages).count() == len(BAD)
    hits = spark.createDataFrame([(1, b, "1 day ago", i) for i, b in enumerate(BAD)], "startup_id long, url string, date_str string, rank int")
    assert K.press_feature(hits, "2024-01-31").collect() == []
    index = spark.createDataFrame([(1, b, links) for b in BAD], "startup_id long, url string, html string")
    assert ("http://jobs.lever.co/x/1", "k") in {(r["url"], r["title"]) for r in G.job_board_links(index).collect()}


def test_networks_of_all_lengths(spark):
    """The provider of the least prio whose network holds the address, as comparing all of them gives."""
    import ipaddress

    rng = random.Random(8)
    nets = [("AWS", "0.0.0.0/0", 9), ("GCP", "10.1.2.3/8", 3), ("X", "nonsense", 0), ("X", "1.2.3.4/x", 0), ("X", "1.2.3.4/99", 0), ("X", "300.1.1.1/8", 0), ("X", "2001:db8::/32", 0), ("X", None, 0), ("Solo", "10.1.2.3", 1)]
    nets += [(rng.choice(["A", "B"]), f"{rng.randint(0, 20)}.{rng.randint(0, 3)}.{rng.randint(0, 255)}.0/{rng.randint(6, 32)}", 4 + i % 4) for i in range(40)]
    hosts = [(i, f"{rng.randint(0, 20)}.{rng.randint(0, 3)}.{rng.randint(0, 255)}.{rng.randint(0, 1)}") for i in range(150)] + [(900, "10.1.2.3"), (901, "bad"), (902, None), (903, "1.2.3.999")]
    ok = []
    for p, cidr, prio in nets:
        try:
            ok.append((prio, p, ipaddress.IPv4Network(cidr, strict=False)))
        except ValueError:
            pass
    want = set()
    for i, ip in hosts:
        try:
            want.add((i, min((prio, p) for prio, p, n in ok if ipaddress.IPv4Address(ip) in n)[1]))
        except ValueError:
            pass
    own, table = spark.createDataFrame(hosts, "startup_id long, ip string"), spark.createDataFrame(nets, SCHEMAS["ip_ranges"])
    assert {(r["startup_id"], r["provider_name"]) for r in G.ip_ranges(own, table, own.select("startup_id").limit(0)).collect()} == want


@pytest.mark.parametrize("raw", ["{\"company_name\": \"A\", \"funding_amount_usd\": 1e30}", "{\"company_name\": \"A\", \"funding_amount_usd\": \"x\", \"announcement_date\": \"2024-99-99\"}", "{", "", None, "[]", "null", "```json"])
def test_bad_replies(spark, raw):
    articles = spark.createDataFrame([(1, "t", "u", None, "s", "b", "prnewswire", 0, 1)], SCHEMAS["articles"])
    events = D.parse_extractions(spark.createDataFrame([(1, raw)], "article_id long, raw_json string"), articles)
    good, _ = D.validate_events(events)
    assert good.collect() == []


def test_boards_of_a_company(spark):
    """Embedded lists with braces and escapes, broken or odd lists, board order, pages that embed a board, look-alike hosts."""
    from provintel.functions.html import _embedded_list

    listed = '<script>window.__appData = {"jobBoard": {"jobPostings": [{"id": 7, "title": "Chef", "d": "<b>{</b> \\" }"}, {"id": "z", "title": null}, {"title": "x"}, 3]}}; f({});</script>'
    assert _embedded_list(listed) == [{"id": "7", "title": "Chef"}, {"id": "z", "title": ""}]
    for broken in ("", "window.__appData", "window.__appData = {", 'window.__appData = {"jobBoard": 3}', "window.__appData = {]}", 'window.__appData = {"jobBoard": {"jobPostings": {}}}'):
        assert _embedded_list(broken) == []
    page = "startup_id long, url string, html string, ord int, status int"
    own = [(1, "https://a.com", '<a href="https://notjobs.lever.co.example/x">n</a><a href="https://x.icims.com/jobs">i</a>', 0, 200), (1, "https://a.com/careers", '<a href="/careers?ashby_jid=3">j</a><a href="https://x.icims.com/jobs">i</a>', 1, 200)]
    got = G.board_indexes(spark.createDataFrame(own, page)).collect()
    assert sorted((r["ord"], r["url"]) for r in got) == [(1, "https://x.icims.com/jobs"), (2, "https://a.com/careers")]
    index = [(1, "https://a.com/careers", listed, 2, 200), (1, "https://x.icims.com/jobs", "<a href='/jobs'>back</a>", 1, 200), (1, "https://y.com", "<a href='/z'>z</a>", 3, 200), (2, "https://b.com", None, 1, 200)]
    posts = sorted((r["ord"], r["startup_id"], r["url"]) for r in G.board_postings(spark.createDataFrame(index, page)).collect())
    assert posts == [(1, 1, "https://jobs.ashbyhq.com/careers/7"), (2, 1, "https://jobs.ashbyhq.com/careers/z")]
