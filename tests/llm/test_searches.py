"""Prefix trie, lexical search and source mixing against plain Python: hostile rows, ties, copies, empty tables, small bounds."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from provintel.llm import lexical_search, mixing, prefix_trie

TERM, WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"
FOLD = {i: i + 32 for i in range(65, 91)}
CONV = "conv_id long, turn long, role string, text string, node_a string"
DOC = "doc_id long, text string, source string, size string, n string"


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    ends = {p: ",".join(map(str, sorted(c for c in who if paths[c] == p))) for p, who in members.items()}
    return sorted((min(w), len(p), min(members[p[:-1]]) if p else None, len(w), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, w in members.items())


def chats(seed):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "lost", None), (7, None, None, None, "x"), (7, None, None, None, "x"), (-7, 0, "user", "é", None), (-5, 3, "b", "a", None), (-5, 3, "a", "b", None)]
    common = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "çela")]
    for c in rng.sample(range(400), 90):
        said = common[: rng.randint(0, 4)] + [(rng.choice(["user", "assistant"]), f"t{rng.randint(0, 3)}") for _ in range(rng.randint(0, 6))]
        rows += [(c, k, r, t, None) for k, (r, t) in enumerate(said)]
    rows += [(c, k, "user", "copy", None) for c in range(1000, 1060, 5) for k in range(12)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, most_cells, a_turn", [(1, 1 << 20, 4), (2, 1 << 10, 4), (3, 1 << 20, 0)])
def test_trie_equals_plain_prefixes(spark, monkeypatch, seed, most_cells, a_turn):
    """Few cells make many collisions, a small bound makes shards: estimates are too large then, nodes stay exact."""
    monkeypatch.setattr(prefix_trie, "CELLS_A_TURN", a_turn)
    rows = chats(seed)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONV).repartition(3), most_cells)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_trie(rows), key=str)


def test_sketch_proves_singletons(spark):
    """Enough cells: what is met once is proved so, what is met in two tasks never."""
    nodes = spark.range(3000).selectExpr("xxhash64(id div 2 * cast(id < 2000 as long) + cast(id >= 2000 as long) * (id + 5000)) as node_a", "xxhash64(id div 2 * cast(id < 2000 as long) + cast(id >= 2000 as long) * (id + 5000), 1) as node_b", "id").repartition(4)
    kept = nodes.selectExpr("id as conv_id", "1L as depth", "0L as parent_a", "0L as parent_b", "node_a", "node_b", "0L as bytes", "true as ends")
    flags = {r["conv_id"]: r["shared"] for r in prefix_trie.screened(kept, 1 << 16).collect()}
    assert all(flags[i] for i in range(2000)) and sum(flags[i] for i in range(2000, 3000)) < 30


def test_deep_copies(spark):
    rows = [(c, k, "user", f"t{k}", None) for c in (10, 15, 20) for k in range(40)]
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, CONV)).collect()}
    assert len(got) == 41 and got[10, 0]["n_leaves"] == 1
    assert got[10, 0]["saved_tokens"] == sum(2 * len(f"t{k}") for k in range(40)) and got[10, 39]["saved_tokens"] == 2 * (3 + 3)


def brute_search(docs, items, top=10):
    texts = [(d, Counter(re.findall(TERM, (t or "").translate(FOLD)))) for d, t, *_ in docs]
    texts = [(d, c) for d, c in texts if c]
    big_n, big_l = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    terms = defaultdict(set)
    for item, text in items:
        terms[item] |= set(re.findall(TERM, (text or "").translate(FOLD)))
    out = []
    for item, wanted in terms.items():
        scored = []
        for d, c in texts:
            m = 100 - 90 + 90 * sum(c.values()) * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, k, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def library(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Étude", "ÉTUDE", "THE", "the", "a1b2", "日本"]
    docs = [(None, None, None, None, None), (None, "the W1 w1", "s", None, None), (3, "...", "s", "x", None), (4, "", None, None, None)]
    docs += [(rng.randint(0, 200), rng.choice([" ", "-", ", "]).join(rng.choices(vocab, k=rng.randint(1, 40))), rng.choice(["a", "b", "é", None]), None, None) for _ in range(150)]
    docs += [(1000 + i, "w1 w2 w3 the the", "hot", None, None) for i in range(120)]
    docs += [(5000, " ".join(rng.choices(vocab, k=9000)), "hot", None, None)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 15)))) for i in range(25)] + [(None, "w1 the"), (None, "w9"), (3, "w2 w5"), (99, None), (98, "nowhere w2 w2")]
    return docs, items


@pytest.mark.parametrize("postings", [lexical_search.POSTINGS, 40])
def test_search_equals_scoring_all(spark, postings):
    docs, items = library(5)
    d, i = spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(d, i, postings=postings)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items)
    assert got.schema["rank"].dataType.simpleString() == "int"


def test_search_of_nothing(spark):
    docs, items = library(6)
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.search(d.limit(0), i).collect() == [] and lexical_search.search(d, i.limit(0)).collect() == []


def test_heaps_keep_ties_in_order():
    import numpy as np

    heaps = lexical_search.Heaps(2, 3)
    for begin in (8, 4, 0):
        doc = np.arange(begin, begin + 4)
        heaps.offer(np.stack([np.full(4, 7), doc], axis=1), doc, np.zeros(4, np.int64))
    item, score, _, doc = heaps.trim()
    assert list(zip(item.tolist(), score.tolist(), doc.tolist(), strict=True)) == [(0, 7, 0), (0, 7, 1), (0, 7, 2), (1, 11, 11), (1, 10, 10), (1, 9, 9)]


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        unit = (total - sum(2 * sizes[s] for s in capped)) / free if free else 0
        more = {s for s in order if s not in capped and weight[s] * unit > 2 * sizes[s]}
        if not more:
            return {s: 2 * sizes[s] if s in capped else weight[s] * unit for s in order}
        capped |= more


def test_mix_meets_targets(spark):
    docs, _ = library(7)
    docs = docs + [(9000, None, "silent", None, None)]
    d = spark.createDataFrame(docs, DOC).repartition(3)
    got = mixing.mix_documents(d, block=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(d.repartition(5), block=8).collect()))
    size = lambda t: len(re.findall(WORD, t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(x[0]), size(x[1])) for x in docs)
    sizes = defaultdict(int)
    for _, text, source, *_ in docs:
        sizes[source] += size(text)
    targets = brute_targets(sizes)
    pairs = {(n, round(t, 6)) for n, t in ((sizes[s], t) for s, t in targets.items())}
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == pairs
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert all(abs(taken[k] - k[1]) <= 12 for k in pairs)
    assert mixing.mix_documents(d.limit(0)).collect() == []


def test_blocks_are_the_mix(spark):
    """The texts of the mix hold as many words of each source as the documents' counts say, and every slot once."""
    docs, _ = library(8)
    d = spark.createDataFrame(docs, DOC).repartition(3)
    blocks = mixing.mix_blocks(d, block=8, shard_slots=50).collect()
    assert sorted(50 * r["shard"] + r["slot"] for r in blocks) == list(range(len(blocks)))
    assert all(len(re.findall(WORD, r["text"])) == r["n_words"] <= 8 for r in blocks)
    assert sum(r["n_words"] for r in blocks) == sum(r["taken"] for r in mixing.mix_documents(d, block=8).collect())
    stream = {s: [w for x in sorted((x for x in docs if x[2] == s and x[0] is not None), key=lambda x: x[0]) for w in re.findall(WORD, x[1] or "")] for s in ("hot",)}["hot"]
    for r in blocks:
        if r["source"] == "hot":
            assert r["text"].split(" ") == stream[8 * r["block"] : 8 * r["block"] + 8]
    shares = Counter(r["shard"] for r in blocks if r["source"] == "hot")
    assert len(shares) > 10 and min(shares.values()) > 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 9973])
def test_orders_are_permutations(spark, n):
    rows = spark.range(n).selectExpr("id as x", f"{n}L as n", "id * 0 + 12345 as key")
    assert sorted(r["x"] for r in mixing.permuted(rows, "x", "n", "key").collect()) == list(range(n))
