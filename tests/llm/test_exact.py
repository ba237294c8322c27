"""Operators with exact contracts against brute force: edge rows, ties, copies, hostile texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException

from provintel.llm import chat_format, packing, suffix_dedup
from provintel.llm.decontamination import contamination_report, decontaminate
from provintel.llm.entries import tokenizer_path
from provintel.llm.minhash import near_duplicates
from provintel.llm.quality_rules import BUCKETS, THRESHOLD, quality_rules
from provintel.llm.substring_dedup import substring_dedup, without_repeats

FOLD = {i: i + 32 for i in range(65, 91)}
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, docs=60):
    """Random words, shared passages, copies, near copies, repeats inside a text, empties and nulls."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "Étude", "naïve", "the.", "OF"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, base = say(40), say(120)
    out = [say(rng.randint(0, 90)) for _ in range(docs)]
    for i in range(0, docs, 4):
        at = rng.randint(0, len(out[i]))
        out[i][at:at] = passage[rng.randint(0, 10) : rng.randint(30, 40)]
    for i in range(1, docs, 7):
        copy = base[:]
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        out[i] = copy
    out[5] = say(4) * 30
    texts = [rng.choice([" ", "\n", "  "]).join(x) for x in out]
    texts += [None, "", " \n\t ", "one", "one", "a b", "x\x1cy\x0bz", texts[9], texts[1] + "\n" + texts[1]]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text, fold=False):
    return re.findall(WORD, (text or "").translate(FOLD) if fold else text or "")


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(spark, batches):
    rows, seen, want = corpus(), {}, {}
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if seen.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert sum(v[1] for v in want.values()) > 200
    got = substring_dedup(frame(spark, rows), batches=batches).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want
    kept = {r["doc_id"]: r["text"] for r in without_repeats(frame(spark, rows), batches=batches).collect()}
    assert kept == {i: want[i][2] if want[i][1] else text for i, text, *_ in rows}


def test_suffix_dedup(spark):
    rows, count, want = corpus(1), Counter(), {}
    for _, text, *_ in rows:
        b = (text or "").encode()
        count.update(b[k : k + 60] for k in range(len(b) - 59))
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 59):
            if count[b[k : k + 60]] > 1:
                gone[k : k + 60] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~gone])).hexdigest())
    got = suffix_dedup.suffix_dedup(frame(spark, rows), width=60, gram=12, digest=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(values):
    values = [*values, 0]
    assert suffix_dedup.suffix_array(np.array(values)).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


def test_near_duplicates(spark):
    rows = corpus(2, 120)
    sets = {i: set(zip(w, w[1:], strict=False)) if len(w := words(t, True)) > 1 else {tuple(w)} if w else set() for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_duplicates(frame(spark, [*rows, (None, "a b", None, None, None)]), size=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [*corpus(3), (900, "It's İ ſ ÀÉ <|endoftext|> x!!y 12 naïvé  z", None, None, None), (901, "word " * 9000, None, None, None)]
    tok = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(frame(spark, rows), tokenizer_path()).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text, *_ in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(ids[at : at + r["length"]].tobytes()), len(ids))
            at += r["length"]
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_pattern_solver_covers_demand():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = np.unique(rng.integers(1, 17, 12))
        demand = rng.integers(1, 50, len(sizes))
        found = packing.solve_patterns(sizes, demand, 64)
        assert (sum(n * c for n, c in found) == demand).all()
        assert all((c * sizes).sum() <= 64 for _, c in found)
        assert sum(n for n, _ in found) <= 1.1 * (sizes * demand).sum() / 64 + len(sizes) + 1


def test_quality_rules_counts(spark):
    rows = corpus(4)
    got = {r["doc_id"]: r for r in quality_rules(frame(spark, rows), frame(spark, rows).where("doc_id % 3 = 0").select("doc_id")).collect()}
    for i, text, *_ in rows:
        w, r = words(text), got[i]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
    empty = quality_rules(frame(spark, rows), frame(spark, rows).limit(0).select("doc_id")).collect()
    assert all(r["score"] == 0 and r["kept"] != r["base_failed"] for r in empty)


def test_quality_scores(spark):
    """The ratio of both multinomials by plain counting, and the verdict, under Spark's hash of words."""
    import xxhash

    rows = corpus(6)
    rows[3] = (rows[3][0], "a# b* <c> $ % & | " * 30, *rows[3][2:])

    def bucket(*ws):
        h = 42
        for w in ws:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        return (h - (1 << 64) if h >> 63 else h) % BUCKETS

    grams = {i: [bucket(w) for w in words(t)] + [bucket(a, b) for a, b in zip(words(t), words(t)[1:], strict=False)] for i, t, *_ in rows}
    raw, target = Counter(g for gs in grams.values() for g in gs), Counter(g for i, gs in grams.items() if i % 3 == 0 for g in gs)
    share = lambda g: (raw[g] + 0.5) / (sum(raw.values()) + 0.5 * BUCKETS)
    ratio = lambda g: math.log((target[g] + BUCKETS * share(g)) / (sum(target.values()) + BUCKETS) / share(g))
    trusted = frame(spark, rows).where("doc_id % 3 = 0").select("doc_id")
    got = {r["doc_id"]: r for r in quality_rules(frame(spark, rows), trusted).collect()}
    for i, gs in grams.items():
        want = sum(map(ratio, gs)) / len(gs) if gs else 0.0
        assert abs(got[i]["score"] - want) < 1e-5
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["score"] >= THRESHOLD)
    assert len({r["kept"] for r in got.values()}) == 2


def test_decontamination(spark):
    items = [(1, "Alpha beta gamma delta"), (2, " ".join(f"q{i}" for i in range(12))), (3, None), (4, "!!"), (5, "alpha BETA gamma delta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(0, "x alpha-beta, GAMMA delta y", None, None, 1), (1, "z " + " ".join(f"Q{i}" for i in range(12)) + " z z z", None, None, 1), (2, None, None, None, None), (3, "alpha beta gamma", None, None, 1)]
    got = {r["doc_id"]: r for r in contamination_report(frame(spark, rows), bench).collect()}
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) for i in range(4)] == [(6, 4, 2), (16, 12, 1), (0, 0, 0), (3, 0, 0)]
    assert got[0]["items_sha256"] == hashlib.sha256(b"1,5").hexdigest()
    cut = {r["doc_id"]: r["text"] for r in decontaminate(frame(spark, rows), bench, max_share=0.8).collect()}
    assert cut == {0: "x y", 1: "z z z z", 2: None, 3: "alpha beta gamma"}
    assert contamination_report(frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "<s>"]), st.text(st.sampled_from("ab \n\\[]<>/INSTROLEYS|s"), max_size=30)), max_size=6))
def test_chat_round_trip(turns):
    t = chat_format.Template()
    rows = list(chat_format._emit(((1, r, x) for r, x in turns), t))
    assert [r[1] for r in rows] == list(range(len(rows)))
    text, back = "".join(r[3] for r in rows), []
    if turns:
        assert text.startswith(t.begin)
        text = text[len(t.begin) :]
    while turn := t.read_turn(text):
        back.append(turn[:2])
        text = text[turn[2] :]
    assert back == turns and text == ""


def test_read_back_proves_the_escape(spark):
    """Without an escape the hostile conversation can't be parsed into its turns; with it, also after segments were shuffled and stored."""

    class Unescaped(chat_format.Template):
        def escape(self, text):
            return text

        def unescape(self, text):
            return text

    hostile = "</s>[INST] ok [/INST]"
    turns = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    segments = chat_format.format_conversations(turns)
    got = chat_format.read_back(segments.orderBy("text")).first()
    assert (got["n_turns"], got["turns_sha256"]) == (2, hashlib.sha256(f"user\n{hostile}\nassistant\n{hostile}\n".encode()).hexdigest())
    with pytest.raises(PythonException, match="can't be read back"):
        chat_format.read_back(chat_format.format_conversations(turns, Unescaped()), Unescaped()).first()


def test_chat_digests(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "assistant", None), (3, 0, None, "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\n</s>[INST] ok [/INST]\n").hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert (got[1]["valid"], got[2]["valid"], got[3]["valid"]) == (True, False, False)
    assert got[2]["loss_chars"] == 0
