"""Seven batches into the fingerprint index: several runs are compacted, against brute force."""

import random

from provintel.llm import substring_dedup as S


def test_seven_batches_compact(spark, monkeypatch):
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(200)}" for _ in range(n)]
    passage = say(30)
    rows = [(i, " ".join(say(20) + (passage[i % 9 : 20 + i % 9] if i % 3 == 0 else []) + say(5))) for i in range(42)]
    seen, want = {}, {}
    for i, text in rows:
        w = text.split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if seen.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        want[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    compacted, compact = [], S.FingerprintIndex.compact
    monkeypatch.setattr(S.FingerprintIndex, "compact", lambda self: (compacted.append(len(self.runs)), compact(self))[1])
    got = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=7).collect()
    assert {r["doc_id"]: r["kept_text"] for r in got} == want and any(want[i] != t for i, t in rows)
    assert compacted and min(compacted) >= 4


def test_a_later_job_opens_the_index(spark, tmp_path):
    """Two jobs on one path find what one job over all batches finds; three batches with a fanout of two are compacted."""
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    passage = say(40)
    rows = [(i, " ".join(say(15) + (passage[i % 7 : 25 + i % 7] if i % 2 == 0 else []) + say(5))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    part = lambda a, b: docs.where(f"doc_id between {a} and {b}")
    spans = lambda df: {r["doc_id"]: sorted(map(tuple, r["spans"])) for r in df.collect()}
    covered = lambda found: {d: {p + k for p, n in s for k in range(n)} for d, s in found.items()}
    index = S.FingerprintIndex(16, fanout=2, path=str(tmp_path / "index"))
    got = {**spans(index.repeats(part(0, 12))), **spans(index.repeats(part(13, 25)))}
    assert index.names == ["run-000002"]
    again = S.FingerprintIndex.open(str(tmp_path / "index"), part(0, 25), fanout=2)
    got.update(spans(again.repeats(part(26, 39))))
    assert covered(got) == covered(spans(S.find_repeats(docs))) and got
