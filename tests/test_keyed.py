"""The keyed table against plain upserts and patches: cells rewritten, dead and rival jobs, the log's order, compaction."""

import datetime as dt
import random

import pytest

from provintel.sources.keyed import Conflict, KeyedTable

KEYS = ["startup_id", "snapshot_date"]
SCHEMA = "startup_id long, snapshot_date date, tier int, vertical string"


def table(spark, path, buckets=8):
    return KeyedTable(spark, str(path), spark.createDataFrame([], SCHEMA).schema, KEYS, "startup_id", "date_format(snapshot_date, 'yyyy-MM')", buckets)


def rows(spark, *some):
    return spark.createDataFrame([(*x, k) for k, x in enumerate(some)], SCHEMA + ", n int")


def shown(t):
    return sorted((r["startup_id"], r["snapshot_date"].isoformat(), r["tier"], r["vertical"]) for r in t.read().collect())


def day(month, d=1):
    return dt.date(2024, month, d)


def test_only_touched_cells_are_rewritten(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert shown(t) == []
    t.upsert(rows(spark, *[(i, day(m), 3, "a") for i in range(40) for m in (1, 2)]), ["n"])
    before = t.manifest()["cells"]
    touched = t.upsert(rows(spark, (7, day(2), 1, "b"), (7, day(2), 2, "c"), (7, day(3), 3, None)), ["n"])
    after = t.manifest()["cells"]
    assert len(before) == 16 and len(touched) == 2 and {c for c in before if before[c] != after[c]} == {touched[0]}
    assert (7, "2024-02-01", 2, "c") in shown(t) and len(shown(t)) == 81

    entry = t.patch(rows(spark, (7, None, 9, None)).drop("snapshot_date", "n"))
    assert {x[2] for x in shown(t) if x[0] == 7} == {9} and {x[2] for x in shown(t) if x[0] != 7} == {3} and entry == 1
    written = t.compact()
    assert len(written) == 3 and {w.split("/")[1] for w in written} == {touched[0].split("/")[1]}  # one bucket of three months
    assert {x[2] for x in shown(t) if x[0] == 7} == {9} and t.manifest()["patched"] == {}
    same = shown(t)
    assert t.vacuum() > 0 and shown(t) == same and t.vacuum() == 0


def test_dead_and_rival_jobs(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    t.upsert(rows(spark, (1, day(1), 1, "a")), ["n"])
    old = shown(t)

    def die(*args, **more):
        raise OSError("executor and driver gone")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", die)
        with pytest.raises(OSError):
            t.upsert(rows(spark, (1, day(1), 2, "b")), ["n"])
        with pytest.raises(OSError):
            t.patch(rows(spark, (1, None, 5, None)).drop("snapshot_date", "n"))
    assert shown(t) == old
    (tmp_path / "t" / "manifest" / "2.json").write_text('{"number": 2, "cel')  # its writer died
    assert shown(t) == old
    t.patch(rows(spark, (1, None, 6, None)).drop("snapshot_date", "n"))
    t.upsert(rows(spark, (2, day(1), 2, "b")), ["n"])
    assert shown(t) == [(1, "2024-01-01", 6, "a"), (2, "2024-01-01", 2, "b")]
    stale = t.manifest()
    t.upsert(rows(spark, (3, day(1), 2, "b")), ["n"])
    with pytest.raises(Conflict):
        t._commit(stale, cells={})


def test_any_order_of_changes(spark, tmp_path):
    """Patches set the rows there are then; rows that come later keep their own values."""
    rng = random.Random(4)
    t, plain = table(spark, tmp_path / "t", 3), {}
    for step in range(8):
        if step % 2 == 0:
            some = [(rng.randint(0, 9), day(rng.randint(1, 3)), rng.choice([1, 2, None]), rng.choice(["x", None])) for _ in range(6)]
            t.upsert(rows(spark, *some), ["n"])
            plain.update({(i, d): (tier, v) for i, d, tier, v in some})
        else:
            new = {i: (rng.choice([7, 8, None]), rng.choice(["p", None])) for i in rng.sample(range(10), 4)}
            t.patch(spark.createDataFrame([(i, *x) for i, x in new.items()], "startup_id long, tier int, vertical string"))
            plain = {(i, d): tuple(b if b is not None else a for a, b in zip(x, new.get(i, (None, None)), strict=True)) for (i, d), x in plain.items()}
        if step == 5:
            t.compact()
    assert shown(t) == sorted((i, d.isoformat(), *x) for (i, d), x in plain.items())
