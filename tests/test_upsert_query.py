"""The snapshot upsert meets a target that has rows of the same keys."""

from provintel.plans import bindings as B
from provintel.plans import entries

SF = "/root/testdata/sf0.01"
KEYS = ["startup_id", "snapshot_date"]


def test_updates_meet_the_target(spark, monkeypatch):
    calls, upsert = [], entries.U.upsert
    monkeypatch.setattr(entries.U, "upsert", lambda t, u, *a: (calls.append((t, u)), upsert(t, u, *a))[1])
    got = sorted(map(tuple, entries.s3_upsert(spark, SF).collect()))
    rows = B.snapshot_events(spark, SF).select(*KEYS, "ts", "event_id").collect()
    last = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        last[r["startup_id"], r["snapshot_date"]] = r["event_id"]
    assert got == sorted((*k, v) for k, v in last.items())
    target, updates = calls[0]
    assert target.join(updates, KEYS, "left_semi").count() > 0 and target.join(updates, KEYS, "left_anti").count() > 0
