"""Runs of states, merged sketches and keyset pages against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from provintel.operators import analytics as A
from provintel.sources.pages import page_after, write_pages


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_runs_expand_to_all_pairs(spark):
    """Null arrays are a state; a startup of one state has no row; few rows stand for many pairs."""
    rng = random.Random(2)
    rows = [(s, day(d), rng.choice([None, ["AWS"], ["AWS", "GCP"]])) for s in range(6) for d in rng.sample(range(60), 25)]
    rows += [(90, day(d), None) for d in range(5)] + [(91, day(d), ["AWS"] if d < 200 else ["GCP"]) for d in range(400)]
    snaps = spark.createDataFrame(rows, "startup_id long, snapshot_date date, cloud_providers array<string>")
    runs = A.change_runs(snaps).collect()
    assert {r["startup_id"] for r in runs if r["startup_id"] == 90} == set()
    big = [r for r in runs if r["startup_id"] == 91]
    assert len(big) == 1 and big[0]["n_pairs"] == 200 * 200
    want = {}
    for s in range(6):
        own = sorted((d, p) for i, d, p in rows if i == s)
        for i, (a, p) in enumerate(own):
            for b, q in own[i + 1 :]:
                if p != q:
                    want[s, a, b] = (p, q)
    got = set()
    dates = {s: sorted(d for i, d, _ in rows if i == s) for s in range(6)}
    for r in runs:
        if r["startup_id"] < 6:
            pairs = {(r["startup_id"], a, b) for a in dates[r["startup_id"]] for b in dates[r["startup_id"]] if r["old_first_date"] <= a <= r["old_last_date"] and r["new_first_date"] <= b <= r["new_last_date"]}
            assert len(pairs) == r["n_pairs"] and not pairs & got
            got |= pairs
    assert got == set(want)


def test_merging_days_in_any_groups(spark):
    rows = spark.range(40_000).selectExpr("id * 7 % 9000 AS startup_id", "'cloud' AS provider_type", "if(id % 3 = 0, 'a', 'b') AS signal_source", "'WEAK' AS signal_strength", "CAST(0.3 AS DECIMAL(3,1)) AS confidence_weight", "date_add(DATE'2024-01-01', CAST(id % 30 AS INT)) AS signal_date")
    sketches = A.effectiveness_sketches(rows)
    by_day = {r["signal_source"]: r.asDict() for r in A.effectiveness_between(sketches).collect()}
    coarse = rows.withColumn("signal_date", F.trunc("signal_date", "week"))
    by_week = {r["signal_source"]: r.asDict() for r in A.effectiveness_between(A.effectiveness_sketches(coarse)).collect()}
    exact = {r["signal_source"]: r.asDict() for r in A.signal_effectiveness(rows).collect()}
    for source, told in by_day.items():
        assert told["signal_count"] == exact[source]["signal_count"] and told["avg_weight"] == exact[source]["avg_weight"]
        assert told["signal_count"] == by_week[source]["signal_count"] and told["avg_weight"] == by_week[source]["avg_weight"]
        assert abs(by_week[source]["startup_count"] - exact[source]["startup_count"]) <= 3 * 0.0065 * exact[source]["startup_count"]
        assert abs(told["startup_count"] - exact[source]["startup_count"]) <= 3 * 0.0065 * exact[source]["startup_count"]
    assert A.effectiveness_between(sketches, "2030-01-01").collect() == []


def test_pages_follow_the_order_and_read_few_files(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *[day(d) for d in range(12)]])) for i in rng.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "id long, snapshot_date date")
    path = str(tmp_path / "p")
    write_pages(df, path, "snapshot_date", "id", 60)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or day(0)).toordinal(), r[0]))
    got, cursor = [], None
    while True:
        page = page_after(spark, path, df.schema, "snapshot_date", "id", 45, cursor)
        assert len(page.inputFiles()) <= 3
        part = [(r["id"], r["snapshot_date"]) for r in page.collect()]
        if not part:
            break
        got += part
        cursor = (part[-1][1], part[-1][0])
    assert got == want
    write_pages(df.limit(0), path, "snapshot_date", "id")
    assert page_after(spark, path, df.schema, "snapshot_date", "id", 5).collect() == []
