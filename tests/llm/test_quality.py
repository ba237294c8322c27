"""The quality classifier: its hierarchy against plain Python, its fit by its gradient, and recall by size."""

import math
from collections import defaultdict

import numpy as np
import pytest

from provintel.llm import quality_classifier as Q

SIZES = "/root/testdata/sf{}"


def strength(groups, parent):
    """groups: (n, rate); parent: rate by group."""
    some = [(n, r, p) for (n, r), p in zip(groups, parent, strict=True) if n >= 2]
    if not some:
        return Q.MAX_STRENGTH
    mean = lambda f: sum(f(*x) for x in some) / len(some)
    spread, noise, most = mean(lambda n, r, p: (r - p) ** 2), mean(lambda n, r, p: p * (1 - p) / n), mean(lambda n, r, p: p * (1 - p))
    return min(Q.MAX_STRENGTH, max(1.0, most / max(spread - noise, 1e-9) - 1))


def logit(p):
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def test_hierarchy_against_plain_python(spark):
    docs, labels = (spark.read.parquet(SIZES.format(0.001) + f"/{t}.parquet") for t in ("documents", "labels"))
    evidence = Q.fit_evidence(docs, labels)
    sited = docs.selectExpr("doc_id", "text", "source AS host", "lang AS path")
    rows = sited.mapInArrow(lambda b: evidence.score(b, ["doc_id", "host", "path"]), "doc_id long, host string, path string, bad_logit double, toxic_logit double").collect()
    got = {r["doc_id"]: r for r in Q.classify_quality(docs, labels).collect()}
    for c in ("bad", "toxic"):
        p = {r["doc_id"]: 1 / (1 + math.exp(-r[f"{c}_logit"])) for r in rows}
        hosts, paths = defaultdict(list), defaultdict(list)
        for r in rows:
            hosts[r["host"]].append(p[r["doc_id"]])
            paths[r["host"], r["path"]].append(p[r["doc_id"]])
        world = sum(p.values()) / len(p)
        m = strength([(len(v), sum(v) / len(v)) for v in hosts.values()], [world] * len(hosts))
        host_rate = {h: (sum(v) + m * world) / (len(v) + m) for h, v in hosts.items()}
        m = strength([(len(v), sum(v) / len(v)) for v in paths.values()], [host_rate[h] for h, _ in paths])
        path_rate = {k: (sum(v) + m * host_rate[k[0]]) / (len(v) + m) for k, v in paths.items()}
        for r in rows:
            k = (r["host"], r["path"])
            want = 1 / (1 + math.exp(-(r[f"{c}_logit"] + logit(path_rate[k]) - logit(world))))
            assert got[r["doc_id"]][f"{c}_host_rate"] == pytest.approx(host_rate[r["host"]], rel=1e-6)
            assert got[r["doc_id"]][f"p_{c}"] == pytest.approx(want, rel=1e-6)
    assert all(r["kept"] == (r["p_bad"] < 0.5 and r["p_toxic"] < 0.5) for r in got.values())


def test_logistic_fit_has_no_gradient_left():
    rng = np.random.default_rng(0)
    x = (rng.random((300, 12)) < 0.3).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ rng.normal(size=12) - 0.5)))).astype(float)
    dense, (row, place) = np.column_stack([np.ones(300), x[:, :4]]), np.nonzero(x[:, 4:])
    pull = np.array([1e-6] + [1.0] * 12)
    fit = Q.logistic(dense, row, place, y, pull)
    full = np.column_stack([dense, x[:, 4:]])
    p = 1 / (1 + np.exp(-full @ fit))
    assert np.abs(full.T @ (p - y) + pull * fit).max() < 0.1


def test_recall_and_kept_share_do_not_follow_the_size(spark):
    """Labels of even doc_id train, odd ones test."""
    shares = {}
    for sf, least_bad, least_toxic in (("0.01", 0.9, 0.6), ("0.1", 0.9, 0.9)):
        docs, labels = (spark.read.parquet(SIZES.format(sf) + f"/{t}.parquet") for t in ("documents", "labels"))
        out = Q.classify_quality(docs, labels.where("doc_id % 2 = 0"))
        shares[sf] = out.selectExpr("avg(CAST(kept AS INT)) AS s").first()["s"]
        told = out.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
        gone = lambda q, t: 1 - told[(told.quality == q) & (told.toxic == t)].kept.mean()
        assert gone(1, 0) < 0.02 and gone(0, 0) > least_bad and gone(1, 1) > least_toxic, (sf, gone(1, 0), gone(0, 0), gone(1, 1))
    assert abs(shares["0.01"] - shares["0.1"]) < 0.06
