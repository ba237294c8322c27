"""Quality classifier by hierarchical empirical Bayes.

A document classifier gives evidence, fitted on a hashed sample of at most about ``SAMPLE`` labelled documents. Its
features are the hashed words present in a text, words' first bytes, and classes of document statistics (length, marks,
bars, capitals, repeats). How likely a word is to tell anything at all comes from all words' test statistics, taken as a
mixture of a null and a wider normal distribution, so evidence fades out smoothly and alike at every size. The words that
may tell most and the classes enter one ridge logistic fit, where a less likely word is pulled to 0 the more; fitted
together, the words of one family of copies share what they tell. Every document's probability is then
aggregated by host and by path: a host's rate is shrunk toward the
global rate, a path's toward its host's, with prior strengths from the spread between groups (method of moments). A
document's posterior log odds are its evidence plus what its path's rate adds to the global rate. The same is done for
toxicity; ``kept`` takes both.

Defined cases: null text has no words and the lowest class of each statistic; null host or path is a group of its own; sparse groups fall back to
their parent; labels that disagree about a document count as bad; without labels of both classes, evidence is 0 and all
documents are kept; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from .words import SPACES, byte_prefix, mix, powers, signed, word_slices, word_spans

SAMPLE = 40_000
PREFIXES = (4, 5, 6, 7)  # bytes of a word's beginning that are features too
LEAST_REAL, FEATURES = 0.2, 4_000  # words less likely than this to tell anything are left out; of the others so many (at most 32,767) enter the fit
Z_BINS = 5  # bins a unit of the test statistic
LEVELS = 12  # classes of a statistic
STATISTICS = ("length", "marks", "bars", "capitals", "repeats")
RIDGE = 0.1
MAX_STRENGTH = 1000.0
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
NOT_PUNCTUATION = np.ones(256, dtype=bool)
NOT_PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = False


def _share_class(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Classes 0..11 of a share, finer near 0."""
    x = part / np.maximum(whole, 1)
    return np.digitize(x, [1e-9, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 0.97])


def doc_features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row number, feature hash, classes of the statistics by row) with each feature of a row perhaps more than once."""
    for w in word_slices(batches, fold=False, outside=NOT_LETTER):
        n = w.batch.num_rows
        row, start, _ = word_spans(w.data, w.offsets, SPACES)
        words = np.bincount(row, minlength=n)
        mark_row, a, b = word_spans(w.data, w.offsets, NOT_PUNCTUATION)
        long_marks = np.bincount(mark_row[b - a > 1], minlength=n)
        pipes = np.bincount(mark_row[(b - a == 1) & (w.data[a] == 0x7C)], minlength=n) if len(a) else np.zeros(n)
        upper = ((w.data >= 65) & (w.data <= 90)).astype(np.int64)
        per_row = np.add.reduceat(np.append(upper, 0), np.minimum(w.offsets[:-1], len(w.data))) * (np.diff(w.offsets) > 0)
        pairs = np.unique(mix(w.hash ^ w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1] if len(w.row) else np.zeros(0, np.int64)
        distinct = np.bincount(w.row[pairs], minlength=n)
        letters = np.bincount(w.row, minlength=n)
        classes = [
            np.digitize(words, [1, 5, 20, 50, 100, 300, 1000, 3000, 10000]),
            _share_class(long_marks, words),
            _share_class(pipes, words),
            _share_class(per_row, np.diff(w.offsets)),
            _share_class(letters - distinct, letters),
        ]
        rows, feats = [w.row[pairs]], [w.hash[pairs]]
        prefix, (_, down) = byte_prefix(w.data), powers(len(w.data) + 1)
        for size in PREFIXES:
            some = pairs[w.end[pairs] - w.start[pairs] > size]
            rows.append(w.row[some])
            feats.append(mix((prefix[w.start[some] + size] - prefix[w.start[some]]) * down[w.start[some]] + np.uint64(size)))
        yield w.batch, np.concatenate(rows), np.concatenate(feats), np.stack(classes, axis=1)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, row, feature, _ in doc_features(batches):
        bad, toxic = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("bad", "toxic"))
        order = np.lexsort((row, feature))
        row, feature = row[order], feature[order]
        once = np.concatenate([[True], (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])]) if len(row) else np.zeros(0, bool)
        row, feature = row[once], feature[once]
        first = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]])) if len(row) else np.zeros(0, np.int64)
        if len(first):
            n, b, t = (np.add.reduceat(v, first) for v in (np.ones(len(row), np.int64), bad[row], toxic[row]))
            yield pa.RecordBatch.from_arrays([pa.array(signed(feature[first])), pa.array(n), pa.array(b), pa.array(t)], names=["feature", "n", "n_bad", "n_toxic"])


class Prior(NamedTuple):
    """Base rate of a label, share of features that tell something, and the variance that their statistics have beyond 1."""

    rate: float
    real: float
    spread: float

    def p_real(self, z: np.ndarray) -> np.ndarray:
        """How likely a feature of this statistic tells something."""
        wide = 1 + self.spread
        null, alive = np.exp(-np.minimum(z * z / 2, 700)), np.exp(-np.minimum(z * z / (2 * wide), 700)) / np.sqrt(wide)
        return self.real * alive / np.maximum((1 - self.real) * null + self.real * alive, 1e-300)

    def least_z(self) -> float:
        """The size of statistic from which features are LEAST_REAL likely to be real."""
        z = np.arange(0, 40, 0.05)
        hit = np.flatnonzero(self.p_real(z) >= LEAST_REAL)
        return float(z[hit[0]]) if len(hit) and 0 < self.rate < 1 else 1e9


def _statistic(n: str, yes: str, rate: float) -> Column:
    """Signed root of the likelihood ratio of a feature's own rate against the base rate."""
    y, no = F.col(yes), F.col(n) - F.col(yes)
    ratio = F.when(y > 0, y * F.log(y / (F.col(n) * rate))).otherwise(0.0) + F.when(no > 0, no * F.log(no / (F.col(n) * (1 - rate)))).otherwise(0.0)
    return F.signum(y - F.col(n) * rate) * F.sqrt(2 * F.greatest(ratio, F.lit(0.0)))


def fit_prior(rate: float, z: np.ndarray, count: np.ndarray) -> Prior:
    """Mixture of N(0, 1) and N(0, 1 + spread) over binned statistics, by expectation and maximization."""
    prior = Prior(rate, 0.01, 25.0)
    for _ in range(200):
        p = prior.p_real(z) * count
        if p.sum() < 1e-9:
            break
        prior = Prior(rate, float(np.clip(p.sum() / count.sum(), 1e-6, 0.5)), float(np.clip((p * z * z).sum() / p.sum() - 1, 4.0, 1e4)))
    return prior


class Evidence:
    """Features (sorted) and, for bad and toxic, the weights of features and of [1, classes of the statistics]."""

    def __init__(self, features: np.ndarray, weights: list[np.ndarray], fits: list[np.ndarray]):
        self.features, self.weights, self.fits = features, weights, fits

    def hits(self, row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, place of a feature), sorted."""
        if not len(self.features) or not len(row):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        hit = self.features[at] == feature
        pairs = np.unique(row[hit] * np.int64(len(self.features)) + at[hit])
        return pairs // len(self.features), pairs % len(self.features)

    def score(self, batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
        for batch, row, feature, classes in doc_features(batches):
            r, f = self.hits(row, feature)
            logits = [one_hot(classes) @ fit + np.bincount(r, weights=w[f], minlength=batch.num_rows) for w, fit in zip(self.weights, self.fits, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(x)) for x in keep] + [pa.array(np.clip(x, -30, 30)) for x in logits], names=[*keep, "bad_logit", "toxic_logit"]
            )

    def rows(self, batches: Iterator[pa.RecordBatch], labels: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        """Labels, classes and places of the features of labelled documents."""
        for batch, row, feature, classes in doc_features(batches):
            r, f = self.hits(row, feature)
            offsets = pa.array(np.searchsorted(r, np.arange(batch.num_rows + 1)).astype(np.int32))
            places = pa.ListArray.from_arrays(offsets, pa.array(f.astype(np.int16)))
            columns = [batch.column(batch.schema.get_field_index(x)) for x in labels] + [pa.array(classes[:, k].astype(np.int32)) for k in range(classes.shape[1])]
            yield pa.RecordBatch.from_arrays([*columns, places], names=[*labels, *STATISTICS, "places"])


def one_hot(classes: np.ndarray) -> np.ndarray:
    hot = np.zeros((len(classes), 1 + classes.shape[1] * LEVELS))
    hot[:, 0] = 1
    for k in range(classes.shape[1]):
        hot[np.arange(len(classes)), 1 + k * LEVELS + np.minimum(classes[:, k], LEVELS - 1)] = 1
    return hot


def logistic(dense: np.ndarray, row: np.ndarray, place: np.ndarray, y: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Ridge logistic fit of dense columns and sparse 0/1 ones (row, place): Newton steps by conjugate gradients, damped."""
    d, m = dense.shape[1], len(pull)

    def forward(b: np.ndarray) -> np.ndarray:
        return dense @ b[:d] + np.bincount(row, weights=b[d + place], minlength=len(y))

    def back(v: np.ndarray) -> np.ndarray:
        return np.concatenate([dense.T @ v, np.bincount(place, weights=v[row], minlength=m - d)])

    def loss(t: np.ndarray, b: np.ndarray) -> float:
        return float(np.logaddexp(0, t).sum() - (t * y).sum() + (pull * b * b).sum() / 2)

    fit = np.zeros(m)
    fit[0] = np.log(y.mean() / (1 - y.mean()))
    t = forward(fit)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(t, -30, 30)))
        v = p * (1 - p)
        goal = -(back(p - y) + pull * fit)
        scale = np.concatenate([(dense * dense).T @ v, np.bincount(place, weights=v[row], minlength=m - d)]) + pull
        step, rest = np.zeros(m), goal.copy()
        z = rest / scale
        way, size = z.copy(), rest @ z
        for _ in range(12):
            turned = back(v * forward(way)) + pull * way
            a = size / max(way @ turned, 1e-300)
            step, rest = step + a * way, rest - a * turned
            z = rest / scale
            new = rest @ z
            if new < 1e-3 * max(goal @ (goal / scale), 1e-300):
                break
            way, size = z + new / size * way, new
        now, length, moved = loss(t, fit), 1.0, forward(step)
        while length > 1e-4 and loss(t + length * moved, fit + length * step) > now:
            length /= 2
        fit, t = fit + length * step, t + length * moved
        if now - loss(t, fit) < 1e-3 * max(now, 1):
            break
    return fit


def fit_evidence(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Evidence:
    """Learns from about ``sample`` labelled documents at most; what reaches the driver is bounded by it."""
    told = labels.where("doc_id is not null").groupBy("doc_id").agg((F.min("quality") < 1).alias("bad"), (F.max("toxic") > 0).alias("toxic"))
    n = told.count()
    million = 1_000_000
    picked = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < int(min(1.0, sample / max(n, 1)) * million)).fillna(False)
    train = materialize(documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "labelled")  # picked is bounded by sample
    kinds = ("bad", "toxic")
    totals = train.agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("int")).alias(c) for c in kinds]).first()
    rates = [(totals[c] or 0) / max(totals["n"], 1) for c in kinds]
    counts = materialize(
        train.mapInArrow(_class_counts, "feature long, n long, n_bad long, n_toxic long")
        .groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "n_bad", "n_toxic")]), "features"
    )
    priors, strong, best = [], F.lit(False), F.lit(0.0)
    for c, rate in zip(kinds, rates, strict=True):
        if not 0 < rate < 1:
            priors.append(None)
            continue
        z = _statistic("n", f"n_{c}", rate)
        bins = counts.groupBy(F.round(z * Z_BINS).alias("z")).agg(F.count("*").alias("k")).collect()
        priors.append(fit_prior(rate, np.array([r["z"] for r in bins]) / Z_BINS, np.array([r["k"] for r in bins], float)))
        strong, best = strong | (F.abs(z) >= priors[-1].least_z()), F.greatest(best, F.abs(z))
        counts = counts.withColumn(f"z_{c}", z)
    rows = counts.where(strong).withColumn("best", best).orderBy(F.desc("best"), "feature").limit(FEATURES).toPandas()
    rows = rows.sort_values("feature", key=lambda x: x.to_numpy(np.int64).view(np.uint64))
    features, width = rows["feature"].to_numpy(np.int64).view(np.uint64), 1 + len(STATISTICS) * LEVELS
    found = Evidence(features, [np.zeros(len(features))] * 2, [np.append(-5.0, np.zeros(width - 1))] * 2)
    schema = ", ".join([f"{c} boolean" for c in kinds] + [f"{x} int" for x in STATISTICS]) + ", places array<smallint>"
    told = train.mapInArrow(lambda b: found.rows(b, kinds), schema).toArrow()  # of the sample's size
    classes = np.stack([told[x].to_numpy() for x in STATISTICS], axis=1) if told.num_rows else np.zeros((0, len(STATISTICS)), np.int64)
    places = told["places"].combine_chunks()
    row, place = np.repeat(np.arange(told.num_rows), pc.list_value_length(places).to_numpy(zero_copy_only=False)), places.flatten().to_numpy().astype(np.int64)
    dense = one_hot(classes)
    for k, c in enumerate(kinds):
        if priors[k]:
            pull = RIDGE / np.maximum(priors[k].p_real(rows[f"z_{c}"].to_numpy()), 1e-3)
            fit = logistic(dense, row, place, told[c].to_numpy().astype(float), np.concatenate([[1e-6], np.full(width - 1, RIDGE), pull]))
            found.fits[k], found.weights[k] = fit[:width], fit[width:]
    return found


def _strength(groups: DataFrame, rate: str, parent: Column) -> float:
    """Prior strength by the method of moments: how little groups spread about their parent's rate."""
    v = F.col(rate) - parent
    r = groups.where("n >= 2").agg(F.avg(v * v).alias("spread"), F.avg(parent * (1 - parent) / F.col("n")).alias("noise"), F.avg(parent * (1 - parent)).alias("most")).first()
    if r["spread"] is None:
        return MAX_STRENGTH
    between = max(r["spread"] - r["noise"], 1e-9)
    return float(min(MAX_STRENGTH, max(1.0, r["most"] / between - 1)))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def classify_quality(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", limit: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_bad, p_toxic (posteriors), their host and path rates, and kept, for every document."""
    evidence = documents.sparkSession.sparkContext.broadcast(fit_evidence(documents, labels, sample))  # bounded by the sample
    sited = documents.select("doc_id", "text", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    scored = materialize(
        sited.mapInArrow(lambda b: evidence.value.score(b, ["doc_id", "host", "path"]), "doc_id long, host string, path string, bad_logit double, toxic_logit double"),
        "evidence",
    )
    p = {c: 1 / (1 + F.exp(-F.col(f"{c}_logit"))) for c in ("bad", "toxic")}
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(p[c]).alias(c) for c in p]), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(c).alias(f"host_{c}") for c in p])
    world = paths.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in p]).first()
    rates = paths.join(hosts, "host")
    for c in p:
        overall = (world[c] or 0.0) / max(world["n"] or 0, 1)
        m_host = _strength(hosts.select(F.col("host_n").alias("n"), (F.col(f"host_{c}") / F.col("host_n")).alias("r")), "r", F.lit(overall))
        rates = rates.withColumn(f"{c}_host_rate", (F.col(f"host_{c}") + m_host * overall) / (F.col("host_n") + m_host))
        m_path = _strength(rates.select("n", (F.col(c) / F.col("n")).alias("r"), f"{c}_host_rate"), "r", F.col(f"{c}_host_rate"))
        rates = rates.withColumn(f"{c}_path_rate", (F.col(c) + m_path * F.col(f"{c}_host_rate")) / (F.col("n") + m_path))
        rates = rates.withColumn(f"{c}_shift", _logit(F.col(f"{c}_path_rate")) - _logit(F.lit(overall)))
    rates = rates.select("host", "path", *[f"{c}_{x}" for c in p for x in ("host_rate", "path_rate", "shift")])
    joined = scored.join(broadcast_if_small(rates, 500_000), ["host", "path"])
    final = {c: 1 / (1 + F.exp(-(F.col(f"{c}_logit") + F.col(f"{c}_shift")))) for c in p}
    return joined.select(
        "doc_id", *[final[c].alias(f"p_{c}") for c in p], *[f"{c}_{x}" for c in p for x in ("host_rate", "path_rate")],
        ((final["bad"] < limit) & (final["toxic"] < limit)).alias("kept"),
    )
