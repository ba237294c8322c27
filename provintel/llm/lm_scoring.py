"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax, trained by distributed updates.

Tokens are counted over all training documents. The most frequent are words of their own, in classes by rank (``Sizes``);
every other token belongs to a rare class by its last two bytes, and within that class has its add-one share. A token's
log probability is log P(class | context) plus log P(word | class, context): softmaxes over sums of weights of the active
features. Features are the previous token, two skip features (two and three back), and the hashed pair of the previous
two; tokens that aren't words of their own stand for their rare class. The probabilities of all known tokens and one
unknown token a rare class sum to 1.

Weights start at the counts' log shares and are fitted in rounds on every training document, each seen once: every task
runs sparse AdaGrad steps from the broadcast weights, and a row of weights moves by the mean of the tasks' changes to it,
each weighted by how often the task met that row. Tasks follow the number of tokens; words of their own and hashed pairs
follow the number of distinct tokens. Counts, rare-class totals and scores cover every document. Counts of the ``FREQUENT`` most frequent tokens are broadcast;
all others are looked up by a join on the token's 64-bit hash.

Defined cases: null text is empty and scores its end token; without training documents every token is unknown; ties of
counts go to the smaller hash; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import Words, column, mix, signed, word_slices

RARE = 32
FREQUENT = 200_000
ROUNDS, TASKS, TASK_TOKENS, BATCH, RATE = 3, 12, 16_000_000, 16384, 0.1
BLOCK = 512  # rows of a table that are averaged together
END = np.uint64(0x27D4EB2F165667C5)


class Sizes(NamedTuple):
    """Classes of words of their own, words in each, and hashed pairs."""

    classes: int
    per_class: int
    pairs: int

    @property
    def head(self) -> int:
        return self.classes * self.per_class

    @property
    def symbols(self) -> int:
        return self.head + RARE + 1  # the last is "before the text"

    @property
    def out(self) -> int:
        return self.classes + RARE

    @property
    def shapes(self) -> list[tuple[int, int]]:
        return [(self.symbols, self.out)] * 3 + [(self.pairs, self.out), (self.symbols * self.classes, self.per_class)]


def sizes(distinct: int) -> Sizes:
    """From a million distinct tokens on, pairs double with every fourfold and words of their own with every eightfold."""
    grown = max(0, int(distinct).bit_length() - 20)
    return Sizes(16 << grown // 6, 64 << (grown + 3) // 6, 1 << (13 + grown // 2))


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and rare class of every token of a slice, with each row's end token."""
    n = w.batch.num_rows
    last = w.data[w.end - 1].astype(np.uint64) if len(w.end) else np.zeros(0, np.uint64)
    second = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)] if len(w.end) else 0, 0).astype(np.uint64)
    rare = (mix(last * np.uint64(256) + second + np.uint64(1)) % np.uint64(RARE)).astype(np.int64)
    ends = np.searchsorted(w.row, np.arange(n), side="right")
    return np.insert(w.row, ends, np.arange(n)), np.insert(w.hash, ends, END), np.insert(rare, ends, 0)


def _lookup(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, rare, n), summed over the task as far as it stays small."""
    held: list[tuple] = []
    size = 0

    def summed(parts: list[tuple]) -> tuple:
        token, rare, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        token, first, back = np.unique(token, return_index=True, return_inverse=True)
        return token, rare[first], np.bincount(back, weights=n).astype(np.int64)

    def batch(parts: list[tuple]) -> pa.RecordBatch:
        token, rare, n = summed(parts)
        return pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(rare.astype(np.int32)), pa.array(n)], names=["token", "rare", "n"])

    for w in word_slices(batches, fold=True):
        _, hashes, rare = tokens(w)
        held.append(summed([(hashes, rare, np.ones(len(hashes)))]))
        size += len(held[-1][0])
        if size > 3_000_000:
            held = [summed(held)]
            size = len(held[0][0])
            if size > 1_500_000:
                yield batch(held)
                held, size = [], 0
    if held:
        yield batch(held)


class Vocabulary:
    """Head words and frequent tokens (sorted hashes), totals, and what rare classes add up to."""

    def __init__(self, head: np.ndarray, head_id: np.ndarray, frequent: np.ndarray, counts: np.ndarray, n: int, v: int, rare_total: np.ndarray):
        self.sizes = sizes(v)
        self.head, self.head_id, self.frequent, self.counts, self.n, self.v = head, head_id, frequent, counts, n, v
        self.log_rare = np.log10(rare_total)

    def symbols(self, hashes: np.ndarray, rare: np.ndarray) -> np.ndarray:
        at = _lookup(self.head, hashes)
        return np.where(at >= 0, self.head_id[at] if len(self.head) else 0, self.sizes.head + rare)


def count_tokens(training: DataFrame) -> DataFrame:
    """token (hash), rare class and n of all training documents."""
    parts = training.select("text").mapInArrow(_count, "token long, rare int, n long")
    return materialize(parts.groupBy("token").agg(F.first("rare").alias("rare"), F.sum("n").alias("n")), "tokens")


def make_vocabulary(counted: DataFrame, frequent: int = FREQUENT) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and its first weights' biases: log counts of classes and head words."""
    totals = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # Counts fall into sixteenths of powers of two; the highest bins that hold at most ``frequent`` tokens together are taken,
    # and of the next one the share of smallest hashes that fills them up.
    # All whole bins are above a least one, so the test of a token stays the same however many bins there are.
    binned = counted.withColumn("bin", F.floor(F.log2("n") * 16).cast("int"))
    seen, whole, wanted = 0, None, F.lit(False)
    for r in sorted(binned.groupBy("bin").agg(F.count("*").alias("k")).collect(), key=lambda r: -r["bin"]):
        share = min(1.0, (frequent - seen) / r["k"])
        if share == 1:
            whole = r["bin"]
        else:
            wanted = (F.col("bin") == r["bin"]) & (F.col("token") < int((share - 0.5) * 2.0**64))
        seen += r["k"]
        if seen >= frequent:
            break
    if whole is not None:
        wanted = wanted | (F.col("bin") >= whole)
    top = binned.where(wanted).drop("bin").toPandas().sort_values(["n", "token"], ascending=[False, True])
    hashes, counts, rare = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), top["rare"].to_numpy(np.int64)
    by_rare = np.ones(RARE)
    for r in counted.groupBy("rare").agg(F.sum(F.col("n") + 1).alias("n")).collect():
        by_rare[r["rare"]] += r["n"]
    size = sizes(int(totals["v"]))
    head = min(size.head, len(top))
    np.subtract.at(by_rare, rare[:head], counts[:head] + 1.0)
    order = np.argsort(hashes[:head])
    all_order = np.argsort(hashes)
    vocabulary = Vocabulary(hashes[:head][order], order, hashes[all_order], counts[all_order], int(totals["n"] or 0), int(totals["v"]), by_rare)
    words = np.full(size.head, -30.0, dtype=np.float32)
    words[:head] = np.log(counts[:head] + 1.0)
    classes = np.full(size.out, -30.0, dtype=np.float32)
    mass = np.exp(words.reshape(size.classes, size.per_class).astype(float)).sum(axis=1)
    classes[: size.classes] = np.log(np.maximum(mass, 1e-13))
    classes[size.classes :] = np.log(by_rare)
    return vocabulary, np.concatenate([classes, words])


def contexts(symbol: np.ndarray, row: np.ndarray, size: Sizes) -> list[np.ndarray]:
    """Feature numbers of every token: previous, two back, three back, hashed pair."""
    out = []
    for k in (1, 2, 3):
        back = np.full(len(symbol), size.symbols - 1)
        ok = np.flatnonzero(row[k:] == row[:-k]) + k if len(row) > k else np.zeros(0, np.int64)
        back[ok] = symbol[ok - k]
        out.append(back)
    pair = mix((out[0] * size.symbols + out[1]).astype(np.uint64)) % np.uint64(size.pairs)
    return [*out, pair.astype(np.int64)]


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _logits(tables: list[np.ndarray], bias: np.ndarray, ctx: list[np.ndarray], symbol: np.ndarray, size: Sizes) -> tuple:
    """Class logits, wanted class, head tokens, their word logits, wanted word, and their rows in the last table."""
    x = np.take(tables[0], ctx[0], axis=0)
    x += bias[: size.out]
    for t, c in zip(tables[1:4], ctx[1:], strict=True):
        x += np.take(t, c, axis=0)
    is_head = symbol < size.head
    wanted = np.where(is_head, symbol // size.per_class, symbol - size.head + size.classes)
    head = np.flatnonzero(is_head)
    cls, word = symbol[head] // size.per_class, symbol[head] % size.per_class
    rows = ctx[0][head] * size.classes + cls
    y = np.take(tables[4], rows, axis=0)
    y += np.take(bias[size.out :].reshape(size.classes, size.per_class), cls, axis=0)
    return x, wanted, head, y, word, rows


def log_probabilities(tables: list[np.ndarray], bias: np.ndarray, ctx: list[np.ndarray], symbol: np.ndarray, size: Sizes) -> np.ndarray:
    """Natural logs of P(class | context), times P(word | class, context) for head words."""
    out = np.empty(len(symbol))
    for i in range(0, len(symbol), 1 << 15):
        part = slice(i, i + (1 << 15))
        x, wanted, head, y, word, _ = _logits(tables, bias, [c[part] for c in ctx], symbol[part], size)
        p = _softmax(x)[np.arange(len(wanted)), wanted].astype(float)
        if len(head):
            p[head] *= _softmax(y)[np.arange(len(word)), word]
        out[part] = np.log(np.maximum(p, 1e-30))
    return out


def _step(table: np.ndarray, square: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """One AdaGrad step on the rows in use."""
    order = np.argsort(rows.astype(np.uint16) if len(table) <= 1 << 16 else rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    g = np.add.reduceat(np.take(gradient, order, axis=0), first, axis=0)
    at = ordered[first]
    seen[at] += np.diff(np.append(first, len(order)))
    now = np.take(square, at, axis=0)
    now += g * g
    square[at] = now
    np.sqrt(now, out=now)
    now += 1e-3
    g *= rate
    g /= now
    table[at] -= g


def _train(batches: Iterator[pa.RecordBatch], tables: list[np.ndarray], bias: np.ndarray, vocabulary: Vocabulary, rate: float) -> Iterator[pa.RecordBatch]:
    old, tables = tables, [t.copy() for t in tables]
    squares = [np.full_like(t, 0.1) for t in tables]
    seen = [np.zeros(len(t), dtype=np.int64) for t in tables]
    size = vocabulary.sizes
    for w in word_slices(batches, fold=True):
        row, hashes, rare = tokens(w)
        symbol = vocabulary.symbols(hashes, rare)
        ctx = contexts(symbol, row, size)
        for i in range(0, len(symbol), BATCH):
            part = slice(i, i + BATCH)
            now = [c[part] for c in ctx]
            x, wanted, head, y, word, rows = _logits(tables, bias, now, symbol[part], size)
            g = _softmax(x)
            g[np.arange(len(wanted)), wanted] -= 1
            for k in range(4):
                _step(tables[k], squares[k], seen[k], now[k], g, rate)
            if len(head):
                g = _softmax(y)
                g[np.arange(len(word)), word] -= 1
                _step(tables[4], squares[4], seen[4], rows, g, rate)
    for k, (a, b, n) in enumerate(zip(tables, old, seen, strict=True)):
        rows = np.flatnonzero(n)
        if len(rows):
            block = rows // BLOCK
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            yield _blocks(k, block[first], np.append(first, len(rows)), rows % BLOCK, n[rows], a[rows] - b[rows])


def _blocks(k: int, block: np.ndarray, cuts: np.ndarray, rows: np.ndarray, n: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    at, values = pa.array(cuts.astype(np.int32)), pa.array((cuts * change.shape[1]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int64))) for x in (rows, n)] + [pa.ListArray.from_arrays(values, pa.array(change.ravel().astype(np.float32)))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(block), k, dtype=np.int32)), pa.array(block.astype(np.int64)), *lists], names=["k", "block", "row", "n", "change"])


CHANGE_SCHEMA = "k int, block long, row array<long>, n array<long>, change array<float>"


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's mean change by row, weighted by how often the tasks met the row; the blocks of a partition are held."""
    held: dict[tuple, tuple] = {}
    for batch in batches:
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            row, n, change = (batch.column(j)[i].values.to_numpy() for j in (2, 3, 4))
            change = change.reshape(len(row), -1)
            count, total = held.setdefault(key, (np.zeros(BLOCK, dtype=np.int64), np.zeros((BLOCK, change.shape[1]))))
            count[row] += n
            total[row] += n[:, None] * change
    for (k, block), (count, total) in held.items():
        row = np.flatnonzero(count)
        yield _blocks(k, np.array([block]), np.array([0, len(row)]), row, count[row], total[row] / count[row, None])


def train(training: DataFrame, vocabulary: Vocabulary, bias: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> list[np.ndarray]:
    """Weights after some rounds, each over its share of all documents."""
    spark = training.sparkSession
    tables = [np.zeros(shape, dtype=np.float32) for shape in vocabulary.sizes.shapes]
    tasks = max(TASKS, vocabulary.n // TASK_TOKENS)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((tables, bias, vocabulary))
        part = training.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k).select("text").coalesce(tasks)
        changes = part.mapInArrow(lambda b, s=shared: _train(b, *s.value, rate), CHANGE_SCHEMA)
        mean = changes.repartition("k", "block").mapInArrow(_averaged, CHANGE_SCHEMA).toArrow()
        for batch in mean.to_batches():
            for i, (t, block) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                row, change = batch.column(2)[i].values.to_numpy(), batch.column(4)[i].values.to_numpy()
                tables[t][block * BLOCK + row] += change.reshape(len(row), -1)
        shared.unpersist()
    return tables


def _score(batches: Iterator[pa.RecordBatch], tables: list[np.ndarray], bias: np.ndarray, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Sums over tokens with known counts, and the other tokens with how often each occurs in the row."""
    key = TaskContext.get().partitionId() << 40
    for w in word_slices(batches, fold=True):
        n = w.batch.num_rows
        row, hashes, rare = tokens(w)
        symbol = vocabulary.symbols(hashes, rare)
        logs = log_probabilities(tables, bias, contexts(symbol, row, vocabulary.sizes), symbol, vocabulary.sizes) / np.log(10)
        at = _lookup(vocabulary.frequent, hashes)
        known = at >= 0
        count_log = np.where(known, np.log10((vocabulary.counts[at] if len(vocabulary.counts) else np.zeros(len(at))) + 1.0), 0.0)
        is_rare = symbol >= vocabulary.sizes.head
        score = logs + np.where(is_rare, count_log - vocabulary.log_rare[rare], 0.0)
        total = lambda x: np.bincount(row, weights=x, minlength=n)
        other = np.flatnonzero(~known)
        order = other[np.lexsort((hashes[other], row[other]))]
        r, h = row[order], hashes[order]
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, np.int64)
        offsets = pa.array(np.searchsorted(r[first], np.arange(n + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(key, key + n)), column(w, "doc_id"), pa.array(np.bincount(row, minlength=n)), pa.array(total(known).astype(np.int64)),
                pa.array(total(count_log)), pa.array(total(score)),
                pa.ListArray.from_arrays(offsets, pa.array(signed(h[first]))), pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(first, len(r))))),
            ],
            names=["row_key", "doc_id", "n_tokens", "n_known", "count_log", "score", "others", "times"],
        )
        key += n


SCORE_SCHEMA = "row_key long, doc_id long, n_tokens long, n_known long, count_log double, score double, others array<long>, times array<long>"


def score_documents(documents: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    counted = count_tokens(training)
    vocabulary, bias = make_vocabulary(counted)
    tables = train(training, vocabulary, bias)
    shared = documents.sparkSession.sparkContext.broadcast((tables, bias, vocabulary))  # of the sizes that the distinct tokens ask for
    scored = materialize(documents.select("doc_id", "text").mapInArrow(lambda b: _score(b, *shared.value), SCORE_SCHEMA), "scored")
    others = scored.select("row_key", F.explode(F.arrays_zip("others", "times")).alias("e")).select("row_key", F.col("e.others").alias("token"), F.col("e.times").alias("times"))
    found = others.join(counted.select("token", "n"), "token").groupBy("row_key").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_log")
    )
    base = float(np.log10(vocabulary.n + vocabulary.v + 1))
    joined = scored.drop("others", "times").join(found, "row_key", "left").fillna({"more": 0, "more_log": 0.0})
    return joined.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("count_log") + F.col("more_log") - F.col("n_tokens") * base).alias("base_score"), (F.col("score") + F.col("more_log")).alias("score"),
    )
