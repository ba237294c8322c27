"""Ranked lexical search, reversed: documents stream through an inverted index over the items' terms.

Items (the queries) are dealt into blocks of about ``POSTINGS`` terms, so the index that a block broadcasts is bounded
whatever the table of items; all documents pass through each block. Of a block:

1. each document's terms are looked up in the index by hash, compared byte by byte, and counted. Its term counts and its
   length are written to the shared folder; df, N and L are counted from them on Spark;
2. term counts stream through the index, batch by batch, into sums of (document, item); each task keeps the ``top`` best
   documents of each item, so that what it holds is bounded by the block;
3. tasks' lists are merged on Spark, in two rounds, so that no item's lists meet in one task all at once.

Scores are exact 64-bit integers. Defined cases: null text has no terms; a document without terms counts nowhere; rows of
one doc_id are documents of their own; rows of one item_id (null too) are one item with the terms of all; of equal scores
the smaller doc_id ranks first, a null one last; an item without terms or hits, and empty tables, give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .words import Words, column, word_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POSTINGS = 400_000
CELLS = 1 << 21
SALTS = 32


class Index(NamedTuple):
    """A block's terms in order of hash (with their bytes), and the items that hold each of them."""

    items: list
    hash: np.ndarray
    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    deepest: int
    first: np.ndarray
    postings: np.ndarray


def build_index(rows: list[tuple]) -> tuple[Index, list[str]]:
    """The index of rows (item_id, its distinct terms), and the terms in its order."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    names = sorted({t for _, terms in rows for t in terms})
    (words,) = word_slices(iter([pa.record_batch({"text": pa.array(names, pa.string())})]), fold=False, most=1 << 62, outside=OUTSIDE) if names else (None,)
    if words is None:
        return Index([r[0] for r in rows], *[np.zeros(0, np.int64)] * 4, 0, np.zeros(1, np.int64), np.zeros(0, np.int64)), []
    order = np.argsort(words.hash, kind="stable")
    place = {names[k]: i for i, k in enumerate(order)}
    term, item = np.array([(place[t], i) for i, (_, terms) in enumerate(rows) for t in terms], dtype=np.int64).T
    by_term = np.argsort(term, kind="stable")
    first = np.searchsorted(term[by_term], np.arange(len(names) + 1))
    hashes = words.hash[order]
    deepest = int(np.unique(hashes, return_counts=True)[1].max())
    index = Index([r[0] for r in rows], hashes, words.data.copy(), words.start[order], (words.end - words.start)[order], deepest, first, item[by_term])
    return index, [names[k] for k in order]


def look_up(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that are terms of the index, and their terms; equal hashes count only with equal bytes."""
    left, length = np.searchsorted(index.hash, words.hash), words.end - words.start
    at, terms = [], []
    for k in range(index.deepest):
        term = np.minimum(left + k, len(index.hash) - 1)
        like = np.flatnonzero((index.hash[term] == words.hash) & (index.length[term] == length))
        term, n = term[like], length[like]
        begin = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(begin, n)
        differ = words.data[np.repeat(words.start[like], n) + inside] != index.data[np.repeat(index.start[term], n) + inside]
        same = np.add.reduceat(differ, begin) == 0 if len(n) else np.zeros(0, bool)
        at.append(like[same])
        terms.append(term[same])
    return (np.concatenate(at), np.concatenate(terms)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _count(index: Index):
    """A task's function: each document with terms, its length, its index terms and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in word_slices(batches, fold=True, outside=OUTSIDE):
            rows, size = words.batch.num_rows, max(len(index.hash), 1)
            at, term = look_up(words, index)
            key, times = np.unique(words.row[at] * size + term, return_counts=True)
            ends = pa.array(np.searchsorted(key // size, np.arange(rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((key % size, pa.int32()), (times, pa.int64()))]
            yield pa.record_batch([column(words, "doc_id"), pa.array(np.bincount(words.row, minlength=rows), pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    return run


class Heaps:
    """The best documents of each item, at most ``top`` after each trim."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, dtype=np.int64)
        self.held = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, whether doc_id is null, doc_id
        self.late = []

    def offer(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """scores: a row a document, a column an item."""
        if len(scores) > self.top:
            self.least = np.maximum(self.least, np.partition(scores, len(scores) - self.top, axis=0)[len(scores) - self.top])
        row, item = np.nonzero(scores >= self.least)
        self.late.append((item, scores[row, item], null[row], doc[row]))
        if sum(len(x[0]) for x in self.late) > CELLS:
            self.trim()

    def trim(self) -> list[np.ndarray]:
        item, score, null, doc = (np.concatenate(x) for x in zip(self.held, *self.late, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item, score, null, doc = (x[order] for x in (item, score, null, doc))
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.held, self.late = [x[rank < self.top] for x in (item, score, null, doc)], []
        full = rank == self.top - 1
        self.least[item[full]] = np.maximum(self.least[item[full]], score[full])
        return self.held


def _score(index: Index, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    """A task's function: the best documents of each item, over all of the task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, items = Heaps(len(index.items), top), len(index.items)
        step = max(1, CELLS // max(items, 1))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                doc_id, n, terms, times = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n", "terms", "times"))
                term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, times))
                row = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False))
                m = 10 + (90 * n.to_numpy(zero_copy_only=False) * n_docs) // n_terms
                worth = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                scores = np.zeros(batch.num_rows * items, dtype=np.int64)
                reach = index.first[term + 1] - index.first[term]
                ends = np.cumsum(reach)
                k = 0
                while k < len(term):  # postings in steps of about CELLS
                    to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + CELLS, side="right")))
                    r = reach[k:to]
                    inside = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)
                    item = index.postings[np.repeat(index.first[term[k:to]], r) + inside]
                    np.add.at(scores, np.repeat(row[k:to], r) * items + item, np.repeat(worth[k:to], r))
                    k = to
                null = doc_id.is_null().to_numpy(zero_copy_only=False)
                heaps.offer(scores.reshape(-1, items), doc_id.fill_null(0).to_numpy(zero_copy_only=False), null.astype(np.int64))
        item, score, null, doc = heaps.trim()
        names = pa.array(index.items, pa.int64()).take(pa.array(item))
        yield pa.record_batch([names, pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    return run


def _merged(lists: DataFrame, top: int) -> DataFrame:
    """Each item's best rows of all tasks' lists: first of a share of the tasks, then of all."""
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy("item_id", "_salt").orderBy(*best))
    shares = lists.withColumn("_salt", F.spark_partition_id() % SALTS).withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): each item's distinct terms, sorted; items without terms are left out."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    terms = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(words).alias("term")).distinct()
    return terms.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def search(documents: DataFrame, items: DataFrame, top: int = 10, postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0."""
    spark = documents.sparkSession
    wanted = materialize(item_terms(items), "items")
    blocks = -(-(wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) // postings)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        index, names = build_index([tuple(r) for r in rows])
        sent = spark.sparkContext.broadcast(index)
        counted = texts.mapInArrow(lambda b, sent=sent: _count(sent.value)(b), "doc_id long, n long, terms array<int>, times array<long>").where("n > 0")
        counted = materialize(counted, "term-counts")
        n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(names), dtype=np.int64)
        for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[r[0]] = r[1]
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        worth = spark.sparkContext.broadcast(weights)
        best = counted.mapInArrow(lambda b, sent=sent, worth=worth, d=n_docs, t=n_terms: _score(sent.value, worth.value, d, t or 1, top)(b), "item_id long, doc_id long, score long")
        found = found.unionByName(_merged(best, top))
    return found
