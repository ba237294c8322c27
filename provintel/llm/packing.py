"""Packing by cutting-stock column generation.

Documents are tokenized and cut into pieces of ``capacity`` ids and a remainder. Piece lengths, rounded up to a multiple
of ``unit``, give a histogram of at most capacity/unit classes, the only thing that reaches the driver. There a linear
program over patterns (how many pieces of each class fill a sequence) is solved by column generation: a basis gives
class prices, an unbounded-knapsack dynamic program finds the pattern worth most, and the simplex takes it in until none
is worth more than one sequence. Patterns are used a whole number of times (rounded down); what is left is packed
largest first into patterns of its own. Pieces are then ranked within their class on Spark and the k-th piece of a class
takes the k-th place that the patterns have for it.

Defined cases: null text is empty and still has its end id; a document longer than a sequence is cut; repeated rows are
packed each; no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .words import slices

CAPACITY, UNIT, END_ID = 4096, 8, 2
CACHED_CHUNKS = 400_000
GROUP_BYTES = 2 << 20  # of text whose distinct chunks are looked up together
# Byte-level tokenizers write printable bytes as themselves and the others as the characters from 256 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, n_cut long"


class ChunkIds:
    """Ids of texts as little-endian unsigned 32-bit bytes, by space-free chunks that are cached up to a number of chunks.

    The tokenizer splits at white space before anything else, so a text's ids are those of its chunks in turn. A chunk
    of Latin-1 letters and then ASCII punctuation is two tokens of the tokenizer's own split, which drops case; it is put
    together from those parts. Lower-case Latin-1 letters are past what normalising and splitting change, so the merges are
    applied to their byte characters at once; what else isn't cached yet is encoded in one call. The cache has two
    generations of at most half the chunks: when the younger is full the older goes, and what is met again moves to the younger.
    """

    def __init__(self, path: str, most: int = CACHED_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge, self.most, self.known, self.older = tokenizer.encode, tokenizer.model.tokenize, most // 2, {"": b""}, {}
        self.split = re.compile(r"([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
        self.simple = re.compile(r"[a-z\xDF-\xF6\xF8-\xFF]+").fullmatch

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) + len(chunks) > self.most:
            self.known, self.older = {"": b""}, self.known
        self._recall(chunks)
        new, parts, plain = chunks.difference(self.known), {}, set()
        for c in new:
            if c.isascii() and c.isalpha() and c.islower():
                plain.add(c)
                continue
            m = self.split(c)
            if m and (m[2] or not c.islower()):
                parts[c] = m[1].lower(), m[2]
                plain.update(parts[c])
            else:
                plain.add(c)
        self._recall(plain)
        words = []
        for w in plain.difference(self.known):
            if w.isascii() and w.isalpha():  # what isn't lower-case was lowered above
                self.known[w] = array("I", [t.id for t in self.merge(w)]).tobytes()
            elif self.simple(w):
                self.known[w] = array("I", [t.id for t in self.merge(w.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()
            else:
                words.append(w)
        if words:
            found = self.encode(words, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4").tobytes()
            ends = np.searchsorted(np.array(found.word_ids), np.arange(len(words)), side="right").tolist()
            at = 0
            for w, end in zip(words, ends, strict=True):
                self.known[w] = ids[4 * at : 4 * end]
                at = end
        for c, (letters, marks) in parts.items():
            self.known[c] = self.known[letters] + self.known[marks]

    def _recall(self, chunks: set[str]) -> None:
        self.known.update((c, self.older[c]) for c in chunks.difference(self.known) if c in self.older)

    def texts(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]


@lru_cache(maxsize=1)
def _shared_ids(path: str) -> ChunkIds:
    """One cache per Python worker, kept over its tasks."""
    return ChunkIds(path)


def cut_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: full pieces first, then the remainder."""
    end = np.array([end_id], dtype="<u4").tobytes()
    types = [pa.int64()] * 6
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "n_cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _shared_ids(tokenizer)
        for part, _, _ in slices(batches, most=GROUP_BYTES):
            out = []
            for doc, ids in zip(part.column(0).to_pylist(), ids_of.texts([t or "" for t in part.column(1).to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    out.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, k))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most value that fits, and how many of each size give it."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        k = np.searchsorted(sizes, w, side="right")  # sizes ascend
        best[w], pick[w] = best[w - 1], -1
        if k:
            v = best[w - sizes[:k]] + values[:k]
            i = int(v.argmax())
            if v[i] > best[w] + 1e-12:
                best[w], pick[w] = v[i], i
    counts, w = np.zeros(len(sizes), dtype=np.int64), capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            counts[pick[w]] += 1
            w -= sizes[pick[w]]
    return float(best[capacity]), counts


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_steps: int = 3000) -> list[tuple[int, np.ndarray]]:
    """(times, counts by class) covering the demand exactly; sizes ascend and fit the capacity."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    inverse, x = np.diag(1.0 / (capacity // sizes)), demand / (capacity // sizes)
    # Products are summed by numpy itself: linear-algebra threads have hung in a driver that had started the JVM.
    product = lambda a, b: np.einsum("ij,jk->ik", a, b)
    for step in range(max_steps):
        value, counts = price(inverse.sum(axis=0), sizes, capacity)  # every pattern costs one sequence
        if value <= 1 + 1e-6:
            break
        way = (inverse * counts).sum(axis=1)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        basis[:, out] = counts
        if step % 200 == 199:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
            inverse += product(inverse, np.eye(m) - product(basis, inverse))  # takes the rounding errors out
            x = np.maximum((inverse * demand).sum(axis=1), 0)
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
    left, found = demand.astype(np.int64).copy(), []
    for i in np.argsort(-x):
        counts = np.rint(basis[:, i]).astype(np.int64)
        used = counts > 0
        times = min(int(x[i] + 1e-6), int((left[used] // counts[used]).min())) if used.any() else 0
        if times > 0:
            found.append((times, counts))
            left -= times * counts
    while left.any():  # largest first; at most a pattern for each basic one that was rounded down
        room, counts = capacity, np.zeros(m, dtype=np.int64)
        for c in range(m - 1, -1, -1):
            counts[c] = min(left[c], room // sizes[c])
            room -= counts[c] * sizes[c]
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        found.append((times, counts))
        left -= times * counts
    return found


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    pieces = materialize(cut_pieces(documents, tokenizer, capacity, end_id), "pieces").withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    histogram = sorted((r["class"], r["n"]) for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in histogram)
    sizes, demand = (np.array([h[i] for h in histogram], dtype=np.int64) for i in (0, 1))
    slots, taken, sequence = [], dict.fromkeys(sizes.tolist(), 0), 0
    for times, counts in solve_patterns(sizes, demand, capacity // unit):
        for c in np.flatnonzero(counts):
            size, per = int(sizes[c]), int(counts[c])
            slots.append((size, taken[size], taken[size] + times * per, per, sequence))
            taken[size] += times * per
        sequence += times
    slot_table = spark.createDataFrame(slots, "class int, lo long, hi long, per long, first_sequence long")
    # Ranks within a class come from ranks within its salted parts, and the sizes of the parts before.
    parts = max(8, -(-total // 100_000))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("class", "part").agg(F.count("*").alias("n")).select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["class", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(slot_table), "class").where("rank >= lo and rank < hi").withColumn("sequence_id", F.expr("first_sequence + (rank - lo) div per"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"),
    )
