"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct shingles. Equal sets are one class, kept once. Of a class, one permutation of shingle
hashes gives ``bins`` minima; empty bins borrow from a bin that a hash of (bin, attempt) picks (optimal densification).
Sets of under 5/4 of ``SMALL`` shingles also get independent minima, as few filled bins vary much. ``rows`` bins make a band's
bucket. In each bucket one hub - the member with most company over all buckets, which in a family of copies is the one
nearest to all - is compared with the others on full sets, a star. Comparisons also leave bit sketches of what a member
lacks of its hub and what it adds. They bound from above what two members of a hub's family share, exactly, so of the
members a hub did not link, only pairs that may reach the threshold are compared on full sets. Thus no link of a shared
bucket is lost to the choice of hubs, and families of thousands do not give all their pairs.

With 32 bands of 4, a pair at similarity 0.8 misses all buckets with probability 5e-8.

Defined cases: a single word is a shingle by itself; null or word-less text has an empty set, no link, and stays, as does a null doc_id; rows
that share a doc_id count as one document's, whose links are those of its least set, and share its component; ties go to the smallest doc_id; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..components import components
from ..session import broadcast_if_small, materialize
from .words import Words, column, mix, runs, signed, word_slices

BINS, ROWS, SMALL = 128, 4, 64
SIMILARITY, WORDS = 80, 5
SKETCH = 256
FAMILY = 2000  # members of a hub that meet its unlinked ones in one block
PAIR_SCHEMA = "a long, b long, n_a long, n_b long, both long, less array<long>, more array<long>"
SIGNATURE_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
_ATTEMPTS = 64
_U = np.uint64


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distinct shingle hashes, sorted by row, then hash."""
    hashes, at = runs(words.hash, words.row, size)
    row = words.row[at]
    count = np.bincount(words.row, minlength=words.batch.num_rows)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):  # fewer words than a shingle: all of them make one
        first = np.searchsorted(words.row, short)
        whole = np.array([_U(n) for n in count[short]], dtype=np.uint64)
        for k in range(int(count[short].max())):
            whole = np.where(k < count[short], whole * _U(0x9E3779B97F4A7C15) + words.hash[np.minimum(first + k, len(words.hash) - 1)], whole)
        row, hashes = np.concatenate([row, short]), np.concatenate([hashes, mix(whole ^ _U(0x5851F42D4C957F2D))])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])]) if len(row) else np.zeros(0, bool)
    return row[new], hashes[new]


def _borrow(bins: int) -> np.ndarray:
    """For each attempt, the bin that each bin looks at."""
    t, i = np.meshgrid(np.arange(_ATTEMPTS), np.arange(bins), indexing="ij")
    return (mix((t * bins + i + 1).astype(np.uint64)) % _U(bins)).astype(np.int64)


def one_permutation(n_rows: int, row: np.ndarray, hashes: np.ndarray, bins: int, borrow: np.ndarray) -> np.ndarray:
    """Densified minima by row and bin; hashes ascend within a row. Rows without hashes give zeros."""
    shift = _U(64 - (bins - 1).bit_length())
    cell = row * bins + (hashes >> shift).astype(np.int64)
    out, full = np.zeros(n_rows * bins, dtype=np.uint64), np.zeros(n_rows * bins, dtype=bool)
    first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
    out[cell[first]], full[cell[first]] = hashes[first], True
    out, full = out.reshape(n_rows, bins), full.reshape(n_rows, bins)
    some = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    values, have = out[some], full[some]
    done, result = have.copy(), values.copy()
    for t in range(_ATTEMPTS):
        take = ~done & have[:, borrow[t]]
        result[take] = values[:, borrow[t]][take]
        done |= take
        if done.all():
            break
    for i in np.flatnonzero(~done.all(axis=1)):  # sets of a shingle or two: the next full bin
        filled = np.flatnonzero(have[i])
        empty = np.flatnonzero(~done[i])
        result[i, empty] = values[i, filled[np.searchsorted(filled, empty) % len(filled)]]
    out[some] = result
    return out


def independent_minima(row: np.ndarray, hashes: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and their minima under so many hash functions."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    salts = mix(np.arange(1, bins + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95))
    return row[first], np.stack([np.minimum.reduceat(mix(hashes ^ salt), first) for salt in salts], axis=1)


def _bands(minima: np.ndarray, rows: int, tag: int) -> np.ndarray:
    n, bins = minima.shape
    parts = minima.reshape(n, bins // rows, rows)
    key = np.arange(bins // rows, dtype=np.uint64)[None, :] + _U(tag) + np.zeros((n, 1), np.uint64)
    for k in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def _signatures(batches: Iterator[pa.RecordBatch], size: int, bins: int, rows: int) -> Iterator[pa.RecordBatch]:
    borrow = _borrow(bins)
    for w in word_slices(batches, fold=True):
        n = w.batch.num_rows
        row, hashes = shingle_sets(w, size)
        count = np.bincount(row, minlength=n)
        sets = np.zeros((2, n), dtype=np.uint64)
        keys, key_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            for k, salt in enumerate((_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))):
                sets[k, row[first]] = np.add.reduceat(mix(hashes ^ salt), first)
            have = np.flatnonzero(count)
            main = _bands(one_permutation(n, row, hashes, bins, borrow)[have], rows, 0)
            keys, key_row = main.ravel(), np.repeat(have, main.shape[1])
            few = (count < SMALL * 5 // 4)[row]
            if few.any():
                rows_few, minima = independent_minima(row[few], hashes[few], bins)
                more = _bands(minima, rows, 1 << 20)
                keys, key_row = np.concatenate([keys, more.ravel()]), np.concatenate([key_row, np.repeat(rows_few, more.shape[1])])
                order = np.argsort(key_row, kind="stable")
                keys, key_row = keys[order], key_row[order]
        offsets = np.searchsorted(key_row, np.arange(n + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [column(w, "doc_id"), pa.array(count), pa.array(signed(sets[0])), pa.array(signed(sets[1])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(keys)))],
            names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for w in word_slices(batches, fold=True):
        row, hashes = shingle_sets(w, size)
        offsets = np.searchsorted(row, np.arange(w.batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([column(w, "doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(hashes)))], names=["doc_id", "shingles"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs of sets: common shingles, and bit sketches of what only the first and only the second has."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            sets = [part.column(part.schema.get_field_index(c)) for c in ("set_of_a", "set_of_b")]
            both, less, more = [], [], []
            for i in range(part.num_rows):
                x, y = (c[i].values.to_numpy().view(np.uint64) for c in sets)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = x[at] == y
                only = np.ones(len(x), dtype=bool)
                only[at[common]] = False
                both.append(int(common.sum()))
                for out, rest in ((less, x[only]), (more, y[~common])):
                    flags = np.zeros(SKETCH, dtype=bool)
                    flags[(mix(rest) >> _U(64 - SKETCH.bit_length() + 1)).astype(np.int64)] = True
                    out.append(np.packbits(flags).view(np.int64))
            keep = [part.column(part.schema.get_field_index(c)) for c in ("a", "b")]
            sizes = [pa.array([len(c[i].values) for i in range(part.num_rows)], pa.int64()) for c in sets]
            yield pa.RecordBatch.from_arrays(
                [*keep, *sizes, pa.array(both, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (less, more))], names=["a", "b", "n_a", "n_b", "both", "less", "more"]
            )


def compare_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their sets' sizes, how many shingles they share, and sketches of a without b (less) and b without a (more)."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_of_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "set_of_a", "set_of_b").mapInArrow(_compare, PAIR_SCHEMA)


def _similar(both: Column, n: Column, m: Column, similarity: int) -> Column:
    return (100 + similarity) * both >= similarity * (n + m)


def _alone(x: str, y: str) -> Column:
    """Bits of sketch x that y lacks; each stands for an element, or more, that only x has."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(1, SKETCH // 64)), F.bit_count(F.get(x, F.lit(0)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(0))))))


def near_duplicates(documents: DataFrame, size: int = WORDS, similarity: int = SIMILARITY, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; similarity in hundredths."""
    signed_docs = materialize(documents.select("doc_id", "text").mapInArrow(lambda b: _signatures(b, size, bins, rows), SIGNATURE_SCHEMA), "signatures")
    linkable = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    real = signed_docs.where(linkable)
    classes = materialize(real.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "classes")
    members = classes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    crowded = materialize(members.join(shared, "bucket"), "crowded")
    # The hub of a bucket is its member with most company over all buckets: of a family of copies, the one nearest to all.
    company = crowded.groupBy("node").agg(F.sum("members").alias("company"))
    ranked = crowded.join(company, "node").select("bucket", F.struct("company", (-F.col("node")).alias("minus")).alias("by"))
    hubs = ranked.groupBy("bucket").agg((-F.max("by")["minus"]).alias("hub"))
    stars = materialize(crowded.join(hubs, "bucket").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    involved = broadcast_if_small(crowded.select(F.col("node").alias("doc_id")).distinct())
    texts = documents.select("doc_id", "text").join(involved, "doc_id", "left_semi")
    sets = texts.mapInArrow(lambda b: _sets(b, size), "doc_id long, shingles array<long>").groupBy(F.col("doc_id").alias("node")).agg(F.min("shingles").alias("shingles"))
    sets = materialize(sets, "sets")
    family = materialize(compare_sets(stars, sets), "family")
    links = family.where(_similar(F.col("both"), F.col("n_a"), F.col("n_b"), similarity)).select("a", "b")
    found = components(links)
    # Members that their hub did not link: sketches against the hub bound what two of them, or one and a linked one, share.
    label = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_c"))
    known = family.join(label("a"), "a", "left").join(label("b"), "b", "left").select(
        "a", "b", F.coalesce("a_c", "a").alias("a_c"), F.coalesce("b_c", "b").alias("b_c"), F.col("n_a").alias("n_hub"), F.col("n_b").alias("n"), "both", "less", "more"
    )
    # A large family meets its unlinked members block by block.
    blocks = family.groupBy("a").agg(F.ceil(F.count("*") / FAMILY).alias("blocks"))
    known = known.join(broadcast_if_small(blocks), "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks"))
    out = known.where("a_c <> b_c").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"x_{c}") for c in ("b", "b_c", "n", "both", "less", "more")])
    joined_less = F.col("n_hub") - F.col("x_both") - _alone("x_less", "less")  # removals the two may share
    joined_more = F.col("x_n") - F.col("x_both") - _alone("x_more", "more")  # additions the two may share
    most = F.col("x_both") + F.col("both") - F.col("n_hub") + joined_less + joined_more
    twice = (F.col("b_c") == F.col("a_c")) | (F.col("x_b") < F.col("b"))
    maybe = known.join(out, ["a", "block"]).where((F.col("x_b_c") != F.col("b_c")) & twice & _similar(most, F.col("x_n"), F.col("n"), similarity))
    pairs = materialize(maybe.select(F.col("x_b").alias("a"), "b").distinct(), "pairs")
    if not pairs.isEmpty():
        more_links = materialize(compare_sets(pairs, sets).where(_similar(F.col("both"), F.col("n_a"), F.col("n_b"), similarity)).select("a", "b"), "links")
        found = components(links.unionByName(more_links))
    of_class = classes.select("set_a", "set_b", "node").join(found, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    linked = real.select("doc_id", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"])
    empty = signed_docs.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    every = linked.select("doc_id", "n_shingles", "component").unionByName(empty)
    return every.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))
