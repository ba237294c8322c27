"""Substring dedup with a log-structured fingerprint index.

A window is ``width`` consecutive words. In each window the 4-gram of least hash is its anchor; neighbouring windows with
the same anchor make a stretch (13 to 22 words). Equal windows have equal anchors, so only stretches are exchanged:
(anchor hash, stretch hash, document, place), packed by bucket of the anchor hash. Within a map slice only a stretch's
first document goes out - its later documents are repeats already - so a passage in a third of all documents adds one
entry a slice, not one a document.

A run of the index is immutable: per bucket, the sorted (anchor, stretch) hashes of one batch and the first document of
each. A batch is sorted by bucket and merge-joined with the runs, of which only rows with one of its anchors go on: a
stretch that an earlier document has is all repeats. Anchors with several different stretches are verified window by
window: their first owners' texts are read again and their windows are resolved the same way, by two 64-bit hashes of the
words' bytes that come from different byte values. The batch's own run is appended, and runs are compacted into one when
there are ``fanout`` of them. With a path, runs stay there and a later job opens the index again.

Defined cases: null text has no words; texts shorter than a window keep everything; a repeat inside one document does not
count; doc_id identifies a document, rows that share one are judged alike; extra columns are kept; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from .words import PRIME, Words, column, mix, other_hashes, powers, signed, word_slices

WIDTH, GRAM = 13, 4
ENTRY_SCHEMA = "bucket long, kind int, doc array<long>, key array<long>, check array<long>, pos array<long>, len array<long>"
NEW, PAST, REPEAT, UNCLEAR, RUN = range(5)
BUCKET_BYTES = 8 << 20
_NAMES = ["doc", "key", "check", "pos", "len"]


def entry_batch(bucket: np.ndarray, kind: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """One row per distinct bucket; entries must be sorted by bucket."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(first, len(bucket)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64) if x.dtype != np.uint64 else signed(x))) for x in arrays]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(np.full(len(first), kind, dtype=np.int32)), *lists], names=["bucket", "kind", *_NAMES])


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values, the place of the first least one."""
    best, place, span = values, np.arange(len(values)), 1
    while 2 * span <= width:
        less = best[span:] < best[:-span]
        best, place, span = np.where(less, best[span:], best[:-span]), np.where(less, place[span:], place[:-span]), 2 * span
    n, k = len(values) - width + 1, width - span
    return np.where(best[k : k + n] < best[:n], place[k : k + n], place[:n])


def stretches(w: Words, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """First word, number of windows, anchor hash and stretch hash of each stretch of a slice."""
    n = len(w.hash) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    size = len(w.hash) - gram + 1
    grams = np.zeros(size, dtype=np.uint64)
    for k in range(gram):
        grams = grams * PRIME + w.hash[k : k + size]
    grams = mix(grams)
    anchor = least_places(grams, width - gram + 1)
    at = np.flatnonzero(w.row[:n] == w.row[width - 1 :])
    if not len(at):
        return at, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    anchor = anchor[at]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    count, start = np.diff(np.append(first, len(at))), at[first]
    prefix, down = word_prefix(other_hashes(w))
    end = start + count + width - 1
    check = mix((prefix[end] - prefix[start]) * down[start] + (anchor[first] - start).astype(np.uint64))
    return start, count, grams[anchor[first]], check


def word_prefix(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) * up[:-1], out=prefix[1:])
    return prefix, down


def send(entries: list[np.ndarray], buckets: int, n: int) -> Iterator[pa.RecordBatch]:
    """Packs (doc, key, check, pos, len): first documents of each (key, check) to their bucket, later ones as repeats."""
    doc, key, check, pos, size = entries
    if not len(doc):
        return
    order = np.lexsort((doc, check, key))
    doc, key, check, pos, size = (x[order] for x in (doc, key, check, pos, size))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
    first = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = doc > first
    if late.any():
        d, p, s = merge_spans(doc[late], pos[late], size[late])
        nothing = np.zeros(len(d), dtype=np.int64)
        yield entry_batch(np.full(len(d), -1 - n % buckets), REPEAT, [d, nothing, nothing, p, s])
    own = ~late
    bucket = (key[own] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    yield entry_batch(bucket[order], NEW, [x[own][order] for x in (doc, key, check, pos, size)])


def merge_spans(doc: np.ndarray, pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a document as one."""
    order = np.lexsort((pos, doc))
    doc, pos, end = doc[order], pos[order], (pos + size)[order]
    lift = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)])) * (int(end.max(initial=0)) + 2)
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], (pos + lift)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], pos[first], reach[last] - lift[first] - pos[first]


def _map_stretches(batches: Iterator[pa.RecordBatch], width: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for n, w in enumerate(word_slices(batches)):
        start, count, anchor, check = stretches(w, width, gram)
        row = w.row[start]
        doc = column(w, "doc_id").to_numpy(zero_copy_only=False)[row].astype(np.int64)
        first_word = np.searchsorted(w.row, np.arange(w.batch.num_rows))
        yield from send([doc, anchor, check, start - first_word[row], count + width - 1], buckets, n)


def _map_windows(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows of the unclear spans (pos, len) of documents."""
    for n, w in enumerate(word_slices(batches)):
        spans = column(w, "spans")
        row = np.repeat(np.arange(w.batch.num_rows), np.diff(spans.offsets.to_numpy()))
        pos, size = (spans.flatten().field(i).to_numpy() for i in range(2))
        first_word = np.searchsorted(w.row, np.arange(w.batch.num_rows + 1))
        count = np.maximum(np.minimum(size, first_word[row + 1] - first_word[row] - pos) - width + 1, 0)
        at = np.repeat(first_word[row] + pos, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.unique(at)
        prefix, down = word_prefix(other_hashes(w))
        check = mix((prefix[at + width] - prefix[at]) * down[at])
        key = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            key = key * PRIME + w.hash[at + k]
        rows = w.row[at]
        doc = column(w, "doc_id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
        past = column(w, "past").to_numpy(zero_copy_only=False)[rows].astype(bool)
        entries = [doc, mix(key), check, at - first_word[rows], np.full(len(at), width)]
        yield from send([x[~past] for x in entries], buckets, n)
        bucket = (entries[1][past] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        yield entry_batch(bucket[order], PAST, [x[past][order] for x in entries])


def _resolve_bucket(bucket: int, parts: list[tuple[int, list[np.ndarray]]], keep_run: bool, unclear: bool) -> Iterator[pa.RecordBatch]:
    fresh = [p for kind, p in parts if kind == NEW]
    if not fresh:
        return
    if keep_run:
        yield from _merge_bucket(bucket, fresh)
    anchors = np.unique(np.concatenate([p[1] for p in fresh]))
    met = [[x[rows] for x in p] for kind, p in parts if kind != NEW and len(rows := _meeting(anchors, p[1]))]
    doc, key, check, pos, size = (np.concatenate([p[i] for p in fresh + met]) for i in range(5))
    past = np.arange(len(doc)) >= sum(len(p[0]) for p in fresh)
    order = np.lexsort((doc, check, key))
    doc, key, check, pos, size, past = (x[order] for x in (doc, key, check, pos, size, past))
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key | np.concatenate([[True], check[1:] != check[:-1]])
    first = np.flatnonzero(new)
    owner = doc[first][np.cumsum(new) - 1]
    repeat = (doc > owner) & ~past
    where = lambda mask: np.full(int(mask.sum()), bucket, dtype=np.int64)
    if repeat.any():
        yield entry_batch(where(repeat), REPEAT, [x[repeat] for x in (doc, key, check, pos, size)])
    if unclear:
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, weights=new) > 1
        lead = np.flatnonzero(new_key)
        several &= np.minimum.reduceat(doc, lead) < np.maximum.reduceat(doc, lead)
        todo = several[group] & (doc == owner)
        if todo.any():
            yield entry_batch(where(todo), UNCLEAR, [x[todo] for x in (doc, key, check, pos, size)])


def _meeting(anchors: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows of a run (keys) that have one of the anchors, which are sorted."""
    at = np.minimum(np.searchsorted(anchors, keys), len(anchors) - 1)
    return np.flatnonzero(anchors[at] == keys)


def _merge_bucket(bucket: int, parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A run: the first document of each (key, check), sorted by them."""
    arrays = [np.concatenate([p[i] for p in parts]) for i in range(5)]
    doc, key, check = arrays[:3]
    order = np.lexsort((doc, check, key))
    key, check = key[order], check[order]
    first = order[np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])]
    yield entry_batch(np.full(len(first), bucket, dtype=np.int64), RUN, [x[first] for x in arrays])


def _resolve(batches: Iterator[pa.RecordBatch], keep_run: bool, unclear: bool, compact: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket's entries are held together."""

    def done(bucket: int, parts: list[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        return _merge_bucket(bucket, [p for _, p in parts]) if compact else _resolve_bucket(bucket, parts, keep_run, unclear)

    now, parts = None, []
    for batch in batches:
        lists = [batch.column(batch.schema.get_field_index(n)) for n in _NAMES]
        for i, (bucket, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if bucket < 0:
                yield batch.slice(i, 1)
                continue
            if bucket != now and parts:
                yield from done(now, parts)
                parts = []
            now = bucket
            views = [x[i].values.to_numpy() for x in lists]
            parts.append((kind, [views[0], views[1].view(np.uint64), views[2].view(np.uint64), views[3], views[4]]))
    if parts:
        yield from done(now, parts)


def resolve(entries: DataFrame, keep_run: bool, unclear: bool, compact: bool = False) -> DataFrame:
    return entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _resolve(b, keep_run, unclear, compact), ENTRY_SCHEMA)


def _spans(entries: DataFrame, kind: int) -> DataFrame:
    """doc_id and its spans (pos, len)."""
    flat = entries.where(F.col("kind") == kind).select(F.explode(F.arrays_zip("doc", "pos", "len")).alias("e"))
    return flat.groupBy(F.col("e.doc").alias("doc_id")).agg(F.collect_list(F.struct(F.col("e.pos").alias("pos"), F.col("e.len").alias("len"))).alias("spans"))


def _texts_with(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text and spans of the documents that have spans; others' texts aren't shuffled where ids are few."""
    some = documents.join(broadcast_if_small(spans.select("doc_id")), "doc_id", "left_semi")
    return some.join(spans, "doc_id")


class FingerprintIndex:
    """Sorted immutable runs of (anchor, stretch) hashes with their first documents, by bucket.

    Without a path the runs last as long as the session. With one, each run is a folder of it, and manifests say which
    runs count; open() takes the index up again, given the documents that are in it.
    """

    def __init__(self, buckets: int, width: int = WIDTH, gram: int = GRAM, fanout: int = 4, path: str | None = None):
        self.buckets, self.width, self.gram, self.fanout, self.path = buckets, width, gram, fanout, path
        self.runs: list[DataFrame] = []
        self.names: list[str] = []
        self.written = 0
        self.past: DataFrame | None = None

    @classmethod
    def open(cls, path: str, documents: DataFrame, width: int = WIDTH, gram: int = GRAM, fanout: int = 4) -> FingerprintIndex:
        spark = documents.sparkSession
        rows = spark.read.parquet(f"{path}/manifest-*").collect()  # a row a run and state
        last = max(r["state"] for r in rows)
        now = sorted((r for r in rows if r["state"] == last), key=lambda r: r["run"])
        index = cls(now[0]["buckets"], width, gram, fanout, path)
        index.names, index.written = [r["run"] for r in now], last + 1
        index.runs = [spark.read.schema(ENTRY_SCHEMA).parquet(f"{path}/{n}") for n in index.names]
        index.past = documents.select("doc_id", "text", F.lit(True).alias("past"))
        return index

    def repeats(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """doc_id and spans of words that repeat earlier documents; the batch then is part of the index, unless last."""
        width, gram, buckets = self.width, self.gram, self.buckets
        entries = batch.select("doc_id", "text").mapInArrow(lambda b: _map_stretches(b, width, gram, buckets), ENTRY_SCHEMA)
        for run in self.runs:
            entries = entries.unionByName(run)
        found = materialize(resolve(entries, not last, True), "stretches", "kind").select("bucket", *_NAMES, F.col("kind").cast("int").alias("kind"))
        texts = batch.select("doc_id", "text", F.lit(False).alias("past"))
        if self.past is not None:
            texts = texts.unionByName(self.past)
        unclear = materialize(_spans(found, UNCLEAR), "unclear")
        windows = _texts_with(texts, unclear).mapInArrow(lambda b: _map_windows(b, width, buckets), ENTRY_SCHEMA)
        verified = materialize(resolve(windows, False, False), "windows")
        if not last:
            self._append(found.where(F.col("kind") == RUN).select("bucket", "kind", *_NAMES))
            self.past = texts.withColumn("past", F.lit(True))
            if len(self.runs) >= self.fanout:
                self.compact()
        return materialize(_spans(found.where(F.col("kind") == REPEAT).unionByName(verified.where(F.col("kind") == REPEAT).select(found.columns)), REPEAT), "repeats")

    def compact(self) -> None:
        """Merges all runs into one; of equal entries the first document stays."""
        every = self.runs[0]
        for run in self.runs[1:]:
            every = every.unionByName(run)
        merged = resolve(every, False, False, compact=True)
        self.runs, self.names = [], []
        self._append(merged if self.path else materialize(merged, "run"))

    def _append(self, run: DataFrame) -> None:
        if self.path:
            name = f"run-{self.written:06d}"
            run.write.parquet(f"{self.path}/{name}")
            run = run.sparkSession.read.schema(ENTRY_SCHEMA).parquet(f"{self.path}/{name}")
            self.names.append(name)
            state = [(self.written, n, self.buckets) for n in self.names]
            run.sparkSession.createDataFrame(state, "state long, run string, buckets long").coalesce(1).write.parquet(f"{self.path}/manifest-{self.written:06d}")
            self.written += 1
        self.runs.append(run)


def _cut(batches: Iterator[pa.RecordBatch], width: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for w in word_slices(batches):
        n = w.batch.num_rows
        first = np.searchsorted(w.row, np.arange(n + 1))
        gone = np.zeros(len(w.row) + 1, dtype=np.int64)
        if "spans" in w.batch.schema.names:
            spans = column(w, "spans")
            row = np.repeat(np.arange(n), np.diff(spans.offsets.to_numpy()))
            pos, size = (spans.flatten().field(i).to_numpy() for i in range(2))
            begin = np.minimum(first[row] + pos, first[row + 1])
            np.add.at(gone, begin, 1)
            np.add.at(gone, np.minimum(begin + size, first[row + 1]), -1)
        gone = np.cumsum(gone)[:-1] > 0
        data, texts = w.data.tobytes(), []
        for i in range(n):
            a, b = first[i], first[i + 1]
            keep = np.flatnonzero(~gone[a:b]) + a
            texts.append(b" ".join([data[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)]))
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
        names, out = ["doc_id", "n_words", "n_removed"], [column(w, "doc_id"), pa.array(np.diff(first)), pa.array(removed)]
        out.append(pa.array([hashlib.sha256(t).hexdigest() for t in texts]) if digest else pa.array([t.decode("utf-8", "replace") for t in texts]))
        yield pa.RecordBatch.from_arrays(out, names=[*names, "kept_sha256" if digest else "kept_text"])


def n_buckets(documents: DataFrame) -> int:
    """So many that a bucket holds the entries of about BUCKET_BYTES of text."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(16, -(-size // BUCKET_BYTES))


def find_repeats(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = 1, fanout: int = 4) -> DataFrame:
    """doc_id and spans (pos, len) of words in windows that documents of smaller doc_id have.

    With several batches, documents come into the index in doc_id order, a range at a time.
    """
    documents = documents.select("doc_id", "text").where("doc_id is not null")
    index = FingerprintIndex(n_buckets(documents), width, gram, fanout)
    edges = documents.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or [] if batches > 1 else []
    edges = sorted(set(edges))
    repeats = None
    for i in range(len(edges) + 1):
        part = documents
        if i > 0:
            part = part.where(F.col("doc_id") > edges[i - 1])
        if i < len(edges):
            part = part.where(F.col("doc_id") <= edges[i])
        found = index.repeats(part, last=i == len(edges))
        repeats = found if repeats is None else repeats.unionByName(found)
    return repeats


def substring_dedup(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = 1, digest: bool = False, fanout: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words, one space between) or its SHA-256."""
    repeats = find_repeats(documents, width, gram, batches, fanout)
    kind = "kept_sha256" if digest else "kept_text"
    schema = f"doc_id long, n_words long, n_removed long, {kind} string"
    touched = _texts_with(documents.select("doc_id", "text"), repeats).mapInArrow(lambda b: _cut(b, width, digest), schema)
    ids = broadcast_if_small(repeats.select("doc_id"))
    rest = documents.select("doc_id", "text").join(ids, "doc_id", "left_anti").mapInArrow(lambda b: _cut(b, width, digest), schema)
    return touched.unionByName(rest)


def _rewrite(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of columns c0, c1, ... (by the names' order) and spans, with new texts."""
    at = names.index("text")
    for batch in batches:
        some = pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), batch.column(at), batch.column(len(names) + 1)], names=["doc_id", "text", "spans"])
        texts = pa.chunked_array([x.column(3) for x in _cut(iter([some]), WIDTH, False)], pa.string()).combine_chunks()
        new = {"text": texts, "n_chars": pa.compute.utf8_length(texts)}
        yield pa.RecordBatch.from_arrays(
            [new[n].cast(batch.schema.field(i).type) if n in new else batch.column(i) for i, n in enumerate(names)], names=[f"c{i}" for i in range(len(names))]
        )


def without_repeats(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = 3, fanout: int = 2) -> DataFrame:
    """The documents, all columns; texts that had repeats are their kept words with one space between, n_chars follows.

    They come into the index in three batches, so that the last meets the compacted runs of the others.
    """
    repeats = find_repeats(documents, width, gram, batches, fanout).withColumnRenamed("doc_id", "__doc")
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])  # no name of theirs can clash
    ids, doc = broadcast_if_small(repeats.select("__doc")), f"c{names.index('doc_id')}"
    some = plain.join(ids, F.col(doc) == F.col("__doc"), "left_semi")
    touched = some.join(repeats, F.col(doc) == F.col("__doc")).select(*plain.columns, "__doc", "spans").mapInArrow(lambda b: _rewrite(b, names), plain.schema)
    return touched.unionByName(plain.join(ids, F.col(doc) == F.col("__doc"), "left_anti")).toDF(*names)
