"""Suffix-array dedup: removes every byte of a ``width``-byte string that starts more than once in the corpus.

Suffix arrays are built by linear grouping: suffixes start in groups by first symbol; groups are taken in descending
order, each suffix finds its previous-smaller suffix (the last one before it in a lower group) and those move, by how many
of the group point at them, into new groups right above their own. In the end each group holds the suffixes of one Lyndon
prefix, and one ascending pass over the groups emits the order along the pointers, without renaming or recursion.

To spread the work, only text that can repeat meets in one array. Each string's ``gram``-byte piece of least hash is its
anchor; neighbouring strings with one anchor make a stretch. Stretches are exchanged as hashes by anchor: equal stretches
are repeats as a whole. Different stretches of one anchor share a string only if they agree on half a width to one side,
so their bytes meet by (anchor, side), and a suffix array over those finds the strings that occur in two of them. Where more
than ``HOT`` stretches meet, as around a passage that many documents share, their strings go out one by one as hashes.
Inside a map slice only one of equal stretches goes out.

Defined cases: null text is empty; shorter texts keep everything; a string that recurs in its own document counts, with
overlaps; doc_id identifies a document, and rows without one are left alone; extra columns are ignored; no rows give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from .substring_dedup import least_places, merge_spans, n_buckets
from .words import byte_prefix, column, mix, powers, signed, slices

WIDTH, GRAM = 200, 24
CHUNK, HOT = 1 << 16, 1000
NEW, REPEAT, UNCLEAR = range(3)
_NAMES = ["doc", "key", "check", "pos", "len", "off"]
ENTRY_SCHEMA = "bucket long, kind int, " + ", ".join(f"{n} array<long>" for n in _NAMES)
STRETCH_SCHEMA = "meet long, doc long, pos long, at long, piece binary"
STRING_SCHEMA = "meet long, first long, second long, doc_id long, pos long"
SPAN_SCHEMA = "doc_id long, pos long, len long"
CUT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, "


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of integers whose last is the only least one."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
    first = np.flatnonzero(new)
    group_np = np.empty(n, dtype=np.int64)
    group_np[order] = first[np.cumsum(new) - 1]
    sizes = np.zeros(n, dtype=np.int64)
    sizes[first] = np.diff(np.append(first, n))
    place_np = np.empty(n, dtype=np.int64)
    place_np[order] = np.arange(n)
    sa, group, size, place = order.tolist(), group_np.tolist(), sizes.tolist(), place_np.tolist()
    before = [-1] * n
    top = n - 1
    while top >= 0:
        low = group[sa[top]]
        if low == top:  # a group of one
            s = sa[top]
            p = s - 1
            while p >= 0 and group[p] > low:
                p = before[p]
            before[s] = p
            if p >= 0:
                levels = ((p,),)
            else:
                levels = ()
        else:
            points: dict[int, int] = {}
            members = sa[low : top + 1]
            members.sort()
            for s in members:  # ascending, so members between have their pointers
                p = s - 1
                while p >= 0 and group[p] >= low:
                    p = before[p]
                before[s] = p
                if p >= 0:
                    points[p] = points.get(p, 0) + 1
            most = max(points.values(), default=0)
            if most <= 1:
                levels = (list(points),) if points else ()
            else:
                by: dict[int, list[int]] = {}
                for p, k in points.items():
                    by.setdefault(k, []).append(p)
                levels = [by[k] for k in sorted(by, reverse=True)]
        for level in levels:
            for p in level:  # to the end of its group, which then shrinks
                g = group[p]
                size[g] -= 1
                last, at = g + size[g], place[p]
                other = sa[last]
                sa[at], sa[last] = other, p
                place[other], place[p] = at, last
            starts = [group[p] + size[group[p]] for p in level]
            for p, start in zip(level, starts):  # noqa: B905
                group[p] = start
                size[start] += 1
        top = low - 1
    return np.array(_emit(n, group, before))


def _emit(n: int, group: list[int], before: list[int]) -> list[int]:
    out, free, placed = [0] * n, group[:], bytearray(n)
    heads: dict[int, int] = {}
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = free[s]
            at = heads.get(g, g)
            out[at] = s
            heads[g] = at + 1
            placed[s] = 1
            s = before[s]
    return out


def repeated_places(pieces: list[np.ndarray], width: int) -> list[np.ndarray]:
    """For each piece of symbols, the starts of strings of width symbols that occur at another place of the pieces too."""
    lengths = np.array([len(p) for p in pieces])
    data = np.concatenate(pieces)
    n = len(pieces)
    ends = np.cumsum(lengths)
    at = np.arange(len(data)) + np.repeat(np.arange(n), lengths)
    symbols = np.empty(len(data) + n, dtype=np.int64)
    symbols[at] = data + n
    symbols[ends + np.arange(n)] = np.arange(n - 1, -1, -1)  # a mark of its own ends each piece; the last is the least
    sa = suffix_array(symbols)
    owner = np.repeat(np.arange(n), lengths + 1)
    begin = np.concatenate([[0], ends[:-1]]) + np.arange(n)
    within = np.arange(len(symbols)) - begin[owner]
    room = lengths[owner] - within
    a, b = sa[:-1], sa[1:]
    full = np.flatnonzero((room[a] >= width) & (room[b] >= width))
    a, b = a[full], b[full]
    codes = np.concatenate([symbols, np.zeros(1, np.int64)])
    for k in (0, width - 1, width // 2, width // 4, 3 * width // 4):  # most neighbours differ soon
        same = codes[a + k] == codes[b + k]
        a, b = a[same], b[same]
    offsets = np.arange(width)
    hit = np.zeros(len(symbols), dtype=bool)
    for i in range(0, len(a), 4096):
        x, y = a[i : i + 4096], b[i : i + 4096]
        same = (codes[x[:, None] + offsets] == codes[y[:, None] + offsets]).all(axis=1)
        hit[x[same]] = hit[y[same]] = True
    found = np.flatnonzero(hit)
    cut = np.searchsorted(owner[found], np.arange(n + 1))
    return [within[found[cut[i] : cut[i + 1]]] for i in range(n)]


def _entries(bucket: np.ndarray, kind: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(first, len(bucket)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(signed(x) if x.dtype == np.uint64 else x.astype(np.int64))) for x in arrays]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(np.full(len(first), kind, dtype=np.int32)), *lists], names=["bucket", "kind", *_NAMES])


def _repeats(bucket: int, doc: np.ndarray, pos: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    doc, pos, size = merge_spans(doc, pos, size)
    none = np.zeros(len(doc), dtype=np.int64)
    return _entries(np.full(len(doc), bucket, dtype=np.int64), REPEAT, [doc, none, none, pos, size, none])


def _map_stretches(batches: Iterator[pa.RecordBatch], width: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for n, (batch, data, offsets) in enumerate(slices(batches)):
        if len(data) < width:
            continue
        prefix, (_, down) = byte_prefix(data), powers(len(data) + 1)
        m = len(data) - gram + 1
        grams = mix((prefix[gram:] - prefix[:m]) * down[:m])
        anchor = least_places(grams, width - gram + 1)
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        at = np.flatnonzero(row[: len(anchor)] == row[width - 1 :])
        if not len(at):
            continue
        anchor = anchor[at]
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
        start, size = at[first], np.diff(np.append(first, len(at))) + width - 1
        off = anchor[first] - start
        check = mix((prefix[start + size] - prefix[start]) * down[start] + mix(off.astype(np.uint64)))
        key, rows = grams[anchor[first]], row[start]
        doc = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
        pos = start - offsets[rows]
        order = np.lexsort((check, key))
        doc, key, check, pos, size, off = (x[order] for x in (doc, key, check, pos, size, off))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
        lead = np.flatnonzero(new)
        many = np.diff(np.append(lead, len(key)))[np.cumsum(new) - 1] > 1
        if many.any():
            yield _repeats(-1 - n % buckets, doc[many], pos[many], size[many])
        bucket = (key[lead] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        yield _entries(bucket[order], NEW, [x[lead][order] for x in (doc, key, check, pos, size, off)])


def _resolve_bucket(bucket: int, parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    doc, key, check, pos, size, off = (np.concatenate([p[i] for p in parts]) for i in range(6))
    order = np.lexsort((doc, check, key))
    doc, key, check, pos, size, off = (x[order] for x in (doc, key, check, pos, size, off))
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key | np.concatenate([[True], check[1:] != check[:-1]])
    lead = np.flatnonzero(new)
    many = np.diff(np.append(lead, len(key)))[np.cumsum(new) - 1] > 1
    if many.any():
        yield _repeats(bucket, doc[many], pos[many], size[many])
    several = np.bincount(np.cumsum(new_key) - 1, weights=new) > 1
    todo = new & several[np.cumsum(new_key) - 1]
    if todo.any():
        yield _entries(np.full(int(todo.sum()), bucket, dtype=np.int64), UNCLEAR, [x[todo] for x in (doc, key, check, pos, size, off)])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, parts = None, []
    for batch in batches:
        lists = [batch.column(batch.schema.get_field_index(n)) for n in _NAMES]
        for i, bucket in enumerate(batch.column(0).to_pylist()):
            if bucket < 0:
                yield batch.slice(i, 1)
                continue
            if bucket != now and parts:
                yield from _resolve_bucket(now, parts)
                parts = []
            now = bucket
            views = [x[i].values.to_numpy() for x in lists]
            parts.append([views[0], views[1].view(np.uint64), views[2].view(np.uint64), *views[3:]])
    if parts:
        yield from _resolve_bucket(now, parts)


def _map_sides(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The bytes of unclear stretches, by anchor and the half width to the right or left of it."""
    half = (width - gram) // 2
    for batch, data, offsets in slices(batches):
        spans = batch.column(batch.schema.get_field_index("spans"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
        pos, size, off, key = (spans.flatten().field(i).to_numpy() for i in range(4))
        ok = pos + size <= np.diff(offsets)[row]
        row, pos, size, off, key = (x[ok] for x in (row, pos, size, off, key))
        doc = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)[row].astype(np.int64)
        prefix, (_, down) = byte_prefix(data), powers(len(data) + 1)
        start = offsets[row] + pos
        raw = data.tobytes()
        for side, block, has in ((1, off, size - off - gram >= half), (2, off - half, off >= half)):
            pick = np.flatnonzero(has)
            if len(pick):
                # Strings that hold the whole block (anchor and half) start at most half before it.
                block, begin = block[pick], np.maximum(block[pick] - half, 0)
                a = start[pick] + (off[pick] + gram if side == 1 else block)
                meet = mix(key[pick].view(np.uint64) ^ mix((prefix[a + half] - prefix[a]) * down[a] + np.uint64(side)))
                ends = np.minimum(block + width, size[pick])
                pieces = [raw[s:e] for s, e in zip((start[pick] + begin).tolist(), (start[pick] + ends).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(meet)), pa.array(doc[pick]), pa.array(pos[pick] + begin), pa.array(block - begin), pa.array(pieces, pa.binary())], names=["meet", "doc", "pos", "at", "piece"]
                )


def _find_shared(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by meet; pieces that met others go into arrays of about CHUNK symbols, whole groups at a time.

    All pieces of a group hold one and the same block, which every string in question holds whole; it becomes one symbol.
    """
    block = gram + (width - gram) // 2

    def solved(groups: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        pieces, rows = [], []
        for k, group in enumerate(groups):
            for row in group:
                left, right = (np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in (row[4][: row[3]], row[4][row[3] + block :]))
                pieces.append(np.concatenate([left, [256 + k], right]))
                rows.append(row)
        found = [(row[1], places + row[2]) for row, places in zip(rows, repeated_places(pieces, width - block + 1), strict=True) if len(places)]
        if found:
            d, p = np.concatenate([np.full(len(p), d) for d, p in found]), np.concatenate([p for _, p in found])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merge_spans(d, p, np.full(len(d), width))], names=["doc_id", "pos", "len"])

    def met(rows: list[tuple]) -> list[list[tuple]]:
        """Groups of two or more by the block's bytes, as equal hashes could differ."""
        by: dict[bytes, list[tuple]] = {}
        for row in rows:
            by.setdefault(row[4][row[3] : row[3] + block], []).append(row)
        return [g for g in by.values() if len(g) > 1]

    todo, group, held = [], [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if group and group[0][0] != row[0]:
                more = met(group) if len(group) > 1 else []
                todo, held, group = todo + more, held + sum(len(x[4]) - block + 1 for g in more for x in g), []
                if held >= CHUNK:
                    yield from solved(todo)
                    todo, held = [], 0
            group.append(row)
    todo = todo + (met(group) if len(group) > 1 else [])
    if todo:
        yield from solved(todo)


def _strings(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Every string of width bytes in the pieces, as its hash from either end; each holds the piece's block whole."""
    for batch in batches:
        meet, doc, pos = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("meet", "doc", "pos"))
        pieces = batch.column(batch.schema.get_field_index("piece")).to_pylist()
        for i in range(0, len(pieces), 1000):
            part = pieces[i : i + 1000]
            data = np.frombuffer(b"".join(part), dtype=np.uint8)
            size = np.array([len(x) for x in part])
            counts = np.maximum(size - width + 1, 0)
            row = np.repeat(np.arange(len(part)), counts)
            within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start, n = (np.cumsum(size) - size)[row] + within, len(data)
            _, down = powers(n + 1)
            ahead, back = byte_prefix(data), byte_prefix(data[::-1])
            first = mix((ahead[start + width] - ahead[start]) * down[start])
            second = mix((back[n - start] - back[n - start - width]) * down[n - start - width])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (meet[i + row], signed(first), signed(second), doc[i + row], pos[i + row] + within)], names=["meet", "first", "second", "doc_id", "pos"])


def split_hot(sides: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Pieces of which at most ``most`` meet, and the others if there are any."""
    hot = materialize(sides.groupBy("meet").count().where(F.col("count") > most).select("meet"), "hot")
    if not hot.limit(1).count():
        return sides, None
    hot = broadcast_if_small(hot)
    return sides.join(hot, "meet", "left_anti"), sides.join(hot, "meet", "left_semi")


def shared_strings(pieces: DataFrame, width: int, most: int) -> DataFrame:
    """Places of the strings that occur twice or more among pieces that meet; strings beyond ``most`` places are joined by broadcast."""
    strings = materialize(pieces.mapInArrow(lambda b: _strings(b, width), STRING_SCHEMA), "strings")
    keys = ["meet", "first", "second"]
    counted = materialize(strings.groupBy(keys).count().where("count > 1"), "repeated")
    often = broadcast_if_small(counted.where(F.col("count") > most).select(keys))
    seldom = counted.where(F.col("count") <= most).select(keys)
    found = strings.join(often, keys, "left_semi").unionByName(strings.join(often, keys, "left_anti").join(seldom, keys, "left_semi"))
    return found.select("doc_id", "pos", F.lit(width).cast("long").alias("len"))


def _cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches):
        n, gone = batch.num_rows, np.zeros(len(data) + 1, dtype=np.int64)
        if "spans" in batch.schema.names:
            spans = batch.column(batch.schema.get_field_index("spans"))
            row = np.repeat(np.arange(n), np.diff(spans.offsets.to_numpy()))
            pos, size = (spans.flatten().field(i).to_numpy() for i in range(2))
            begin = np.minimum(offsets[row] + pos, offsets[row + 1])
            np.add.at(gone, begin, 1)
            np.add.at(gone, np.minimum(begin + size, offsets[row + 1]), -1)
        gone = np.cumsum(gone)[:-1] > 0
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = gone[edges]
        counts = [np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (gone, first)]
        last = pa.array([hashlib.sha256(x).hexdigest() for x in kept]) if digest else pa.array([x.decode("utf-8", "ignore") for x in kept])
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), pa.array(np.diff(offsets)), *map(pa.array, counts), last],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept_text"],
        )


def suffix_dedup(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, digest: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_text (bytes cut from characters dropped) or its bytes' SHA-256."""
    texts = documents.select("doc_id", "text")
    buckets = n_buckets(documents)
    entries = texts.where("doc_id is not null").mapInArrow(lambda b: _map_stretches(b, width, gram, buckets), ENTRY_SCHEMA)
    found = materialize(entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_resolve, ENTRY_SCHEMA), "stretches")
    unclear = found.where(F.col("kind") == UNCLEAR).select(F.explode(F.arrays_zip("doc", "pos", "len", "off", "key")).alias("e"))
    unclear = materialize(unclear.groupBy(F.col("e.doc").alias("doc_id")).agg(F.collect_list(F.struct("e.pos", "e.len", "e.off", "e.key")).alias("spans")), "unclear")
    some = texts.join(broadcast_if_small(unclear.select("doc_id")), "doc_id", "left_semi").join(unclear, "doc_id")
    sides, crowd = split_hot(materialize(some.mapInArrow(lambda b: _map_sides(b, width, gram), STRETCH_SCHEMA), "sides"), hot)
    met = sides.select("meet", "doc", "pos", "at", "piece").repartition("meet").sortWithinPartitions("meet", "doc", "pos")
    shared = met.mapInArrow(lambda b: _find_shared(b, width, gram), SPAN_SCHEMA)
    if crowd is not None:
        shared = shared.unionByName(shared_strings(crowd, width, hot))
    whole = found.where(F.col("kind") == REPEAT).select(F.explode(F.arrays_zip("doc", "pos", "len")).alias("e")).select(F.col("e.doc").alias("doc_id"), "e.pos", "e.len")
    spans = materialize(whole.unionByName(shared).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "len")).alias("spans")), "spans")
    schema = CUT_SCHEMA + ("kept_sha256 string" if digest else "kept_text string")
    ids = broadcast_if_small(spans.select("doc_id"))
    touched = texts.join(ids, "doc_id", "left_semi").join(spans, "doc_id").mapInArrow(lambda b: _cut(b, digest), schema)
    rest = texts.join(ids, "doc_id", "left_anti").mapInArrow(lambda b: _cut(b, digest), schema)
    return touched.unionByName(rest)
