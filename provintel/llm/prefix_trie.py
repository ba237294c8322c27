"""Conversation prefix trie: prefix digests screened by a count-min sketch, so that only possibly shared ones are shuffled.

Conversations are rebuilt around the first turns of their group's head, streamed in order of turn, and every prefix gets a
128-bit chained digest. A count-min sketch of two rows of saturating cells counts the digests. Cells follow the number of
turns; past ``CELLS`` they are dealt into shards by a conversation's first digest, one sketch each, so that what a task or
the driver holds of a sketch is bounded. An estimate of one proves that a prefix is of one conversation: its node is
emitted where it is read. The others are grouped exactly by digest. A node of several conversations sums its subtree by
pointer doubling, so rounds follow the logarithm of the depth. Sorted member lists are written in pieces by range, and only
the pieces of a node meet for its digest, streamed.

The turns of a conversation stream through one task, as chained digests are sequential; none holds more than eight turns'
digests of a head.

Defined cases: null role or text is empty; null turns come first; turns that tie are ordered by role, then text; repeated
rows are turns of their own; rows without conv_id belong to no conversation; conv_id % 5 has the sign of conv_id, as in
SQL; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

GROUP, HEADS = 5, 9
CELLS = 1 << 25
CELLS_A_TURN = 4
BLOCK = 1 << 19
PIECE_CHARS = 1 << 20
BATCH = 1 << 14
ROOT = bytes(16)
NOBODY = sha256(b"").hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, 1024).columns], strict=True)


def _packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _turn(role: bytes, text: bytes) -> bytes:
    return blake2b(len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()


def _kept(turns: Iterator[tuple], first: list, most: int) -> Iterator[tuple]:
    for turn in turns:
        if len(first) < most:
            first.append(turn)
        yield turn


def rebuilt(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, depth, first, parent, node, bytes, end) of each prefix of each rebuilt conversation, the empty one too.

    rows: (head, conv_id, h, role, text) by head, its own conversation first, then by conversation and turn.
    """
    at, head = None, []
    for (group, conv, h), own in groupby(rows, itemgetter(0, 1, 2)):
        if group != at:
            at, head = group, []
        turns = ((_turn(r, t), len(t)) for _, _, _, r, t in own)
        turns = _kept(turns, head, HEADS - 1) if conv == group else chain(head[:h], islice(turns, h, None))
        depth, first, node, row = 0, 0, ROOT, (conv, 0, 0, 0, 0, 0, 0, 0)
        for digest, size in turns:
            yield *row, False
            depth, parent, node = depth + 1, node, blake2b(node + digest, digest_size=16).digest()
            ids = struct.unpack("<4q", parent + node)
            first = first if depth > 1 else ids[2]
            row = (conv, depth, first, *ids, size)
        yield *row, True


def prefixes(conversations: DataFrame, shards: int) -> DataFrame:
    """One row per prefix of each rebuilt conversation; no texts, only digests."""
    fields = [(n, pa.int64()) for n in ("conv_id", "depth", "first", "parent_a", "parent_b", "node_a", "node_b", "bytes")]
    schema = pa.schema([*fields, ("ends", pa.bool_())])
    conv = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select(
        (conv - conv % GROUP).alias("head"), conv.alias("conv_id"), (F.crc32(conv.cast("string")) % HEADS).cast("int").alias("h"),
        *[F.coalesce(c, F.lit("")).cast("binary").alias(c) for c in ("role", "text")], "turn",
    )
    order = ["head", F.col("conv_id") != F.col("head"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = turns.repartition("head").sortWithinPartitions(*order).drop("turn")
    found = dealt.mapInArrow(lambda batches: _packed(rebuilt(_rows(batches)), schema), "conv_id long, depth long, first long, parent_a long, parent_b long, node_a long, node_b long, bytes long, ends boolean")
    return materialize(found.withColumn("shard", F.pmod("first", F.lit(shards))), "prefixes", "shard")


def _cells(batch: pa.RecordBatch, cells: int, names: tuple[str, str] = ("node_a", "node_b")) -> np.ndarray:
    """A cell in each of the two rows of the sketch, a column a prefix."""
    ids = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
    return np.stack([ids[0] & (cells - 1), (ids[1] & (cells - 1)) + cells])


def _counted(cells: int):
    """A task's function: bits of the cells met, and of those met twice, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(2 * cells, dtype=bool), np.zeros(2 * cells, dtype=bool)
        for batch in batches:
            at, n = np.unique(_cells(batch, cells), return_counts=True)
            twice[at] |= once[at] | (n > 1)
            once[at] = True
        for k in range(0, 2 * cells, BLOCK):
            if once[k : k + BLOCK].any():
                yield pa.record_batch([[k // BLOCK], [np.packbits(once[k : k + BLOCK]).tobytes()], [np.packbits(twice[k : k + BLOCK]).tobytes()]], pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, sorted by number, added up: a cell is twice if it is twice anywhere or once in two places."""
    for block, parts in groupby(_rows(batches), itemgetter(0)):
        once = twice = np.zeros(1, dtype=np.uint8)
        for _, a, b in parts:
            a, b = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
            once, twice = once | a, twice | b | (once & a)
        yield pa.record_batch([[block], [twice.tobytes()]], pa.schema([("block", pa.int32()), ("twice", pa.binary())]))


def shared_cells(nodes: DataFrame, cells: int) -> np.ndarray:
    """Which of the 2 * cells cells hold a count over one, as bits. At most cells / 4 bytes reach the driver."""
    blocks = nodes.select("node_a", "node_b").mapInArrow(_counted(cells), "block int, once binary, twice binary")
    added = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_added, "block int, twice binary")
    out = np.zeros(2 * cells // 8, dtype=np.uint8)
    for block, twice in added.collect():
        out[block * BLOCK // 8 : block * BLOCK // 8 + len(twice)] = np.frombuffer(twice, dtype=np.uint8)
    return out


def screened(nodes: DataFrame, cells: int) -> DataFrame:
    """nodes with shared and parent_shared: whether the estimates are over one. The root is always shared."""
    bits = nodes.sparkSession.sparkContext.broadcast(shared_cells(nodes, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = bits.value
        over = lambda at: ((twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
        for batch in batches:
            top = batch.column(batch.schema.get_field_index("depth")).to_numpy(zero_copy_only=False) == 1
            flags = over(_cells(batch, cells)), over(_cells(batch, cells, ("parent_a", "parent_b"))) | top
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, flags)], [*batch.schema.names, "shared", "parent_shared"])

    nodes = nodes.select("conv_id", "depth", "parent_a", "parent_b", "node_a", "node_b", "bytes", "ends")
    return nodes.mapInArrow(run, "conv_id long, depth long, parent_a long, parent_b long, node_a long, node_b long, bytes long, ends boolean, shared boolean, parent_shared boolean")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node_a", pa.int64()), ("node_b", pa.int64()), ("conv_id", pa.int64()), ("ids", pa.string())])

    def run() -> Iterator[tuple]:
        for node, members in groupby(_rows(batches), itemgetter(0, 1)):
            held, chars = [], 0
            for _, _, conv in members:
                held.append(conv)
                chars += len(str(conv)) + 1
                if chars > PIECE_CHARS:
                    yield *node, held[0], ",".join(map(str, held))
                    held, chars = [], 0
            if held:
                yield *node, held[0], ",".join(map(str, held))

    return _packed(run(), schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node_a", pa.int64()), ("node_b", pa.int64()), ("ends_sha256", pa.string())])

    def run() -> Iterator[tuple]:
        for node, parts in groupby(_rows(batches), itemgetter(0, 1)):
            digest = sha256()
            for k, (_, _, _, ids) in enumerate(parts):
                digest.update((b"," if k else b"") + ids.encode())
            yield *node, digest.hexdigest()

    return _packed(run(), schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(node_a, node_b, ends_sha256): the digest of a node's conv_ids, ascending. Ids are joined in pieces by range first."""
    key = ["node_a", "node_b", "conv_id"]
    pieces = ends.select(*key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_pieces, "node_a long, node_b long, conv_id long, ids string")
    return pieces.repartition("node_a", "node_b").sortWithinPartitions(*key).mapInArrow(_digests, "node_a long, node_b long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, depth: int) -> DataFrame:
    """(node_a, node_b, n_leaves, saved_tokens) summed over subtrees of nodes (node_a, node_b, up_a, up_b, ...), by pointer doubling."""
    now, reach = nodes, 1
    while reach < depth:
        below = now.where("up_a is not null").groupBy(F.col("up_a").alias("node_a"), F.col("up_b").alias("node_b")).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        over = now.select(F.col("node_a").alias("up_a"), F.col("node_b").alias("up_b"), F.col("up_a").alias("_up_a"), F.col("up_b").alias("_up_b"))
        more = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_leaves", "_leaves"), ("saved_tokens", "_saved"))]
        step = now.join(over, ["up_a", "up_b"], "left").select("node_a", "node_b", F.col("_up_a").alias("up_a"), F.col("_up_b").alias("up_b"), "n_leaves", "saved_tokens")
        now = materialize(step.join(below, ["node_a", "node_b"], "left").select("node_a", "node_b", "up_a", "up_b", *more), "sums")
        reach *= 2
    return now.select("node_a", "node_b", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame, most_cells: int = CELLS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    most_cells, a power of two, bounds a row of a sketch.
    """
    spark = conversations.sparkSession
    wanted = max(CELLS_A_TURN * conversations.count(), 64)
    cells = min(1 << (wanted - 1).bit_length(), most_cells)
    shards = -(-wanted // most_cells)
    every = prefixes(conversations, shards)
    known = None
    for shard in range(shards):
        part = materialize(screened(every.where((F.col("shard") == shard) & (F.col("depth") > 0)), cells), "screened")
        known = part if known is None else known.unionByName(part)

    counts = known.where("shared").groupBy("node_a", "node_b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent_a").alias("parent_a"), F.min("parent_b").alias("parent_b"), F.min("bytes").alias("bytes"), F.max("ends").alias("ends")
    )
    counts = materialize(counts, "nodes")
    several, alone = counts.where("n_convs > 1"), counts.where("n_convs = 1")
    single = ["conv_id", "depth", "parent_a", "parent_b", "ends"]
    singles = known.where("not shared and parent_shared").select(*single).unionByName(alone.select(*single))
    children = singles.select("parent_a", "parent_b", F.lit(1).alias("one")).unionByName(several.select("parent_a", "parent_b", F.lit(0).alias("one")))
    children = children.groupBy(F.col("parent_a").alias("node_a"), F.col("parent_b").alias("node_b")).agg(F.count("*").alias("n_children"), F.sum("one").alias("alone"))
    leaves = (F.coalesce("alone", F.lit(0)) + F.when(F.coalesce("n_children", F.lit(0)) == 0, 1).otherwise(0)).cast("long").alias("n_leaves")
    up = [F.when(F.col("depth") > 1, F.col(f"parent_{x}")).alias(f"up_{x}") for x in "ab"]
    weighed = several.join(children, ["node_a", "node_b"], "left").select(
        "node_a", "node_b", "conv_id", "depth", "parent_a", "parent_b", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), *up, leaves, ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    )
    weighed = materialize(weighed, "weighed")

    tops = every.where("depth = 0")
    smallest, n, bare = tops.agg(F.min("conv_id"), F.count("*"), F.count_if("ends")).first()
    n_leaves, saved, depth, top_several = weighed.agg(F.sum("n_leaves"), F.sum("saved_tokens"), F.max("depth"), F.count_if(F.col("depth") == 1)).first()
    top_single = singles.where("depth = 1").count()
    n_children = top_several + top_single
    ends = materialize(end_digests(known.where("shared and ends").unionByName(tops.where("ends").drop("shard", "first").withColumns({"shared": F.lit(True), "parent_shared": F.lit(True)}))), "ends")
    root = [(smallest, 0, None, n, n_children, (n_leaves or 0) + top_single + (n_children == 0), saved or 0)] if n else []
    root = spark.createDataFrame(root, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    root = root.join(F.broadcast(ends.where("node_a = 0 and node_b = 0").select("ends_sha256").limit(1)), F.lit(True), "left").fillna(NOBODY, "ends_sha256")

    owner = weighed.select(F.col("node_a").alias("parent_a"), F.col("node_b").alias("parent_b"), F.col("conv_id").alias("_owner"))
    parent = F.when(F.col("depth") == 1, F.lit(smallest)).otherwise(F.coalesce("_owner", "conv_id")).cast("long").alias("parent_conv_id")
    one = [F.lit(1).cast("long").alias("n_convs"), F.when(F.col("ends"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
           F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOBODY).alias("ends_sha256")]
    tails = known.where("not shared and not parent_shared").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *one)
    heads = singles.join(owner, ["parent_a", "parent_b"], "left").select("conv_id", "depth", parent, *one)
    sums = subtree_sums(weighed.select("node_a", "node_b", "up_a", "up_b", "n_leaves", "saved_tokens"), depth or 0)
    inner = weighed.drop("n_leaves", "saved_tokens").join(sums, ["node_a", "node_b"]).join(ends, ["node_a", "node_b"], "left").fillna(NOBODY, "ends_sha256").join(owner, ["parent_a", "parent_b"], "left")
    inner = inner.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return root.unionByName(inner).unionByName(heads).unionByName(tails)
