"""Mixing sources to target weights: fixed-length blocks, multinomial counts a shard, pseudorandom orders; JVM expressions only.

The words of a source's documents, in order of doc_id, make one stream; its block b is the words from b * block on. Sources
get targets by weight, at most ``cap`` times their size. A mix has as many slots as the targets need blocks, ``shard_slots``
of them to an output shard. The slots of all shards get their sources by one pseudorandom order of all slots, so a shard's
counts are multinomial given the totals: free draws would miss a small source's target by their deviation, and could pass
the cap. A source's k-th slot takes the k-th block of its own pseudorandom order, in a new order each time all its blocks
are used up. Draws and blocks are then joined by (source, block).

No step sees a source whole: running sums come from range partitions, a source's slots are dealt in chunks, and keys of
joins are single blocks. All orders are arithmetic of a seed, so reruns agree.

Defined cases: null text has no words, size 0 and taken 0; a null source is a source of its own, last in order; documents
of equal or null doc_id are documents of their own, in order of size, then text; a source without words has target 0; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BLOCK = 64
SHARD_SLOTS = 4096
CHUNK = 1 << 16
ROUNDS = 3
SEED = 20240613


def running(rows: DataFrame, group: list[str], order: list[Column | str], value: str, label: str) -> DataFrame:
    """rows and before: the sum of value over the earlier rows of their group. No task sees more than a range of a group."""
    dealt = materialize(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), label)
    parts = dealt.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    so_far = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "_part", F.coalesce(F.sum("_sum").over(so_far), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(broadcast_if_small(parts), [*group, "_part"]).withColumn("before", F.col("_base") + F.col("_inside")).drop("_base", "_inside", "_part")


def _sized(documents: DataFrame, texts: bool) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.coalesce(F.col("text"), F.lit("")).alias("text")] if texts else []
    return documents.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("_text"), *kept)


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, number, source_size, target) of rows (source, size): share times all sizes, dealt by weight; what a source can't take goes to the others."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    ranked = running(sizes, ["_all"], [F.col("source").isNull(), "source"], "_one", "sources").withColumnRenamed("before", "number")
    weight = F.element_at(F.lit(list(weights)), (F.col("number") % len(weights)).cast("int") + 1).cast("double")
    ranked = materialize(ranked.select("source", "number", "source_size", weight.alias("weight")), "weighed")
    unit, full = 0.0, -1
    while True:
        over = F.col("weight") * unit > cap * F.col("source_size")
        words, held, free, n = ranked.agg(F.sum("source_size"), F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if n == full:
            break
        full, unit = n, (share * (words or 0) - cap * (held or 0)) / free if free else unit
    return ranked.select("source", "number", "source_size", F.least(F.col("weight") * unit, F.col("source_size") * cap).alias("target"))


def permuted(rows: DataFrame, x: str, n: str, key: str) -> DataFrame:
    """rows with x replaced by its place in the key's pseudorandom order of 0..n-1.

    Each round rotates by the key, then adds functions of the low half to the high half and back (a Feistel network over
    lo * hi of the n numbers; rotation moves the few others in).
    """
    rows = rows.withColumn("_lo", F.floor(F.sqrt(n)).cast("long")).withColumn("_hi", F.expr(f"{n} div _lo"))
    for r in range(ROUNDS):
        rows = rows.withColumn("_key", F.expr(f"({key} + {(r + 1) * 104729}) % 2147483647")).withColumn(x, F.expr(f"({x} + _key) % {n}"))
        rows = rows.withColumn("_in", F.expr(f"{x} < _lo * _hi")).withColumn("_high", F.expr(f"{x} div _lo")).withColumn("_low", F.expr(f"{x} % _lo"))
        rows = rows.withColumn("_mix", F.expr("(_low * 1540483477 + _key) % 2147483647")).withColumn("_high", F.expr("(_high + _mix * _mix % 2147483629) % _hi"))
        rows = rows.withColumn("_mix", F.expr("(_high * 1103515245 + _key) % 2147483647")).withColumn("_low", F.expr("(_low + _mix * _mix % 2147483629) % _lo"))
        rows = rows.withColumn(x, F.expr(f"if(_in, _high * _lo + _low, {x})"))
    # Not nullable, else a join's null filter is pushed below and repeats every step's expression.
    return rows.withColumn(x, F.coalesce(x, F.lit(0))).drop("_lo", "_hi", "_key", "_in", "_high", "_low", "_mix")


def draw_slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(number, block, shard, slot): every slot of the mix, and the block of the source that it takes."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    counted = targets.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn("_rounds", rounds)
    rest = F.least(F.floor((F.col("target") - F.col("_rounds") * F.col("source_size")) / block + 0.5).cast("long"), F.col("blocks"))
    counted = counted.withColumn("slots", F.col("_rounds") * F.col("blocks") + rest).where("slots > 0").select("number", "blocks", "slots").withColumn("_all", F.lit(0))
    first = materialize(running(counted, ["_all"], ["number"], "slots", "slots").select("number", "blocks", "slots", "before"), "first-slots")
    total = first.agg(F.sum("slots")).first()[0] or 0
    chunks = first.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})"))).repartition("number", "_chunk")
    drawn = chunks.select("number", "blocks", "before", F.explode(F.expr(f"sequence(_chunk * {CHUNK}, least(slots, (_chunk + 1) * {CHUNK}) - 1)")).alias("k"))
    drawn = drawn.withColumn("place", F.col("before") + F.col("k")).withColumn("total", F.lit(total)).withColumn("key", F.lit(seed % 2147483647))
    drawn = permuted(drawn, "place", "total", "key")
    drawn = drawn.withColumn("key", F.expr(f"({seed} + (number % 1000003) * 1000003 + (k div blocks) * 7919) % 2147483647")).withColumn("block", F.expr("k % blocks"))
    drawn = permuted(drawn, "block", "blocks", "key")
    return drawn.select("number", "block", F.expr(f"place div {shard_slots}").alias("shard"), F.expr(f"place % {shard_slots}").alias("slot"))


def _laid(documents: DataFrame, block: int, texts: bool, weights: tuple, share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """Documents with the place of their first word in their source (before), one row a block that they reach into; and the sources."""
    sized = materialize(_sized(documents, texts), "sized")
    sources = materialize(source_targets(sized, weights, share, cap), "targets")
    known = broadcast_if_small(sources.select("number", F.col("source").alias("_source")))
    numbered = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = running(numbered, ["number"], ["doc_id", "size", "_text"], "size", "laid")
    reach = F.when(F.col("size") > 0, F.expr(f"sequence(before div {block}, (before + size - 1) div {block})"))
    pieces = laid.withColumn("block", F.explode_outer(reach)).withColumn("_from", F.greatest(F.col("before"), F.col("block") * block))
    return pieces.withColumn("_words", F.least(F.col("before") + F.col("size"), (F.col("block") + 1) * block) - F.col("_from")), sources


def mix_documents(documents: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row per document: size, source_size, the source's target, and taken, the words that the mix takes of it."""
    pieces, sources = _laid(documents, block, False, weights, share, cap)
    times = draw_slots(sources, block, shard_slots, seed).groupBy("number", "block").agg(F.count("*").alias("times")).hint("merge")  # Catalyst takes exploded slots for few
    taken = F.coalesce(F.sum(F.col("_words") * F.col("times")), F.lit(0)).cast("long").alias("taken")
    mixed = pieces.join(times, ["number", "block"], "left").groupBy("_row", "number", "doc_id", "size").agg(taken)
    return mixed.join(broadcast_if_small(sources.select("number", "source_size", "target")), "number").select("doc_id", "size", "source_size", "target", "taken")


def mix_blocks(documents: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix itself: shard, slot, source, block, n_words and text, the block's words joined by spaces."""
    pieces, sources = _laid(documents, block, True, weights, share, cap)
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("_from") - F.col("before") + 1).cast("int"), F.col("_words").cast("int"))
    texts = pieces.where("block is not null").select("number", "block", "_from", "_words", F.array_join(words, " ").alias("_piece")).groupBy("number", "block").agg(
        F.sum("_words").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_from", "_piece"))), lambda p: p["_piece"]), " ").alias("text")
    )
    named = broadcast_if_small(sources.select("number", "source"))
    return draw_slots(sources, block, shard_slots, seed).hint("merge").join(texts, ["number", "block"]).join(named, "number").select("shard", "slot", "source", "block", "n_words", "text")
