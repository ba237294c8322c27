"""Benchmark decontamination: broadcast n-gram windows of the test set, scan training windows, verify hits; JVM only.

Words are runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters. An item's windows are its runs of
``width`` consecutive words; a shorter item is one window. Window hashes of a document are built by doubling
(1, 2, 4, 8 words, then the pieces a length needs). Only (row key, place, hash) are exploded and joined with the distinct
test hashes, which are broadcast when a count proves them few, else the join shuffles. Documents with a hash hit are read
again; only their hit windows are cut out as words and compared with the test windows word by word. A document's items
come from those windows in the end, so that neither many items with one window nor many documents multiply.

A row's key is its doc_id and two 64-bit hashes of its text, so rows with equal doc_id and text share one result.

Defined cases: null or word-less text has no words and no hits; null item text gives no window, a null item_id counts for
hits but is no item; items with equal texts all count; every row gives one row, repeated ones too; extra columns are
ignored by the report and kept by the cut, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

WIDTH = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["key_a", "key_b"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def row_key(text: Column) -> list[Column]:
    """Two independent hashes of a text (the second starts from another seed)."""
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit(1), text).alias("key_b")]


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return (left["key_a"] == right["key_a"]) & (left["key_b"] == right["key_b"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def _doubled(df: DataFrame, words: str, longest: int) -> DataFrame:
    """Columns _h1, _h2, _h4, ... with the hashes of windows of so many words."""
    df = df.withColumn("_h1", F.transform(words, lambda w: F.xxhash64(w)))
    k = 1
    while 2 * k <= longest:
        df = df.withColumn(f"_h{2 * k}", _joined(F.col(f"_h{k}"), F.col(f"_h{k}"), k))
        k *= 2
    return df


def _joined(left: Column, right: Column, k: int) -> Column:
    """Hashes of a left window followed, k words on, by a right one."""
    n = F.greatest(F.least(F.size(left), F.size(right) - k), F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, k + 1, n), lambda a, b: F.xxhash64(a, b))


def window_hashes(df: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """Adds _w<L>, the hashes of all windows of L words, for each length."""
    df = _doubled(df, words, max(lengths))
    for length in lengths:
        parts = [1 << i for i in reversed(range(length.bit_length())) if length >> i & 1]
        have, h = parts[0], F.col(f"_h{parts[0]}")
        for p in parts[1:]:
            h, have = _joined(h, F.col(f"_h{p}"), have), have + p
        df = df.withColumn(f"_w{length}", h)
    return df


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, list[int]]:
    """Distinct windows (len, hash, words) with the sorted ids of the items that hold them, and the lengths in use (at most width)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    items = items.withColumn("len", F.least(F.size("_w"), F.lit(width)))
    cut = items.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("len") + 1), lambda i: F.slice("_w", i, F.col("len")))).alias("words"))
    windows = cut.groupBy("len", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())
    if not lengths:
        return windows.withColumn("hash", F.lit(None).cast("long")), lengths
    hashed = window_hashes(windows, "words", lengths)
    pick = F.coalesce(*[F.when(F.col("len") == n, F.get(f"_w{n}", F.lit(0))) for n in lengths])
    return materialize(hashed.select("len", "words", "items", pick.alias("hash")), "test-windows"), lengths


def hash_hits(documents: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (doc_id and key) with a window whose hash a test window has: at, an array of (pos, len), pos from 0."""
    keyed = documents.select("doc_id", *row_key(F.col("text")), words_of(F.col("text")).alias("_words"))
    hashed = window_hashes(keyed, "_words", lengths)
    others = lengths[:-1]
    every = hashed.select("doc_id", *KEY, *[F.size(f"_w{n}").alias(f"_n{n}") for n in others], F.posexplode_outer(F.concat(*[F.col(f"_w{n}") for n in lengths])).alias("_at", "hash"))
    # The windows stand one length after the other.
    before = sum((F.col(f"_n{n}") for n in others), F.lit(0))
    pos, size = F.col("_at") - before, F.lit(lengths[-1])
    for n in reversed(others):
        inside, before = F.col("_at") < before, before - F.col(f"_n{n}")
        pos, size = F.when(inside, F.col("_at") - before).otherwise(pos), F.when(inside, n).otherwise(size)
    tests = broadcast_if_small(windows.select("hash").distinct())
    found = every.join(tests, "hash").select("doc_id", *KEY, F.struct(pos.alias("pos"), size.alias("len")).alias("at"))
    return found.groupBy("doc_id", *KEY).agg(F.collect_set("at").alias("at"))


def find_hits(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id and key) with verified hits: hit_words (places from 0, sorted), items (strings, sorted) and n_words."""
    windows, lengths = benchmark_windows(benchmark, width)
    schema = documents.select("doc_id").schema["doc_id"].dataType.simpleString()
    if not lengths:
        return documents.sparkSession.createDataFrame([], f"doc_id {schema}, key_a long, key_b long, n_words long, hit_words array<int>, items array<string>")
    hits = broadcast_if_small(materialize(hash_hits(documents, windows, lengths), "hits"))
    keyed = documents.select("doc_id", *row_key(F.col("text")), "text")
    texts = keyed.join(hits, _same_row(keyed, hits)).select(keyed["doc_id"], keyed["key_a"], keyed["key_b"], words_of(keyed["text"]).alias("_words"), "at")
    cut = texts.select("doc_id", *KEY, F.size("_words").cast("long").alias("n_words"), F.explode(F.transform("at", lambda a: F.struct(a["pos"].alias("pos"), F.slice("_words", a["pos"] + 1, a["len"]).alias("words")))).alias("w"))
    tests = broadcast_if_small(windows.select("words", F.xxhash64("items").alias("set")))
    same = cut.select("doc_id", *KEY, "n_words", "w.pos", "w.words").join(tests, "words")
    grouped = same.groupBy("doc_id", *KEY).agg(
        F.first("n_words").alias("n_words"), F.collect_set(F.struct("pos", F.size("words").alias("len"))).alias("at"), F.collect_set("set").alias("sets")
    )
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))))
    found = materialize(grouped.select("doc_id", *KEY, "n_words", places.alias("hit_words"), "sets"), "verified")
    # Windows of the same items count once a document.
    sets = broadcast_if_small(windows.groupBy(F.xxhash64("items").alias("set")).agg(F.first("items").alias("set_items")))
    items = found.select("doc_id", *KEY, F.explode("sets").alias("set")).join(sets, "set").groupBy("doc_id", *KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("set_items")))).alias("items"))
    items = materialize(items, "items")
    return found.join(items, _same_row(found, items)).select(*[found[c] for c in ("doc_id", *KEY, "n_words", "hit_words")], "items")


def contamination_report(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated and hit_words (0-based places)."""
    found = broadcast_if_small(find_hits(documents, benchmark, width).drop("n_words"))
    counted = documents.select("doc_id", *row_key(F.col("text")), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(CASED_WORD)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return counted.join(found, _same_row(counted, found), "left").select(
        counted["doc_id"],
        "n_words",
        F.coalesce(F.size("hit_words"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
        F.col("hit_words").isNotNull().alias("contaminated"),
        F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_share: float = 0.5) -> DataFrame:
    """Documents with the hit words cut out, each with the gap before it; a document whose hit share exceeds max_share goes whole.

    Words of the normalised text and of the text itself stand at the same places, so the spans are cut from the text.
    An n_chars column follows the text.
    """
    found = broadcast_if_small(find_hits(documents, benchmark, width).drop("items"))
    whole = documents.select("doc_id", *row_key(F.col("text")), F.struct(*documents.columns).alias("d"))
    joined = whole.join(found, _same_row(whole, found), "left").where(F.col("hit_words").isNull() | (F.size("hit_words") <= max_share * F.col("n_words")))
    # Text is gap, word, gap, word, ..., gap; splitting at words leaves the gaps.
    words, gaps = F.regexp_extract_all("d.text", F.lit(CASED_WORD), F.lit(0)), F.split("d.text", CASED_WORD)
    pieces = joined.withColumn("pieces", F.when(F.col("hit_words").isNotNull(), F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), F.col("hit_words"))
    text = F.when(F.col("hit_words").isNull(), F.col("d.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("pieces", i)), ""))
    cut = pieces.select(F.col("d").withField("text", text).alias("d"), F.col("hit_words").isNull().alias("untouched"))
    if "n_chars" in documents.columns:
        n = F.when(F.col("untouched"), F.col("d.n_chars")).otherwise(F.length("d.text")).cast(documents.schema["n_chars"].dataType)
        cut = cut.withColumn("d", F.col("d").withField("n_chars", n))
    return cut.select("d.*")
