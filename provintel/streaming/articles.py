"""Streaming ingest of articles: filters, url de-duplication in state, and one entry per title and look-back.

An entry is a run of articles of one title key of which each is at most the look-back after an earlier one; it keeps the
first and last time of the run and its best article, by source priority, then order. Entries that a later article can
still join are the open ones. A micro-batch joins its articles with the open entries and writes a new version of them;
entries that the watermark has passed by the look-back are closed, and written once, by the batch that closes them. So
the open table is bounded by the look-back, closed ones are never read again, and readers de-duplicate nothing.

A version is valid once its closed and open folders are written (Spark's success marks); a batch that is run again, or
was cut off, writes its own version again from the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import title_key
from ..operators.discovery import passes_filters, priority
from ..session import files, remove

LOOK_BACK = "3 days"
ENTRY = "key string, first timestamp, last timestamp, prio int, "
NEVER = "1970-01-01 00:00:00"


def fresh_articles(stream: DataFrame, look_back: str = LOOK_BACK) -> DataFrame:
    """Articles that pass their source's filter, once per url within the look-back; later than that is dropped, so state stays bounded."""
    return passes_filters(stream).withWatermark("published", look_back).dropDuplicatesWithinWatermark(["url"])


def entries_of(articles: DataFrame) -> DataFrame:
    """Each article as an entry of its own."""
    return articles.select(title_key(F.col("title")).alias("key"), F.col("published").alias("first"), F.col("published").alias("last"), priority(F.col("source")).cast("int").alias("prio"), *articles.columns)


def joined_entries(entries: DataFrame, look_back: str = LOOK_BACK) -> DataFrame:
    """Entries of one key that are at most the look-back apart become one; the best article stays. In any order and any parts the result is the same."""
    in_time = Window.partitionBy("key").orderBy("first", "last", "ord")
    reach = F.max("last").over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reach.isNull() | (F.col("first") > reach + F.expr(f"INTERVAL {look_back}"))).cast("int")
    runs = entries.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("key", "_run")
    best = F.row_number().over(run.orderBy(F.desc("prio"), "ord"))
    spans = runs.withColumn("_n", best).withColumn("_first", F.min("first").over(run)).withColumn("_last", F.max("last").over(run)).where("_n = 1")
    return spans.withColumn("first", F.col("_first")).withColumn("last", F.col("_last")).select(*entries.columns)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batches whose open and closed folders are whole, in order."""
    fs, root = files(spark, f"{path}/open")
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
    whole = lambda n: all(fs.exists(files(spark, f"{path}/{kind}/batch={n}/_SUCCESS")[1]) for kind in ("open", "closed"))
    return [n for n in found if whole(n)]


def _read(spark: SparkSession, path: str, kind: str, batches: list[int], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{kind}/batch={n}" for n in batches]) if batches else spark.createDataFrame([], schema)


def store_batch(batch: DataFrame, batch_id: int, path: str, schema: str, look_back: str = LOOK_BACK, slack: str = LOOK_BACK) -> None:
    """Writes the version of batch_id: entries that nothing can join any more to closed, the others to open.

    slack is the watermark's delay: an article may still come as late as that behind the latest one seen.
    """
    spark = batch.sparkSession
    before = [n for n in versions(spark, path) if n < batch_id][-1:]
    held = _read(spark, path, "open", before, ENTRY + schema)
    every = joined_entries(held.unionByName(entries_of(batch)), look_back).persist()
    seen = every.agg(F.max("last")).first()[0]
    over = F.col("last") < F.lit(seen or NEVER).cast("timestamp") - F.expr(f"INTERVAL {slack}") - F.expr(f"INTERVAL {look_back}")
    every.where(over).write.mode("overwrite").parquet(f"{path}/closed/batch={batch_id}")
    every.where(~over).write.mode("overwrite").parquet(f"{path}/open/batch={batch_id}")
    every.unpersist()
    old = [n for n in versions(spark, path) if n < batch_id - 1]
    for n in old:  # the version before stays, for a batch that is run again
        remove(spark, f"{path}/open/batch={n}")


def start_ingest(stream: DataFrame, path: str, checkpoint: str, look_back: str = LOOK_BACK) -> StreamingQuery:
    """Keeps path's entries up to date with a stream of articles."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)

    def store(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, path, schema, look_back, look_back)

    return fresh_articles(stream, look_back).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All entries: the closed ones of every version, and the open ones of the last. Nothing stored gives no rows."""
    done = versions(spark, path)
    fs, _ = files(spark, path)
    last = done[-1] if done else -1
    closed = []
    if done:
        names = [s.getPath().getName() for s in fs.listStatus(files(spark, f"{path}/closed")[1])]
        closed = sorted(n for n in (int(x.split("=")[1]) for x in names if x.startswith("batch=")) if n <= last)
    return _read(spark, path, "closed", closed, ENTRY + schema).unionByName(_read(spark, path, "open", done[-1:], ENTRY + schema))
