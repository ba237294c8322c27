"""Pages of a sorted table: files in order of (date descending, id), and an index of their first and last rows to seek by.

A page is found from the last row of the one before, not by counting rows: the index names the files that can hold what
comes after it, and only those are read. However far a page is, it reads as many files as its rows lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_A_FILE = 100_000


def _order(date: str, key: str) -> list[Column]:
    return [F.col(date).desc_nulls_last(), F.col(key)]


def _after(date: Column, key: Column, cursor: tuple) -> Column:
    """Whether a row comes after the cursor (date, key); dates are newest first, null ones last."""
    day, last = cursor
    at = F.lit(day)
    if day is None:
        return date.isNull() & (key > F.lit(last))
    return F.coalesce(date < at, F.lit(True)) | ((date == at) & (key > F.lit(last)))


def write_pages(rows: DataFrame, path: str, date: str, key: str, rows_a_file: int = ROWS_A_FILE) -> None:
    """Writes rows in order, and the index: a row a file."""
    n = max(1, -(-rows.count() // rows_a_file))
    rows.repartitionByRange(n, *_order(date, key)).sortWithinPartitions(*_order(date, key)).write.mode("overwrite").parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows").withColumn("file", F.col("_metadata.file_path"))
    # As numbers that rise in order: days before the newest possible one, and a null date after all.
    at = F.struct(F.coalesce(-F.unix_date(F.col(date).cast("date")), F.lit(1 << 30)).alias("d"), F.col(key).alias("k"))
    index = stored.groupBy("file").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    index.repartitionByRange(1, "first").sortWithinPartitions("first").write.mode("overwrite").parquet(f"{path}/index")


def page_after(spark: SparkSession, path: str, schema: T.StructType, date: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """The ``limit`` rows after the cursor (date, key of the last row seen), or the first ones."""
    index = spark.read.parquet(f"{path}/index")
    if cursor is not None:
        day = F.lit(1 << 30) if cursor[0] is None else -F.unix_date(F.lit(cursor[0]).cast("date"))
        index = index.where(F.col("last") > F.struct(day.alias("d"), F.lit(cursor[1]).cast(schema[key].dataType).alias("k")))
    found, held = [], 0
    for r in index.orderBy("first").limit(limit + 1).toLocalIterator():  # a file has a row at least; the first may lie before the cursor in part
        found.append(r["file"])
        held += r["n"] if len(found) > 1 or cursor is None else 0
        if held >= limit:
            break
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*found)
    if cursor is not None:
        rows = rows.where(_after(F.col(date), F.col(key), cursor))
    return rows.orderBy(*_order(date, key)).limit(limit)
