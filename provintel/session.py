"""Session helpers shared by the library: the shared work folder and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 256 << 20
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh folder where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="spark-")
    return _fallback[app]


def files(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark reads."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = files(spark, path)
    fs.delete(jpath, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """The path goes when the driver's JVM ends."""
    fs, jpath = files(spark, path)
    fs.deleteOnExit(jpath)


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and survives lost executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(value), T.ArrayType(kind.keyType)) + _width(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda a, x: a + _width(x, kind.elementType)), F.lit(16))
        return F.greatest(F.size(value), F.lit(0)) * 8 + 16
    return F.lit(8)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when a count of rows and bytes proves df small; otherwise leave the join strategy to Spark."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(width.cast("long"))).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df
