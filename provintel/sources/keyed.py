"""A keyed table of Parquet cells with a manifest: upserts rewrite the cells they touch, patches go to a log that reads merge.

Rows lie in cells (part, bucket): a part is a value of the rows (say, the month of a snapshot), a bucket a hash of the
patch key (say, the startup). An upsert reads and writes the cells that its rows fall into, so a day's snapshots leave
other months alone. A patch, which sets columns of all rows of a patch key, is written to a log by bucket; a read joins the
log entries that a cell has not taken in yet. compact() takes them in, in the buckets they touch only.

What counts is the newest whole manifest: which version of each cell is valid, and how far in the log it is. A manifest is
created once under its number, after all its files; a job that dies before leaves the table as it was, and of two jobs
that change the table at once one fails with Conflict and can run again. Files that no manifest names go with vacuum().
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, files, remove


class Conflict(RuntimeError):
    """Another job has changed the table meanwhile."""


class KeyedTable:
    """Rows of schema with one row per keys; patch_key is one of the keys, part an SQL expression of the keys."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], patch_key: str, part: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.patch_key, self.part, self.buckets = spark, path.rstrip("/"), schema, keys, patch_key, part, buckets

    def _placed(self, df: DataFrame) -> DataFrame:
        part = F.coalesce(F.expr(self.part).cast("string"), F.lit("none"))
        return df.withColumn("_part", part).withColumn("_bucket", F.pmod(F.xxhash64(self.patch_key), F.lit(self.buckets)).cast("int"))

    def _number(self) -> int:
        """The newest manifest's number; 0 if there is none."""
        fs, folder = files(self.spark, f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)

    def manifest(self) -> dict:
        """{number, cells: {part/bucket: [version, place in the log]}, log: number of its last entry, patched: {entry: buckets}}."""
        for number in range(self._number(), 0, -1):
            try:
                text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{number}.json", wholetext=True).collect())
                return json.loads(text)
            except ValueError:  # its writer died: it never counted
                continue
        return {"number": 0, "cells": {}, "log": 0, "patched": {}}

    def _commit(self, now: dict, **changes) -> None:
        number = self._number() + 1 if now["number"] == 0 else now["number"] + 1
        fs, target = files(self.spark, f"{self.path}/manifest/{number}.json")
        if self.manifest()["number"] != now["number"]:
            raise Conflict(f"{self.path} is at {self.manifest()['number']}, not {now['number']}")
        while fs.exists(target):  # broken ones keep their numbers
            number += 1
            _, target = files(self.spark, f"{self.path}/manifest/{number}.json")
        out = fs.create(target, False)
        out.write(bytearray(json.dumps({**now, **changes, "number": number}).encode()))
        out.close()

    def _base(self, cells: dict) -> DataFrame:
        """Rows of cells as they are stored, with _part, _bucket and _at, their cell's place in the log."""
        wide = T.StructType([*self.schema.fields, T.StructField("v", T.IntegerType()), T.StructField("_part", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        folders = [f"{self.path}/data/v={v}/_part={cell.rsplit('/', 1)[0]}/_bucket={cell.rsplit('/', 1)[1]}" for cell, (v, _) in cells.items()]
        rows = self.spark.read.schema(wide).option("basePath", f"{self.path}/data").parquet(*folders) if folders else self.spark.createDataFrame([], wide)
        places = self.spark.createDataFrame([(cell, at) for cell, (_, at) in cells.items()], "_cell string, _at int")
        return rows.withColumn("_cell", F.concat_ws("/", "_part", F.col("_bucket").cast("string"))).join(broadcast_if_small(places), "_cell").drop("v", "_cell")

    def _pending(self, now: dict, cells: dict) -> DataFrame | None:
        """Log entries that some of the cells lack: patch key, columns and _entry."""
        least = {}
        for cell, (_, at) in cells.items():
            bucket = int(cell.rsplit("/", 1)[1])
            least[bucket] = min(at, least.get(bucket, at))
        wanted = [(int(n), b) for n, bs in now["patched"].items() for b in bs if int(n) > least.get(b, now["log"])]
        if not wanted:
            return None
        schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in self.schema.fields if f.name not in self.keys or f.name == self.patch_key], T.StructField("_entry", T.IntegerType()), T.StructField("_bucket", T.IntegerType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/log").parquet(*[f"{self.path}/log/_entry={n}/_bucket={b}" for n, b in wanted]).drop("_bucket")

    def _merged(self, now: dict, cells: dict) -> DataFrame:
        """Rows of cells with all log entries taken in, and their _part and _bucket."""
        base, patches = self._base(cells), self._pending(now, cells)
        if patches is None:
            return base.drop("_at")
        values = [c for c in patches.columns if c not in (self.patch_key, "_entry")]
        history = patches.groupBy(self.patch_key).agg(F.array_sort(F.collect_list(F.struct("_entry", *values))).alias("_log"))  # a patch key has one row an entry
        joined = base.join(history, self.patch_key, "left")

        def last(c: str):
            told = F.filter("_log", lambda e: (e["_entry"] > F.col("_at")) & e[c].isNotNull())
            return F.coalesce(F.get(told, F.size(told) - 1)[c], F.col(c)).alias(c)

        return joined.select(*[last(f.name) if f.name in values else F.col(f.name) for f in self.schema.fields], "_part", "_bucket")

    def read(self) -> DataFrame:
        now = self.manifest()
        return self._merged(now, now["cells"]).select(*self.schema.fieldNames())

    def _write(self, now: dict, rows: DataFrame, cells: list[str]) -> None:
        """Rows of whole cells become a new version of those; cells without rows go."""
        version = max([v for v, _ in now["cells"].values()], default=0) + 1
        while files(self.spark, f"{self.path}/data/v={version}")[0].exists(files(self.spark, f"{self.path}/data/v={version}")[1]):
            version += 1  # of a job that died
        rows.repartition("_part", "_bucket").write.partitionBy("_part", "_bucket").parquet(f"{self.path}/data/v={version}")
        fs, folder = files(self.spark, f"{self.path}/data/v={version}")
        written = {f"{p.getPath().getName().split('=', 1)[1]}/{b.getPath().getName().split('=', 1)[1]}" for p in fs.listStatus(folder) if p.isDirectory() for b in fs.listStatus(p.getPath()) if b.isDirectory()}
        kept = {c: x for c, x in now["cells"].items() if c not in cells}
        self._commit(now, cells={**kept, **{c: [version, now["log"]] for c in sorted(written)}})

    def upsert(self, updates: DataFrame, order: list[str]) -> list[str]:
        """Of several updates of a key the last in order counts; updates beat stored rows. Returns the cells written, no more than there are cells."""
        now = self.manifest()
        placed = self._placed(updates.select(*self.schema.fieldNames(), *[c for c in order if c not in self.schema.fieldNames()]))
        last = Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in order])
        new = placed.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*self.schema.fieldNames(), "_part", "_bucket").persist()
        touched = sorted(f"{r[0]}/{r[1]}" for r in new.select("_part", "_bucket").distinct().collect())
        if touched:
            old = self._merged(now, {c: now["cells"][c] for c in touched if c in now["cells"]})
            kept = old.join(new.select(*self.keys), self.keys, "left_anti")
            self._write(now, kept.select(*new.columns).unionByName(new), touched)
        new.unpersist()
        return touched

    def patch(self, patch: DataFrame) -> int:
        """Sets the patch's non-null columns in all rows there are now of its patch keys; one row a key. Returns the entry's number."""
        now = self.manifest()
        columns = [F.col(f.name) if f.name in patch.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in self.keys or f.name == self.patch_key]
        entry = now["log"] + 1
        rows = patch.select(*columns).dropDuplicates([self.patch_key]).withColumn("_bucket", F.pmod(F.xxhash64(self.patch_key), F.lit(self.buckets)).cast("int"))
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/log/_entry={entry}")
        fs, folder = files(self.spark, f"{self.path}/log/_entry={entry}")
        buckets = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder) if s.isDirectory())
        self._commit(now, log=entry, patched={**now["patched"], str(entry): buckets})
        return entry

    def compact(self) -> list[str]:
        """Takes the log in where it is pending. Returns the cells written."""
        now = self.manifest()
        behind = {c: x for c, x in now["cells"].items() if any(int(n) > x[1] and int(c.rsplit("/", 1)[1]) in bs for n, bs in now["patched"].items())}
        if behind:
            self._write(now, self._merged(now, behind), list(behind))
        now = self.manifest()
        self._commit(now, patched={}, cells={c: [v, now["log"]] for c, (v, _) in now["cells"].items()})
        return sorted(behind)

    def vacuum(self) -> int:
        """Removes versions, log entries and manifests that the newest manifest doesn't name; no other job may read or write meanwhile."""
        now, gone = self.manifest(), 0
        used = {"data": {v for v, _ in now["cells"].values()}, "log": {int(n) for n in now["patched"]}, "manifest": {now["number"]}}
        for kind, keep in used.items():
            fs, folder = files(self.spark, f"{self.path}/{kind}")
            for name in [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []:
                if int(name.split("=")[-1].removesuffix(".json")) not in keep:
                    remove(self.spark, f"{self.path}/{kind}/{name}")
                    gone += 1
        return gone
