"""Upserts and snapshot building as set operations over keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.engagement import engagement_tier, tier_label, tier_rationale


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Target and updates with one row per key: updates beat the target, and of several the last in order."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), *[F.desc(c) for c in order]))
    return both.withColumn("_n", last).where("_n = 1").drop("_n", "_new")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_n", last).where("_n = 1").drop("_n")


def upsert_keep_nonnull(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """New values win, but a null never overwrites."""
    new = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in updates.columns if c != key])
    joined = target.join(new, target[key].eqNullSafe(F.col("_key")) & F.col("_key").isNotNull(), "full_outer")
    value = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in updates.columns else F.col(c)
    return joined.select(*[F.coalesce(key, "_key").alias(key) if c == key else value(c).alias(c) for c in target.columns])


def replace_signals(target: DataFrame, new: DataFrame, startups: DataFrame) -> DataFrame:
    """All signals of the given startups go; the new ones come in."""
    return target.join(startups.select("startup_id").distinct(), "startup_id", "left_anti").unionByName(new)


def build_snapshot(attributions: DataFrame, classification: DataFrame, as_of: str, startups: DataFrame | None = None, funding: DataFrame | None = None) -> DataFrame:
    """One wide row per startup from its two attribution sides and its classification; a missing side gets defaults.

    With startups every one of them has a row, attributed or not. With funding (startup_id, announcement_date) the
    engagement tier, its label and rationale are in the row.
    """
    first = F.get("providers", F.lit(0))
    told = F.struct(
        F.col("is_multi"), F.col("primary_provider"), F.transform("providers", lambda p: p["provider_name"]).alias("providers"), F.col("confidence"), first["entrenchment"].alias("entrenchment"),
        F.col("evidence_count"), first["raw_score"].cast("double").alias("raw_score"), F.col("is_not_applicable").alias("not_applicable"), F.col("not_applicable_note"),
    )
    sides = attributions.groupBy("startup_id").agg(*[F.first(F.when(F.col("provider_type") == k, told), ignorenulls=True).alias(k) for k in ("cloud", "ai")])
    if startups is not None:
        sides = startups.select(F.col("id").alias("startup_id")).join(sides, "startup_id", "left")
    default = {"is_multi": F.lit(False), "providers": F.array().cast("array<string>"), "evidence_count": F.lit(0).cast("long"), "not_applicable": F.lit(False)}
    names = ("is_multi", "primary_provider", "providers", "confidence", "entrenchment", "evidence_count", "raw_score", "not_applicable", "not_applicable_note")
    value = lambda k, n: F.coalesce(F.col(k)[n], default[n]) if n in default else F.col(k)[n]
    wide = sides.select("startup_id", *[value(k, n).alias(f"{k}_{n}") for k in ("cloud", "ai") for n in names]).join(classification, "startup_id", "left")
    if funding is not None:
        dates = funding.groupBy("startup_id").agg(F.max("announcement_date").alias("_date"))
        args = (F.col("_date"), F.col("cloud_propensity"), F.col("cloud_entrenchment"), F.lit(as_of).cast("date"))
        wide = wide.join(dates, "startup_id", "left").withColumn("engagement_tier", engagement_tier(*args))
        tier = F.col("engagement_tier")
        wide = wide.withColumn("engagement_tier_label", tier_label(tier)).withColumn("engagement_tier_rationale", tier_rationale(tier, *args)).drop("_date")
    return wide.withColumn("snapshot_date", F.lit(as_of).cast("date"))


def patch_snapshots(snapshots: DataFrame, patch: DataFrame, latest_only: bool = False) -> DataFrame:
    """Every snapshot of a startup takes the patch's non-null columns; with latest_only just its newest one."""
    new = patch.select("startup_id", *[F.col(c).alias(f"_{c}") for c in patch.columns if c != "startup_id"])
    joined = snapshots.join(new, "startup_id", "left")
    takes = F.lit(True)
    if latest_only:
        takes = F.col("snapshot_date") == F.max("snapshot_date").over(Window.partitionBy("startup_id"))
    value = lambda c: F.when(takes, F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
    return joined.select(*[value(c) if c in patch.columns and c != "startup_id" else F.col(c) for c in snapshots.columns])
