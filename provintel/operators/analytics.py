"""Analytics over snapshots, funding and signals: latest state, distributions, changes, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def max_funding(funding: DataFrame) -> DataFrame:
    return funding.groupBy("startup_id").agg(F.max("funding_amount_usd").alias("max_funding_usd"))


def best_round(funding: DataFrame) -> DataFrame:
    """Largest amount per startup and the date of that round; of equal amounts the latest."""
    best = funding.groupBy("startup_id").agg(F.max(F.struct("funding_amount_usd", "announcement_date")).alias("b"))
    return best.select("startup_id", "b.funding_amount_usd", "b.announcement_date")


def newest(df: DataFrame, key: str, date: str) -> DataFrame:
    """Row of the latest date per key; max of a struct combines map-side, a window would not."""
    rest = [c for c in df.columns if c not in (key, date)]
    got = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(date)).alias("s"), F.max(date).alias(date))
    return got.select(key, date, *[F.col(f"s.{c}").alias(c) for c in rest])


def latest_attributions(startups: DataFrame, funding: DataFrame, snapshots: DataFrame, least_funding: int = 10) -> DataFrame:
    """Each startup with its newest snapshot; startups whose largest round is under least_funding are left out."""
    kept = startups.join(max_funding(funding).withColumnRenamed("startup_id", "id"), "id", "left").where(
        F.col("max_funding_usd").isNull() | (F.col("max_funding_usd") >= least_funding)
    )
    return kept.join(newest(snapshots, "startup_id", "snapshot_date").withColumnRenamed("startup_id", "id"), "id", "left")


def cloud_bucket() -> Column:
    primary, multi = F.col("cloud_primary_provider"), F.coalesce("cloud_is_multi", F.lit(False))
    return (
        F.when(multi & (primary == "Hybrid"), "Hybrid").when(multi, "Multi-Cloud").when(primary.isin("AWS", "GCP", "Azure", "On-Premises"), primary)
        .when(primary.isNotNull(), "Other").otherwise("Unknown")
    )


def cloud_distribution(latest: DataFrame) -> DataFrame:
    return latest.groupBy(cloud_bucket().alias("provider")).agg(F.count("*").alias("startup_count"), F.round(F.avg("cloud_confidence"), 2).alias("avg_confidence"))


def ai_distribution(latest: DataFrame) -> DataFrame:
    bucket = F.when(F.coalesce("ai_is_multi", F.lit(False)), "Multi-Provider").otherwise(F.coalesce("ai_primary_provider", F.lit("Unknown")))
    return latest.groupBy(bucket.alias("provider")).agg(F.count("*").alias("startup_count"), F.round(F.avg("ai_confidence"), 2).alias("avg_confidence"))


def provider_combinations(latest: DataFrame) -> DataFrame:
    grouped = latest.where(F.col("cloud_providers").isNotNull()).groupBy("cloud_providers", "cloud_is_multi").agg(F.count("*").alias("startup_count"))
    return grouped.select(F.array_join("cloud_providers", " + ").alias("combination"), "startup_count", "cloud_is_multi")


def signal_effectiveness(signals: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct("startup_id") if approximate else F.count_distinct("startup_id")
    return signals.groupBy("provider_type", "signal_source", "signal_strength").agg(
        F.count("*").alias("signal_count"), distinct.alias("startup_count"), F.round(F.avg("confidence_weight"), 2).cast("double").alias("avg_weight")
    )


def vertical_distribution(latest: DataFrame) -> DataFrame:
    return latest.where(F.col("vertical").isNotNull()).groupBy("vertical").agg(F.count("*").alias("startup_count"))


def summary(latest: DataFrame, triggers: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row: companies, tier-1 companies, the commonest known cloud provider and its companies, triggers, and the newest run if runs are given."""
    known = latest.groupBy(cloud_bucket().alias("p")).agg(F.count("*").alias("n")).where("p <> 'Unknown'")
    top = known.agg(F.max(F.struct("n", "p")).alias("t")).select(F.col("t.p").alias("top_provider"), F.col("t.n").alias("top_count"))
    totals = latest.agg(F.count("*").alias("total_startups"), F.count_if(F.col("engagement_tier") == 1).alias("tier1_count"))
    hits = triggers.agg(F.count("*").alias("trigger_count"))
    every = totals.join(hits, F.lit(True)).join(top, F.lit(True))  # one row each
    if runs is not None:
        last = runs.agg(F.max(F.struct("run_date", "run_id", "status")).alias("r")).select(F.col("r.run_date").alias("last_run_date"), F.col("r.run_id").alias("last_run_id"), F.col("r.status").alias("last_run_status"))
        every = every.join(last, F.lit(True))
    return every


def usage_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("usage_date"), "source").agg(F.count("*").alias("query_count"))


def search_usage(usage: DataFrame, days: int, as_of: str, cost: float = 0.0003) -> DataFrame:
    """Zero-filled day x source rows of the last days: each source's count and rank by its total, the day's total and cost, and the grand total.

    Every source of the days is there, however many; a pivot on source_rank gives the matrix in the order of totals.
    """
    recent = usage.where(F.col("usage_date") > F.date_sub(F.lit(as_of).cast("date"), days))
    sources = recent.groupBy("source").agg(F.sum("query_count").alias("source_total"))
    ranked = sources.withColumn("source_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("source_total"), "source")))  # few sources
    by_day = recent.groupBy("usage_date").agg(F.sum("query_count").alias("total"))
    grand = recent.agg(F.sum("query_count").alias("grand_total"))
    cells = by_day.join(broadcast_if_small(ranked), F.lit(True)).join(F.broadcast(grand), F.lit(True))  # days x sources, as asked; grand is one row
    counts = recent.groupBy("usage_date", "source").agg(F.sum("query_count").alias("query_count"))
    return cells.join(counts, ["usage_date", "source"], "left").fillna(0, ["query_count"]).withColumn("cost_usd", F.round(F.col("total") * cost, 4))


def run_metrics(results: DataFrame) -> DataFrame:
    """Per run: discovered, attributed, errors, error map and status, from (run_id, startup_id, attributed, error).

    The map has one entry a startup; of several errors the last in sorted order.
    """
    failed = F.col("error").isNotNull()
    by_startup = results.groupBy("run_id", F.col("startup_id").cast("string").alias("s")).agg(
        F.count("*").alias("n"), F.count_if("attributed").alias("a"), F.count_if(failed).alias("e"), F.max("error").alias("error")
    )
    pairs = F.array_sort(F.collect_list(F.when(failed, F.struct("s", "error"))))
    return by_startup.groupBy("run_id").agg(
        F.sum("n").alias("startups_discovered"), F.sum("a").alias("startups_attributed"), F.sum("e").alias("errors_count"), F.map_from_entries(pairs).alias("error_log"),
    ).withColumn("status", F.when(F.col("errors_count") == 0, "completed").otherwise("completed_with_errors"))


def tier_counts(latest: DataFrame) -> DataFrame:
    return latest.groupBy("engagement_tier").agg(F.count("*").alias("startup_count"))


def fold_other(distribution: DataFrame, keep: list[str]) -> DataFrame:
    """Named providers stay, others become 'Other'; Unknown stays and sorts last."""
    name = F.when(F.col("provider").isin([*keep, "Unknown"]), F.col("provider")).otherwise("Other")
    return distribution.groupBy(name.alias("provider")).agg(F.sum("startup_count").alias("startup_count")).withColumn("is_last", F.col("provider") == "Unknown")


def top_n_other(distribution: DataFrame, name: str, n: int = 7) -> DataFrame:
    """The n largest groups and one 'Other' with the rest's names; groups are few, so one window holds them."""
    ranked = distribution.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("startup_count"), name)))
    big = F.col("rank") <= n
    return ranked.groupBy(F.when(big, F.col(name)).otherwise("Other").alias(name)).agg(
        F.sum("startup_count").alias("startup_count"), F.array_join(F.array_sort(F.collect_list(F.when(~big, F.col(name)))), ", ").alias("folded")
    )


def recent_funding(funding: DataFrame, startups: DataFrame, latest: DataFrame, n: int = 50, least: int = 10) -> DataFrame:
    rows = funding.where(F.col("funding_amount_usd") >= least).join(startups.select(F.col("id").alias("startup_id"), "canonical_name"), "startup_id")
    state = latest.select(F.col("id").alias("startup_id"), "cloud_primary_provider", "cloud_confidence")
    return rows.join(state, "startup_id", "left").orderBy(F.desc("announcement_date"), F.desc("funding_amount_usd"), "startup_id", "funding_id").limit(n)


def top_rows(df: DataFrame, newest_by: str, ties: list[str], n: int) -> DataFrame:
    """The n newest rows of runs or changes, ties by the given columns."""
    return df.orderBy(F.desc(newest_by), *ties).limit(n)


def attribution_changes(snapshots: DataFrame, mode: str = "all") -> DataFrame:
    """Pairs of snapshots of a startup, later after earlier, whose provider arrays differ (nulls compare equal).

    ``all`` gives every pair; startups of one state only are pruned first by a hash of the arrays. ``consecutive`` uses lag.
    """
    cols = [F.col("startup_id"), F.col("snapshot_date"), F.col("cloud_providers").alias("p")]
    state = snapshots.select(*cols)
    if mode == "consecutive":
        order = Window.partitionBy("startup_id").orderBy("snapshot_date")
        before = state.withColumn("old_date", F.lag("snapshot_date").over(order)).withColumn("old", F.lag("p").over(order))
        pairs = before.where(F.col("old_date").isNotNull())
    else:
        moving = state.groupBy("startup_id").agg(F.min(F.xxhash64("p")).alias("a"), F.max(F.xxhash64("p")).alias("b")).where("a <> b").select("startup_id")
        moved = state.join(moving, "startup_id")
        old = moved.select("startup_id", F.col("snapshot_date").alias("old_date"), F.col("p").alias("old"))
        pairs = moved.join(old, "startup_id").where("snapshot_date > old_date")
    differs = ~F.col("p").eqNullSafe(F.col("old"))
    return pairs.where(differs).select("startup_id", "old_date", F.col("snapshot_date").alias("new_date"), F.array_join("old", " + ").alias("old_providers"), F.array_join("p", " + ").alias("new_providers"))


def state_runs(snapshots: DataFrame) -> DataFrame:
    """(startup_id, run, providers, first_date, last_date, n): snapshots of a startup in a row with the same provider array."""
    order = Window.partitionBy("startup_id").orderBy("snapshot_date")
    state = snapshots.select("startup_id", "snapshot_date", F.col("cloud_providers").alias("p"))
    before = state.withColumn("_old", F.lag(F.struct("p")).over(order))  # a struct, so that no row and a null array differ
    opens = before.withColumn("_opens", (F.col("_old").isNull() | ~F.col("_old.p").eqNullSafe(F.col("p"))).cast("int"))
    numbered = opens.withColumn("run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("startup_id", "run").agg(F.first("p").alias("providers"), F.min("snapshot_date").alias("first_date"), F.max("snapshot_date").alias("last_date"), F.count("*").alias("n"))


def change_runs(snapshots: DataFrame) -> DataFrame:
    """attribution_changes() of all pairs, a row for each two runs of different state instead of each two snapshots.

    n_pairs is how many pairs of snapshots a row stands for; rows are bounded by the square of a startup's changes, however
    many snapshots it has.
    """
    runs = state_runs(snapshots)
    old = runs.select("startup_id", *[F.col(c).alias(f"old_{c}") for c in ("run", "providers", "first_date", "last_date", "n")])
    pairs = runs.join(old, "startup_id").where((F.col("run") > F.col("old_run")) & ~F.col("providers").eqNullSafe(F.col("old_providers")))
    return pairs.select(
        "startup_id", F.array_join("old_providers", " + ").alias("old_providers"), F.array_join("providers", " + ").alias("new_providers"), "old_first_date", "old_last_date",
        F.col("first_date").alias("new_first_date"), F.col("last_date").alias("new_last_date"), (F.col("n") * F.col("old_n")).alias("n_pairs"),
    )


SKETCH_K = 14  # standard error of a merged count: 0.83 / sqrt(2**14), 0.65 %


def effectiveness_sketches(signals: DataFrame, day: str = "signal_date") -> DataFrame:
    """signal_effectiveness() by day in a form that merges: counts, sums of weights, and a sketch of the startups."""
    return signals.groupBy(F.col(day).alias("day"), "provider_type", "signal_source", "signal_strength").agg(
        F.count("*").alias("n"), F.sum("confidence_weight").alias("weight"), F.hll_sketch_agg("startup_id", F.lit(SKETCH_K)).alias("startups")
    )


def effectiveness_between(sketches: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """signal_effectiveness() of any range of days from their sketches; startup_count is estimated (SKETCH_K; how days were grouped before moves it within the error), the rest exact."""
    some = sketches
    if first is not None:
        some = some.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        some = some.where(F.col("day") <= F.lit(last).cast("date"))
    merged = some.groupBy("provider_type", "signal_source", "signal_strength").agg(F.sum("n").alias("signal_count"), F.sum("weight").alias("_w"), F.hll_union_agg("startups").alias("_s"))
    return merged.select("provider_type", "signal_source", "signal_strength", "signal_count", F.hll_sketch_estimate("_s").alias("startup_count"), F.round(F.col("_w") / F.col("signal_count"), 2).cast("double").alias("avg_weight"))


def provider_label(primary: Column, multi: Column, names: Column, not_applicable: Column, kind: str = "cloud") -> Column:
    joined = F.array_join(names, ", ")
    many = "Multi-Cloud" if kind == "cloud" else "Multi-Provider"
    known = ["AWS", "GCP", "Azure", "On-Premises", "Unknown"]
    single = F.when(primary.isNull(), "Unknown").when(primary.isin(known) | F.lit(kind == "ai"), primary).otherwise(F.concat(F.lit("Other ("), primary, F.lit(")")))
    return (
        F.when(F.coalesce(not_applicable, F.lit(False)), "N/A").when(primary == "Hybrid", F.concat(F.lit("Hybrid ("), joined, F.lit(")")))
        .when(F.coalesce(multi, F.lit(False)), F.concat(F.lit(many + " ("), joined, F.lit(")"))).otherwise(single)
    )


def filter_companies(latest: DataFrame, cloud_provider=None, ai_provider=None, search=None, date_from=None, date_to=None, vertical=None, cloud_propensity=None, engagement_tier=None) -> DataFrame:
    """Only the filters that are given apply."""
    if cloud_provider is not None:
        latest = latest.where(F.array_contains("cloud_providers", cloud_provider))
    if ai_provider is not None:
        latest = latest.where(F.array_contains("ai_providers", ai_provider))
    if search is not None:
        latest = latest.where(F.col("canonical_name").ilike(f"%{search}%"))
    if date_from is not None:
        latest = latest.where(F.col("snapshot_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        latest = latest.where(F.col("snapshot_date") <= F.lit(date_to).cast("date"))
    for name, value in (("vertical", vertical), ("cloud_propensity", cloud_propensity), ("engagement_tier", engagement_tier)):
        if value is not None:
            latest = latest.where(F.col(name) == value)
    return latest


def page_of(latest: DataFrame, offset: int, limit: int) -> DataFrame:
    return latest.orderBy(F.desc_nulls_last("snapshot_date"), "id").offset(offset).limit(limit)


def company_history(snapshots: DataFrame, newest_first: list[str]) -> DataFrame:
    """All snapshots of a startup as one array, newest first."""
    return snapshots.groupBy("startup_id").agg(F.sort_array(F.collect_list(F.struct(*newest_first)), asc=False).alias("history"))


def ready_to_engage(latest: DataFrame, with_tier2: bool = True) -> DataFrame:
    tiers = [1, 2] if with_tier2 else [1]
    heat = F.when(F.col("engagement_timing") == "Hot", 0).when(F.col("engagement_timing") == "Warm", 1).otherwise(2)
    return latest.where(F.col("engagement_tier").isin(tiers)).withColumn("heat", heat).orderBy("heat", F.desc_nulls_last("funding_date"), "id")


def usage_last_rows(usage_by_day: DataFrame, n: int = 7) -> DataFrame:
    """Running sum of the last n days; one row a day, so one window holds them."""
    order = Window.partitionBy(F.lit(0)).orderBy("usage_date").rowsBetween(1 - n, 0)
    return usage_by_day.withColumn("last_rows", F.sum("query_count").over(order))


def filter_logs(logs: DataFrame, run_id=None, level=None, stage=None) -> DataFrame:
    for name, value in (("run_id", run_id), ("level", level), ("stage", stage)):
        if value is not None:
            logs = logs.where(F.col(name) == value)
    return logs.orderBy("created_at")
