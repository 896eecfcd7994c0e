"""Operating side: flags, progress, quota, resume points, stored-path repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions import metrics as M
from cohortlab.scale import lookup_join, row_numbers, running_total

MAX_RETRIES = 3  # fixed value: failed owners are retried this often


# --- flags ----------------------------------------------------------------


def flag_sync(flags: DataFrame, owners: DataFrame) -> DataFrame:
    """Compare a review sheet with stored owners by handle.

    ``flags`` has (handle, analyze_enabled, category, label, ord): the last
    row of a handle wins. ``owners`` has (owner_id, custom_url,
    analyze_enabled, category). Statuses: updated, unchanged, unmatched_flag,
    unmatched_owner. Owners without a handle match nothing and stay out of the join,
    so they never meet on one key.
    """
    last = (
        flags.filter(F.col("handle") != "")
        .groupBy("handle")
        .agg(F.max_by(F.struct("analyze_enabled", "category"), "ord").alias("_f"))
        .select("handle", F.col("_f.analyze_enabled").alias("new_enabled"), F.col("_f.category").alias("new_category"))
    )
    mine = owners.select(
        "owner_id", F.lower(F.regexp_replace(F.coalesce("custom_url", F.lit("")), "^@+", "")).alias("handle"),
        F.col("analyze_enabled").alias("old_enabled"), F.col("category").alias("old_category"),
    )
    named, nameless = mine.filter(F.col("handle") != ""), mine.filter(F.col("handle") == "")
    joined = last.join(named, "handle", "full_outer").unionByName(nameless, allowMissingColumns=True)
    flag_changed = ~F.col("old_enabled").eqNullSafe(F.col("new_enabled"))
    category_changed = (F.col("new_category") != "") & ~F.col("old_category").eqNullSafe(F.col("new_category"))
    status = (
        F.when(F.col("owner_id").isNull(), "unmatched_flag")
        .when(F.col("new_enabled").isNull(), "unmatched_owner")
        .when(flag_changed | category_changed, "updated")
        .otherwise("unchanged")
    )
    return joined.select(
        "handle", "owner_id", status.alias("status"),
        F.coalesce("new_enabled", "old_enabled").alias("analyze_enabled"),
        F.when(category_changed, F.col("new_category")).otherwise(F.coalesce("old_category", "new_category")).alias("category"),
    )


def category_lookup(owners: DataFrame, config: DataFrame) -> DataFrame:
    """Category of each owner by handle, 'unknown' when not configured."""
    handles = config.groupBy("handle").agg(F.max_by("category", "ord").alias("category"))
    return owners.join(handles, "handle", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))


def enabled_count(owners: DataFrame, flag: str = "analyze_enabled") -> DataFrame:
    return owners.agg(F.count_if(F.col(flag)).alias("enabled"), F.count(F.lit(1)).alias("total"))


def unmatched_both_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only_a = a.join(b, key, "left_anti").withColumn("side", F.lit("left"))
    return only_a.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


# --- stored image paths ---------------------------------------------------


def backfill_paths(items: DataFrame, results: DataFrame, item: str = "item_id") -> DataFrame:
    """Set the image path of items whose image was stored."""
    ok = results.filter("ok").groupBy(item).agg(F.max("path").alias("_path"))
    return items.join(ok, item, "left").withColumn("image_path", F.coalesce("_path", "image_path")).drop("_path")


def shorts_with_images(items: DataFrame) -> DataFrame:
    return items.filter(F.col("is_short") & (F.coalesce("image_path", F.lit("")) != ""))


def clear_short_images(items: DataFrame) -> DataFrame:
    hit = F.col("is_short") & (F.coalesce("image_path", F.lit("")) != "")
    return items.withColumn("image_path", F.when(hit, F.lit("")).otherwise(F.col("image_path")))


def image_stats(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals per batch; failed ids are the rows of ``failed_images``."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed")
    )


def failed_images(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("ok"))


# --- progress -------------------------------------------------------------


def progress_fold(events: DataFrame) -> DataFrame:
    """Current progress per owner from its event log.

    ``events`` has (owner_id, ts, seq, event, n). Events: start (begins anew:
    no rows, no retries), progress (n = rows done so far, whatever was
    counted before), completed, failed, update (n = new rows on top), refresh.
    ``update_new_items`` is what the last update brought. Both passes combine
    map-side; the marks of an owner are one row.
    """
    order = F.struct("ts", "seq")

    def at(*kinds: str) -> Column:
        return F.col("event").isin(*kinds)

    status = (
        F.when(at("start"), "pending").when(at("progress"), "in_progress").when(at("completed"), "completed")
        .when(at("failed"), "failed")
    )
    level = F.when(at("start"), F.lit(0)).when(at("progress"), F.col("n")).cast("long")
    marks = events.groupBy(F.col("owner_id").alias("_id")).agg(
        F.max(F.when(at("start"), order)).alias("_start"),
        F.max(F.when(level.isNotNull(), order)).alias("_set"),
        F.max_by(F.when(level.isNotNull(), level), F.when(level.isNotNull(), order)).alias("_level"),
    )
    later = lambda mark: F.col(mark).isNull() | (order > F.col(mark))
    events = events.join(marks, F.col("owner_id").eqNullSafe(F.col("_id")))
    added = F.sum(F.when(at("update") & later("_set"), F.col("n")))
    return events.groupBy("owner_id").agg(
        F.max_by(F.when(status.isNotNull(), status), F.when(status.isNotNull(), order)).alias("status"),
        (F.coalesce(F.max("_level"), F.lit(0)) + F.coalesce(added, F.lit(0))).cast("long").alias("items_processed"),
        F.count_if(at("failed") & later("_start")).alias("retry_count"),
        F.coalesce(F.max_by(F.when(at("update"), F.col("n")), F.when(at("update"), order)), F.lit(0)).cast("long").alias("update_new_items"),
        F.count_if(at("refresh")).alias("refreshes"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_processed_at"),
    )


def progress_summary(progress: DataFrame) -> DataFrame:
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status)

    return progress.agg(
        n("completed"), n("in_progress"), n("pending"), n("failed"),
        F.coalesce(F.sum("items_processed"), F.lit(0)).alias("total_items"),
    )


def owners_to_process(wanted: DataFrame, progress: DataFrame) -> DataFrame:
    """start, resume or completed per owner; owners out of retries get none."""
    rows = wanted.join(progress.select("owner_id", "status", "retry_count"), "owner_id", "left")
    action = (
        F.when(F.col("status").isNull(), "start")
        .when(F.col("status") == "completed", "completed")
        .when(F.col("status").isin("in_progress", "pending"), "resume")
        .when((F.col("status") == "failed") & (F.col("retry_count") < MAX_RETRIES), "resume")
    )
    return rows.withColumn("action", action)


def unresolved_fold(attempts: DataFrame) -> DataFrame:
    """Failed link lookups: attempts, first and last time, last error."""
    return attempts.groupBy("id").agg(
        F.count(F.lit(1)).alias("retry_count"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_attempt_at"),
        F.max_by("error", F.struct("ts", "seq")).alias("error_message"),
        F.max_by("source_url", F.struct("ts", "seq")).alias("source_url"),
    )


def unresolved_split(progress: DataFrame, unknown: str = "no error was recorded") -> DataFrame:
    """Separate rows whose id is not an owner id, with field defaults."""
    def text(*cols: str) -> list[Column]:
        return [F.when(F.col(c) != "", F.col(c)) for c in cols]

    return progress.select(
        F.col("id"),
        M.is_owner_id(F.col("id")).alias("is_valid"),
        F.coalesce(*text("source_url", "title"), F.lit("")).alias("source_url"),
        F.coalesce(*text("error_message"), F.lit(unknown)).alias("error_message"),
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        F.col("started_at").alias("first_seen_at"),
        F.col("last_processed_at").alias("last_attempt_at"),
    )


def session_report(runs: DataFrame) -> DataFrame:
    """Totals of one session over per-owner run rows."""
    return runs.agg(
        F.count_if("success").alias("owners_processed"), F.count_if(~F.col("success")).alias("owners_failed"),
        F.count(F.lit(1)).alias("owners_total"), F.coalesce(F.sum(F.when(F.col("success"), F.col("n_items"))), F.lit(0)).alias("items"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("n_images"))), F.lit(0)).alias("images"),
        F.max("quota_used").alias("quota_used"),
    )


# --- quota ----------------------------------------------------------------


def quota_used_on(progress: DataFrame, day: Column) -> DataFrame:
    used = F.max(F.when(F.col("quota_date") == day, F.col("quota_used")))
    return progress.agg(F.coalesce(used, F.lit(0)).alias("quota_used"))


def quota_ledger(
    calls: DataFrame, order: Sequence[str], cost: str = "cost", limit: int = M.DAILY_QUOTA, reserve: int = M.QUOTA_RESERVE,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Running use, remaining units and the low flag after each call."""
    out = running_total(calls, list(order), {"used": F.col(cost).cast("long")}, keys)
    return out.withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used"))).withColumn(
        "is_low", F.lit(limit) - F.col("used") <= reserve
    )


# --- order ----------------------------------------------------------------


def resume_after(df: DataFrame, markers: DataFrame, owner: str, item: str, position: str) -> DataFrame:
    """Rows after each owner's marker; all rows if the marker is gone."""
    marker = F.col(item) == F.col("_marker")
    marks = (
        df.join(markers.select(owner, F.col("marker").alias("_marker")), owner)
        .filter(marker)
        .groupBy(owner)
        .agg(F.max(position).alias("_at"))
    )
    return lookup_join(df, marks, [owner], "left").filter(F.col(position) > F.coalesce("_at", F.lit(-1))).drop("_at")


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 50, out: str = "chunk") -> DataFrame:
    """Fixed-size ordered groups per key, numbered from 0."""
    numbered = row_numbers(df, list(order), "_rn", keys)
    return numbered.withColumn(out, F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key: each task keeps its own n before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


# --- owner statistics -----------------------------------------------------


def owner_stats(items: DataFrame, owner: str = "owner_id") -> DataFrame:
    """Mean views, mean engagement and uploads per week of each owner."""
    days = F.greatest(F.lit(1), F.datediff(F.max("published_at"), F.min("published_at")))
    return items.groupBy(owner).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg("views").alias("avg_views"),
        F.avg("engagement").alias("avg_engagement"),
        (F.count(F.lit(1)) / days * 7).alias("uploads_per_week"),
    )


def performance_percentile(df: DataFrame, owner: str, metric: str, out: str = "percentile") -> DataFrame:
    """Percent rank of the metric within its owner.

    Distinct values are counted and running sums spread over range
    partitions, so a hot owner is never sorted in one task. A row without a
    metric keeps a null rank and does not count for the others.
    """
    counts = df.filter(F.col(metric).isNotNull()).groupBy(owner, F.col(metric).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    below = running_total(counts, ["_v"], {"_upto": F.col("_c")}, [owner]).withColumn("_lower", F.col("_upto") - F.col("_c"))
    sizes = counts.groupBy(owner).agg(F.sum("_c").alias("_n"))
    same = below.join(sizes.withColumnRenamed(owner, "_o"), F.col(owner).eqNullSafe(F.col("_o")))
    ranked = same.select(
        F.col(owner).alias("_o"), "_v",
        F.when(F.col("_n") > 1, F.col("_lower") / (F.col("_n") - 1)).otherwise(F.lit(0.0)).alias(out),
    )
    match = F.col(owner).eqNullSafe(F.col("_o")) & (F.col(metric) == F.col("_v"))
    return df.join(ranked, match, "left").drop("_o", "_v")
