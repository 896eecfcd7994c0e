"""Load jobs over landed records: full, incremental and statistics refresh."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.operators.cohort import drop_shorts
from cohortlab.operators.ops import top_per_key
from cohortlab.operators.work import new_ids_until_known_page
from cohortlab.scale import stage
from cohortlab.sources.landed import item_rows
from cohortlab.sources.sinks import newest_per_key, update_columns, upsert

STATS_COLUMNS = ["views", "likes", "comments", "calculated", "stats_refreshed_at"]
KEYS = ["owner_id", "item_id"]


@dataclass
class LoadResult:
    items: DataFrame  # new state of the item table
    loaded: DataFrame  # rows written by this run
    missing: DataFrame  # listed ids without a record (deleted or private)
    image_work: DataFrame  # items whose image is to be fetched


def record_columns(rows: DataFrame) -> list[str]:
    """Fields that every landed record carries: one that is empty now clears the stored value."""
    return [c for c in rows.columns if c not in KEYS]


def _details(wanted: DataFrame, raw: DataFrame, owners: DataFrame, as_of: Column, include_shorts: bool):
    rows = item_rows(raw.join(wanted.select(F.col("item_id").alias("id")).distinct(), "id", "left_semi"), owners, as_of)
    # staged: new table state, missing ids and image work all read these rows
    rows = stage(newest_per_key(rows, KEYS, ["published_at"]), "loaded")
    missing = wanted.join(rows.select("item_id"), "item_id", "left_anti")
    return drop_shorts(rows, include_shorts=include_shorts), missing


def full_load(
    listed: DataFrame, raw: DataFrame, owners: DataFrame, as_of: Column, stored: DataFrame | None = None,
    markers: DataFrame | None = None, completed: DataFrame | None = None, max_items: int | None = None,
    include_shorts: bool = False, skip_short_images: bool = True,
) -> LoadResult:
    """Listed ids (owner_id, page, pos, item_id) to item rows.

    Owners already completed are skipped; others go on after their marker.
    """
    work = listed
    if completed is not None:
        work = work.join(completed.select("owner_id"), "owner_id", "left_anti")
    if max_items:
        work = top_per_key(work, ["owner_id"], [F.col("page"), F.col("pos")], max_items).drop("rank")
    if markers is not None:
        place = F.struct("page", "pos")
        marks = work.join(markers, "owner_id").filter(F.col("item_id") == F.col("marker")).groupBy("owner_id").agg(
            F.max(place).alias("_at")
        )
        work = work.join(marks, "owner_id", "left").filter(F.col("_at").isNull() | (place > F.col("_at"))).drop("_at")
    rows, missing = _details(work, raw, owners, as_of, include_shorts)
    items = rows if stored is None else upsert(stored, rows, KEYS, present=record_columns(rows))
    return LoadResult(items, rows, missing, drop_shorts(rows, include_shorts=not skip_short_images))


def incremental_load(
    listed: DataFrame, raw: DataFrame, stored: DataFrame, owners: DataFrame, as_of: Column,
    completed: DataFrame | None = None, include_shorts: bool = False, skip_short_images: bool = True,
) -> LoadResult:
    """New ids of completed owners, up to the first page that is all known."""
    work = listed if completed is None else listed.join(completed.select("owner_id"), "owner_id", "left_semi")
    work = new_ids_until_known_page(work, stored)
    rows, missing = _details(work, raw, owners, as_of, include_shorts)
    return LoadResult(upsert(stored, rows, KEYS, present=record_columns(rows)), rows, missing, drop_shorts(rows, include_shorts=not skip_short_images))


def stats_refresh(
    stored: DataFrame, raw: DataFrame, owners: DataFrame, as_of: Column, completed: DataFrame | None = None
) -> DataFrame:
    """Fresh counts and derived metrics for stored items, nothing else."""
    ids = stored.select(*KEYS)
    if completed is not None:
        ids = ids.join(completed.select("owner_id"), "owner_id", "left_semi")
    fresh = item_rows(raw, owners, as_of).join(ids, KEYS, "left_semi").withColumn("stats_refreshed_at", as_of)
    fresh = newest_per_key(fresh.select(*KEYS, *STATS_COLUMNS), KEYS, ["stats_refreshed_at"])
    return update_columns(stored, fresh, KEYS, STATS_COLUMNS)


def load_counts(result: LoadResult) -> DataFrame:
    """Rows loaded per owner (progress of the run)."""
    return result.loaded.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_items"))

