"""Incremental load as a stream: new ids only, drained by ``availableNow``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortlab.scale import stage
from cohortlab.sources.sinks import newest_per_key
from cohortlab.sources.versions import Store


def new_items_stream(
    landed: DataFrame, keys: list[str], event_time: str, delay: str = "2 days"
) -> DataFrame:
    """First record per key; state older than the watermark is dropped.

    A key that comes back after the watermark passes once more and is removed
    by the merge into the stored table.
    """
    return landed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def read_landed(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def drain(df: DataFrame, checkpoint: str, into: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run all available input through ``foreachBatch`` and stop."""
    query = (
        df.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def drain_to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    query = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def merge_new_items(
    store: Store, landed: DataFrame, to_rows: Callable[[DataFrame], DataFrame], at: Column, checkpoint: str, run: str,
    items: str = "items", progress: str = "progress", owner: str = "owner_id", order: str = "published_at",
) -> StreamingQuery:
    """Drain landed records into the stored items, one version of the store per micro-batch.

    ``to_rows`` makes item rows of a micro-batch. Keys that are stored already
    are left alone, so only the buckets of new keys are read and rewritten. The
    same version adds the batch's new items to each owner's row in
    ``progress``. A batch that is replayed after a failure finds its version
    by name and changes nothing; ``run`` names the checkpoint and must not be
    used with another one.
    """

    def into(batch: DataFrame, batch_id: int) -> None:
        mine = Store(batch.sparkSession, store.root)
        name = f"{run}-{batch_id}"
        if mine.has(name):
            return
        keys = mine.table(items).keys
        rows = stage(newest_per_key(to_rows(batch), keys, [order]), "arrived")
        known = mine.read(items, mine.touched(items, rows)).select(*keys)
        fresh = stage(rows.join(known, keys, "left_anti"), "fresh")
        counted = fresh.groupBy(owner).agg(F.count(F.lit(1)).alias("_n"))
        before = mine.read(progress).select(owner, F.col("new_items").alias("_before"))
        told = counted.join(before, owner, "left").select(
            owner, (F.coalesce("_before", F.lit(0)) + F.col("_n")).cast("long").alias("new_items"), at.alias("updated_at")
        )
        changes = [mine.upsert(items, fresh, [c for c in fresh.columns if c not in keys]), mine.upsert(progress, told)]
        mine.commit(name, changes)

    return drain(landed, checkpoint, into)
