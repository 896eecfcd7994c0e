"""Posting-time profiles by weekday and by local hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.metrics import steady_round

MIN_POSTS = 5  # fixed value: smallest reported slot


def timing_profile(
    df: DataFrame, metric: str, day: str = "day", hour: str = "hour", group: str = "content_type"
) -> DataFrame:
    """Mean metric and count per slot with at least 5 positive rows.

    Weekdays and hours come from one pass with grouping sets.
    """
    rows = df.select(group, F.col(day).alias("day"), F.col(hour).cast("int").alias("hour"), F.col(metric).alias("_m"))
    rows = rows.filter(F.col("_m") > 0)
    return (
        rows.groupingSets([[F.col(group), F.col("day")], [F.col(group), F.col("hour")]], F.col(group), F.col("day"), F.col("hour"))
        .agg(
            F.grouping("hour").alias("_by_day"), F.avg("_m").alias("_avg"), F.count(F.lit(1)).alias("n_items"),
        )
        .select(
            group,
            F.when(F.col("_by_day") == 1, "day").otherwise("hour").alias("dim"),
            F.when(F.col("_by_day") == 1, F.col("day")).otherwise(F.col("hour").cast("string")).alias("slot"),
            steady_round(F.col("_avg"), 2).alias("avg_vps"),
            "n_items",
        )
        .filter(F.col("slot").isNotNull() & (F.col("n_items") >= MIN_POSTS))
    )
