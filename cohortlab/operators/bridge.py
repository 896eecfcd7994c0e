"""From per-type profiles to the lift tables that recommendations read.

Inputs are the tidy result tables of the profile operators: their size is
bounded by content types times schema leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.metrics import hour_label, is_significant, steady_round

# Section of a feature path -> reported category, and limits.
SECTION_CATEGORY = {
    "humanPresence": "humanPresence", "food": "food", "colors": "colors", "textElements": "text",
    "composition": "composition", "scene": "composition", "graphics": "composition", "branding": "composition",
    "psychology": "composition", "technicalQuality": "composition",
}
DEFAULT_CATEGORY = "composition"
NEAR_ZERO, NEAR_ZERO_LIFT = 0.01, 2.0
GOOD_LIFT, BAD_LIFT = 1.0, 0.7
TOP_PER_CATEGORY, TOP_WORST, TOP_PATTERNS, TOP_WORDS = 10, 10, 15, 10
HIGH_IMPACT = 1.5
HIGH_COMPETITION = 20


def weighted_avg(value: Column, weight: Column) -> Column:
    """Weighted mean; 0 for no rows or zero weight."""
    return F.coalesce(F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight))), F.lit(0.0))


def bool_lifts(profile: DataFrame, sizes: DataFrame, group: str = "content_type") -> DataFrame:
    """Sample-weighted lift per feature over all types.

    ``profile`` holds boolean rows, ``sizes`` the document counts per type.
    """
    rows = profile.join(sizes.select(group, F.col("n_all").alias("_n")), group).filter(F.col("confidence") != "low")
    lift = F.when(F.col("all_rate") > NEAR_ZERO, F.col("top_rate") / F.col("all_rate")).when(
        F.col("top_rate") > 0, F.lit(NEAR_ZERO_LIFT)
    )
    return (
        rows.withColumn("_lift", lift)
        .filter(F.col("_lift").isNotNull() & (F.col("_n") >= 10))
        .groupBy("path")
        .agg(
            steady_round(F.sum(F.col("_lift") * F.col("_n")) / F.sum("_n"), 2).alias("lift"),
            F.sum("_n").alias("sample_size"),
            F.bool_or(is_significant(F.col("all_rate"), F.col("top_rate"))).alias("_significant"),
        )
        .filter("_significant")
        .drop("_significant")
    )


def category_of(path: Column, mapping: dict[str, str] | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in (mapping or SECTION_CATEGORY).items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.substring_index(path, ".", 1)), F.lit(DEFAULT_CATEGORY))


def image_elements(lifts: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Best elements per category and the worst ones; lifts between are left out."""
    good = F.col("lift") >= GOOD_LIFT
    rows = (
        lifts.filter(good | (F.col("lift") < BAD_LIFT))
        .withColumn("category", F.when(good, category_of(F.col("path"), mapping)).otherwise("worst"))
        .withColumn("avoid", ~good)
    )
    order = [F.when(F.col("avoid"), F.col("lift")).otherwise(-F.col("lift")), F.col("path")]
    rank = F.row_number().over(Window.partitionBy("category").orderBy(*order))
    limit = F.when(F.col("avoid"), TOP_WORST).otherwise(TOP_PER_CATEGORY)
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select(
        "category", "rank", F.col("path").alias("element"), "lift", "sample_size", "avoid"
    )


def title_patterns(shares: DataFrame, sizes: DataFrame, group: str = "content_type", n: int = TOP_PATTERNS) -> DataFrame:
    """Winning values of a categorical title feature over all types."""
    top_total = sizes.agg(F.sum("n_top")).scalar()
    per_value = (
        shares.drop("n_all", "n_top")
        .join(sizes, group)
        .groupBy(F.col("value").alias("pattern"))
        .agg(
            F.sum(F.col("all_share") * F.col("n_all")).alias("_all"),
            F.sum(F.col("top_share") * F.col("n_top")).alias("_top"),
            F.sum("n_all").alias("_n"),
        )
        .withColumn("_top_total", top_total)
    )
    all_rate = F.col("_all") / F.col("_n")
    top_rate = F.coalesce(F.try_divide("_top", "_top_total"), F.lit(0.0))
    lift = F.when(all_rate > NEAR_ZERO, top_rate / all_rate).otherwise(F.lit(0.0))
    return (
        per_value.filter((F.col("_n") > 0) & (lift > 0))
        .select("pattern", steady_round(lift, 2).alias("lift"), F.floor(F.round("_all", 6)).cast("long").alias("sample_size"))
        .orderBy(F.desc("lift"), "pattern")
        .limit(n)
    )


def power_words(items: DataFrame, sizes: DataFrame, group: str = "content_type", n: int = TOP_WORDS) -> DataFrame:
    """Words used more by top rows, in a high and a medium band."""
    per_word = (
        items.drop("n_all", "n_top")
        .join(sizes, group)
        .groupBy(F.col("item").alias("word"))
        .agg(
            F.sum(F.col("all_rate") * F.col("n_all")).alias("_all"), F.sum("n_all").alias("_n"),
            F.sum(F.col("top_rate") * F.col("n_top")).alias("_top"), F.sum("n_top").alias("_n_top"),
        )
    )
    all_rate = F.coalesce(F.try_divide("_all", "_n"), F.lit(0.0))
    top_rate = F.coalesce(F.try_divide("_top", "_n_top"), F.lit(0.0))
    raw = F.when(all_rate > NEAR_ZERO, top_rate / all_rate).otherwise(F.lit(0.0))
    rows = per_word.filter(raw > 1.0).select("word", steady_round(raw, 2).alias("multiplier"))
    band = (
        F.when(F.col("multiplier") >= HIGH_IMPACT, "high").when(F.col("multiplier") > 1.0, "medium")
    )
    rank = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("multiplier"), "word"))
    return (
        rows.withColumn("band", band).filter(F.col("band").isNotNull()).withColumn("rank", rank).filter(F.col("rank") <= n)
    )


def _averages(numeric: DataFrame, sizes: DataFrame, path: str, group: str) -> DataFrame:
    rows = numeric.filter(F.col("path") == path).select(group, "all_avg", "top_avg").join(sizes, group)
    return rows.agg(
        weighted_avg(F.col("all_avg"), F.col("n_all")).alias("all_avg"),
        weighted_avg(F.col("top_avg"), F.col("n_top")).alias("top_avg"),
    ).withColumn("path", F.lit(path))


def optimal_length(
    numeric: DataFrame, sizes: DataFrame, paths: dict[str, str], group: str = "content_type"
) -> DataFrame:
    """Range of 70% to 130% around the top average per measured length."""
    parts = [_averages(numeric, sizes, p, group).withColumn("measure", F.lit(m)) for m, p in paths.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    top = F.col("top_avg")
    return rows.filter((F.col("all_avg") > 0) | (top > 0)).select(
        "measure", steady_round(top * 0.7, 0).alias("min"), steady_round(top * 1.3, 0).alias("max"),
        steady_round(top, 0).alias("sweet_spot"),
    )


def language_mix(numeric: DataFrame, sizes: DataFrame, path: str, group: str = "content_type") -> DataFrame:
    """Ratio range of plus/minus 0.15 around the top average, within [0, 1]."""
    top = F.col("top_avg")
    return _averages(numeric, sizes, path, group).filter((F.col("all_avg") > 0) | (top > 0)).select(
        steady_round(F.greatest(F.lit(0.0), top - 0.15), 2).alias("min"),
        steady_round(F.least(F.lit(1.0), top + 0.15), 2).alias("max"),
        steady_round(top, 2).alias("sweet_spot"),
    )


def timing_insights(timing: DataFrame) -> DataFrame:
    """Count-weighted mean per slot over types, and its multiplier.

    The base is the plain mean of the slots. At most 7 days and 24 hours.
    """
    slots = timing.groupBy("dim", "slot").agg(
        (F.sum(F.col("avg_vps") * F.col("n_items")) / F.sum("n_items")).alias("_avg")
    )
    base = F.avg("_avg").over(Window.partitionBy("dim"))
    multiplier = steady_round(F.when(base > 0, F.col("_avg") / base).otherwise(F.lit(1.0)), 2)
    return slots.select(
        "dim", "slot", steady_round(F.col("_avg"), 2).alias("avg_views"), multiplier.alias("multiplier"),
        F.when(F.col("dim") == "hour", hour_label(F.col("slot").cast("int"))).alias("label"),
    )


def optimal_slot(insights: DataFrame) -> DataFrame:
    """Best day, best hour and their joint multiplier, as one row."""
    by_day = F.when(F.col("dim") == "day", F.col("slot"))
    # highest multiplier first; on ties the smaller name / hour
    day_key = F.when(F.col("dim") == "day", F.struct(-F.col("multiplier"), by_day))
    hour = F.when(F.col("dim") == "hour", F.col("slot").cast("int"))
    hour_key = F.when(F.col("dim") == "hour", F.struct(-F.col("multiplier"), hour))
    best = insights.agg(
        F.min_by(by_day, day_key).alias("day"),
        F.min_by(F.col("multiplier"), day_key).alias("_day_x"),
        F.min_by(hour, hour_key).alias("hour"),
        F.min_by(F.col("label"), hour_key).alias("description"),
        F.min_by(F.col("multiplier"), hour_key).alias("_hour_x"),
    )
    joint = steady_round(F.coalesce(F.col("_day_x") * F.col("_hour_x"), F.col("_day_x"), F.col("_hour_x")), 2)
    return best.select("day", "hour", "description", joint.alias("multiplier"))


def content_gap_insights(gaps: DataFrame, saturated: DataFrame) -> DataFrame:
    """Gaps and saturated topics in the flat form recommendations read."""
    high = gaps.select(
        F.lit("high_opportunity").alias("kind"), "topic", F.col("avg_vps").alias("avg_views"), "n_items",
        "opportunity_score", F.lit(None).cast("string").alias("competition"),
    )
    full = saturated.select(
        F.lit("saturated").alias("kind"), "topic", F.lit(None).cast("double").alias("avg_views"),
        F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("double").alias("opportunity_score"),
        F.when(F.col("content_share") > HIGH_COMPETITION, "high").otherwise("medium").alias("competition"),
    )
    return high.unionByName(full)
