"""Topic, keyword and format gaps of a cohort.

``metric`` is any numeric column; totals count all rows, means only rows with
a positive metric.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.metrics import steady_round
from cohortlab.functions.nested import tag_list

# Thresholds, list lengths and the analysed formats.
MIN_TOPIC_ROWS, MIN_KEYWORD_ROWS = 3, 2
SATURATED_SHARE, SATURATED_LEVEL = 0.1, 0.8
KEYWORD_SHARE = 0.1
TOP_TOPICS, TOP_SATURATED, TOP_KEYWORDS = 20, 10, 30
FORMATS = ["recipe", "tutorial", "review", "vlog", "challenge", "reaction", "comparison", "list", "storytime"]


def topic_of(niche: Column, sub_niche: Column) -> Column:
    niche = F.coalesce(niche, F.lit("unknown"))
    return F.when(F.coalesce(sub_niche, F.lit("")) != "", F.concat(niche, F.lit("/"), sub_niche)).otherwise(niche)


def overall(df: DataFrame, metric: str) -> tuple[Column, Column]:
    """(total rows, mean of positive metrics) as scalar subqueries."""
    total = df.agg(F.count(F.lit(1))).scalar()
    mean = df.agg(F.coalesce(F.avg(F.when(F.col(metric) > 0, F.col(metric))), F.lit(0.0))).scalar()
    return total, mean


def topic_stats(df: DataFrame, topic: str, metric: str) -> DataFrame:
    """Every topic with at least 3 positive rows and its opportunity."""
    total, mean = overall(df, metric)
    grouped = (
        df.filter(F.col(metric) > 0)
        .groupBy(F.col(topic).alias("topic"))
        .agg(F.avg(metric).alias("_avg"), F.count(F.lit(1)).alias("n_items"))
        .filter(F.col("n_items") >= MIN_TOPIC_ROWS)
    )
    return grouped.withColumns({"_total": total, "_mean": mean}).select(
        "topic",
        steady_round(F.col("_avg"), 2).alias("avg_vps"),
        "n_items",
        F.round(F.col("n_items") / F.col("_total") * 100, 2).alias("content_share"),
        steady_round(F.col("_avg") / (F.col("n_items") + 1), 3).alias("opportunity_score"),
        ((F.col("n_items") > F.col("_total") * SATURATED_SHARE) & (steady_round(F.col("_avg"), 2) < F.col("_mean") * SATURATED_LEVEL)).alias(
            "saturated"
        ),
    )


def topic_gaps(stats: DataFrame, n: int = TOP_TOPICS) -> DataFrame:
    return stats.drop("saturated").orderBy(F.desc("opportunity_score"), "topic").limit(n)


def saturated_topics(stats: DataFrame, n: int = TOP_SATURATED) -> DataFrame:
    return stats.filter("saturated").drop("saturated").orderBy(F.desc("opportunity_score"), "topic").limit(n)


def topic_summary(df: DataFrame, stats: DataFrame, metric: str) -> DataFrame:
    _, mean = overall(df, metric)
    return stats.agg(F.count(F.lit(1)).alias("total_topics")).select("total_topics", steady_round(mean, 2).alias("avg_vps"))


def keyword_rows(
    df: DataFrame, metric: str, primary: str, secondary_text: str | None = None, secondary_list: str | None = None
) -> DataFrame:
    """(keyword, metric) rows; a keyword in both places counts twice."""
    second = tag_list(
        F.col(secondary_text) if secondary_text else None, F.col(secondary_list) if secondary_list else None
    )
    words = F.filter(F.concat(F.array(F.coalesce(F.col(primary), F.lit(""))), second), lambda w: w != "")
    return df.filter(F.col(metric) > 0).select(
        F.explode(F.transform(words, lambda w: F.lower(w))).alias("keyword"), F.col(metric).alias("_m")
    )


def keyword_stats(
    df: DataFrame, metric: str, primary: str, secondary_text: str | None = None, secondary_list: str | None = None
) -> DataFrame:
    total, mean = overall(df, metric)
    grouped = (
        keyword_rows(df, metric, primary, secondary_text, secondary_list)
        .groupBy("keyword")
        .agg(F.avg("_m").alias("_avg"), F.count(F.lit(1)).alias("usage_count"))
        .filter(F.col("usage_count") >= MIN_KEYWORD_ROWS)
    )
    rate = F.col("usage_count") / F.col("_total")
    return (
        grouped.withColumns({"_total": total, "_mean": mean})
        .filter((F.col("_avg") > F.col("_mean")) & (rate < KEYWORD_SHARE))
        .select(
            "keyword",
            steady_round(F.col("_avg"), 2).alias("avg_vps"),
            steady_round(F.when(F.col("_mean") > 0, F.col("_avg") / F.col("_mean")).otherwise(F.lit(1.0)), 2).alias("multiplier"),
            "usage_count",
            F.round(rate * 100, 2).alias("usage_percent"),
            F.round(rate, 6).alias("usage_rate"),
        )
    )


def keyword_summary(
    df: DataFrame, metric: str, primary: str, secondary_text: str | None = None, secondary_list: str | None = None
) -> DataFrame:
    """Number of different keywords of rows with a positive metric, rare ones included."""
    words = keyword_rows(df, metric, primary, secondary_text, secondary_list).select("keyword").distinct()
    return words.agg(F.count(F.lit(1)).alias("total_keywords"))


def keyword_gaps(stats: DataFrame, n: int = TOP_KEYWORDS) -> DataFrame:
    return stats.orderBy(F.desc("multiplier"), "keyword").limit(n)


def format_stats(df: DataFrame, metric: str, flags: dict[str, Column]) -> DataFrame:
    """Mean, multiplier and usage per boolean format flag."""
    total, mean = overall(df, metric)
    names = F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))
    grouped = (
        df.filter(F.col(metric) > 0)
        .select(F.explode(names).alias("format"), F.col(metric).alias("_m"))
        .groupBy("format")
        .agg(F.avg("_m").alias("_avg"), F.count(F.lit(1)).alias("n_items"))
    )
    multiplier = steady_round(F.when(F.col("_mean") > 0, F.col("_avg") / F.col("_mean")).otherwise(F.lit(1.0)), 2)
    return grouped.withColumns({"_total": total, "_mean": mean}).select(
        "format",
        steady_round(F.col("_avg"), 2).alias("avg_vps"),
        multiplier.alias("multiplier"),
        "n_items",
        F.round(F.col("n_items") / F.col("_total") * 100, 2).alias("usage_percent"),
        (multiplier > 1.0).alias("recommended"),
    )


def insights_summary(df: DataFrame, metric: str, group: str = "content_type") -> DataFrame:
    """Count and mean metric per group with the grand total (null group)."""
    return df.rollup(group).agg(F.count(F.lit(1)).alias("n_items"), steady_round(F.avg(metric), 2).alias("avg_vps"))
