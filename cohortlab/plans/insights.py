"""The insights job: assembled items in, all result tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions import metrics as M
from cohortlab.operators import bridge as B
from cohortlab.operators import cohort as C
from cohortlab.operators import gaps as G
from cohortlab.operators import profile as P
from cohortlab.operators.correlate import feature_correlations
from cohortlab.operators.recommend import Insights
from cohortlab.operators.timing import timing_profile
from cohortlab.scale import settle, stage
from cohortlab.sources.sinks import overwrite_documents

MIN_CORRELATED = 30  # fixed value: documents a type needs for correlations


def build_cohort(
    assembled: DataFrame, as_of: Column, metric: str = "vps", engagement: str = "engagement",
    subscribers: str = "subscribers", recency: bool = True, min_rows: int = C.MIN_GROUP_ROWS,
) -> DataFrame:
    """Capped metric, weight and both top flags of types with enough rows.

    The assembled rows are staged once. Cap, thresholds and flags are then
    cheap expressions over that table and a small broadcast of thresholds, so
    every later aggregation is one pruned scan.
    """
    kept = C.winsorize(stage(assembled, "assembled"), metric, subscribers)
    marked = C.mark_top(
        kept, ["content_type"], {"is_top": metric, "is_top_eng": engagement}, min_rows=min_rows
    )
    weight = M.recency_weight(F.col("published_at"), as_of) if recency else F.lit(1.0)
    return marked.withColumn("weight", weight)


def type_summary(cohort: DataFrame, metric: str = "vps") -> DataFrame:
    return cohort.groupBy("content_type").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if("is_top").alias("n_top"),
        M.steady_round(F.max("is_top_at"), 2).alias("top_threshold"), M.steady_round(F.avg(metric), 2).alias("avg_vps"),
        F.count_if("is_top_eng").alias("n_top_engagement"), F.round(F.max("is_top_eng_at"), 4).alias("engagement_threshold"),
    )


def run_insights(
    cohort: DataFrame, image: str = "image_analysis", title: str = "title_analysis", description: str | None = None,
    metric: str = "vps", formats: dict[str, Column] | None = None, topic: Column | None = None,
    primary: str | None = None, secondary: str | None = None,
) -> dict[str, DataFrame]:
    """All insight tables of a cohort (see ``build_cohort``)."""
    out: dict[str, DataFrame] = {"summary": type_summary(cohort, metric), "overview": G.insights_summary(cohort, metric)}
    with_image = C.with_document(cohort, image)
    out["image_profile"] = settle(P.feature_profile(with_image, image, "thumbnail"))
    out["title_profile"] = settle(P.feature_profile(cohort, title, "title"))
    if description:
        nested = cohort.withColumn("_desc", F.col(description))
        out["description_profile"] = P.feature_profile(C.with_document(nested, "_desc"), "_desc", "description")
    out["engagement_image_profile"] = P.feature_profile(with_image, image, "thumbnail", top="is_top_eng", weight=None)
    out["engagement_title_profile"] = P.feature_profile(cohort, title, "title", top="is_top_eng", weight=None)
    out["correlations"] = feature_correlations(C.min_rows(with_image, ["content_type"], MIN_CORRELATED), image)
    out["timing"] = settle(timing_profile(cohort, metric))
    image_sizes = settle(P.sample_sizes(cohort, image))
    title_sizes = settle(P.sample_sizes(cohort, title))

    image_rows, title_rows = out["image_profile"], out["title_profile"]
    lifts = B.bool_lifts(image_rows.filter("kind = 'bool'"), image_sizes)
    out["elements"] = settle(B.image_elements(lifts))
    shares = title_rows.filter("kind = 'str' AND path = 'structure.pattern'").withColumnsRenamed(
        {"all_rate": "all_share", "top_rate": "top_share"}
    )
    out["patterns"] = settle(B.title_patterns(shares, title_sizes))
    words = title_rows.filter("kind = 'item' AND path = 'hooks.powerWords'").withColumnRenamed("value", "item")
    out["words"] = settle(B.power_words(words, title_sizes))
    numbers = title_rows.filter("kind = 'num'")
    out["length"] = B.optimal_length(
        numbers, title_sizes, {"characters": "structure.characterCount", "words": "structure.wordCount"}
    )
    out["language_mix"] = B.language_mix(numbers, title_sizes, "language.teluguRatio")
    out["slots"] = settle(B.timing_insights(out["timing"]))
    out["optimal"] = settle(B.optimal_slot(out["slots"]))

    if topic is not None:
        stats = settle(G.topic_stats(cohort.withColumn("_topic", topic), "_topic", metric))
        out["topics"] = stats
        out["gaps"] = settle(G.topic_gaps(stats))
        out["saturated"] = settle(G.saturated_topics(stats))
        out["content_gaps"] = B.content_gap_insights(out["gaps"], out["saturated"])
    if primary:
        out["keywords"] = settle(G.keyword_gaps(G.keyword_stats(cohort, metric, primary, secondary)))
    if formats:
        out["formats"] = settle(G.format_stats(cohort, metric, formats))
    return out


def as_insights(tables: dict[str, DataFrame], n_items: int, version: str) -> Insights:
    """The part of the result tables that recommendations read."""
    names = ["gaps", "saturated", "keywords", "formats", "slots", "optimal", "elements", "patterns", "words"]
    return Insights(**{n: tables.get(n) for n in names}, n_items=n_items, version=version)


def write_insights(tables: dict[str, DataFrame], path: str, generated_at: Column) -> None:
    """One JSON row per result row in partitions by insight; only those written are replaced."""
    for name, df in tables.items():
        rows = df.select(
            F.lit(name).alias("insight_type"), generated_at.alias("generated_at"), F.to_json(F.struct("*")).alias("row")
        )
        overwrite_documents(rows, path, "insight_type")
