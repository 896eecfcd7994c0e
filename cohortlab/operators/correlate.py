"""Co-occurrence of boolean features among top performers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.nested import doc_leaves
from cohortlab.operators.profile import bool_counts
from cohortlab.scale import lookup_join, settle

# Feature and pair limits.
TOP_FEATURES, TOP_PAIRS, MIN_VALUES, MIN_RATE = 20, 10, 10, 0.01


def lifted_features(
    df: DataFrame, doc: str, group: str = "content_type", top: str = "is_top", n_features: int = TOP_FEATURES
) -> DataFrame:
    """The features with the highest lift per group, ranked from 0."""
    all_rate, top_rate = F.col("t_all") / F.col("n_all"), F.col("t_top") / F.col("n_top")
    counts = bool_counts(df, doc, group, top).filter(
        (F.col("n_all") >= MIN_VALUES) & (all_rate >= MIN_RATE) & (F.col("n_top") > 0)
    )
    by_lift = Window.partitionBy(group).orderBy(F.desc("lift"), "path")
    return (
        counts.select(group, "path", (top_rate / all_rate).alias("lift"))
        .withColumn("bit", F.row_number().over(by_lift) - 1)
        .filter(F.col("bit") < n_features)
    )


def feature_correlations(
    df: DataFrame, doc: str, group: str = "content_type", top: str = "is_top",
    n_features: int = TOP_FEATURES, n_pairs: int = TOP_PAIRS,
) -> DataFrame:
    """Best co-occurring pairs of the most lifted features per group.

    Each row becomes a bit mask of its selected features and rows collapse to
    distinct masks before any pair is formed, so pairs never multiply rows.
    """
    feats = lifted_features(df, doc, group, top, n_features)
    per_group = settle(feats).groupBy(group).agg(  # at most n_features entries
        F.array_sort(F.collect_list(F.struct("bit", "path"))).alias("_feats")
    ).filter(F.size("_feats") >= 2)
    bits = F.map_from_entries(
        F.transform("_feats", lambda f: F.struct(f["path"], F.pow(F.lit(2.0), f["bit"]).cast("long")))
    )
    rows = lookup_join(df, per_group.select(group, bits.alias("_bits")), [group])
    mask = F.lit(0).cast("long")
    for leaf in doc_leaves(df.schema, doc, "bool"):
        bit = F.coalesce(F.try_element_at("_bits", F.lit(leaf.path)), F.lit(0))
        mask = mask + F.when(leaf.column(doc), bit).otherwise(F.lit(0))
    masks = (
        rows.select(group, top, mask.alias("_mask"))
        .groupBy(group, "_mask")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(top)).alias("n_top"))
    )
    pairs = per_group.select(
        group,
        F.explode(
            F.flatten(
                F.transform(
                    "_feats",
                    lambda a: F.transform(
                        F.filter("_feats", lambda b: b["bit"] > a["bit"]),
                        lambda b: F.struct(
                            a["bit"].alias("bit_a"), b["bit"].alias("bit_b"),
                            a["path"].alias("feature_a"), b["path"].alias("feature_b"),
                            (F.pow(F.lit(2.0), a["bit"]) + F.pow(F.lit(2.0), b["bit"])).cast("long").alias("_pair"),
                        ),
                    ),
                )
            )
        ).alias("_p"),
    ).select(group, "_p.*")
    both = F.col("_mask").bitwiseAND(F.col("_pair")) == F.col("_pair")
    shared = (
        lookup_join(masks, pairs, [group])
        .groupBy(group, "bit_a", "bit_b", "feature_a", "feature_b")
        .agg(
            F.sum("n").alias("rows_all"), F.sum("n_top").alias("rows_top"),
            F.sum(F.when(both, F.col("n")).otherwise(0)).alias("co_all"),
            F.sum(F.when(both, F.col("n_top")).otherwise(0)).alias("co_top"),
        )
    )
    all_rate = F.col("co_all") / F.col("rows_all")
    top_rate = F.coalesce(F.try_divide("co_top", "rows_top"), F.lit(0.0))
    lift = F.round(F.when(all_rate > MIN_RATE, top_rate / all_rate).otherwise(F.lit(0.0)), 2)
    best = Window.partitionBy(group).orderBy(F.desc("lift"), "bit_a", "bit_b")
    return (
        shared.select(
            group, "feature_a", "feature_b", "bit_a", "bit_b",
            F.round(all_rate, 3).alias("all_rate"), F.round(top_rate, 3).alias("top_rate"), lift.alias("lift"),
        )
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= n_pairs)
        .drop("bit_a", "bit_b")
    )
