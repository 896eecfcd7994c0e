"""From items, owners and documents to a cohort with top-performer flags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions import metrics as M
from cohortlab.scale import group_quantile, group_quantiles, lookup_join, one_value

# Cohort thresholds.
MIN_SUBSCRIBERS = 1000
CAP_PERCENTILE = 0.95
TOP_PERCENTILE = 0.90
MIN_GROUP_ROWS = 30


def assemble(
    owners: DataFrame, items: DataFrame, documents: DataFrame, title_kinds: Sequence[str] = ("title_description", "title"),
    image_kind: str = "thumbnail",
) -> DataFrame:
    """Items with their owner and documents; the title document is required.

    ``documents`` has (owner_id, item_id, kind, doc). The first of
    ``title_kinds`` present wins. One conditional pivot over documents, then
    keyed joins.
    """
    kinds = [*title_kinds, image_kind]
    by_item = (
        documents.filter(F.col("kind").isin(kinds))
        .groupBy("owner_id", "item_id")
        .agg(*[F.max_by(F.when(F.col("kind") == k, F.col("doc")), F.col("kind") == k).alias(f"_{k}") for k in kinds])
        .select(
            "owner_id", "item_id",
            F.coalesce(*[F.col(f"_{k}") for k in title_kinds]).alias("title_analysis"),
            F.col(f"_{image_kind}").alias("image_analysis"),
        )
        .filter(F.col("title_analysis").isNotNull())
    )
    return items.join(by_item, ["owner_id", "item_id"]).join(owners, "owner_id")


def assembly_counts(owners: DataFrame, items: DataFrame, assembled: DataFrame) -> DataFrame:
    """How much the assembly left out, as one row."""
    empty = owners.join(items.select("owner_id").distinct(), "owner_id", "left_anti")
    bare = items.join(assembled.select("owner_id", "item_id"), ["owner_id", "item_id"], "left_anti")
    return assembled.agg(F.count(F.lit(1)).alias("assembled")).select(
        "assembled",
        empty.agg(F.count(F.lit(1))).scalar().alias("owners_without_items"),
        bare.agg(F.count(F.lit(1))).scalar().alias("items_without_analysis"),
    )


def winsorize(
    df: DataFrame, metric: str, subscribers: str, min_subscribers: int = MIN_SUBSCRIBERS, cap: float = CAP_PERCENTILE
) -> DataFrame:
    """Drop small owners and cap the metric at a quantile of the rest.

    The kept rows are read three times (sketch, count, result): stage ``df``
    first if it comes from joins.
    """
    kept = df.filter(F.coalesce(F.col(subscribers), F.lit(0)) >= min_subscribers)
    limit = one_value(group_quantile(kept, [], metric, cap)) or 0.0
    return kept.withColumn("cap", F.lit(limit)).withColumn(metric, F.least(F.col(metric), F.lit(limit)))


def winsorize_stats(
    df: DataFrame, metric: str, subscribers: str, min_subscribers: int = MIN_SUBSCRIBERS, cap: float = CAP_PERCENTILE
) -> DataFrame:
    keep = F.coalesce(F.col(subscribers), F.lit(0)) >= min_subscribers
    limit = F.lit(one_value(group_quantile(df.filter(keep), [], metric, cap)) or 0.0)
    return df.agg(
        F.count(F.lit(1)).alias("original_count"),
        F.count_if(keep).alias("filtered_count"),
        F.count_if(~keep).alias("removed_low_subscribers"),
        F.count_if(keep & (F.col(metric) > limit)).alias("winsorized_count"),
    ).withColumns({"vps_cap": M.steady_round(limit, 2), "min_subscribers": F.lit(min_subscribers).cast("long")})


def mark_top(
    df: DataFrame, keys: Sequence[str], flags: dict[str, str], p: float = TOP_PERCENTILE, min_rows: int = 1,
) -> DataFrame:
    """Flag rows at or above the group quantile of a metric (ties are all in).

    ``flags`` maps flag names to metric columns; the thresholds come along as
    ``{flag}_at``. Groups with fewer than ``min_rows`` rows are left out.
    """
    wanted = {f"{flag}_at": (metric, p) for flag, metric in flags.items()}
    limits = group_quantiles(df, keys, wanted, count="_rows").filter(F.col("_rows") >= min_rows).drop("_rows")
    if keys:
        out = lookup_join(df, limits, keys)
    else:
        out = df.join(F.broadcast(limits))  # one row of thresholds
    return out.withColumns({flag: F.col(metric) >= F.col(f"{flag}_at") for flag, metric in flags.items()})


def min_rows(df: DataFrame, keys: Sequence[str], n: int = MIN_GROUP_ROWS) -> DataFrame:
    """Rows of groups with at least ``n`` rows."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).drop("_n")
    return lookup_join(df, big, keys, "left_semi")


def group_counts(df: DataFrame, key: str = "content_type") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"))


def drop_shorts(df: DataFrame, flag: str = "is_short", include_shorts: bool = False) -> DataFrame:
    """Without Shorts unless wanted; a missing flag counts as not short."""
    return df if include_shorts else df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def positive_share(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Rows with a positive metric per group; the total keeps all rows."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col(metric) > 0).alias("n_positive"), F.count(F.lit(1)).alias("n_total")
    )


def has_value(value: Column, dtype: T.DataType) -> Column:
    """Whether a value, or any field of a nested document, is not null."""
    if isinstance(dtype, T.StructType):
        return reduce(or_, [has_value(value[f.name], f.dataType) for f in dtype.fields], F.lit(False))
    return value.isNotNull()


def with_document(df: DataFrame, doc: str, predicate: Column | None = None) -> DataFrame:
    """Rows whose document holds at least one value (an empty object counts as none) and meets the caller's predicate."""
    kept = has_value(F.col(doc), df.schema[doc].dataType)
    return df.filter(kept if predicate is None else kept & predicate)


def required_fields_report(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Missing values per required column, one row per column."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f).isNull()).alias(f"_m{i}") for i, f in enumerate(fields)]
    )
    return counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("field"), F.col(f"_m{i}").alias("n_missing"), F.col("n").alias("n_rows"))
                    for i, f in enumerate(fields)
                ]
            )
        ).alias("r")
    ).select("r.*")
