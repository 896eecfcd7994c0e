"""Feature profiles: every leaf of a document, all rows against top rows.

Input: one row per item with the group column, a boolean ``is_top`` column,
optionally a weight column, and a typed document struct. The kind of each leaf
comes from the schema, so booleans and numbers are aggregated as wide columns
in one pass (no row multiplication) and only strings and lists are exploded.
Before strings are exploded a pass of constant size drops leaves that surely have
too many values (free text), which would otherwise all be shuffled just to be
thrown away. It never drops a leaf within the limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.metrics import confidence_label, is_significant, safe_key, steady_round
from cohortlab.functions.nested import Leaf, doc_leaves
from cohortlab.scale import lookup_join

# Limits of categorical and list features.
MAX_CATEGORIES = 20
MAX_LIST_ITEMS = 50
TOP_LIST_ITEMS = 15


def _tidy(wide: DataFrame, group: str, found: list[Leaf], fields: list[str]) -> DataFrame:
    """One row per (group, leaf) from columns named ``{field}_{i}``."""
    rows = [
        F.struct(F.lit(leaf.path).alias("path"), *[F.col(f"{f}_{i}").alias(f) for f in fields])
        for i, leaf in enumerate(found)
    ]
    return wide.select(group, F.explode(F.array(*rows)).alias("_r")).select(group, "_r.*")


def bool_counts(df: DataFrame, doc: str, group: str = "content_type", top: str = "is_top") -> DataFrame:
    """Counts of values and true values, all and top, per boolean leaf."""
    found = doc_leaves(df.schema, doc, "bool")
    aggs: list[Column] = []
    for i, leaf in enumerate(found):
        value = leaf.column(doc)
        aggs += [
            F.count(value).alias(f"n_all_{i}"),
            F.count_if(value).alias(f"t_all_{i}"),
            F.count_if(F.col(top) & value.isNotNull()).alias(f"n_top_{i}"),
            F.count_if(F.col(top) & value).alias(f"t_top_{i}"),
        ]
    wide = df.groupBy(group).agg(*aggs)
    return _tidy(wide, group, found, ["n_all", "t_all", "n_top", "t_top"]).filter(F.col("n_all") > 0)


def bool_profile(df: DataFrame, doc: str, group: str = "content_type", top: str = "is_top") -> DataFrame:
    counts = bool_counts(df, doc, group, top)
    all_rate = F.col("t_all") / F.col("n_all")
    top_rate = F.when(F.col("n_top") > 0, F.col("t_top") / F.col("n_top")).otherwise(F.lit(0.0))
    return counts.select(
        group, "path", "n_all", "n_top",
        F.round(all_rate, 3).alias("all_rate"),
        F.round(top_rate, 3).alias("top_rate"),
        confidence_label(F.col("n_all")).alias("confidence"),
        is_significant(all_rate, top_rate).alias("significant"),
    )


def numeric_profile(
    df: DataFrame, doc: str, group: str = "content_type", top: str = "is_top", weight: str | None = "weight"
) -> DataFrame:
    """Means (weighted when a weight column is given), all and top."""
    found = doc_leaves(df.schema, doc, "num")
    w = F.col(weight) if weight else F.lit(1.0)
    aggs: list[Column] = []
    for i, leaf in enumerate(found):
        value = leaf.column(doc).cast("double")
        known, known_top = value.isNotNull(), value.isNotNull() & F.col(top)
        aggs += [
            F.count(value).alias(f"n_all_{i}"),
            F.count_if(known_top).alias(f"n_top_{i}"),
            F.sum(F.when(known, value * w)).alias(f"s_all_{i}"),
            F.sum(F.when(known, w)).alias(f"w_all_{i}"),
            F.sum(F.when(known_top, value * w)).alias(f"s_top_{i}"),
            F.sum(F.when(known_top, w)).alias(f"w_top_{i}"),
        ]
    wide = df.groupBy(group).agg(*aggs)
    tidy = _tidy(wide, group, found, ["n_all", "n_top", "s_all", "w_all", "s_top", "w_top"])
    return tidy.filter(F.col("n_all") > 0).select(
        group, "path", "n_all", "n_top",
        steady_round(F.try_divide("s_all", "w_all"), 2).alias("all_avg"),
        steady_round(F.coalesce(F.try_divide("s_top", "w_top"), F.lit(0.0)), 2).alias("top_avg"),
        confidence_label(F.col("n_all")).alias("confidence"),
    )


def surely_distinct(value: Column) -> Column:
    """A count that the number of distinct values is never below: marked hash classes of 64.

    Free text marks nearly all of them. One long per leaf, combined map-side.
    """
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(value), F.lit(64)).cast("int"))
    return F.bit_count(F.coalesce(F.bit_or(F.when(value.isNotNull(), mark)), F.lit(0).cast("long")))


def _kept_paths(evidence: DataFrame, group: str, limit: int) -> DataFrame:
    """(group, paths): leaves not known to have more than ``limit`` values."""
    return (
        evidence.filter(F.col("n_distinct") <= limit)
        .groupBy(group)
        .agg(F.collect_set("path").alias("_paths"))  # at most one entry per schema leaf
    )


def categorical_profile(
    df: DataFrame, doc: str, group: str = "content_type", top: str = "is_top", most: int = MAX_CATEGORIES
) -> DataFrame:
    """Value shares of string leaves with at most 20 distinct values.

    Empty strings stay in the denominator but are not reported.
    """
    found = doc_leaves(df.schema, doc, "str")
    sketch = df.groupBy(group).agg(
        *[surely_distinct(leaf.column(doc)).alias(f"n_distinct_{i}") for i, leaf in enumerate(found)]
    )
    kept = _kept_paths(_tidy(sketch, group, found, ["n_distinct"]), group, most)
    pairs = F.array(
        *[F.struct(F.lit(leaf.path).alias("path"), leaf.column(doc).alias("value")) for leaf in found]
    )
    counts = (
        lookup_join(df.select(group, top, pairs.alias("_pairs")), kept, [group])
        .select(
            group, top,
            F.explode(
                F.filter("_pairs", lambda p: p["value"].isNotNull() & F.array_contains("_paths", p["path"]))
            ).alias("_p"),
        )
        .groupBy(group, F.col("_p.path").alias("path"), F.col("_p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("c_all"), F.count_if(F.col(top)).alias("c_top"))
    )
    # few values per leaf survive the evidence, so this window is small
    leaf_rows = Window.partitionBy(group, "path")
    totals = counts.select(
        "*",
        F.count(F.lit(1)).over(leaf_rows).alias("_distinct"),
        F.sum("c_all").over(leaf_rows).alias("n_all"),
        F.sum("c_top").over(leaf_rows).alias("n_top"),
    )
    return totals.filter((F.col("_distinct") <= most) & (F.col("value") != "")).select(
        group, "path", safe_key(F.col("value")).alias("value"), "n_all", "n_top",
        F.round(F.col("c_all") / F.col("n_all"), 3).alias("all_share"),
        F.round(F.coalesce(F.try_divide("c_top", "n_top"), F.lit(0.0)), 3).alias("top_share"),
        confidence_label(F.col("n_all")).alias("confidence"),
    )


def list_profile(df: DataFrame, doc: str, group: str = "content_type", top: str = "is_top") -> DataFrame:
    """Mean list lengths, all and top."""
    found = doc_leaves(df.schema, doc, "list")
    aggs: list[Column] = []
    for i, leaf in enumerate(found):
        value = leaf.column(doc)
        length = F.when(value.isNotNull(), F.size(value))
        aggs += [
            F.count(value).alias(f"n_all_{i}"),
            F.count_if(F.col(top) & value.isNotNull()).alias(f"n_top_{i}"),
            F.sum(length).alias(f"s_all_{i}"),
            F.sum(F.when(F.col(top), length)).alias(f"s_top_{i}"),
        ]
    tidy = _tidy(df.groupBy(group).agg(*aggs), group, found, ["n_all", "n_top", "s_all", "s_top"])
    return tidy.filter(F.col("n_all") > 0).select(
        group, "path", "n_all", "n_top",
        F.round(F.col("s_all") / F.col("n_all"), 2).alias("all_avg_count"),
        F.round(F.coalesce(F.try_divide("s_top", "n_top"), F.lit(0.0)), 2).alias("top_avg_count"),
        confidence_label(F.col("n_all")).alias("confidence"),
    )


def list_items(
    df: DataFrame, doc: str, group: str = "content_type", top: str = "is_top", most: int = MAX_LIST_ITEMS, n: int = TOP_LIST_ITEMS
) -> DataFrame:
    """The 15 most common items of string lists with at most 50 distinct items.

    Rates are per row that has the list; repeats within a row count again.
    """
    found = [leaf for leaf in doc_leaves(df.schema, doc, "list") if leaf.dtype.simpleString() == "array<string>"]
    pairs = F.array(*[F.struct(F.lit(leaf.path).alias("path"), leaf.column(doc).alias("value")) for leaf in found])
    long = df.select(group, top, pairs.alias("_pairs"))

    def items_of(rows: DataFrame, wanted) -> DataFrame:
        lists = F.filter("_pairs", lambda p: p["value"].isNotNull() & wanted(p))
        return (
            rows.select(group, top, F.explode(lists).alias("_p"))
            .select(group, top, F.col("_p.path").alias("path"), F.explode("_p.value").alias("item"))
            .filter(F.col("item").isNotNull())
        )

    evidence = (
        items_of(long, lambda p: F.lit(True)).groupBy(group, "path")
        .agg(surely_distinct(F.col("item")).alias("n_distinct"))
    )
    kept = _kept_paths(evidence, group, most)
    counts = (
        items_of(lookup_join(long, kept, [group]), lambda p: F.array_contains("_paths", p["path"]))
        .groupBy(group, "path", "item")
        .agg(F.count(F.lit(1)).alias("c_all"), F.count_if(F.col(top)).alias("c_top"))
    )
    leaf_rows = Window.partitionBy(group, "path")
    ranked = counts.select(
        "*",
        F.count(F.lit(1)).over(leaf_rows).alias("_distinct"),
        F.row_number().over(leaf_rows.orderBy(F.desc("c_all"), "item")).alias("rank"),
    ).filter((F.col("_distinct") <= most) & (F.col("rank") <= n) & (F.col("item") != ""))
    lengths = list_profile(df, doc, group, top).select(group, "path", "n_all", "n_top")
    return lookup_join(ranked, lengths, [group, "path"]).select(
        group, "path", safe_key(F.col("item")).alias("item"), "rank", "n_all", "n_top",
        F.round(F.col("c_all") / F.col("n_all"), 3).alias("all_rate"),
        F.round(F.coalesce(F.try_divide("c_top", "n_top"), F.lit(0.0)), 3).alias("top_rate"),
    )


def flatten(df: DataFrame, doc: str, row_id: str) -> DataFrame:
    """Tidy long form of a document: one row per leaf, nulls kept."""
    rows = []
    for leaf in doc_leaves(df.schema, doc):
        value = leaf.column(doc)
        is_list = leaf.dtype.simpleString() == "array<string>"
        rows.append(
            F.struct(
                F.lit(leaf.path).alias("path"), F.lit(leaf.kind).alias("kind"),
                (value if leaf.kind == "bool" else F.lit(None)).cast("boolean").alias("bool_v"),
                (value if leaf.kind == "num" else F.lit(None)).cast("double").alias("num_v"),
                (value if leaf.kind == "str" else F.lit(None)).cast("string").alias("str_v"),
                (value if is_list else F.lit(None)).cast("array<string>").alias("list_v"),
            )
        )
    return df.select(row_id, F.explode(F.array(*rows)).alias("_r")).select(row_id, "_r.*")


def sample_sizes(df: DataFrame, doc: str, group: str = "content_type", top: str = "is_top") -> DataFrame:
    """Rows with a document, all and top."""
    return df.groupBy(group).agg(
        F.count(F.col(doc)).alias("n_all"), F.count_if(F.col(top) & F.col(doc).isNotNull()).alias("n_top")
    )


def feature_profile(
    df: DataFrame, doc: str, section: str, group: str = "content_type", top: str = "is_top",
    weight: str | None = "weight",
) -> DataFrame:
    """All kinds of statistics of one document in one tidy table."""
    kinds = {leaf.kind for leaf in doc_leaves(df.schema, doc)}
    parts = []
    if "bool" in kinds:
        parts.append(bool_profile(df, doc, group, top).withColumn("kind", F.lit("bool")))
    if "num" in kinds:
        parts.append(numeric_profile(df, doc, group, top, weight).withColumn("kind", F.lit("num")))
    if "str" in kinds:
        cats = categorical_profile(df, doc, group, top).withColumn("kind", F.lit("str"))
        parts.append(cats.withColumnsRenamed({"all_share": "all_rate", "top_share": "top_rate"}))
    if "list" in kinds:
        lengths = list_profile(df, doc, group, top).withColumn("kind", F.lit("list"))
        parts.append(lengths.withColumnsRenamed({"all_avg_count": "all_avg", "top_avg_count": "top_avg"}))
        items = list_items(df, doc, group, top).withColumn("kind", F.lit("item"))
        parts.append(items.withColumnRenamed("item", "value").drop("rank"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.withColumn("section", F.lit(section))


def profile_json(profile: DataFrame, group: str = "content_type") -> DataFrame:
    """One JSON document per group and section for export.

    Entries per document are bounded by the leaves of the schema times the
    reported values per leaf.
    """
    stat = F.to_json(F.struct(*[c for c in profile.columns if c not in (group, "section", "path")]))
    return (
        profile.groupBy(group, "section", "path")
        .agg(F.array_sort(F.collect_list(stat)).alias("_stats"))
        .groupBy(group, "section")
        .agg(F.array_sort(F.collect_list(F.struct("path", "_stats"))).alias("_entries"))
        .select(group, "section", F.to_json(F.map_from_entries("_entries")).alias("document"))
    )
