"""Scans of landed files: configuration, review sheets, raw API records, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab import schemas as S
from cohortlab.functions import links as L
from cohortlab.functions import metrics as M


def read_config(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per configured link with its settings; bad JSON fails the read."""
    reader = spark.read.schema(S.CONFIG).option("multiLine", multi_line).option("mode", "FAILFAST")
    return (
        reader.json(path)
        .select(F.posexplode("channels").alias("ord", "_c"), "settings")
        .select(
            "ord", "_c.url", "_c.category", "_c.priority",
            F.col("settings.maxVideosPerChannel").alias("max_items"),
            F.coalesce("settings.includeShorts", F.lit(False)).alias("include_shorts"),
            F.coalesce("settings.includePrivate", F.lit(False)).alias("include_private"),
            F.coalesce("settings.skipShortThumbnails", F.lit(False)).alias("skip_short_images"),
        )
    )


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """Review sheet: headers in any case, cells trimmed, a BOM is ignored."""
    raw = spark.read.option("header", True).option("multiLine", False).csv(path)
    raw = raw.toDF(*[c.replace("﻿", "").strip().lower() for c in raw.columns])

    def cell(name: str) -> Column:
        return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name in raw.columns else F.lit("")

    link = cell("link")
    label = F.coalesce(*[F.when(cell(n) != "", cell(n)) for n in ("channel name", "channel_name", "channel")], F.lit(""))
    return raw.select(
        L.handle_of(link).alias("handle"), link.alias("link"),
        F.lower(cell("analyze")).isin("yes", "true").alias("analyze_enabled"),
        cell("category").alias("category"), label.alias("label"),
    ).filter((F.col("link") != "") | (F.col("handle") != ""))


def _first_url(struct: str, *sizes: str) -> Column:
    urls = [F.col(f"{struct}.`{s}`.url") for s in sizes]
    return F.coalesce(*[F.when(u != "", u) for u in urls], F.lit(""))


def owner_rows(raw: DataFrame) -> DataFrame:
    """Flat owner rows of raw owner records."""
    return raw.select(
        F.col("id").alias("owner_id"),
        F.col("snippet.title").alias("title"),
        F.col("snippet.description").alias("description"),
        F.coalesce("snippet.customUrl", F.lit("")).alias("custom_url"),
        M.subscriber_count(F.col("statistics.subscriberCount"), F.col("statistics.hiddenSubscriberCount")).alias("subscribers"),
        M.parse_count(F.col("statistics.videoCount")).alias("item_count"),
        M.parse_count(F.col("statistics.viewCount")).alias("view_count"),
        _first_url("snippet.thumbnails", "high", "medium", "default").alias("thumbnail_url"),
        F.col("brandingSettings.image.bannerExternalUrl").alias("banner_url"),
        F.col("snippet.country").alias("country"),
        F.try_to_timestamp("snippet.publishedAt").alias("published_at"),
        M.uploads_list_id(F.col("id")).alias("uploads_id"),
    )


def read_owners(spark: SparkSession, path: str) -> DataFrame:
    return owner_rows(spark.read.schema(S.RAW_OWNER).json(path))


def item_rows(raw: DataFrame, owners: DataFrame | None, as_of: Column) -> DataFrame:
    """Flat item rows of raw item records with all derived fields.

    ``owners`` (owner_id, subscribers) gives the subscriber counts.
    """
    rows = raw.withColumnRenamed("channelId", "owner_id")
    if owners is not None:
        rows = rows.join(owners.select("owner_id", "subscribers"), "owner_id", "left")
    else:
        rows = rows.withColumn("subscribers", F.lit(None).cast("long"))
    none = F.array().cast("array<string>")
    seconds = M.duration_seconds(F.col("contentDetails.duration"))
    views, likes, comments = (M.parse_count(F.col(f"statistics.{c}")) for c in ("viewCount", "likeCount", "commentCount"))
    published = F.try_to_timestamp("snippet.publishedAt")
    tags = F.coalesce("snippet.tags", none)
    sizes = [
        F.coalesce(F.col(f"snippet.thumbnails.`{s}`.url"), F.lit("") if s in ("default", "medium", "high") else F.lit(None)).alias(s)
        for s in ("default", "medium", "high", "standard", "maxres")
    ]
    return rows.select(
        F.col("id").alias("item_id"), "owner_id",
        F.col("snippet.title").alias("title"), F.col("snippet.description").alias("description"),
        published.alias("published_at"), F.struct(*sizes).alias("thumbnails"),
        F.col("contentDetails.duration").alias("duration"), seconds.alias("duration_seconds"),
        views.alias("views"), likes.alias("likes"), comments.alias("comments"), tags.alias("tags"),
        F.col("snippet.categoryId").alias("category_id"), M.category_name(F.col("snippet.categoryId")).alias("category_name"),
        F.col("snippet.defaultLanguage").alias("default_language"),
        F.col("snippet.defaultAudioLanguage").alias("default_audio_language"),
        F.coalesce("status.madeForKids", F.lit(False)).alias("made_for_kids"),
        F.col("contentDetails.definition").alias("definition"),
        F.coalesce(F.col("contentDetails.caption") == "true", F.lit(False)).alias("caption"),
        F.col("contentDetails.licensedContent").alias("licensed_content"),
        F.coalesce("topicDetails.topicCategories", none).alias("topic_categories"),
        M.classify_short(seconds, F.col("snippet.title"), F.col("snippet.description"))["isShort"].alias("is_short"),
        M.watch_url(F.col("id")).alias("item_url"),
        M.engagement_metrics(views, likes, comments, F.col("subscribers"), published, as_of, F.size(tags)).alias("calculated"),
    )


def read_items(spark: SparkSession, path: str, owners: DataFrame | None, as_of: Column) -> DataFrame:
    return item_rows(spark.read.schema(S.RAW_ITEM).json(path), owners, as_of)


def page_rows(raw: DataFrame) -> DataFrame:
    """Listed ids with page and position; empty ids are dropped."""
    return (
        raw.select(F.col("channelId").alias("owner_id"), "page", F.posexplode("items").alias("pos", "_i"))
        .select(
            "owner_id", "page", "pos", F.col("_i.videoId").alias("item_id"),
            F.try_to_timestamp("_i.publishedAt").alias("published_at"),
            F.coalesce("_i.title", F.lit("")).alias("title"), F.coalesce("_i.description", F.lit("")).alias("description"),
        )
        .filter(F.coalesce("item_id", F.lit("")) != "")
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return page_rows(spark.read.schema(S.RAW_PAGE).json(path))


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    """Result lines in file order: (file, block, line_no, line).

    ``block`` is the start of the file split and ``line_no`` grows inside it,
    which is the order ``failure_cutoff`` needs.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    return raw.withColumn("line_no", F.struct("block", F.monotonically_increasing_id().alias("n")))


def latest_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Newest prepared batch by name and its number of requests.

    A batch is a folder; its part files count together.
    """
    folder = F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1)
    files = spark.read.text(path).select(folder.alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n_requests"))
    return files.orderBy(F.desc("file")).limit(1)
