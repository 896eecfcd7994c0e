"""The driver's tables seen as owners, items, documents, texts and requests.

Each binding is a projection or a keyed join over whole tables. The matching
DuckDB text for the oracle stands next to it (``*_SQL``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions import metrics as M
from cohortlab.scale import spread

AS_OF = "2024-07-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ts(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("timestamp")


# --- orders as items, customers as owners -----------------------------------

LINE_SQL = """
line AS (
  SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
    bool_or(l_returnflag = 'R') AS has_return, bool_or(l_linestatus = 'O') AS has_open,
    bool_or(l_quantity >= 49) AS is_bulk, bool_or(l_discount >= 0.1) AS has_discount, bool_or(l_tax >= 0.08) AS high_tax,
    max(l_discount) AS max_discount, max(l_partkey) AS key_part, list_sort(list_distinct(list(p_type))) AS types
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
)"""

ITEMS_SQL = (
    LINE_SQL
    + """,
items AS (
  SELECT o_orderkey AS item_id, o_custkey AS owner_id, o_orderpriority AS content_type, c_mktsegment AS category,
    o_orderdate AS published_at, o_orderstatus AS status, o_totalprice AS views, coalesce(n_lines, 0) AS likes,
    coalesce(n_returned, 0) AS comments, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS subscribers, c_name AS owner_name,
    line.* EXCLUDE (l_orderkey)
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN line ON l_orderkey = o_orderkey
)"""
)

METRICS_SQL = (
    ITEMS_SQL
    + """,
measured AS (
  SELECT *, CASE WHEN subscribers > 0 THEN views / subscribers ELSE 0 END AS vps,
    CASE WHEN views > 0 THEN (likes + comments) / views * 100 ELSE 0 END AS engagement
  FROM items
)"""
)

COHORT_SQL = (
    METRICS_SQL
    + f""",
kept AS (SELECT * FROM measured WHERE coalesce(subscribers, 0) >= 1000),
cap AS (SELECT quantile_cont(vps, 0.95) AS cap FROM kept),
capped AS (SELECT kept.* EXCLUDE (vps), least(vps, cap) AS vps, cap FROM kept, cap),
tops AS (
  SELECT content_type, quantile_cont(vps, 0.9) AS top_at, quantile_cont(engagement, 0.9) AS eng_at
  FROM capped GROUP BY content_type
),
cohort AS (
  SELECT capped.*, top_at, eng_at, vps >= top_at AS is_top, engagement >= eng_at AS is_top_eng,
    exp(greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published_at)) / 86400e6) * (-0.6931471805599453 / 365.0)) AS weight
  FROM capped JOIN tops USING (content_type)
)"""
)


def line_features(spark: SparkSession, sf: str) -> DataFrame:
    """Per order; combined map-side, sets hold at most the few part types."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", "p_type")
    return line.join(part, line.l_partkey == part.p_partkey).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.bool_or(F.col("l_returnflag") == "R").alias("has_return"), F.bool_or(F.col("l_linestatus") == "O").alias("has_open"),
        F.bool_or(F.col("l_quantity") >= 49).alias("is_bulk"), F.bool_or(F.col("l_discount") >= 0.1).alias("has_discount"),
        F.bool_or(F.col("l_tax") >= 0.08).alias("high_tax"), F.max("l_discount").alias("max_discount"),
        F.max("l_partkey").alias("key_part"), F.array_sort(F.collect_set("p_type")).alias("types"),
    )


def owners(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("owner_name"), F.col("c_mktsegment").alias("category"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("subscribers"),
    )


def bare_items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as items, without line features."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("owner_id"),
        F.col("o_orderpriority").alias("content_type"), _ts(o, "o_orderdate").alias("published_at"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("views"),
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    lines = line_features(spark, sf).withColumnRenamed("l_orderkey", "item_id")
    return (
        bare_items(spark, sf)
        .join(owners(spark, sf), "owner_id")
        .join(lines, "item_id", "left")
        .withColumns({"likes": F.coalesce("n_lines", F.lit(0)), "comments": F.coalesce("n_returned", F.lit(0))})
    )


def measured(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).withColumns(
        {
            "vps": M.views_per_subscriber(F.col("views"), F.col("subscribers")),
            "engagement": M.ratio_percent(F.col("likes") + F.col("comments"), F.col("views")),
        }
    )


def image_document() -> Column:
    """Image document of an order; null for orders without lines."""
    return F.when(
        F.col("n_lines").isNotNull(),
        F.struct(
            F.struct(
                F.col("has_return").alias("facePresent"), F.col("has_open").alias("eyeContact"),
                F.col("n_lines").cast("int").alias("faceCount"),
            ).alias("humanPresence"),
            F.struct(F.col("is_bulk").alias("foodPresent")).alias("food"),
            F.struct(F.col("has_discount").alias("contrastWithYouTube"), F.col("status").alias("palette")).alias("colors"),
            F.struct(F.col("high_tax").alias("hasArrows")).alias("graphics"),
            F.struct(F.col("max_discount").alias("totalTextCoverage"), F.col("types").alias("emojiList")).alias("textElements"),
            F.struct(F.col("owner_name").alias("location")).alias("scene"),
        ),
    )


def title_document() -> Column:
    pattern = F.concat(F.col("status"), F.lit("-Q"), F.quarter("published_at").cast("string"))
    return F.struct(
        F.struct(
            pattern.alias("pattern"), F.floor(F.col("views") / 10000).cast("int").alias("characterCount"),
            F.col("likes").cast("int").alias("wordCount"),
        ).alias("structure"),
        F.struct(F.coalesce("max_discount", F.lit(0.0)).alias("teluguRatio")).alias("language"),
        F.struct(F.coalesce("types", F.array().cast("array<string>")).alias("powerWords")).alias("hooks"),
        F.struct(
            F.struct((F.col("status") == "F").alias("wellOrganized")).alias("structure"),
            F.struct(F.col("comments").cast("int").alias("totalLinkCount")).alias("links"),
        ).alias("descriptionAnalysis"),
    )


FORMAT_SQL = {
    "recipe": "has_return", "tutorial": "is_bulk", "review": "has_discount", "vlog": "has_open", "challenge": "high_tax",
    "reaction": "status = 'F'", "comparison": "status = 'P'", "list": "likes >= 5", "storytime": "likes = 1",
}


def format_flags() -> dict[str, Column]:
    return {name: F.coalesce(F.expr(sql), F.lit(False)) for name, sql in FORMAT_SQL.items()}


# --- parts as topics and keywords --------------------------------------------

TOPIC_SQL = """
topical AS (
  SELECT cohort.*, p_type AS niche, p_brand AS sub_niche, string_split(p_name, ' ')[1] AS primary_keyword,
    string_split(p_name, ' ')[2] || ', ' || p_brand || ' ' || p_type AS secondary_keywords
  FROM cohort LEFT JOIN part ON key_part = p_partkey
)"""


def with_topic(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("key_part"), F.col("p_type").alias("niche"), F.col("p_brand").alias("sub_niche"),
        F.split("p_name", " ")[0].alias("primary_keyword"),
        F.concat(F.split("p_name", " ")[1], F.lit(", "), F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("secondary_keywords"),
    )
    # items without a part stay, as topic 'unknown'
    return df.join(p, "key_part", "left")


# --- documents as texts, pages as links, events as posts ---------------------

# first line is the title, the rest the description; ids in the platform's shape
TEXTS_SQL = """
texts AS (
  SELECT doc_id, lang, source, split_part(text, chr(10), 1) AS title,
    CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, position(chr(10) IN text) + 1) ELSE '' END AS description
  FROM documents
)"""
# fixed-width ids: 'UC' + 22 digits and 11 digits
OWNER_ID_SQL = "'UC' || lpad(CAST({} AS VARCHAR), 22, '0')"
ITEM_ID_SQL = "lpad(CAST({} AS VARCHAR), 11, '0')"


def texts(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents"))
    at = F.instr("text", "\n")
    return d.select(
        "doc_id", "lang", "source",
        F.when(at > 0, F.substr("text", F.lit(1), at - 1)).otherwise(F.col("text")).alias("title"),
        F.when(at > 0, F.substr("text", at + 1)).otherwise(F.lit("")).alias("description"),
    )


def owner_code(col: Column) -> Column:
    return F.concat(F.lit("UC"), F.lpad(col.cast("string"), 22, "0"))


def item_code(col: Column) -> Column:
    return F.lpad(col.cast("string"), 11, "0")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "pages"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.withColumn("ts", _ts(e, "ts"))
