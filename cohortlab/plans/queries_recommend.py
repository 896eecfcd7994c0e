"""Recommendation, rate-limit and streaming queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortlab.operators import bridge as B
from cohortlab.operators import gaps as G
from cohortlab.operators import recommend as R
from cohortlab.operators import templates as P
from cohortlab.operators.profile import bool_profile
from cohortlab.operators.rate_limit import rate_limit
from cohortlab.plans import bindings as D
from cohortlab.plans.insights import run_insights, type_summary, write_insights
from cohortlab.plans.queries_cohort import (
    BOOL_SQL, BOOLS, BY_BRAND, C_SQL, FORMAT_ROWS_SQL, KEYWORD_SQL, SLOT_SQL, T_SQL, bool_sql, event_timing, order_cohort, topic_cohort,
)
from cohortlab.plans.registry import query
from cohortlab.scale import settle, spread, stage, stage_path
from cohortlab.streaming import incremental as SI
from cohortlab.streaming.rate_limit import rate_limit_stream


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# one request per part: types in every shape, some blank topics
REQUEST_SQL = f"""
raw AS (
  SELECT p_partkey AS request_id, CASE WHEN p_partkey % 50 = 7 THEN '  ' ELSE '  ' || p_name || chr(9) || ' dish ' END AS topic,
    CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'vlog' WHEN 3 THEN 'tutorial' WHEN 4 THEN 'review' WHEN 5 THEN 'challenge' WHEN 6 THEN 'Cooking' ELSE 'recipe' END AS type,
    CASE WHEN p_partkey % 3 = 0 THEN p_type || ' angle' END AS angle, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS audience
  FROM part
),
clean AS (
  SELECT request_id, type AS raw_type, trim(regexp_replace(replace(topic, chr(9), ''), '\\s+', ' ', 'g')) AS topic, coalesce(nullif(type, ''), 'recipe') AS type, angle, coalesce(audience, {q(P.DEFAULT_AUDIENCE)}) AS audience
  FROM raw
),
checked AS (
  SELECT *, CASE WHEN topic = '' THEN 'Topic is required and must be a non-empty string' WHEN type NOT IN ('recipe', 'vlog', 'tutorial', 'review', 'challenge')
    THEN 'Invalid content type. Must be one of: recipe, vlog, tutorial, review, challenge' END AS reject_reason FROM clean
),
valid AS (SELECT * FROM checked WHERE reject_reason IS NULL)"""
DIM_SQL = "dims AS (SELECT * FROM (VALUES " + ", ".join(
    "("
    + ", ".join(
        [q(t), *[q(x) for x in P.TITLE_TEMPLATES[t]], *["[" + ", ".join(q(x) for x in P.DEFAULT_TAGS[t][g]) + "]" for g in P.DEFAULT_TAGS[t]]]
        + [str(n) for n in P.VIEW_RANGES[t]]
        + [q(P.IMAGE_SPECS[t][0]), q(P.IMAGE_SPECS[t][-1])]
    )
    + ")"
    for t in P.TYPES
) + ") t(type, t0, t1, t2, tp, ts, tt, tl, low, medium, high, layout, accent))"
V_SQL = f"WITH {REQUEST_SQL}, {DIM_SQL}"


def requests(spark, sf):
    k = F.col("p_partkey")
    kinds = F.array(*[F.lit(x) for x in (None, "", "vlog", "tutorial", "review", "challenge", "Cooking", "recipe")])
    # a request is filled by hundreds of string expressions: the one or two splits of a small file would be one or two long tasks
    return spread(D.table(spark, sf, "part")).select(
        k.alias("request_id"),
        F.when(k % 50 == 7, "  ").otherwise(F.concat(F.lit("  "), "p_name", F.lit("\t dish "))).alias("topic"),
        F.get(kinds, (k % 8).cast("int")).alias("type"), F.when(k % 3 == 0, F.concat("p_type", F.lit(" angle"))).alias("angle"),
        F.when(k % 4 == 0, F.col("p_brand")).alias("audience"),
    )


def valid_requests(spark, sf):
    return R.validate(requests(spark, sf)).filter(F.col("reject_reason").isNull()).drop("reject_reason")


@query("request_validation", f"{V_SQL} SELECT request_id, topic, type, angle, audience, reject_reason FROM checked")
def request_validation(spark, sf):
    """R11, T22."""
    return R.validate(requests(spark, sf)).select("request_id", "topic", "type", "angle", "audience", "reject_reason")


@query(
    "resolve_content_type",
    "SELECT p_partkey AS request_id, CASE p_partkey % 8 WHEN 2 THEN 'vlog' WHEN 3 THEN 'tutorial' WHEN 4 THEN 'review' WHEN 5 THEN 'challenge' ELSE 'recipe' END AS type FROM part",
)
def resolve_content_type(spark, sf):
    """Valid type, alias or default."""
    return requests(spark, sf).select("request_id", R.resolve_type(F.col("type")).alias("type"))


@query("template_dimension", f"{V_SQL} SELECT request_id, layout, accent, CAST(medium AS BIGINT) AS views_medium FROM valid JOIN dims USING (type)")
def template_dimension(spark, sf):
    """Static rows per type."""
    return R.with_dimension(valid_requests(spark, sf)).select("request_id", "layout", "accent", "views_medium")


def fill_sql(template: str) -> str:
    out = template
    for name, value in [
        ("{dish}", "topic"), ("{dish_telugu}", "topic || ' (తెలుగు)'"), ("{topic}", "topic"), ("{topic_telugu}", "topic || ' తెలుగు'"),
        ("{modifier}", "coalesce(angle, 'SECRET')"), ("{location}", "topic"), ("{number}", "'10'"),
    ]:
        out = f"replace({out}, {q(name)}, {value})"
    return out


TITLES_SQL = f"""topic || ' | ' || coalesce(angle, 'SECRET') AS english, topic || {q(' | ' + P.DEFAULT_TELUGU_WORD)} AS telugu, {fill_sql("t0")} AS combined,
  {fill_sql("t1")} AS alternative_1, {fill_sql("t2")} AS alternative_2"""


@query("title_templates", f"{V_SQL} SELECT request_id, {TITLES_SQL} FROM valid JOIN dims USING (type)")
def title_templates(spark, sf):
    """R2."""
    rows = R.with_dimension(valid_requests(spark, sf)).select("request_id", R.titles(F.col("topic"), F.col("angle"), F.col("templates")).alias("t"))
    return rows.select(
        "request_id", "t.english", "t.telugu", "t.combined", F.get("t.alternatives", F.lit(0)).alias("alternative_1"), F.get("t.alternatives", F.lit(1)).alias("alternative_2")
    )


@query("thumbnail_template", f"{V_SQL} SELECT request_id, string_split(upper(topic), ' ')[1] AS text, layout, accent FROM valid JOIN dims USING (type)")
def thumbnail_template(spark, sf):
    """R3."""
    rows = R.with_dimension(valid_requests(spark, sf))
    return rows.select("request_id", R.image_text(F.col("topic")).alias("text"), "layout", "accent")


TAG_SQL = """tagged AS (
  SELECT request_id, array_to_string([lower(topic), lower(topic) || CASE WHEN type = 'recipe' THEN ' recipe' ELSE ' video' END] || tp || [lower(topic) || ' telugu', 'how to ' || lower(topic)] || ts || tt
    || [lower(topic) || ' in telugu', lower(topic) || ' for beginners'] || tl, ', ') AS tags FROM valid JOIN dims USING (type)
)"""


@query("tag_templates", f"{V_SQL}, {TAG_SQL} SELECT request_id, tags, CAST(length(tags) AS INTEGER) AS characters, round(least(100, length(tags) / 500 * 100), 6) AS utilization FROM tagged")
def tag_templates(spark, sf):
    """R4, N7."""
    rows = R.with_dimension(valid_requests(spark, sf))
    tags = R.tag_struct(R.tag_groups(F.col("topic"), F.col("type")))
    return rows.select("request_id", tags.alias("t")).select(
        "request_id", F.col("t.full").alias("tags"), "t.characters", F.round("t.utilization", 6).alias("utilization")
    )


@query(
    "tag_string",
    f"""{V_SQL}, given AS (SELECT request_id, array_to_string(CASE WHEN request_id % 2 = 0 THEN [topic] ELSE tp END || ts || tt || tl || CASE WHEN request_id % 3 = 0 THEN ['brand'] ELSE [] END, ', ') AS tags FROM valid JOIN dims USING (type))
SELECT request_id, tags, CAST(length(tags) AS INTEGER) AS characters FROM given""",
)
def tag_string(spark, sf):
    """Given tag groups completed by defaults."""
    none = F.lit(None).cast("array<string>")
    given = F.struct(
        F.when(F.col("request_id") % 2 == 0, F.array("topic")).alias("primary"), none.alias("secondary"), none.alias("telugu"), none.alias("longtail"),
        F.when(F.col("request_id") % 3 == 0, F.array(F.lit("brand"))).alias("brand"),
    )
    rows = R.with_dimension(valid_requests(spark, sf)).select("request_id", R.complete_tags(given).alias("t"))
    return rows.select("request_id", F.col("t.full").alias("tags"), "t.characters")


# --- insights for requests ----------------------------------------------------------


def request_insights(spark, sf, full=False):
    """Small insight tables: topics by part type, slots of events."""
    df = topic_cohort(spark, sf)
    by_type = df.withColumn("topic", G.topic_of(F.lower("niche"), F.lit("")))
    stats = settle(G.topic_stats(by_type.withColumn("vps", F.when(F.col("topic") == "small", F.col("vps") * 0.3).otherwise(F.col("vps"))), "topic", "vps"))
    slots = settle(B.timing_insights(event_timing(spark, sf)))
    out = R.Insights(
        gaps=settle(G.topic_gaps(stats)), saturated=settle(G.saturated_topics(stats)), slots=slots, optimal=settle(B.optimal_slot(slots)), n_items=1000, version="v1",
    )
    if full:
        out.keywords = settle(G.keyword_gaps(G.keyword_stats(df, "vps", "primary_keyword", "secondary_keywords")))
        out.formats = settle(G.format_stats(df, "vps", D.format_flags()))
    return out


TOPICS_SQL = """ptot AS (SELECT count(*) AS total, avg(vps) FILTER (WHERE vps > 0) AS mean FROM penal),
ptopics AS (
  SELECT topic, round(a, 2) AS avg_vps, n AS n_items, round(n / total * 100, 2) AS content_share, round(a / (n + 1), 3) AS opportunity_score, n > total * 0.1 AND round(a, 2) < mean * 0.8 AS saturated
  FROM (SELECT lower(coalesce(niche, 'unknown')) AS topic, avg(vps) AS a, count(*) AS n FROM penal WHERE vps > 0 GROUP BY 1 HAVING count(*) >= 3), ptot
),
pgaps AS (SELECT * FROM ptopics ORDER BY opportunity_score DESC, topic LIMIT 20),
psat AS (SELECT * FROM ptopics WHERE saturated ORDER BY opportunity_score DESC, topic LIMIT 10)"""
PENAL_SQL = "penal AS (SELECT * REPLACE (CASE WHEN niche = 'SMALL' THEN vps * 0.3 ELSE vps END AS vps) FROM topical)"
REQ_T_SQL = f"{T_SQL}, {PENAL_SQL}, {TOPICS_SQL}, {REQUEST_SQL}, {DIM_SQL}"
BEST_SQL = """d AS (SELECT slot, multiplier FROM slots WHERE dim = 'day' ORDER BY multiplier DESC, slot LIMIT 1),
h AS (SELECT CAST(slot AS INTEGER) AS slot, multiplier, label FROM slots WHERE dim = 'hour' ORDER BY multiplier DESC, CAST(slot AS INTEGER) LIMIT 1),
others AS (SELECT slot, row_number() OVER (ORDER BY multiplier DESC, slot) AS i FROM slots WHERE dim = 'day' AND slot <> (SELECT slot FROM d)),
post AS (
  SELECT d.slot AS best_day, h.slot || ':00 IST' AS best_time, (SELECT slot FROM others WHERE i = 1) || ' ' || h.slot || ':00 IST' AS alternative_1, (SELECT slot FROM others WHERE i = 2) || ' ' || h.slot || ':00 IST' AS alternative_2,
    'Based on analysis of 1000 videos, ' || d.slot || ' at ' || h.slot || ':00 IST has ' || printf('%.1f', round(round(d.multiplier * h.multiplier, 2), 1)) || 'x average performance' AS reasoning
  FROM d, h
)"""


@query("posting_recommendation", f"WITH {SLOT_SQL}, {BEST_SQL} SELECT p_partkey AS request_id, post.* FROM part, post")
def posting_recommendation(spark, sf):
    """The best slot and two other days for every request."""
    slots = settle(B.timing_insights(event_timing(spark, sf)))
    rows = R.with_insights(requests(spark, sf), R.Insights(slots=slots, optimal=settle(B.optimal_slot(slots))))
    return rows.select("request_id", R.posting(1000).alias("p")).select(
        "request_id", "p.best_day", "p.best_time", F.get("p.alternatives", F.lit(0)).alias("alternative_1"), F.get("p.alternatives", F.lit(1)).alias("alternative_2"), "p.reasoning"
    )


@query("posting_default", "SELECT p_partkey AS request_id, 'Saturday' AS best_day, '18:00 IST' AS best_time, 'Sunday 12:00 IST, Friday 19:00 IST' AS alternatives FROM part")
def posting_default(spark, sf):
    """Without timing insights."""
    return R.with_insights(requests(spark, sf), R.Insights()).select("request_id", R.posting().alias("p")).select(
        "request_id", "p.best_day", "p.best_time", F.array_join("p.alternatives", ", ").alias("alternatives")
    )


# topics of requests get their part type, so that some contain a listed topic
def topic_requests(spark, sf):
    p = D.table(spark, sf, "part").select(F.col("p_partkey").alias("request_id"), F.concat_ws(" ", "p_name", "p_type").alias("topic"))
    return valid_requests(spark, sf).drop("topic").join(p, "request_id")


FLAGS_SQL = """flagged AS (
  SELECT v.request_id, v.type, dims.*  EXCLUDE (type), EXISTS (SELECT 1 FROM pgaps WHERE contains(lower(p_name || ' ' || p_type), topic)) AS is_open, EXISTS (SELECT 1 FROM psat WHERE contains(lower(p_name || ' ' || p_type), topic)) AS is_full
  FROM valid v JOIN part ON p_partkey = request_id JOIN dims USING (type)
)"""


@query(
    "performance_prediction",
    f"""{REQ_T_SQL}, {FLAGS_SQL} SELECT request_id, CAST(low AS BIGINT) AS low, CAST(medium AS BIGINT) AS medium, CAST(high AS BIGINT) AS high, 'medium' AS confidence, CAST(2 + CAST(is_open AS INT) + CAST(type = 'recipe' AS INT) AS INTEGER) AS n_positive, CAST(is_full AS INTEGER) AS n_risk, is_open AS open, is_full AS saturated FROM flagged""",
)
def performance_prediction(spark, sf):
    """View range, factors and topic matches."""
    ins = request_insights(spark, sf)
    rows = R.with_insights(R.with_dimension(topic_requests(spark, sf)), ins)
    rows = rows.select("request_id", R.prediction(F.col("topic"), F.col("type"), ins.version).alias("p"))
    return rows.select(
        "request_id", "p.expected_views.*", "p.confidence", F.size("p.positive_factors").alias("n_positive"), F.size("p.risk_factors").alias("n_risk"),
        F.array_contains("p.positive_factors", "Topic has high opportunity score (low competition, good views)").alias("open"),
        F.array_contains("p.risk_factors", "Topic is saturated - need unique angle to stand out").alias("saturated"),
    )


@query(
    "recommendation_rows",
    f"""{REQ_T_SQL}, {TAG_SQL}, {SLOT_SQL}, {BEST_SQL}
SELECT v.request_id, v.topic, v.type, {fill_sql("t0")} AS combined, string_split(upper(v.topic), ' ')[1] AS image_text, layout, tags, best_day, best_time, CAST(medium AS BIGINT) AS views_medium, 'template' AS model, true AS fallback_used, 'v1' AS insights_version
FROM valid v JOIN dims USING (type) JOIN tagged USING (request_id), post""".replace("{fill}", ""),
)
def recommendation_rows(spark, sf):
    """Complete recommendations for every valid request."""
    rows = R.recommend(valid_requests(spark, sf), request_insights(spark, sf))
    return rows.select(
        "request_id", "topic", "type", "titles.combined", F.col("image.text").alias("image_text"), "image.layout", F.col("tags.full").alias("tags"), "posting.best_day", "posting.best_time",
        F.col("prediction.expected_views.medium").alias("views_medium"), "metadata.model", "metadata.fallback_used", "metadata.insights_version",
    )


@query(
    "fill_missing_sections",
    f"{V_SQL} SELECT request_id, CASE WHEN request_id % 2 = 0 THEN 'given' ELSE topic || ' | ' || coalesce(angle, 'SECRET') END AS english, string_split(upper(topic), ' ')[1] AS image_text FROM valid",
)
def fill_missing_sections(spark, sf):
    """Given sections, templates where missing."""
    base = R.recommend(valid_requests(spark, sf), R.Insights())
    titles = base.schema["titles"].dataType
    given = F.from_json(F.lit('{"english": "given"}'), titles)
    parsed = valid_requests(spark, sf).select("request_id", F.when(F.col("request_id") % 2 == 0, given).alias("titles"), F.lit(None).cast(base.schema["image"].dataType).alias("image"))
    return R.fill_sections(parsed, base, ["titles", "image"]).select("request_id", "titles.english", F.col("image.text").alias("image_text"))


IDEAS_SQL = f"""{FORMAT_ROWS_SQL},
bestf AS (SELECT format FROM format_rows WHERE recommended ORDER BY multiplier DESC, format LIMIT 1),
kw AS (SELECT *, row_number() OVER (ORDER BY multiplier DESC, keyword) AS r FROM keyword_rows ORDER BY r LIMIT 5),
gi AS (SELECT row_number() OVER (ORDER BY opportunity_score DESC, topic) AS rank, topic, coalesce((SELECT format FROM bestf) || ' style — low competition, high viewer interest', 'Underserved topic with high viewer demand') AS angle, opportunity_score AS score FROM pgaps QUALIFY rank <= 5),
ki AS (SELECT (SELECT count(*) FROM gi) + r AS rank, keyword AS topic, 'High-value keyword with ' || printf('%.1f', round(multiplier, 1)) || 'x view multiplier' AS angle, round(least(100, multiplier * 20), 3) AS score FROM kw WHERE r <= 5 - (SELECT count(*) FROM gi)),
ideas AS (SELECT * FROM gi UNION ALL SELECT * FROM ki)"""


@query("idea_rows", f"{REQ_T_SQL}, {KEYWORD_SQL}, {IDEAS_SQL} SELECT request_id, CAST(rank AS INTEGER) AS rank, i.topic, i.angle, i.score, type AS suggested_type FROM valid v, ideas i")
def idea_rows(spark, sf):
    """The best gaps, padded by keywords, for every request."""
    ideas = R.idea_rows(valid_requests(spark, sf), request_insights(spark, sf, full=True))
    return ideas.select("request_id", "rank", "topic", "angle", "score", "suggested_type")


@query(
    "insight_digest",
    f"""{REQ_T_SQL}, {KEYWORD_SQL}, {FORMAT_ROWS_SQL}, {SLOT_SQL}, {BEST_SQL}
SELECT 'high_opportunity' AS section, CAST(row_number() OVER (ORDER BY opportunity_score DESC, topic) AS INTEGER) AS rank, topic || ' (opportunity score: ' || printf('%.0f', round(opportunity_score, 0)) || ')' AS label FROM pgaps QUALIFY rank <= 3
UNION ALL SELECT 'saturated', CAST(row_number() OVER (ORDER BY opportunity_score DESC, topic) AS INTEGER), topic || CASE WHEN content_share > 20 THEN ' (high competition)' ELSE ' (medium competition)' END FROM psat
UNION ALL SELECT 'keyword', CAST(r AS INTEGER), keyword || ' (' || printf('%.1f', round(multiplier, 1)) || 'x views, used ' || usage_count || ' times, ' || printf('%.1f', round(usage_percent, 1)) || '% usage)' FROM (SELECT *, row_number() OVER (ORDER BY multiplier DESC, keyword) AS r FROM keyword_rows) WHERE r <= 15
UNION ALL SELECT 'format', CAST(row_number() OVER (ORDER BY multiplier DESC, format) AS INTEGER), format || ': ' || printf('%.1f', round(multiplier, 1)) || 'x views (' || n_items || ' videos, ' || printf('%.1f', round(usage_percent, 1)) || '% of content)' FROM format_rows
UNION ALL SELECT 'optimal_posting', 1, d.slot || ' at ' || h.slot || ':00 IST (' || printf('%.1f', round(round(d.multiplier * h.multiplier, 2), 1)) || 'x performance)' FROM d, h""",
)
def insight_digest(spark, sf):
    """The ranked entries shown to a requester."""
    return R.digest(request_insights(spark, sf, full=True))


@query("insights_read", f"{C_SQL},{BOOL_SQL} SELECT 'thumbnails' AS insight_type, count(*) AS n_rows, TIMESTAMP '{D.AS_OF}' AS version FROM bool_rows UNION ALL SELECT 'summary', (SELECT count(DISTINCT content_type) FROM cohort), TIMESTAMP '{D.AS_OF}'")
def insights_read(spark, sf):
    """Insight documents written by partition and read with their version."""
    cohort = order_cohort(spark, sf)
    path = stage_path(spark, "insights")
    write_insights({"thumbnails": bool_profile(cohort.filter("image_analysis IS NOT NULL"), "image_analysis"), "summary": type_summary(cohort)}, path, D.as_of())
    saved = spark.read.schema("generated_at timestamp, row string, insight_type string").parquet(path)
    version = R.insights_version(saved).select("version").scalar()
    return saved.groupBy("insight_type").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("version", version.cast("timestamp_ntz"))


JOB_SQL = f"""{T_SQL}, {bool_sql("topical", BOOLS).replace("bools", "b1").replace("bool_rows", "br1")}, {bool_sql("topical", BOOLS, "", "is_top_eng").replace("bools", "b2").replace("bool_rows", "br2")},
{BY_BRAND}, {KEYWORD_SQL.replace("tot AS (", "ktot AS (").replace(", tot", ", ktot")}, {FORMAT_ROWS_SQL.replace("FROM cohort", "FROM topical")},
slots AS (
  SELECT content_type || '|day|' || dayname(published_at) AS key, round(avg(vps), 2) AS value FROM topical WHERE vps > 0 GROUP BY 1 HAVING count(*) >= 5
  UNION ALL SELECT content_type || '|hour|0', round(avg(vps), 2) FROM topical WHERE vps > 0 GROUP BY 1 HAVING count(*) >= 5
)
SELECT 'summary' AS insight, content_type AS key, CAST(count(*) FILTER (WHERE is_top) AS DOUBLE) AS value FROM topical GROUP BY ALL
UNION ALL SELECT 'image_profile', content_type || '|' || path, top_rate FROM br1
UNION ALL SELECT 'engagement_image_profile', content_type || '|' || path, top_rate FROM br2
UNION ALL SELECT 'timing', key, value FROM slots
UNION ALL SELECT * FROM (SELECT 'gaps', topic, opportunity_score FROM topic_rows ORDER BY opportunity_score DESC, topic LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'keywords', keyword, multiplier FROM keyword_rows ORDER BY multiplier DESC, keyword LIMIT 30)
UNION ALL SELECT 'formats', format, multiplier FROM format_rows"""


@query("insights_job", JOB_SQL)
def insights_job(spark, sf):
    """G15, G32, 3.1: the whole insights job; one number of each main table per key."""
    cohort = D.with_topic(order_cohort(spark, sf), spark, sf).withColumns({"day": F.date_format("published_at", "EEEE"), "hour": F.hour("published_at")})
    tables = run_insights(
        stage(cohort, "topical"), description="title_analysis.descriptionAnalysis", formats=D.format_flags(),
        topic=G.topic_of(F.col("niche"), F.col("sub_niche")), primary="primary_keyword", secondary="secondary_keywords",
    )

    def rows(name, value, *key, where="true"):
        return tables[name].filter(where).select(
            F.lit(name).alias("insight"), F.concat_ws("|", *key).alias("key"), F.col(value).cast("double").alias("value")
        )

    parts = [
        rows("summary", "n_top", "content_type"), rows("image_profile", "top_rate", "content_type", "path", where="kind = 'bool'"),
        rows("engagement_image_profile", "top_rate", "content_type", "path", where="kind = 'bool'"),
        rows("timing", "avg_vps", "content_type", "dim", "slot"), rows("gaps", "opportunity_score", "topic"),
        rows("keywords", "multiplier", "keyword"), rows("formats", "multiplier", "format"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- generations ------------------------------------------------------------------------

GEN_SQL = "SELECT 'g' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, CASE o_orderkey % 3 WHEN 0 THEN 'ideas' WHEN 1 THEN 'recommendation' ELSE 'other' END AS type, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS request, o_orderpriority AS response, o_orderdate AS saved_at FROM orders"


def generations(spark, sf):
    k = F.col("o_orderkey")
    return D.table(spark, sf, "orders").select(
        F.concat(F.lit("g"), F.lpad(k.cast("string"), 12, "0")).alias("id"), F.when(k % 3 == 0, "ideas").when(k % 3 == 1, "recommendation").otherwise("other").alias("type"),
        F.when(k % 5 > 0, F.col("o_orderstatus")).alias("request"), F.col("o_orderpriority").alias("response"), F.col("o_orderdate").alias("saved_at"),
    )


@query(
    "generation_validation",
    f"SELECT reject_reason, count(*) AS n FROM (SELECT CASE WHEN type = 'other' THEN 'Invalid type. Must be \"ideas\" or \"recommendation\".' WHEN request IS NULL THEN 'Both request and response fields are required.' END AS reject_reason FROM ({GEN_SQL})) GROUP BY ALL",
)
def generation_validation(spark, sf):
    """Saved generations with a reject reason."""
    return R.validate_generation(generations(spark, sf)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("recent_generations", f"SELECT id, type FROM ({GEN_SQL}) WHERE type = 'ideas' ORDER BY saved_at DESC, id LIMIT 50")
def recent_generations(spark, sf):
    """Newest of one type."""
    return R.recent_generations(generations(spark, sf), "ideas").select("id", "type")


# --- rate limit and streams ---------------------------------------------------------------

DAY_MS, PER_DAY = 86_400_000, 2
RATE_SQL = f"""WITH RECURSIVE seq AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
fold AS (
  SELECT user_id, event_id, ms, i, ms AS window_start, 1 AS used, true AS allowed FROM seq WHERE i = 1
  UNION ALL
  SELECT s.user_id, s.event_id, s.ms, s.i, CASE WHEN s.ms - f.window_start >= {DAY_MS} THEN s.ms ELSE f.window_start END,
    CASE WHEN s.ms - f.window_start >= {DAY_MS} THEN 1 WHEN f.used >= {PER_DAY} THEN f.used ELSE f.used + 1 END, s.ms - f.window_start >= {DAY_MS} OR f.used < {PER_DAY}
  FROM fold f JOIN seq s ON s.user_id = f.user_id AND s.i = f.i + 1
)
SELECT user_id, event_id, window_start, allowed, CAST(CASE WHEN allowed THEN {PER_DAY} - used ELSE 0 END AS BIGINT) AS remaining FROM fold"""


@query("rate_limit_batch", RATE_SQL)
def rate_limit_batch(spark, sf):
    """Two requests per user and 24 hours."""
    rows = D.events(spark, sf).select("user_id", "event_id", F.unix_millis("ts").alias("ms"))
    out = rate_limit(rows, "user_id", "ms", "event_id", PER_DAY, DAY_MS)
    return out.select("user_id", "event_id", "window_start", "allowed", F.col("remaining").cast("long").alias("remaining"))


def event_stream(spark, sf):
    schema = D.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("rate_limit_stream", RATE_SQL)
def rate_limit_stream_query(spark, sf):
    """The same decisions from a keyed stream, one landed file a trigger, in order of time."""
    requests = D.events(spark, sf).select("user_id", "event_id", F.unix_millis("ts").alias("ms"))
    first, last = requests.agg(F.min("ms"), F.max("ms")).first()
    landed, files = stage_path(spark, "requests"), 4
    file = F.floor((F.col("ms") - (first or 0)) * files / ((last or 0) - (first or 0) + 1))
    for i in range(files):
        requests.filter(file == i).coalesce(1).write.mode("append").parquet(landed)
    rows = SI.read_landed(spark, landed, requests.schema, max_files=1)
    out = rate_limit_stream(rows, "user_id", "ms", "event_id", PER_DAY, DAY_MS)
    path = stage_path(spark, "limited")
    SI.drain_to_parquet(out, path, stage_path(spark, "limited-checkpoint"))
    return spark.read.schema(out.schema).parquet(path).select(
        F.col("key").cast("long").alias("user_id"), F.col("seq").alias("event_id"), "window_start", "allowed", "remaining"
    )


@query("incremental_stream", "SELECT user_id, event_type, props FROM events GROUP BY ALL")
def incremental_stream(spark, sf):
    """First record per key from a drained stream."""
    rows = event_stream(spark, sf).select("user_id", "event_type", "props", "ts")
    fresh = SI.new_items_stream(rows, ["user_id", "event_type", "props"], "ts", "60 days")
    path = stage_path(spark, "fresh")
    SI.drain_to_parquet(fresh, path, stage_path(spark, "fresh-checkpoint"))
    return spark.read.schema(fresh.schema).parquet(path).select("user_id", "event_type", "props")
