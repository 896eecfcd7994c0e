"""Scans, sinks, derived item columns and load jobs over landed copies of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab import schemas as S
from cohortlab.functions import metrics as M
from cohortlab.operators import cohort as C
from cohortlab.plans import bindings as D
from cohortlab.plans import load as J
from cohortlab.plans.registry import query
from cohortlab.scale import spread, stage_path
from cohortlab.sources import landed as R
from cohortlab.sources import sinks as K
from cohortlab.sources import tables as B

OWNER, ITEM = D.OWNER_ID_SQL, D.ITEM_ID_SQL


def land(df, name):
    """Write rows as JSON lines; returns the folder."""
    path = stage_path(df.sparkSession, name)
    df.write.option("ignoreNullFields", "true").json(path)
    return path


# --- raw records derived from customers and orders ------------------------------

RAW_OWNER_SQL = """
raw_owner AS (
  SELECT c_custkey AS k, c_name, c_mktsegment, c_nationkey, c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN 'n/a'
    ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS subs, c_custkey % 13 = 0 AS hidden
  FROM customer
)"""


def raw_owners(spark, sf):
    k = F.col("c_custkey")
    subs = F.when(k % 7 == 0, "").when(k % 11 == 0, "n/a").otherwise(F.floor("c_acctbal").cast("string"))
    url = F.concat(F.lit("https://img/"), k.cast("string"))
    return D.table(spark, sf, "customer").select(
        D.owner_code(k).alias("id"),
        F.struct(
            F.col("c_name").alias("title"), F.lit("about").alias("description"),
            F.concat(F.lit("@"), F.translate("c_name", "#", "_")).alias("customUrl"), F.lit("2015-03-01T10:00:00Z").alias("publishedAt"),
            F.struct(
                F.when(k % 3 == 0, F.struct(F.concat(url, F.lit("/h")).alias("url"))).alias("high"),
                F.when(k % 3 <= 1, F.struct(F.concat(url, F.lit("/m")).alias("url"))).alias("medium"),
            ).alias("thumbnails"),
        ).alias("snippet"),
        F.struct(
            subs.alias("subscriberCount"), (k % 13 == 0).alias("hiddenSubscriberCount"), k.cast("string").alias("videoCount"),
            F.when(k % 5 > 0, (k * 10).cast("string")).alias("viewCount"),
        ).alias("statistics"),
    )


SUBS_SQL = "CASE WHEN NOT hidden AND regexp_matches(subs, '^-?[0-9]+$') THEN CAST(subs AS BIGINT) END"


@query(
    "channel_api_scan",
    f"""WITH {RAW_OWNER_SQL} SELECT {OWNER.format("k")} AS owner_id, c_name AS title, '@' || replace(c_name, '#', '_') AS custom_url, {SUBS_SQL} AS subscribers,
  k AS item_count, CASE WHEN k % 5 > 0 THEN k * 10 ELSE 0 END AS view_count,
  CASE k % 3 WHEN 0 THEN 'https://img/' || k || '/h' WHEN 1 THEN 'https://img/' || k || '/m' ELSE '' END AS thumbnail_url, 'UU' || lpad(CAST(k AS VARCHAR), 22, '0') AS uploads_id
FROM raw_owner""",
)
def channel_api_scan(spark, sf):
    """Raw owner records read back from JSON."""
    rows = R.read_owners(spark, land(raw_owners(spark, sf), "raw_owner"))
    return rows.select("owner_id", "title", "custom_url", "subscribers", "item_count", "view_count", "thumbnail_url", "uploads_id")


# durations of every shape; seconds as the oracle sees them
DURATION = """CASE CAST({k} % 6 AS INT) WHEN 0 THEN 'PT' || CAST({k} % 59 AS {s}) || 'M' || CAST({k} % 60 AS {s}) || 'S'
  WHEN 1 THEN 'PT' || CAST({k} % 9 + 1 AS {s}) || 'H' || CAST({k} % 59 AS {s}) || 'M' WHEN 2 THEN 'PT' || CAST({k} % 60 AS {s}) || 'S'
  WHEN 3 THEN 'P1DT' || CAST({k} % 5 AS {s}) || 'H' WHEN 4 THEN '' ELSE 'invalid' END"""
SECONDS = """CASE {k} % 6 WHEN 0 THEN {k} % 59 * 60 + {k} % 60 WHEN 1 THEN ({k} % 9 + 1) * 3600 + {k} % 59 * 60 WHEN 2 THEN {k} % 60
  WHEN 3 THEN 86400 + {k} % 5 * 3600 ELSE 0 END"""
RAW_ITEM_SQL = f"""
raw_item AS (
  SELECT o_orderkey AS k, o_custkey, o_orderdate, o_orderstatus, floor(o_totalprice) AS price, {SECONDS.format(k="o_orderkey")} AS sec,
    {DURATION.format(k="o_orderkey", s="VARCHAR")} AS duration, o_orderstatus || CASE WHEN o_orderkey % 14 = 2 THEN ' #Shorts' ELSE ' plain' END AS title,
    CASE WHEN o_orderkey % 10 = 8 THEN 'see youtube.com/shorts/x' ELSE 'text #short' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'age' END END AS description
  FROM orders
)"""
SHORT_SQL = (
    "CASE WHEN sec > 60 THEN 'Duration exceeds 60 seconds' WHEN contains(title, '#Shorts') THEN '#Shorts hashtag found in title' "
    "WHEN regexp_matches(description, '(?i)#shorts?\\b') THEN '#Shorts hashtag found in description' WHEN contains(description, 'youtube.com/shorts/') THEN 'Shorts URL found in description' "
    "WHEN sec <= 15 THEN 'Very short duration (<=15s)' ELSE 'Duration <=60s but no #Shorts indicator found' END"
)
IS_SHORT_SQL = f"({SHORT_SQL}) NOT IN ('Duration exceeds 60 seconds', 'Duration <=60s but no #Shorts indicator found')"


def item_texts(spark, sf):
    """Orders with the texts and durations raw item records are made of."""
    return spread(D.table(spark, sf, "orders")).withColumns(
        {
            "k": F.col("o_orderkey"), "duration": F.expr(DURATION.format(k="o_orderkey", s="STRING")),
            "title": F.expr("o_orderstatus || CASE WHEN o_orderkey % 14 = 2 THEN ' #Shorts' ELSE ' plain' END"),
            "description": F.expr(
                "CASE WHEN o_orderkey % 10 = 8 THEN 'see youtube.com/shorts/x' ELSE 'text #short' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'age' END END"
            ),
        }
    )


def raw_items(spark, sf):
    k = F.col("k")
    return item_texts(spark, sf).select(
        D.item_code(k).alias("id"), D.owner_code(F.col("o_custkey")).alias("channelId"),
        F.struct(
            "title", "description", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
            F.struct(F.struct(F.concat(F.lit("https://img/"), k.cast("string")).alias("url")).alias("default")).alias("thumbnails"),
            F.when(k % 3 > 0, F.array(F.lit("a"), F.col("o_orderpriority"))).alias("tags"), (k % 46).cast("string").alias("categoryId"),
        ).alias("snippet"),
        F.struct("duration", F.lit("hd").alias("definition"), F.when(k % 2 == 0, "true").otherwise("false").alias("caption"), (k % 5 == 0).alias("licensedContent")).alias("contentDetails"),
        F.struct(
            F.floor("o_totalprice").cast("string").alias("viewCount"), F.when(k % 9 > 0, (k % 1000).cast("string")).otherwise("none").alias("likeCount"),
            F.when(k % 8 > 0, (k % 100).cast("string")).alias("commentCount"),
        ).alias("statistics"),
        F.when(k % 4 == 0, F.struct(F.lit(True).alias("madeForKids"))).alias("status"),
    )


def flat_owners(spark, sf):
    return R.owner_rows(spark.read.schema(S.RAW_OWNER).json(land(raw_owners(spark, sf), "raw_owner")))


CATEGORY_SQL = "CASE CAST(k % 46 AS VARCHAR) " + " ".join(f"WHEN '{i}' THEN '{n}'" for i, n in M.CATEGORY_NAMES.items()) + " ELSE 'Unknown' END"
COUNTS_SQL = "CAST(price AS BIGINT) AS views, CASE WHEN k % 9 > 0 THEN k % 1000 ELSE 0 END AS likes, CASE WHEN k % 8 > 0 THEN k % 100 ELSE 0 END AS comments"


@query(
    "video_api_scan",
    f"""WITH {RAW_OWNER_SQL},{RAW_ITEM_SQL}, counted AS (SELECT r.*, {COUNTS_SQL}, {SUBS_SQL} AS subscribers FROM (SELECT raw_item.*, o.subs, o.hidden FROM raw_item JOIN raw_owner o ON o.k = o_custkey) r)
SELECT {ITEM.format("k")} AS item_id, {OWNER.format("o_custkey")} AS owner_id, title, duration, CAST(sec AS BIGINT) AS duration_seconds, views, likes, comments,
  CAST(CASE WHEN k % 3 > 0 THEN 2 ELSE 0 END AS INTEGER) AS n_tags, {CATEGORY_SQL} AS category_name, k % 4 = 0 AS made_for_kids, k % 2 = 0 AS caption, {IS_SHORT_SQL} AS is_short,
  'https://www.youtube.com/watch?v=' || {ITEM.format("k")} AS item_url, 'https://img/' || k AS thumbnail, '' AS thumbnail_high,
  round(CASE WHEN views > 0 THEN (likes + comments) / views * 100 ELSE 0 END, 6) AS engagement_rate, round(CASE WHEN subscribers > 0 THEN views / subscribers ELSE 0 END, 6) AS vps
FROM counted""",
)
def video_api_scan(spark, sf):
    """Raw item records read back from JSON."""
    rows = R.read_items(spark, land(raw_items(spark, sf), "raw_item"), flat_owners(spark, sf), D.as_of())
    return rows.select(
        "item_id", "owner_id", "title", "duration", "duration_seconds", "views", "likes", "comments", F.size("tags").alias("n_tags"),
        "category_name", "made_for_kids", "caption", "is_short", "item_url", F.col("thumbnails.default").alias("thumbnail"),
        F.col("thumbnails.high").alias("thumbnail_high"), F.round("calculated.engagementRate", 6).alias("engagement_rate"),
        F.round("calculated.viewsPerSubscriber", 6).alias("vps"),
    )


@query(
    "playlist_page_scan",
    f"SELECT {OWNER.format('o_orderkey // 50')} AS owner_id, CAST(o_orderkey // 50 AS INTEGER) AS page, CAST(o_orderkey % 50 AS INTEGER) AS pos, {ITEM.format('o_orderkey')} AS item_id, o_orderstatus AS title FROM orders WHERE o_orderkey % 50 <> 7",
)
def playlist_page_scan(spark, sf):
    """Landed list pages of 50 (one has an empty id) exploded by position."""
    o = D.table(spark, sf, "orders")
    entry = F.struct(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 50 == 7, "").otherwise(D.item_code(F.col("o_orderkey"))).alias("videoId"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), F.col("o_orderstatus").alias("title"),
    )
    page = F.floor(F.col("o_orderkey") / 50)
    raw = o.groupBy(page.cast("int").alias("page")).agg(F.array_sort(F.collect_list(entry)).alias("items"))  # 50 keys per page
    path = land(raw.withColumn("channelId", D.owner_code(F.col("page"))), "raw_page")
    return R.read_pages(spark, path).select("owner_id", "page", "pos", "item_id", "title")


@query(
    "channel_config_scan",
    "SELECT 'https://www.youtube.com/@' || c_name AS url, c_mktsegment AS category, c_nationkey AS priority, CAST(500 AS INTEGER) AS max_items, false AS include_shorts, true AS skip_short_images FROM customer",
)
def channel_config_scan(spark, sf):
    """Configuration documents, here one per owner."""
    c = D.table(spark, sf, "customer").select(
        F.array(F.struct(F.concat(F.lit("https://www.youtube.com/@"), F.col("c_name")).alias("url"), F.col("c_mktsegment").alias("category"), F.col("c_nationkey").alias("priority"))).alias("channels"),
        F.struct(F.lit(500).alias("maxVideosPerChannel"), F.lit(True).alias("skipShortThumbnails")).alias("settings"),
    )
    rows = R.read_config(spark, land(c, "config"), multi_line=False)
    return rows.select("url", "category", "priority", "max_items", "include_shorts", "skip_short_images")


FLAG_SQL = "c_custkey % 3 = 0"


@query(
    "channel_flags_csv_scan",
    "SELECT lower('h' || c_custkey) AS handle, 'https://www.youtube.com/@H' || c_custkey AS link, c_custkey % 3 = 0 AS analyze_enabled, c_mktsegment AS category, c_name AS label FROM customer WHERE c_custkey % 17 > 0",
)
def channel_flags_csv_scan(spark, sf):
    """Review sheet with odd header case, blanks and empty links."""
    k = F.col("c_custkey")
    sheet = D.table(spark, sf, "customer").select(
        F.when(k % 3 == 0, F.when(k % 2 == 0, " Yes").otherwise("TRUE ")).otherwise("no").alias("Analyze"), F.col("c_name").alias("Channel Name"),
        F.when(k % 17 > 0, F.concat(F.lit(" https://www.youtube.com/@H"), k.cast("string"))).alias("LINK"), F.concat(F.col("c_mktsegment"), F.lit(" ")).alias("Category"),
    )
    path = stage_path(spark, "flags")
    sheet.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return R.read_flags(spark, path)


# --- durations, labels, ids ----------------------------------------------------------


@query(
    "parse_iso_duration",
    f"""WITH {RAW_ITEM_SQL} SELECT k AS item_id, CAST(sec AS BIGINT) AS seconds, sec <= 60 AS short_simple,
  CASE WHEN sec >= 3600 THEN (sec // 3600) || 'h ' || (sec % 3600 // 60) || 'm ' || (sec % 60) || 's' WHEN sec >= 60 THEN (sec // 60) || 'm ' || (sec % 60) || 's' ELSE sec || 's' END AS label
FROM raw_item""",
)
def parse_iso_duration(spark, sf):
    """M5, M6, M7."""
    sec = M.duration_seconds(F.col("duration"))
    return item_texts(spark, sf).withColumn("sec", sec).select(
        F.col("k").alias("item_id"), F.col("sec").alias("seconds"), M.is_short_simple(F.col("sec")).alias("short_simple"), M.duration_label(F.col("sec")).alias("label")
    )


@query(
    "classify_short",
    f"""WITH {RAW_ITEM_SQL}, r AS (SELECT k, {SHORT_SQL} AS reason FROM raw_item)
SELECT k AS item_id, reason NOT IN ('Duration exceeds 60 seconds', 'Duration <=60s but no #Shorts indicator found') AS "isShort",
  CASE WHEN reason LIKE 'Very%' THEN 'medium' WHEN reason LIKE 'Duration <=%' THEN 'low' ELSE 'high' END AS confidence, reason FROM r""",
)
def classify_short(spark, sf):
    """M8."""
    sec = M.duration_seconds(F.col("duration"))
    return item_texts(spark, sf).select(F.col("k").alias("item_id"), M.classify_short(sec, F.col("title"), F.col("description")).alias("s")).select("item_id", "s.*")


@query("category_name", f"SELECT {CATEGORY_SQL} AS category_name, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) GROUP BY ALL")
def category_name(spark, sf):
    """M9: 32-entry lookup with a default."""
    name = M.category_name((F.col("o_orderkey") % 46).cast("string"))
    return D.table(spark, sf, "orders").groupBy(name.alias("category_name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "media_urls_and_ids",
    f"""SELECT o_orderkey, 'https://img.youtube.com/vi/' || {ITEM.format("o_orderkey")} || '/mqdefault.jpg' AS image, {OWNER.format("o_custkey")} || '_' || {ITEM.format("o_orderkey")} || '_thumbnail' AS key,
  {OWNER.format("o_custkey")} AS owner_id, {ITEM.format("o_orderkey")} AS item_id, 'batches_' || o_orderkey AS job_id, o_orderkey % 5 > 0 AS owner_ok, o_orderkey % 7 > 0 AS item_ok, o_orderkey % 3 > 0 AS job_ok FROM orders""",
)
def media_urls_and_ids(spark, sf):
    """Ids, keys and their checks round trip."""
    owner, item = D.owner_code(F.col("o_custkey")), D.item_code(F.col("o_orderkey"))
    key = M.request_key(owner, item, F.lit("thumbnail"))
    k = F.col("o_orderkey")
    name = F.concat(F.lit("batches/"), k.cast("string"))
    return D.table(spark, sf, "orders").select(
        "o_orderkey", M.thumbnail_url(item).alias("image"), key.alias("key"), M.parse_request_key(key, "thumbnail").alias("p"), M.job_id(name).alias("job_id"),
        # some ids are spoilt: too short, with a sign that no id has, a name that is no job
        M.is_owner_id(F.when(k % 5 > 0, owner).otherwise(F.substring(owner, 1, 23))).alias("owner_ok"),
        M.is_item_id(F.when(k % 7 > 0, item).otherwise(F.concat(F.substring(item, 1, 10), F.lit("!")))).alias("item_ok"),
        M.is_job_name(F.when(k % 3 > 0, M.job_id(name)).otherwise(F.concat(name, F.lit(" ")))).alias("job_ok"),
    ).select("*", "p.*").drop("p")


@query(
    "number_formats",
    """SELECT l_orderkey, l_partkey, l_extendedprice AS price, format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) AS grouped,
  CASE WHEN v >= 1000000 THEN printf('%.1fM', round(v / 1000000, 1)) WHEN v >= 1000 THEN printf('%.0fK', round(v / 1000, 0)) ELSE CAST(v AS VARCHAR) END AS views,
  regexp_replace(CAST(round(CASE WHEN v < 1024 THEN v WHEN v < 1048576 THEN v / 1024 ELSE v / 1048576 END, 2) AS VARCHAR), '\\.0$', '') || CASE WHEN v < 1024 THEN ' Bytes' WHEN v < 1048576 THEN ' KB' ELSE ' MB' END AS bytes
FROM (SELECT *, CAST(floor(l_extendedprice * l_quantity) AS BIGINT) AS v FROM lineitem)""",
)
def number_formats(spark, sf):
    """M18."""
    v = F.floor(F.col("l_extendedprice") * F.col("l_quantity"))
    return D.table(spark, sf, "lineitem").withColumn("v", v).select(
        "l_orderkey", "l_partkey", F.col("l_extendedprice").alias("price"), M.grouped_number(F.floor("l_extendedprice")).alias("grouped"),
        M.views_label(F.col("v")).alias("views"), M.bytes_label(F.col("v")).alias("bytes"),
    )


@query("doc_name", "SELECT DISTINCT c_mktsegment || '/' || o_orderpriority AS content_type, lower(replace(replace(c_mktsegment || '/' || o_orderpriority, '/', '_'), ' ', '_')) AS doc_name FROM orders JOIN customer ON o_custkey = c_custkey")
def doc_name(spark, sf):
    """Document names of content types."""
    kind = F.concat_ws("/", "category", "content_type")
    df = D.bare_items(spark, sf).join(D.owners(spark, sf), "owner_id").select(kind.alias("content_type")).distinct()
    return df.withColumn("doc_name", M.doc_name(F.col("content_type")))


@query(
    "pacific_date",
    "SELECT event_id, strftime(timezone('America/Los_Angeles', timezone('UTC', ts)), '%Y-%m-%d') AS day FROM events",
)
def pacific_date(spark, sf):
    """M29."""
    return D.events(spark, sf).select("event_id", M.local_date(F.col("ts")).alias("day"))


@query(
    "confidence_and_hours",
    """SELECT user_id, hour_ist AS hour, n, CASE WHEN n < 10 THEN 'low' WHEN n < 50 THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN hour_ist BETWEEN 6 AND 11 THEN 'Morning' WHEN hour_ist BETWEEN 12 AND 16 THEN 'Afternoon' WHEN hour_ist BETWEEN 17 AND 21 THEN 'Evening' ELSE 'Night' END AS label
FROM (SELECT user_id, CAST(hour(ts + INTERVAL 330 MINUTE) AS INTEGER) AS hour_ist, count(*) AS n FROM events GROUP BY ALL)""",
)
def confidence_and_hours(spark, sf):
    """M23, M25 over counts per user and hour."""
    rows = D.events(spark, sf).groupBy("user_id", M.local_hour(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumns({"confidence": M.confidence_label(F.col("n")), "label": M.hour_label(F.col("hour"))})


@query(
    "batch_cost_estimate",
    "SELECT kind, n, round(n * CAST(CASE WHEN kind = 'thumbnail' THEN 0.002 ELSE 0.001 END AS DOUBLE), 6) AS cost FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'thumbnail' ELSE 'title_description' END AS kind, count(*) AS n FROM orders GROUP BY ALL)",
)
def batch_cost_estimate(spark, sf):
    """M28."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "thumbnail").otherwise("title_description")
    rows = D.table(spark, sf, "orders").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("cost", F.round(M.batch_cost(F.col("kind"), F.col("n")), 6))


# --- table reads -----------------------------------------------------------------------


@query("existing_subset", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def existing_subset(spark, sf):
    """Stored rows among many keys."""
    return B.existing(D.table(spark, sf, "documents"), D.table(spark, sf, "labels"), ["doc_id"]).select("doc_id", "lang", "n_chars")


@query("exists_flag", 'SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS "exists" FROM documents')
def exists_flag(spark, sf):
    """Existence test for every key."""
    return B.exists_flag(D.table(spark, sf, "documents").select("doc_id"), D.table(spark, sf, "labels"), ["doc_id"])


@query("equality_filtered_scan", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def equality_filtered_scan(spark, sf):
    """Equality predicate in the scan."""
    return B.where_equal(D.table(spark, sf, "documents"), lang="en").select("doc_id", "source")


@query("predicate_scan", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND (n_chars > 1000 OR source = 'src1')")
def predicate_scan(spark, sf):
    """equality and a predicate of the caller's, both in the scan."""
    docs = D.table(spark, sf, "documents")
    return B.where_equal(docs, (F.col("n_chars") > 1000) | (F.col("source") == "src1"), lang="en").select("doc_id", "source")


@query("children_of_owner", "SELECT o_orderkey AS item_id, o_totalprice AS views FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)")
def children_of_owner(spark, sf):
    """Rows of one parent (the one with the greatest key)."""
    o = D.bare_items(spark, sf)
    return B.children_of(o, "owner_id", o.agg(F.max("owner_id")).scalar()).select("item_id", "views")


@query("key_ordered_page", "SELECT o_orderkey AS item_id, o_orderstatus AS status FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 1000")
def key_ordered_page(spark, sf):
    """One keyset page of 1,000."""
    return B.page_after(D.bare_items(spark, sf), "item_id", 100, 1000).select("item_id", "status")


@query("id_only_projection", "SELECT o_orderkey AS item_id FROM orders")
def id_only_projection(spark, sf):
    """S12."""
    return B.ids(D.bare_items(spark, sf), "item_id")


@query("count_rows", "SELECT o_custkey AS owner_id, count(*) AS n FROM orders GROUP BY ALL")
def count_rows(spark, sf):
    """S13."""
    return B.counts_by(D.bare_items(spark, sf), "owner_id")


TOP_SQL = "SELECT {key} AS {name}, o_orderkey AS item_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order} DESC, o_orderkey) AS rank FROM orders) WHERE rank <= {n}"


@query("indexed_top_by_owner", TOP_SQL.format(key="o_custkey", name="owner_id", order="o_totalprice", n=3))
def indexed_top_by_owner(spark, sf):
    """Top by views per owner."""
    return B.heads(D.bare_items(spark, sf), ["owner_id"], [F.desc("views"), F.col("item_id")], 3).select("owner_id", "item_id", "rank")


@query("newest_by_owner", TOP_SQL.format(key="o_custkey", name="owner_id", order="o_orderdate", n=3))
def newest_by_owner(spark, sf):
    """Newest per owner."""
    return B.heads(D.bare_items(spark, sf), ["owner_id"], [F.desc("published_at"), F.col("item_id")], 3).select("owner_id", "item_id", "rank")


@query("top_by_weekday", TOP_SQL.format(key="dayname(o_orderdate)", name="weekday", order="o_totalprice", n=20))
def top_by_weekday(spark, sf):
    """Top by views per weekday."""
    df = D.bare_items(spark, sf).withColumn("weekday", M.weekday_name(F.col("published_at")))
    return B.heads(df, ["weekday"], [F.desc("views"), F.col("item_id")], 20).select("weekday", "item_id", "rank")


@query("max_items_per_owner", TOP_SQL.format(key="o_custkey", name="owner_id", order="-o_orderkey", n=10))
def max_items_per_owner(spark, sf):
    """First ten per owner in list order."""
    return B.heads(D.bare_items(spark, sf), ["owner_id"], [F.col("item_id")], 10).select("owner_id", "item_id", "rank")


@query(
    "shorts_filter",
    f"WITH {RAW_ITEM_SQL} SELECT k AS item_id FROM raw_item WHERE NOT (k % 5 > 0 AND {IS_SHORT_SQL})",
)
def shorts_filter(spark, sf):
    """Drop Shorts; a missing flag counts as not short."""
    short = M.classify_short(M.duration_seconds(F.col("duration")), F.col("title"), F.col("description"))["isShort"]
    df = item_texts(spark, sf).withColumn("is_short", F.when(F.col("k") % 5 > 0, short))
    return C.drop_shorts(df).select(F.col("k").alias("item_id"))


# --- sinks -------------------------------------------------------------------------------

NEW_SQL = "SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 4 = 0 THEN 'N' END AS status, o_totalprice * 2 AS views FROM orders WHERE o_orderkey % 2 = 0"


def old_and_new(spark, sf):
    """Stored items (two thirds) and records of the even keys."""
    o = D.bare_items(spark, sf)
    old = o.filter(F.col("item_id") % 3 > 0).select("item_id", "owner_id", "status", "views")
    new = o.filter(F.col("item_id") % 2 == 0).select(
        "item_id", F.when(F.col("item_id") % 4 == 0, "N").alias("status"), (F.col("views") * 2).alias("views")
    )
    return old, new


MERGE_SQL = f"WITH old AS (SELECT o_orderkey AS item_id, o_custkey AS owner_id, o_orderstatus AS status, o_totalprice AS views FROM orders WHERE o_orderkey % 3 > 0), new AS ({NEW_SQL})"


@query("upsert_merge", f"{MERGE_SQL} SELECT coalesce(o.item_id, n.item_id) AS item_id, owner_id, coalesce(n.status, o.status) AS status, coalesce(n.views, o.views) AS views FROM old o FULL JOIN new n ON o.item_id = n.item_id")
def upsert_merge(spark, sf):
    """Insert or overwrite the fields present."""
    return K.upsert(*old_and_new(spark, sf), ["item_id"])


@query("upsert_present_null", f"{MERGE_SQL} SELECT coalesce(o.item_id, n.item_id) AS item_id, owner_id, CASE WHEN n.item_id IS NULL THEN o.status ELSE n.status END AS status, coalesce(n.views, o.views) AS views FROM old o FULL JOIN new n ON o.item_id = n.item_id")
def upsert_present_null(spark, sf):
    """A null clears a field that every record carries."""
    return K.upsert(*old_and_new(spark, sf), ["item_id"], present=["status"])


@query("stats_only_update", f"{MERGE_SQL} SELECT coalesce(o.item_id, n.item_id) AS item_id, owner_id, o.status, coalesce(n.views, o.views) AS views FROM old o FULL JOIN new n ON o.item_id = n.item_id")
def stats_only_update(spark, sf):
    """Only the statistics columns are written."""
    return K.update_columns(*old_and_new(spark, sf), ["item_id"], ["views"])


@query("update_existing_only", f"{MERGE_SQL} SELECT o.item_id, owner_id, coalesce(n.status, o.status) AS status, coalesce(n.views, o.views) AS views FROM old o LEFT JOIN new n ON o.item_id = n.item_id")
def update_existing_only(spark, sf):
    """Patches never insert."""
    return K.patch_existing(*old_and_new(spark, sf), ["item_id"])


@query("delete_by_key", f"{MERGE_SQL} SELECT * FROM old WHERE item_id NOT IN (SELECT item_id FROM new)")
def delete_by_key(spark, sf):
    """S23."""
    old, new = old_and_new(spark, sf)
    return K.delete_keys(old, new, ["item_id"])


@query("delete_all", "SELECT count(*) FILTER (WHERE o_orderkey % 3 > 0) AS n_before, CAST(0 AS BIGINT) AS n_after FROM orders")
def delete_all(spark, sf):
    """Truncate a stored copy; rows before and after."""
    path = stage_path(spark, "truncated")
    old = old_and_new(spark, sf)[0]
    old.write.parquet(path)
    before = spark.read.schema(old.schema).parquet(path).count()
    K.truncate(old, path)
    left = spark.read.schema(old.schema).parquet(path).agg(F.count(F.lit(1)).alias("n_after"))
    return left.select(F.lit(before).cast("long").alias("n_before"), "n_after")


@query(
    "overwrite_document_sink",
    "SELECT o_orderpriority AS content_type, count(*) AS n, CASE WHEN o_orderpriority LIKE '1%' THEN 'second' ELSE 'first' END AS run FROM orders GROUP BY ALL",
)
def overwrite_document_sink(spark, sf):
    """A second run replaces only the documents it writes."""
    path = stage_path(spark, "documents")
    rows = D.bare_items(spark, sf).groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))
    K.overwrite_documents(rows.withColumn("run", F.lit("first")), path, "content_type")
    K.overwrite_documents(rows.filter("content_type LIKE '1%'").withColumn("run", F.lit("second")), path, "content_type")
    return spark.read.schema("n bigint, run string, content_type string").parquet(path)


@query(
    "append_sink_with_id",
    "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'ideas' ELSE 'recommendation' END AS type, count(*) AS n, count(*) AS n_ids FROM orders GROUP BY ALL",
)
def append_sink_with_id(spark, sf):
    """Two appends; every row got its own id."""
    path = stage_path(spark, "generations")
    kind = F.when(F.col("item_id") % 2 == 0, "ideas").otherwise("recommendation")
    rows = D.bare_items(spark, sf).select(kind.alias("type"), F.to_json(F.struct("item_id")).alias("request"))
    for part in ("type = 'ideas'", "type = 'recommendation'"):
        K.append_with_id(rows.filter(part), path, D.as_of())
    saved = spark.read.parquet(path)
    return saved.groupBy("type", "id").agg(F.count(F.lit(1)).alias("c")).groupBy("type").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_ids"))


@query("json_report_sink", "SELECT o_orderpriority AS content_type, count(*) AS n, round(avg(o_totalprice), 2) AS avg_views, 'é ' || o_orderpriority AS label FROM orders GROUP BY ALL")
def json_report_sink(spark, sf):
    """Report written and read back, non-ASCII kept."""
    rows = D.bare_items(spark, sf).groupBy("content_type").agg(F.count(F.lit(1)).alias("n"), M.steady_round(F.avg("views"), 2).alias("avg_views"))
    rows = rows.withColumn("label", F.concat(F.lit("é "), F.col("content_type")))
    path = K.write_report(rows, stage_path(spark, "reports"), "summary", "20240101_000000")
    return K.read_report(spark, path, rows.schema)


# --- load jobs -----------------------------------------------------------------------------

# every owner lists its orders in key order, 5,000 keys to a page; one in 97 has no record
LISTED_SQL = f"""
listed AS (
  SELECT {OWNER.format("o_custkey")} AS owner_id, o_custkey AS c, o_orderkey AS k, {ITEM.format("o_orderkey")} AS item_id FROM orders
)"""


def listing(spark, sf):
    k = F.col("o_orderkey")
    return D.table(spark, sf, "orders").select(
        D.owner_code(F.col("o_custkey")).alias("owner_id"), F.floor(k / 5000).cast("int").alias("page"), (k % 5000).cast("int").alias("pos"),
        D.item_code(k).alias("item_id"), F.col("o_custkey").alias("c"), k.alias("k"),
    )


def available(spark, sf):
    raw = raw_items(spark, sf).filter(F.col("id").cast("long") % 97 > 0)
    return spark.read.schema(S.RAW_ITEM).json(land(raw, "raw_item"))


@query(
    "full_load",
    f"""WITH {LISTED_SQL},{RAW_ITEM_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY k) AS rn FROM listed WHERE c % 5 > 0),
work AS (SELECT * FROM ranked WHERE rn <= 10 AND (c % 5 > 1 OR rn > 1)),
rows AS (SELECT w.owner_id, w.k, r.k IS NULL AS gone, coalesce({IS_SHORT_SQL}, false) AS short FROM work w LEFT JOIN raw_item r ON r.k = w.k AND r.k % 97 > 0)
SELECT owner_id, count(*) FILTER (WHERE NOT gone AND NOT short) AS n_loaded, count(*) FILTER (WHERE gone) AS n_missing FROM rows GROUP BY ALL
HAVING count(*) FILTER (WHERE NOT gone AND NOT short) + count(*) FILTER (WHERE gone) > 0""",
)
def full_load(spark, sf):
    """First ten per owner, after a marker, without Shorts."""
    listed = listing(spark, sf)
    markers = listed.filter(F.col("c") % 5 == 1).groupBy("owner_id").agg(F.min("item_id").alias("marker"))
    done = listed.filter(F.col("c") % 5 == 0).select("owner_id").distinct()
    res = J.full_load(
        listed.drop("c", "k"), available(spark, sf), flat_owners(spark, sf), D.as_of(), markers=markers, completed=done, max_items=10
    )
    loaded = res.loaded.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_loaded"))
    missing = res.missing.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_missing"))
    return loaded.join(missing, "owner_id", "full_outer").na.fill(0, ["n_loaded", "n_missing"])


@query(
    "incremental_load",
    f"""WITH {LISTED_SQL},{RAW_ITEM_SQL},
paged AS (SELECT *, k // 5000 AS page, k % 3 = 0 AND NOT (c % 4 = 0 AND k // 5000 = 1) AS is_new FROM listed),
stops AS (SELECT owner_id, min(page) AS stop FROM (SELECT owner_id, page FROM paged GROUP BY ALL HAVING count(*) FILTER (WHERE is_new) = 0) GROUP BY ALL),
fresh AS (SELECT p.* FROM paged p LEFT JOIN stops USING (owner_id) WHERE is_new AND (stop IS NULL OR page < stop))
SELECT count(*) FILTER (WHERE f.k % 97 = 0) AS n_missing, count(*) FILTER (WHERE r.k IS NOT NULL AND NOT {IS_SHORT_SQL}) AS n_loaded,
  count(*) FILTER (WHERE r.k IS NOT NULL AND NOT {IS_SHORT_SQL}) + (SELECT count(*) FROM paged WHERE NOT is_new) AS n_items
FROM fresh f LEFT JOIN raw_item r ON r.k = f.k AND r.k % 97 > 0""",
)
def incremental_load(spark, sf):
    """New ids up to the first fully known page, merged into the stored items."""
    listed = listing(spark, sf)
    known = ~((F.col("k") % 3 == 0) & ~((F.col("c") % 4 == 0) & (F.floor(F.col("k") / 5000) == 1)))
    stored = listed.filter(known).select("owner_id", "item_id")
    res = J.incremental_load(listed.drop("c", "k"), available(spark, sf), stored, flat_owners(spark, sf), D.as_of())
    n = F.count(F.lit(1))
    return res.items.agg(n.alias("n_items")).select(
        res.missing.agg(n).scalar().alias("n_missing"), res.loaded.agg(n).scalar().alias("n_loaded"), "n_items"
    )


@query(
    "stats_refresh",
    f"""WITH {RAW_ITEM_SQL}, counted AS (SELECT *, {COUNTS_SQL} FROM raw_item)
SELECT {OWNER.format("o_custkey")} AS owner_id, {ITEM.format("k")} AS item_id, 'kept' AS title, CASE WHEN k % 97 > 0 THEN views ELSE -1 END AS views,
  CASE WHEN k % 97 > 0 THEN likes END AS likes, CASE WHEN k % 97 > 0 THEN comments END AS comments FROM counted WHERE k % 2 = 0""",
)
def stats_refresh(spark, sf):
    """Fresh counts for stored items, other columns untouched."""
    stored = listing(spark, sf).filter(F.col("k") % 2 == 0).select(
        "owner_id", "item_id", F.lit("kept").alias("title"), F.lit(-1).cast("long").alias("views")
    )
    out = J.stats_refresh(stored, available(spark, sf), flat_owners(spark, sf), D.as_of())
    return out.select("owner_id", "item_id", "title", "views", "likes", "comments")
