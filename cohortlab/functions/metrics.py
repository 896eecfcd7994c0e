"""Derived metrics and scalar expressions (numbers, dates, ids, labels)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab.functions.binding import let

# Platform category ids and names.
CATEGORY_NAMES = {
    "1": "Film & Animation", "2": "Autos & Vehicles", "10": "Music", "15": "Pets & Animals", "17": "Sports",
    "18": "Short Movies", "19": "Travel & Events", "20": "Gaming", "21": "Videoblogging", "22": "People & Blogs",
    "23": "Comedy", "24": "Entertainment", "25": "News & Politics", "26": "Howto & Style", "27": "Education",
    "28": "Science & Technology", "29": "Nonprofits & Activism", "30": "Movies", "31": "Anime/Animation",
    "32": "Action/Adventure", "33": "Classics", "34": "Comedy", "35": "Documentary", "36": "Drama", "37": "Family",
    "38": "Foreign", "39": "Horror", "40": "Sci-Fi/Fantasy", "41": "Thriller", "42": "Shorts", "43": "Shows",
    "44": "Trailers",
}
# Request prices, quota limits and sample-size bands.
COST_PER_REQUEST = {"thumbnail": 0.002}
COST_PER_REQUEST_DEFAULT = 0.001
DAILY_QUOTA = 10_000
QUOTA_RESERVE = 500
LOW_SAMPLE, MEDIUM_SAMPLE = 10, 50
SIGNIFICANT_DIFFERENCE = 0.05
KEY_BYTES = 200


def steady_round(value: Column, digits: int) -> Column:
    """Round a mean of doubles.

    The last bits of a sum depend on the order of its parts; they are dropped
    first, so that a tie rounds the same way whatever the partitioning.
    """
    return F.round(F.round(value, digits + 6), digits)


def ratio_percent(part: Column, views: Column) -> Column:
    """``part / views * 100``; 0 without views."""
    return F.when(views > 0, part / views * 100).otherwise(F.lit(0.0))


def days_since(ts: Column, as_of: Column) -> Column:
    """Whole elapsed days, at least 1 (elapsed time, not calendar days)."""
    millis = F.abs(F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(ts.cast("timestamp")))
    return F.greatest(F.lit(1), F.floor(millis / 86_400_000)).cast("long")


def views_per_subscriber(views: Column, subscribers: Column) -> Column:
    """0 when the subscriber count is hidden (null) or not positive."""
    return F.when(subscribers > 0, views / subscribers).otherwise(F.lit(0.0))


def weekday_name(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), tz), "EEEE")


def local_hour(ts: Column, tz: str = "Asia/Kolkata") -> Column:
    return F.hour(F.from_utc_timestamp(ts.cast("timestamp"), tz))


def engagement_metrics(
    views: Column, likes: Column, comments: Column, subscribers: Column, published: Column,
    as_of: Column, tag_count: Column | None = None, weekday_tz: str = "UTC", hour_tz: str = "Asia/Kolkata",
) -> Column:
    """All derived metrics of an item as one struct."""
    return F.struct(
        ratio_percent(likes + comments, views).alias("engagementRate"),
        ratio_percent(likes, views).alias("likeRatio"),
        ratio_percent(comments, views).alias("commentRatio"),
        views_per_subscriber(views, subscribers).alias("viewsPerSubscriber"),
        (views / days_since(published, as_of)).alias("viewsPerDay"),
        weekday_name(published, weekday_tz).alias("publishDayOfWeek"),
        local_hour(published, hour_tz).alias("publishHourIST"),
        (tag_count if tag_count is not None else F.lit(0)).cast("int").alias("tagCount"),
    )


def whole_number(text: Column, pattern: str) -> Column:
    """First group of the first match as a whole number; null if there is none.

    An empty text is never cast: a cast that fails raises and catches an error
    inside, which costs more than the match.
    """
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")


def duration_seconds(iso: Column) -> Column:
    """Seconds of an ISO-8601 duration; missing parts and junk count 0."""
    has_p = F.coalesce(iso.startswith("P"), F.lit(False))
    body = F.when(has_p, F.substr(iso, F.lit(2))).otherwise(iso)

    def part(text: Column, unit: str) -> Column:
        # most texts lack most units: those are not searched for digits
        return F.when(text.contains(unit), F.coalesce(whole_number(text, rf"(\d+){unit}"), F.lit(0))).otherwise(F.lit(0).cast("long"))

    def build(c: Column) -> Column:
        days = F.when(c["has_p"], part(c["body"], "D")).otherwise(F.lit(0))
        return days * 86_400 + part(c["clock"], "H") * 3_600 + part(c["clock"], "M") * 60 + part(c["clock"], "S")

    # everything after the first T; the text itself when there is none
    return let(build, has_p=has_p, body=body, clock=F.when(body.contains("T"), F.substr(body, F.instr(body, "T") + 1)).otherwise(body))


def duration_label(seconds: Column) -> Column:
    hours = F.floor(seconds / 3600).cast("string")
    minutes = F.floor((seconds % 3600) / 60).cast("string")
    rest = (seconds % 60).cast("string")
    tail = F.concat(rest, F.lit("s"))
    return (
        F.when(seconds >= 3600, F.concat(hours, F.lit("h "), minutes, F.lit("m "), tail))
        .when(seconds >= 60, F.concat(minutes, F.lit("m "), tail))
        .otherwise(tail)
    )


def is_short_simple(seconds: Column) -> Column:
    return seconds <= 60


def classify_short(seconds: Column, title: Column, description: Column) -> Column:
    """Short-form test from length, hashtag and link, with its reason."""
    tag = r"(?i)#shorts?\b"

    def verdict(is_short: bool, confidence: str, reason: str) -> Column:
        return F.struct(
            F.lit(is_short).alias("isShort"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason")
        )

    def build(c: Column) -> Column:
        text = c["description"]
        linked = text.contains("youtube.com/shorts/") | text.contains("youtu.be/shorts/")
        return (
            F.when(c["seconds"] > 60, verdict(False, "high", "Duration exceeds 60 seconds"))
            .when(c["title"].rlike(tag), verdict(True, "high", "#Shorts hashtag found in title"))
            .when(text.rlike(tag), verdict(True, "high", "#Shorts hashtag found in description"))
            .when(linked, verdict(True, "high", "Shorts URL found in description"))
            .when(c["seconds"] <= 15, verdict(True, "medium", "Very short duration (<=15s)"))
            .otherwise(verdict(False, "low", "Duration <=60s but no #Shorts indicator found"))
        )

    return let(
        build, seconds=seconds, title=F.coalesce(title, F.lit("")), description=F.coalesce(description, F.lit(""))
    )


def category_name(category_id: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CATEGORY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, category_id), F.lit("Unknown"))


def parse_count(text: Column) -> Column:
    """Leading integer of a count string, 0 if there is none."""
    return F.coalesce(whole_number(text, r"^\s*([+-]?\d+)"), F.lit(0).cast("long"))


def subscriber_count(text: Column, hidden: Column) -> Column:
    """Null when hidden, missing, empty or not a number."""
    number = whole_number(text, r"^\s*([+-]?\d+)")
    return F.when(F.coalesce(hidden, F.lit(False)), F.lit(None).cast("long")).otherwise(number)


def uploads_list_id(owner_id: Column) -> Column:
    """Upload-list id of an owner id; null for malformed ids."""
    return F.when(owner_id.startswith("UC"), F.concat(F.lit("UU"), F.substr(owner_id, F.lit(3))))


def watch_url(item_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), item_id)


def thumbnail_url(item_id: Column, quality: str = "mqdefault") -> Column:
    return F.concat(F.lit("https://img.youtube.com/vi/"), item_id, F.lit(f"/{quality}.jpg"))


def is_item_id(col: Column) -> Column:
    return col.rlike(r"^[A-Za-z0-9_-]{11}$")


def is_owner_id(col: Column) -> Column:
    return col.rlike(r"^UC.{22}$")


def is_job_name(col: Column) -> Column:
    return col.rlike(r"^[A-Za-z0-9_-]{1,128}$")


def request_key(owner_id: Column, item_id: Column, kind: Column) -> Column:
    return F.concat_ws("_", owner_id, item_id, kind)


def parse_request_key(key: Column, kind: str) -> Column:
    """Fixed-width parse of a request key into owner and item id, else null."""
    base = F.regexp_replace(key, f"_{kind}$", "")
    owner, item = F.substr(base, F.lit(1), F.lit(24)), F.substr(base, F.lit(26))
    ok = (F.length(base) >= 36) & owner.startswith("UC") & (F.substr(base, F.lit(25), F.lit(1)) == "_") & is_item_id(item)
    return F.when(ok, F.struct(owner.alias("owner_id"), item.alias("item_id")))


def job_id(job_name: Column) -> Column:
    return F.translate(job_name, "/", "_")


def stored_or_computed_vps(stored: Column, views: Column, subscribers: Column) -> Column:
    """Stored value if positive, else views per subscriber, else 0."""
    return (
        F.when(stored > 0, stored.cast("double")).when(subscribers > 0, views / subscribers).otherwise(F.lit(0.0))
    )


def stored_engagement(rate: Column) -> Column:
    return F.when(rate > 0, rate.cast("double")).otherwise(F.lit(0.0))


def content_type_of(col: Column) -> Column:
    return F.coalesce(col, F.lit("unknown"))


def recency_weight(published: Column, as_of: Column, half_life_days: float = 365.0) -> Column:
    """Exponential decay by age; future or unreadable dates weigh 1."""
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 86_400e6
    return F.coalesce(F.exp(F.greatest(F.lit(0.0), days) * (-0.6931471805599453 / half_life_days)), F.lit(1.0))


def confidence_label(n: Column) -> Column:
    return F.when(n < LOW_SAMPLE, "low").when(n < MEDIUM_SAMPLE, "medium").otherwise("high")


def is_significant(all_rate: Column, top_rate: Column, threshold: float = SIGNIFICANT_DIFFERENCE) -> Column:
    return F.abs(top_rate - all_rate) > threshold


def hour_label(hour: Column) -> Column:
    return (
        F.when(hour.between(6, 11), "Morning")
        .when(hour.between(12, 16), "Afternoon")
        .when(hour.between(17, 21), "Evening")
        .otherwise("Night")
    )


def safe_key(key: Column, max_bytes: int = KEY_BYTES) -> Column:
    """Cut whole characters until the key plus '...' fits ``max_bytes``."""
    room = max_bytes - 3
    keep = F.array_max(
        F.filter(F.sequence(F.lit(0), F.lit(room)), lambda n: F.octet_length(F.left(key, n)) <= room)
    )
    return F.when(F.octet_length(key) <= max_bytes, key).otherwise(F.concat(F.left(key, keep), F.lit("...")))


def doc_name(content_type: Column) -> Column:
    return F.lower(F.translate(content_type, " /,", "___"))


def batch_cost(kind: Column, requests: Column) -> Column:
    price = F.lit(COST_PER_REQUEST_DEFAULT)
    for name, cost in COST_PER_REQUEST.items():
        price = F.when(kind == name, F.lit(cost)).otherwise(price)
    return requests * price


def local_date(ts: Column, tz: str = "America/Los_Angeles") -> Column:
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), tz), "yyyy-MM-dd")


def grouped_number(n: Column) -> Column:
    return F.format_number(n, 0)


def bytes_label(size: Column) -> Column:
    unit = F.when(size < 1024, "Bytes").when(size < 1024**2, "KB").when(size < 1024**3, "MB").otherwise("GB")
    scale = F.when(size < 1024, 1).when(size < 1024**2, 1024).when(size < 1024**3, 1024**2).otherwise(1024**3)
    number = F.regexp_replace(F.round(size / scale, 2).cast("string"), r"\.0$", "")
    return F.when(size == 0, "0 Bytes").otherwise(F.concat(number, F.lit(" "), unit))


def views_label(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", F.round(n / 1_000_000, 1)))
        .when(n >= 1_000, F.format_string("%.0fK", F.round(n / 1_000, 0)))
        .otherwise(n.cast("string"))
    )
