"""Scalar expressions on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import links as L
from cohortlab.functions import metrics as M


def values(spark, rows, schema, expr):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_durations(spark):
    iso = ["PT15M33S", "PT1H30M45S", "PT2H", "PT45M", "PT30S", "", "invalid", "P", "P1DT2H", None]
    assert values(spark, iso, "d string", M.duration_seconds(F.col("d"))) == [933, 5445, 7200, 2700, 30, 0, 0, 0, 93600, 0]
    assert values(spark, [3723, 123, 3], "s int", M.duration_label(F.col("s"))) == ["1h 2m 3s", "2m 3s", "3s"]


def test_shorts(spark):
    rows = [
        (61, "#shorts", ""), (45, "a #Shorts", ""), (45, "a", "x #short"), (45, "a", "https://youtube.com/shorts/1"),
        (15, "a", ""), (16, "a", ""), (45, "#shortage", None),
    ]
    got = values(spark, rows, "s int, t string, d string", M.classify_short(F.col("s"), F.col("t"), F.col("d")))
    assert [(r.isShort, r.confidence) for r in got] == [
        (False, "high"), (True, "high"), (True, "high"), (True, "high"), (True, "medium"), (False, "low"), (False, "low")
    ]
    assert got[1].reason.endswith("title") and got[2].reason.endswith("description")


def test_owner_urls(spark):
    uc = "UC" + "x" * 22
    urls = [
        "https://www.youtube.com/@chef", "https://youtube.com/@chef?x=1", f"https://www.youtube.com/channel/{uc}",
        "https://www.youtube.com/c/name/videos", "https://www.youtube.com/user/u1", "https://www.youtube.com/watch?v=1", "https://e.org/a", "",
    ]
    got = values(spark, urls, "u string", L.parse_owner_url(F.col("u")))
    assert [tuple(r) if r else None for r in got] == [
        ("chef", "handle"), ("chef", "handle"), (uc, "channelId"), ("name", "customUrl"), ("u1", "user"), None, None, None
    ]
    ids = ["https://a.b/@x/videos", "https://a.b", "not a url!", "", "https://a.b/c/d?q=1"]
    assert values(spark, ids, "u string", L.progress_id(F.col("u"))) == ["@x_videos", "unknown", "not_a_url_", "unknown", "c_d"]
    assert values(spark, ["https://y/@Ab/", "x"], "u string", L.handle_of(F.col("u"), strip_slash=True)) == ["ab", ""]


def test_link_classes(spark):
    urls = [
        "https://www.instagram.com/a", "http://bit.ly/x", "https://shop.org/p?tag=1", "https://youtube.com/playlist?list=2",
        "https://youtu.be/abc", "https://e.org", "https://netflix.com/x",
    ]
    want = ["social", "affiliate", "affiliate", "playlist", "video", "website", "social"]
    assert values(spark, urls, "u string", L.link_class(F.col("u"))) == want
    assert values(spark, urls[-1:] + ["https://m.x.com/a"], "u string", L.link_class(F.col("u"), True)) == ["website", "social"]


def test_rates_and_weights(spark):
    rows = [(2.5, 100, 10), (None, 500, 100), (None, 500, 0), (None, 500, None), (0.0, 10, 5)]
    expr = M.stored_or_computed_vps(F.col("a"), F.col("v"), F.col("s"))
    assert values(spark, rows, "a double, v int, s int", expr) == [2.5, 5.0, 0.0, 0.0, 2.0]
    now = dt.datetime(2024, 1, 1)
    dates = [now, now - dt.timedelta(days=365), now + dt.timedelta(days=9), None]
    got = values(spark, dates, "t timestamp", M.recency_weight(F.col("t"), F.lit(now)))
    assert got == pytest.approx([1.0, 0.5, 1.0, 1.0])
    assert values(spark, [now, now - dt.timedelta(hours=47)], "t timestamp", M.days_since(F.col("t"), F.lit(now))) == [1, 1]
    assert values(spark, [9, 10, 49, 50], "n int", M.confidence_label(F.col("n"))) == ["low", "medium", "medium", "high"]
    assert values(spark, [(0.3, 0.35), (0.3, 0.5)], "a double, b double", M.is_significant(F.col("a"), F.col("b"))) == [False, True]


def test_labels_and_keys(spark):
    assert values(spark, [8, 14, 19, 23, 5], "h int", M.hour_label(F.col("h"))) == ["Morning", "Afternoon", "Evening", "Night", "Night"]
    keys = ["a" * 200, "a" * 201, "తె" * 60]
    got = values(spark, keys, "k string", M.safe_key(F.col("k")))
    assert got[0] == keys[0] and got[1] == "a" * 197 + "..." and got[2] == ("తె" * 60)[:65] + "..."
    assert values(spark, ["How To, A/B"], "k string", M.doc_name(F.col("k"))) == ["how_to__a_b"]
    assert values(spark, [1234567, 12345, 999], "n bigint", M.views_label(F.col("n"))) == ["1.2M", "12K", "999"]
    assert values(spark, [0, 1536, 1048576, 5], "n bigint", M.bytes_label(F.col("n"))) == ["0 Bytes", "1.5 KB", "1 MB", "5 Bytes"]


def test_request_keys(spark):
    uc, vid = "UC" + "a" * 22, "abc_-123456"
    keys = [f"{uc}_{vid}_thumbnail", f"XX{uc}_{vid}_thumbnail", f"{uc}_{vid}x_thumbnail", "", f"{uc}-{vid}_thumbnail"]
    got = values(spark, keys, "k string", M.parse_request_key(F.col("k"), "thumbnail"))
    assert [tuple(r) if r else None for r in got] == [(uc, vid), None, None, None, None]
    counts = [("12", False), ("", False), (None, False), ("x", False), ("12", True), ("12abc", None)]
    assert values(spark, counts, "c string, h boolean", M.subscriber_count(F.col("c"), F.col("h"))) == [12, None, None, None, None, 12]
    assert values(spark, [uc, "XY1"], "k string", M.uploads_list_id(F.col("k"))) == ["UU" + "a" * 22, None]


def test_local_times(spark):
    t = dt.datetime(2024, 1, 1, 19, 0)
    assert values(spark, [t], "t timestamp", M.local_hour(F.col("t"))) == [0]
    assert values(spark, [t], "t timestamp", M.weekday_name(F.col("t"))) == ["Monday"]
    assert values(spark, [dt.datetime(2024, 7, 1, 6, 59)], "t timestamp", M.local_date(F.col("t"))) == ["2024-06-30"]


def test_sql_functions(spark):
    from cohortlab.functions.sql import register

    assert len(register(spark)) == 7
    row = spark.sql(
        "SELECT days_since_publish(timestamp'2024-01-01', timestamp'2024-01-04 01:00:00') d, recency_weight(timestamp'2023-01-01', timestamp'2024-01-01', 365) w, "
        "confidence_label(10) c, is_significant(0.3, 0.5) s, hour_label(19) h, views_per_subscriber(10, null) v, doc_name('A b/c') n"
    ).first()
    assert (row.d, round(row.w, 6), row.c, row.s, row.h, row.v, row.n) == (3, 0.5, "medium", True, "Evening", 0.0, "a_b_c")


def test_empty_numbers_are_not_cast(spark):
    """A failed cast costs an exception per value: of a million records each has several texts without a number."""
    texts = ["PT5M", "PTM", "PT", "P1DT", "T", "xD9M", "PT9T1H2M", "P2D3D", "99999999999999999999H", " +7x", "n/a", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parsed = df.select("i", M.duration_seconds(F.col("t")).alias("s"), M.parse_count(F.col("t")).alias("c"), M.subscriber_count(F.col("t"), F.lit(False)).alias("o"))
    assert [tuple(r)[1:] for r in parsed.orderBy("i").collect()] == [
        (300, 0, None), (0, 0, None), (0, 0, None), (86400, 0, None), (0, 0, None), (540, 0, None), (3720, 0, None), (172800, 0, None),
        (0, 0, None), (0, 7, 7), (0, 0, None), (0, 0, None), (0, 0, None),
    ]
    plan = parsed._jdf.queryExecution().analyzed().toString().lower()
    assert "try_cast(nullif(regexp_extract(" in plan and "try_cast(regexp_extract(" not in plan
