"""Cohort, profile, timing, correlation, gap and bridge operators on edge sets."""

import itertools

import pytest
from pyspark.sql import functions as F

from cohortlab.functions.nested import deep_merge, leaves
from cohortlab.operators import bridge as B
from cohortlab.operators import cohort as C
from cohortlab.operators import gaps as G
from cohortlab.operators import profile as P
from cohortlab.operators.correlate import feature_correlations
from cohortlab.operators.timing import timing_profile
from cohortlab.schemas import IMAGE_DOCUMENT, TITLE_DOCUMENT, struct_type


def docs(spark, rows, ddl):
    """rows: (is_top, doc tuple or None)."""
    return spark.createDataFrame(
        [("x", top, 1.0, doc) for top, doc in rows], f"content_type string, is_top boolean, weight double, doc struct<{ddl}>"
    )


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_document_schemas(spark):
    image, title = leaves(struct_type(IMAGE_DOCUMENT)), leaves(struct_type(TITLE_DOCUMENT))
    assert (len(image), len(title)) == (130, 76)
    assert [sum(x.kind == k for x in image) for k in ("bool", "str", "num", "list")] == [48, 65, 7, 10]


def test_categorical(spark):
    rows = [(True, ("a",)), (False, ("b",)), (True, ("a",))]
    got = {r.value: (r.all_share, r.top_share) for r in P.categorical_profile(docs(spark, rows, "c: string"), "doc").collect()}
    assert got == {"a": (0.667, 1.0), "b": (0.333, 0.0)}
    many = [(False, (f"v{i}",)) for i in range(21)]
    assert P.categorical_profile(docs(spark, many, "c: string"), "doc").count() == 0
    free = [(False, (f"text {i}",)) for i in range(500)]
    assert P.categorical_profile(docs(spark, free, "c: string"), "doc").count() == 0
    empty = [(False, ("",)), (False, ("a",))]
    assert one(P.categorical_profile(docs(spark, empty, "c: string"), "doc")).all_share == 0.5


def test_lists(spark):
    rows = [(False, (["1", "2", "3"],)), (False, (["4", "5"],)), (True, (["1", "2", "3", "4", "5"],))]
    r = one(P.list_profile(docs(spark, rows, "l: array<string>"), "doc"))
    assert (r.all_avg_count, r.top_avg_count, r.n_top) == (3.33, 5.0, 1)
    twice = [(True, (["a", "a", ""],)), (False, (["a"],))]
    item = one(P.list_items(docs(spark, twice, "l: array<string>"), "doc"))
    assert (item.item, item.all_rate, item.top_rate) == ("a", 1.5, 2.0)
    many = [(False, ([f"i{j}" for j in range(51)],))]
    assert P.list_items(docs(spark, many, "l: array<string>"), "doc").count() == 0


def test_bool_and_numeric(spark):
    rows = [(True, (True, 1)), (False, (None, 3)), (False, (False, None))]
    r = one(P.bool_profile(docs(spark, rows, "b: boolean, n: int"), "doc"))
    assert (r.n_all, r.all_rate, r.top_rate, r.confidence, r.significant) == (2, 0.5, 1.0, "low", True)
    r = one(P.numeric_profile(docs(spark, rows, "b: boolean, n: int"), "doc"))
    assert (r.n_all, r.all_avg, r.top_avg) == (2, 2.0, 1.0)
    nothing = docs(spark, [(False, (None, None))], "b: boolean, n: int")
    assert P.bool_profile(nothing, "doc").count() == 0 and P.numeric_profile(nothing, "doc").count() == 0
    no_top = docs(spark, [(False, (True, 4))], "b: boolean, n: int")
    assert one(P.bool_profile(no_top, "doc")).top_rate == 0.0 and one(P.numeric_profile(no_top, "doc")).top_avg == 0.0


def test_weighted_numeric(spark):
    df = spark.createDataFrame([("x", True, 3.0, (1.0,)), ("x", False, 1.0, (5.0,))], "content_type string, is_top boolean, weight double, doc struct<n: double>")
    assert one(P.numeric_profile(df, "doc")).all_avg == 2.0
    assert one(P.numeric_profile(df, "doc", weight=None)).all_avg == 3.0


def test_skipped_fields_and_flatten(spark):
    df = spark.createDataFrame([(1, ("m", (True, None)))], "id int, doc struct<modelUsed: string, s: struct<b: boolean, n: int>>")
    assert {(r.path, r.kind) for r in P.flatten(df, "doc", "id").collect()} == {("s.b", "bool"), ("s.n", "num")}


def test_correlations(spark):
    rows = [(False, pair) for pair in itertools.product([True, False], repeat=2) for _ in range(7)] + [(True, (True, True))] * 12
    r = one(feature_correlations(docs(spark, rows, "a: boolean, b: boolean"), "doc"))
    assert (r.feature_a, r.feature_b, r.all_rate, r.top_rate, r.lift) == ("a", "b", 0.475, 1.0, 2.11)
    assert feature_correlations(docs(spark, rows[:5], "a: boolean, b: boolean"), "doc").count() == 0
    assert feature_correlations(docs(spark, [(t, (d[0],)) for t, d in rows], "a: boolean"), "doc").count() == 0


def test_correlation_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m, top = rng.random((400, 6)) < rng.uniform(0.2, 0.8, 6), rng.random(400) < 0.2
    df = docs(spark, [(bool(t), tuple(bool(x) for x in r)) for t, r in zip(top, m)], ", ".join(f"f{i}: boolean" for i in range(6)))
    got = {(r.feature_a, r.feature_b): (r.all_rate, r.top_rate) for r in feature_correlations(df, "doc", n_pairs=99).collect()}
    assert len(got) == 15
    for (a, b), (all_rate, top_rate) in got.items():
        both = m[:, int(a[1])] & m[:, int(b[1])]
        assert all_rate == pytest.approx(both.mean(), abs=6e-4) and top_rate == pytest.approx(both[top].mean(), abs=6e-4)


def test_top_split_and_winsor(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 11)] + [("h", 5.0)] * 10, "k string, v double")
    rows = C.mark_top(df, ["k"], {"is_top": "v"}).collect()
    assert [r.v for r in rows if r.is_top and r.k == "g"] == [10.0] and sum(r.is_top for r in rows if r.k == "h") == 10
    assert next(r.is_top_at for r in rows if r.k == "g") == pytest.approx(9.1)
    df = spark.createDataFrame([(1.0, 10_000)] * 95 + [(100.0, 10_000)] * 5 + [(1.0, 500), (7.0, None)], "vps double, subs int")
    s = one(C.winsorize_stats(df, "vps", "subs"))
    assert (s.original_count, s.filtered_count, s.removed_low_subscribers, s.winsorized_count) == (102, 100, 2, 5) and s.vps_cap < 100
    assert C.winsorize(df, "vps", "subs").agg(F.max("vps")).first()[0] < 100
    assert C.winsorize(df, "vps", "subs", min_subscribers=100).count() == 101
    assert one(C.winsorize_stats(df.limit(0), "vps", "subs")).vps_cap == 0.0
    assert C.mark_top(df, [], {"t": "vps"}).filter("t").count() == C.mark_top(df, [], {"t": "vps"}).filter("vps >= t_at").count()


def test_timing(spark):
    rows = [("x", "Monday", 10, 1.5)] * 5 + [("x", "Friday", 18, 2.5)] * 5 + [("x", "Sunday", 1, 9.0), ("x", "Sunday", 2, 0.0)]
    df = spark.createDataFrame(rows, "content_type string, day string, hour int, v double")
    got = {(r.dim, r.slot): (r.avg_vps, r.n_items) for r in timing_profile(df, "v").collect()}
    assert got == {("day", "Monday"): (1.5, 5), ("day", "Friday"): (2.5, 5), ("hour", "10"): (1.5, 5), ("hour", "18"): (2.5, 5)}
    best = one(B.optimal_slot(B.timing_insights(timing_profile(df, "v"))))
    assert (best.day, best.hour, best.description, best.multiplier) == ("Friday", 18, "Evening", 1.56)
    nothing = one(B.optimal_slot(B.timing_insights(timing_profile(df.limit(0), "v"))))
    assert nothing.day is None and nothing.multiplier is None


def test_topic_gaps(spark):
    rows = [("crowd", 0.5)] * 60 + [("open", 5.0)] * 40 + [("rare", 9.0)] * 2 + [("none", 0.0)] * 10
    stats = G.topic_stats(spark.createDataFrame(rows, "topic string, v double"), "topic", "v")
    assert [r.topic for r in G.topic_gaps(stats).collect()] == ["open", "crowd"]
    assert [r.topic for r in G.saturated_topics(stats).collect()] == ["crowd"]
    topics = spark.createDataFrame([(None, None), ("a", ""), ("a", "b")], "n string, s string")
    assert [r.t for r in topics.select(G.topic_of(F.col("n"), F.col("s")).alias("t")).collect()] == ["unknown", "a", "a/b"]


def test_keyword_and_format_gaps(spark):
    rows = [("Rice", "rice, Quick", None, 9.0), ("RICE", None, ["quick"], 8.0)] + [("other", "", None, 1.0)] * 40
    df = spark.createDataFrame(rows, "p string, s string, l array<string>, v double")
    got = {r.keyword: r.usage_count for r in G.keyword_stats(df, "v", "p", "s", "l").collect()}
    assert got == {"rice": 3, "quick": 2}
    formats = G.format_stats(df, "v", {"long": F.col("v") > 5, "never": F.lit(False)})
    r = one(formats)
    assert (r.format, r.n_items, r.recommended) == ("long", 2, True)


def test_bridge(spark):
    profile = spark.createDataFrame(
        [("a", "humanPresence.facePresent", 0.4, 0.8, "high", True), ("b", "humanPresence.facePresent", 0.5, 0.5, "high", False),
         ("a", "scene.day", 0.6, 0.9, "high", True), ("a", "food.steam", 0.005, 0.1, "high", True), ("a", "colors.x", 0.8, 0.4, "medium", True),
         ("a", "graphics.y", 0.5, 0.45, "high", False), ("a", "food.low", 0.1, 0.9, "low", True)],
        "content_type string, path string, all_rate double, top_rate double, confidence string, significant boolean",
    )
    sizes = spark.createDataFrame([("a", 60, 6), ("b", 20, 2)], "content_type string, n_all bigint, n_top bigint")
    lifts = {r.path: r.lift for r in B.bool_lifts(profile, sizes).collect()}
    assert lifts == {"humanPresence.facePresent": 1.75, "scene.day": 1.5, "food.steam": 2.0, "colors.x": 0.5}
    found = {r.element: (r.category, r.avoid) for r in B.image_elements(B.bool_lifts(profile, sizes)).collect()}
    assert found == {
        "humanPresence.facePresent": ("humanPresence", False), "scene.day": ("composition", False), "food.steam": ("food", False), "colors.x": ("worst", True)
    }


def test_deep_merge(spark):
    df = spark.createDataFrame(
        [((1, (1, 2)), ((9, 3), "o")), ((1, (1, 2)), None)], "a struct<x: int, s: struct<p: int, q: int>>, b struct<s: struct<p: int, r: int>, y: string>"
    )
    rows = df.select(deep_merge(F.col("a"), df.schema["a"].dataType, F.col("b"), df.schema["b"].dataType).alias("m")).collect()
    assert rows[0].m.asDict(True) == {"x": 1, "s": {"p": 9, "q": 2, "r": 3}, "y": "o"}
    assert rows[1].m.asDict(True) == {"x": 1, "s": {"p": 1, "q": 2, "r": None}, "y": None}


def test_profile_json(spark):
    rows = P.bool_profile(docs(spark, [(True, (True,))] * 12, "b: boolean"), "doc").withColumn("section", F.lit("s"))
    assert '"b":[' in one(P.profile_json(rows)).document


def test_empty_documents_do_not_count(spark):
    rows = [(1, "{}"), (2, None), (3, '{"a": {"b": null}}'), (4, '{"a": {"b": false}}'), (5, '{"c": 0}')]
    df = spark.createDataFrame(rows, "id int, j string").withColumn("doc", F.from_json("j", "a struct<b boolean>, c int"))
    assert sorted(r.id for r in C.with_document(df, "doc").collect()) == [4, 5]
