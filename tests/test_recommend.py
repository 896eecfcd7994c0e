"""Recommendation rows with and without insights."""

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import recommend as R
from cohortlab.operators import templates as P


@pytest.fixture(scope="module")
def requests(spark):
    rows = [
        ("1", "  Chicken\x00 Biryani ", "recipe", None, None), ("2", "Goa Trip", "vlog", "on a budget", "students"), ("3", " \n ", "recipe", None, None),
        ("4", "x", "podcast", None, None), ("5", "t" * 300, None, None, None), ("6", "Phone", "review", None, None),
    ]
    return spark.createDataFrame(rows, "request_id string, topic string, type string, angle string, audience string")


@pytest.fixture(scope="module")
def insights(spark):
    return R.Insights(
        gaps=spark.createDataFrame([("biryani", 9.5, 3, 2.375), ("goa", 4.0, 3, 1.0)], "topic string, avg_vps double, n_items bigint, opportunity_score double"),
        saturated=spark.createDataFrame([("phone", 25.0, 0.1)], "topic string, content_share double, opportunity_score double"),
        keywords=spark.createDataFrame([(f"k{i}", 2.0, 6.0 - i, 5, 4.0) for i in range(6)], "keyword string, avg_vps double, multiplier double, usage_count bigint, usage_percent double"),
        formats=spark.createDataFrame([("vlog", 1.5, 9, 10.0, True), ("list", 0.5, 9, 10.0, False)], "format string, multiplier double, n_items bigint, usage_percent double, recommended boolean"),
        slots=spark.createDataFrame([("day", "Monday", 1.0, 0.9, None), ("day", "Friday", 2.0, 1.4, None), ("day", "Sunday", 2.0, 1.2, None), ("hour", "18", 2.0, 1.5, "Evening")], "dim string, slot string, avg_views double, multiplier double, label string"),
        optimal=spark.createDataFrame([("Friday", 18, "Evening", 2.1)], "day string, hour int, description string, multiplier double"),
        n_items=50, version="2024-01-01",
    )


def test_validation(requests):
    got = {r.request_id: r for r in R.validate(requests).collect()}
    assert got["1"].topic == "Chicken Biryani" and got["1"].reject_reason is None and got["1"].audience == P.DEFAULT_AUDIENCE
    assert got["3"].reject_reason.startswith("Topic is required") and got["4"].reject_reason.startswith("Invalid content type")
    assert len(got["5"].topic) == 200 and got["5"].type == "recipe" and got["2"].angle == "on a budget"


def test_types(spark):
    names = ["Vlog", "cooking", "HOWTO", "how-to", "unboxing", "nope", "", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, t string")
    got = [r.x for r in df.select("i", R.resolve_type(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == ["vlog", "recipe", "tutorial", "tutorial", "review", "recipe", "recipe", "recipe"]


def test_with_insights(requests, insights):
    valid = R.validate(requests).filter("reject_reason IS NULL")
    got = {r.request_id: r for r in R.recommend(valid, insights).collect()}
    a = got["1"]
    assert a.titles.combined == "Chicken Biryani Recipe | Chicken Biryani (తెలుగు) | SECRET" and len(a.titles.alternatives) == 2
    assert a.image.text == "CHICKEN" and a.tags.primary[:2] == ["chicken biryani", "chicken biryani recipe"] and a.tags.characters == len(a.tags.full)
    assert (a.posting.best_day, a.posting.best_time) == ("Friday", "18:00 IST") and a.posting.alternatives == ["Sunday 18:00 IST", "Monday 18:00 IST"]
    assert a.posting.reasoning == "Based on analysis of 50 videos, Friday at 18:00 IST has 2.1x average performance"
    assert len(a.prediction.positive_factors) == 4 and a.prediction.risk_factors == [] and a.prediction.confidence == "medium"
    assert got["2"].titles.combined == "My Goa Trip Experience | Goa Trip తెలుగు" and got["2"].titles.english == "Goa Trip | on a budget"
    assert len(got["6"].prediction.risk_factors) == 1 and got["6"].prediction.expected_views.high == 120000


def test_without_insights(requests):
    valid = R.validate(requests).filter("request_id = '1'")
    r = R.recommend(valid, R.Insights()).first()
    assert r.posting.best_day == "Saturday" and r.prediction.confidence == "low" and len(r.prediction.positive_factors) == 3 and r.metadata.fallback_used


def test_production_table(spark, requests):
    plans = spark.createDataFrame([("recipe", "10-15 minutes")], "type string, production string")
    got = {r.request_id: r.production for r in R.recommend(R.validate(requests).filter("reject_reason IS NULL"), R.Insights(), plans).collect()}
    assert got["1"] == "10-15 minutes" and got["2"] is None


def test_ideas_are_padded_by_keywords(requests, insights):
    ideas = R.idea_rows(R.validate(requests).filter("request_id = '2'"), insights).orderBy("rank").collect()
    assert [i.topic for i in ideas] == ["biryani", "goa", "k0", "k1", "k2"] and all(i.suggested_type == "vlog" for i in ideas)
    assert ideas[0].angle == "vlog style — low competition, high viewer interest" and ideas[0].keywords == ["k0", "k1", "k2"]
    assert ideas[0].why == "Opportunity score of 2 with only 3 existing videos and 9.5 avg views."
    assert ideas[2].score == 100.0 and ideas[2].keywords == ["k0", "k1", "k2"] and ideas[3].keywords == ["k1", "k0", "k2"]


def test_digest(insights):
    rows = {(r.section, r.rank): r.label for r in R.digest(insights).collect()}
    assert rows["saturated", 1] == "phone (high competition)" and rows["optimal_posting", 1] == "Friday at 18:00 IST (2.1x performance)"
    assert rows["keyword", 1] == "k0 (6.0x views, used 5 times, 4.0% usage)"


def test_sections_tags_and_generations(spark, requests):
    base = R.recommend(R.validate(requests).filter("request_id IN ('1', '2')"), R.Insights())
    given = spark.createDataFrame([("1",)], "request_id string").withColumn("posting", F.lit(None).cast(base.schema["posting"].dataType))
    assert R.fill_sections(given, base, ["posting"]).filter("posting IS NULL").count() == 0
    rows = spark.createDataFrame([("ideas", "r", "x"), ("other", "r", "x"), ("ideas", None, "x")], "type string, request string, response string")
    assert [r.reject_reason is None for r in R.validate_generation(rows).collect()] == [True, False, False]


def test_two_plans_of_one_type_are_an_error(spark, requests):
    plans = spark.createDataFrame([("recipe", "x")] * 5 + [("vlog", "y")], "type string, production string")
    with pytest.raises(Exception, match="two production plans"):
        R.recommend(R.validate(requests).filter("reject_reason IS NULL"), R.Insights(), plans).collect()


def test_all_listed_topics_count(spark):
    table = spark.createDataFrame([(f"Topic{i:02d}",) for i in range(40)], "topic string")
    rows = R.with_insights(spark.range(1), R.Insights(gaps=table, saturated=table)).first()
    assert len(rows["_open"]) == len(rows["_full"]) == 40


def test_requests_are_dealt_over_the_cores(spark):
    """One small file of requests is not one task, and insights for requests carry no documents that nobody reads."""
    from compare import TESTDATA

    from cohortlab.plans import bindings as D
    from cohortlab.plans import queries_cohort as QC
    from cohortlab.plans import queries_recommend as QR

    sf = f"{TESTDATA}/sf0.001"
    assert QR.valid_requests(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    lean, full = QC.topic_cohort(spark, sf), D.with_topic(QC.order_cohort(spark, sf), spark, sf)
    assert not {"types", "image_analysis", "title_analysis"} & set(lean.columns)
    same = ["item_id", "vps", "is_top", "is_top_eng", "niche", "primary_keyword", "secondary_keywords"]
    assert lean.select(same).exceptAll(full.select(same)).isEmpty() and full.select(same).exceptAll(lean.select(same)).isEmpty()
