"""The skew-proof building blocks against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab import scale


@pytest.fixture(scope="module")
def hot(spark):
    """60,000 rows, a third of them in one group, many ties."""
    rng = np.random.default_rng(7)
    n = 60_000
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 400, n))
    value = np.where(rng.random(n) < 0.3, np.round(rng.lognormal(2, 2, n)), rng.lognormal(2, 2, n))
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "v": value, "w": rng.normal(size=n)})
    return pdf, spark.createDataFrame(pdf).repartition(8)


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.9, 0.95, 1.0])
def test_group_quantile_equals_numpy(hot, p):
    pdf, df = hot
    got = {r.k: r.threshold for r in scale.group_quantile(df, ["k"], "v", p).collect()}
    want = pdf.groupby("k")["v"].quantile(p).to_dict()
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_group_quantile_with_a_coarse_sketch(hot):
    """The result stays exact when the sketch is much smaller than the group."""
    pdf, df = hot
    out = scale.group_quantiles(df, ["k"], {"a": ("v", 0.9), "b": ("w", 0.25)}, accuracy=200, count="n")
    want = pdf.groupby("k").agg(a=("v", lambda s: s.quantile(0.9)), b=("w", lambda s: s.quantile(0.25)), n=("v", "size"))
    for r in out.collect():
        assert r.a == pytest.approx(want.a[r.k], rel=1e-12) and r.b == pytest.approx(want.b[r.k], rel=1e-12)
        assert r.n == want.n[r.k]


def test_global_quantile_and_empty_input(hot):
    pdf, df = hot
    assert scale.one_value(scale.group_quantile(df, [], "v", 0.95)) == pytest.approx(pdf.v.quantile(0.95), rel=1e-12)
    assert scale.one_value(scale.group_quantile(df.limit(0), [], "v", 0.95)) is None


def test_quantile_ignores_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)], "k string, v double")
    got = {r.k: r.threshold for r in scale.group_quantile(df, ["k"], "v", 0.5).collect()}
    assert got["a"] == 2.0 and got.get("b") is None


def test_running_total_per_key(hot):
    pdf, df = hot
    got = scale.running_total(df, ["id"], {"total": F.col("k") + 1}, ["k"]).toPandas().sort_values("id")
    want = pdf.assign(total=(pdf.k + 1)).groupby("k")["total"].cumsum()
    assert (got.total.to_numpy() == want.to_numpy()).all()


def test_row_numbers_in_one_global_order(hot):
    pdf, df = hot
    got = scale.row_numbers(df, ["v", "id"], "rn").toPandas().sort_values(["v", "id"])
    assert (got.rn.to_numpy() == np.arange(1, len(pdf) + 1)).all()


def test_running_total_spreads_a_hot_key(spark, hot):
    """With many range partitions the offsets still add up."""
    pdf, df = hot
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = scale.row_numbers(df, ["id"], "rn", ["k"]).toPandas().sort_values("id")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert (got.rn.to_numpy() == (pdf.groupby("k").cumcount() + 1).to_numpy()).all()


def test_lookup_join_with_and_without_broadcast(spark, hot):
    pdf, df = hot
    small = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    a = scale.lookup_join(df, small, ["k"])
    b = scale.lookup_join(df, small, ["k"], max_rows=10)
    assert a.agg(F.sum("n")).first()[0] == b.agg(F.sum("n")).first()[0] == int((pdf.groupby("k").size() ** 2).sum())
    assert "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()
    assert scale.settle(small, max_rows=10).count() == scale.settle(small).count() == pdf.k.nunique()


def test_stage_prunes_columns(spark, hot):
    _, df = hot
    staged = scale.stage(df)
    plan = staged.select("k").filter("k = 3")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:bigint>" in plan and "PushedFilters: [IsNotNull(k), EqualTo(k,3)]" in plan


def test_stage_root_is_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert scale.stage_root(spark) == scale.stage_root(spark)
    assert not shared or scale.stage_root(spark) == shared.rstrip("/")


def test_brackets_are_narrowed_to_a_bounded_size(hot, monkeypatch):
    """With a tiny bound the sketch's brackets are cut down in rounds; heavy ties end them."""
    pdf, df = hot
    monkeypatch.setattr(scale, "BRACKET_VALUES", 40)
    seen, plain = [], scale.narrowed

    def spy(*args):
        out = plain(*args)
        seen.extend(b for r in out.collect() for b in r._b)
        return out

    monkeypatch.setattr(scale, "narrowed", spy)
    out = scale.group_quantiles(df, ["k"], {"a": ("v", 0.9), "b": ("w", 0.25)}, accuracy=200).collect()
    want = pdf.groupby("k").agg(a=("v", lambda s: s.quantile(0.9)), b=("w", lambda s: s.quantile(0.25)))
    assert all(r.a == pytest.approx(want.a[r.k], rel=1e-12) and r.b == pytest.approx(want.b[r.k], rel=1e-12) for r in out)
    assert len(out) == len(want) and all(b.size <= 40 or b.lo == b.hi for b in seen)


def test_a_missed_bracket_is_opened_again(hot, monkeypatch):
    pdf, df = hot
    plain = scale.quantile_brackets

    def wrong(*args):
        """Every other group's brackets lie beside the rank, below or above it."""
        off = F.when(F.col("k") % 4 == 0, F.lit(-1e9)).when(F.col("k") % 4 == 2, F.lit(1e9)).otherwise(F.lit(0.0))
        moved = lambda b: b.withField("lo", b["lo"] + off).withField("hi", b["hi"] + off)
        return plain(*args).withColumn("_b", F.transform("_b", moved))

    monkeypatch.setattr(scale, "quantile_brackets", wrong)
    got = {r.k: r.threshold for r in scale.group_quantile(df, ["k"], "v", 0.95).collect()}
    want = pdf.groupby("k")["v"].quantile(0.95).to_dict()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_ties_in_one_very_large_group(spark, monkeypatch):
    monkeypatch.setattr(scale, "BRACKET_VALUES", 1)
    df = spark.range(100_000).select(F.lit("a").alias("k"), F.when(F.col("id") < 50_000, 5.0).otherwise(6.0).alias("v"))
    assert scale.group_quantile(df, ["k"], "v", 0.5).collect()[0].threshold == 5.5
    # the rank lies just beyond 100,000 equal values, with 2,000 different ones behind them
    rest = spark.range(2_000).select(F.lit("a").alias("k"), (F.col("id") + 10.0).alias("v"))
    got = scale.group_quantile(df.unionByName(rest), ["k"], "v", 100_001 / 101_999, "t").collect()[0].t
    assert got == pytest.approx(11.0, abs=1e-6)
