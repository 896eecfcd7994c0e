"""Rate limiter: table and stream against a plain fold; incremental stream."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.operators.rate_limit import rate_limit
from cohortlab.scale import stage_path
from cohortlab.streaming import incremental as SI
from cohortlab.streaming.rate_limit import rate_limit_stream


def fold(rows, limit, window):
    out, state = {}, {}
    for key, ms, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        start, used = state.get(key, (None, 0))
        if start is None or ms - start >= window:
            start, used = ms, 0
        ok = used < limit
        used += ok
        state[key] = (start, used)
        out[seq] = (start, ok, limit - used if ok else 0)
    return out


@pytest.fixture(scope="module")
def requests():
    """A third of the requests from one key, bursts within a millisecond."""
    rng = np.random.default_rng(11)
    n = 6000
    keys = np.where(rng.random(n) < 0.34, "hot", np.char.add("k", rng.integers(0, 40, n).astype(str)))
    ms = np.sort(rng.integers(0, 400_000, n) // 7 * 7)
    return [(str(k), int(t), i) for i, (k, t) in enumerate(zip(keys, ms))]


@pytest.mark.parametrize("limit, window", [(3, 10_000), (1, 1), (100, 60_000), (2, 1_000_000)])
def test_table_equals_fold(spark, requests, limit, window):
    df = spark.createDataFrame(requests, "key string, ms long, seq long").repartition(6)
    got = {r.seq: (r.window_start, r.allowed, r.remaining) for r in rate_limit(df, "key", "ms", "seq", limit, window).collect()}
    assert got == fold(requests, limit, window)


def test_small_arrow_batches(spark, requests):
    """Windows that span several batches of the scan."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.createDataFrame(requests, "key string, ms long, seq long")
        got = {r.seq: (r.window_start, r.allowed, r.remaining) for r in rate_limit(df, "key", "ms", "seq", 5, 20_000).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == fold(requests, 5, 20_000)


def test_stream_equals_table_over_several_batches(spark, requests, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate(np.array_split(np.arange(len(requests)), 4)):
        pd.DataFrame([requests[j] for j in part], columns=["key", "ms", "seq"]).to_parquet(src / f"{i}.parquet")
    stream = SI.read_landed(spark, str(src), "key string, ms long, seq long", max_files=1)
    out = rate_limit_stream(stream, "key", "ms", "seq", 3, 10_000)
    path = stage_path(spark, "stream")
    SI.drain_to_parquet(out, path, stage_path(spark, "stream-checkpoint"))
    got = {r.seq: (r.window_start, r.allowed, r.remaining) for r in spark.read.parquet(path).collect()}
    assert got == fold(requests, 3, 10_000)


def test_incremental_stream_resumes(spark, tmp_path):
    """A second run reads only new files and passes only new keys."""
    src = tmp_path / "landed"
    src.mkdir()
    seen = []

    def into(batch, _):
        seen.extend(r.id for r in batch.select("id").collect())

    def run():
        rows = SI.read_landed(spark, str(src), "id long, at timestamp")
        SI.drain(SI.new_items_stream(rows, ["id"], "at", "10 days"), str(tmp_path / "checkpoint"), into)

    day = pd.Timestamp("2024-01-01")
    pd.DataFrame({"id": [1, 2, 2], "at": [day] * 3}).astype({"at": "datetime64[us]"}).to_parquet(src / "a.parquet")
    run()
    pd.DataFrame({"id": [2, 3], "at": [day + pd.Timedelta(days=1)] * 2}).astype({"at": "datetime64[us]"}).to_parquet(src / "b.parquet")
    run()
    assert sorted(seen) == [1, 2, 3]


def test_requests_without_a_key_are_decided_too(spark):
    rows = [("a", 0, 1), (None, 0, 2), (None, 5, 3)]
    df = spark.createDataFrame(rows, "key string, ms long, seq long")
    got = {r.seq: (r.allowed, r.remaining) for r in rate_limit(df, "key", "ms", "seq", max_requests=1, window_ms=100).collect()}
    assert got == {1: (True, 0), 2: (True, 0), 3: (False, 0)}


def test_a_hot_key_over_many_blocks(spark):
    """Gaps, bursts and times before zero; the hot key has requests in hundreds of blocks."""
    rng = np.random.default_rng(2)
    rows = [("hot", int(t), i) for i, t in enumerate(rng.integers(-300_000, 300_000, 3000))]
    rows += [("gaps", int(t), 5000 + i) for i, t in enumerate([-290_000, -1, 0, 99, 100, 250_000, 250_001, 299_999])]
    df = spark.createDataFrame(rows, "key string, ms long, seq long").repartition(5)
    got = {r.seq: (r.window_start, r.allowed, r.remaining) for r in rate_limit(df, "key", "ms", "seq", 2, 100).collect()}
    assert got == fold(rows, 2, 100)


def test_no_requests_and_equal_times(spark):
    none = spark.createDataFrame([], "key string, ms long, seq long")
    assert rate_limit(none, "key", "ms", "seq", 2, 100).count() == 0
    same = [("a", 7, i) for i in range(5)]
    got = {r.seq: (r.window_start, r.allowed, r.remaining) for r in rate_limit(spark.createDataFrame(same, none.schema), "key", "ms", "seq", 2, 100).collect()}
    assert got == fold(same, 2, 100)


def test_stream_state_expires(spark, tmp_path):
    """A key's window is removed once the watermark has passed its end."""
    src = tmp_path / "in"
    src.mkdir()
    rows = [(f"k{i}", i * 1000, i) for i in range(200)]
    for i in range(4):
        pd.DataFrame(rows[i * 50 : i * 50 + 50], columns=["key", "ms", "seq"]).to_parquet(src / f"{i}.parquet")
        os.utime(src / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = SI.read_landed(spark, str(src), "key string, ms long, seq long", max_files=1)
    out = rate_limit_stream(stream, "key", "ms", "seq", 3, 5_000, delay="2 seconds")
    path = stage_path(spark, "expiring")
    query = SI.drain_to_parquet(out, path, stage_path(spark, "expiring-checkpoint"))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(path).count() == 200
    assert held[-1] <= 10 < max(held) <= 110, held
