"""Pending work, imports, jobs, operations, sinks and load jobs."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab import schemas as S
from cohortlab.operators import ops as O
from cohortlab.operators import work as W
from cohortlab.plans import load as J
from cohortlab.scale import stage_path
from cohortlab.sources import landed as R
from cohortlab.sources import sinks as K
from cohortlab.sources import tables as B

UC = "UC" + "a" * 22
VID = "abcdefghij{}"


def result(key, text):
    return json.dumps({"key": key, "response": {"candidates": [{"content": {"parts": [{"text": text}]}}] if text is not None else []}})


def test_import_of_every_kind_of_line(spark):
    lines = [
        result(f"{UC}_{VID.format(1)}_title_description", '{"structure": {"pattern": "p"}}'), "{not json", result(f"XX_{VID.format(1)}_title_description", "{}"),
        result(f"{UC}_{VID.format('12')}_title_description", "{}"), result(f"UC{'b' * 22}_{VID.format(1)}_title_description", '{"a": 1}'),
        result(f"{UC}_{VID.format(2)}_title_description", None), result(f"{UC}_{VID.format(3)}_title_description", '```json\n{"structure": {"pattern": "q"}}\n```'),
        result(f"{UC}_{VID.format(4)}_title_description", "{}"), "", "  ",
    ]
    path = stage_path(spark, "lines")
    K.write_json_lines(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1), path, "line")
    parsed = W.parse_results(R.read_result_lines(spark, path), "title_description")
    owners = spark.createDataFrame([(UC,)], "owner_id string")
    texts = spark.createDataFrame([(UC, VID.format(1), "Big Day", "")], "owner_id string, item_id string, title string, description string")
    rows = W.import_results(parsed, owners, texts, S.struct_type(S.TITLE_DOCUMENT)).orderBy("line_no").collect()
    assert [r.reason for r in rows] == [None, "parse_error", "bad_key", "bad_key", "unknown_owner", "empty_document", None, "empty_document"]
    assert rows[0].analysis.structure.pattern == "p" and rows[0].analysis.structure.characterCount == 7 and rows[0].features_merged
    assert rows[6].analysis.structure.pattern == "q" and rows[6].analysis.structure.characterCount is None
    stats = W.import_stats(W.import_results(parsed, owners, texts)).first()
    assert (stats.total, stats.imported, stats.failed, stats.parse_errors, stats.features_merged) == (8, 2, 5, 1, 1)


def test_abort_rule(spark):
    status = ["imported"] * 6 + ["failed"] * 3 + ["imported"] * 3
    rows = [("f", i, i // 4, s) for i, s in enumerate(status)] + [("g", i, i // 4, "parse_error" if i % 2 else "imported") for i in range(20)]
    out = W.failure_cutoff(spark.createDataFrame(rows, "file string, n int, b int, status string"), "file", "n", "b")
    got = {r.file: (r.n, r.aborted) for r in out.groupBy("file").agg(F.count("n").alias("n"), F.bool_or("aborted").alias("aborted")).collect()}
    assert got == {"f": (10, True), "g": (20, False)}


def test_jobs(spark):
    day = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    rows = [("1", "a", "JOB_STATE_RUNNING", day[0], None), ("2", "a", "JOB_STATE_SUCCEEDED", day[1], None), ("3", "b", "JOB_STATE_SUCCEEDED", day[0], day[1]),
            ("4", "b", "JOB_STATE_FAILED", day[2], None), ("5", "c", "JOB_STATE_OTHER", day[3], None), ("6", "c", "JOB_STATE_FAILED", day[0], None)]
    jobs = spark.createDataFrame(rows, "job_id string, kind string, state string, created_at timestamp, imported_at timestamp").withColumn("job_name", F.lit("x" * 40))
    assert {r.kind: r.job_id for r in W.active_job(jobs).collect()} == {"a": "1", "c": "5"}
    assert {r.kind: r.job_id for r in W.importable_job(jobs).collect()} == {"a": "2"}
    assert [r.job_id for r in W.recent_jobs(jobs, 2).collect()] == ["5", "4"] and W.recent_jobs(jobs, 1).first().label == "..." + "x" * 30


def test_prepare_stats_brute_force(spark):
    rows = [(f"o{i % 7}", i, i % 5 == 0, "missing_data" if i % 3 == 0 else None) for i in range(140)]
    work = spark.createDataFrame(rows, "owner_id string, item_id int, analyzed boolean, reject string")
    for limit in (1, 17, 30, 1000):
        written = analyzed = missing = scanned = with_work = 0
        for owner in sorted({r[0] for r in rows}):
            if written >= limit:
                break
            scanned, before = scanned + 1, written
            mine = sorted(r for r in rows if r[0] == owner)
            analyzed += sum(r[2] for r in mine)
            for r in mine:
                if written >= limit:
                    break
                if r[2]:
                    continue
                missing, written = missing + (r[3] is not None), written + (r[3] is None)
            with_work += written > before
        got = W.prepare_stats(work, limit).first()
        assert (got.requests, got.already_analyzed, got.missing_data, got.owners_scanned, got.owners_with_work) == (written, analyzed, missing, scanned, with_work)


def test_upsert_keeps_what_the_record_lacks(spark):
    old = spark.createDataFrame([(1, "a", (1, 2)), (2, "b", None)], "id int, t string, c struct<x: int, y: int>")
    new = spark.createDataFrame([(1, None, (9, None), 5), (3, "n", None, 6)], "id int, t string, c struct<x: int, y: int>, extra int")
    got = {r.id: r.asDict(True) for r in K.upsert(old, new, ["id"]).collect()}
    assert got[1] == {"id": 1, "t": "a", "c": {"x": 9, "y": 2}, "extra": 5}
    assert got[2] == {"id": 2, "t": "b", "c": None, "extra": None} and got[3]["t"] == "n"
    assert {r.id for r in K.patch_existing(old, new, ["id"]).collect()} == {1, 2}
    assert K.update_columns(old, new, ["id"], ["t"]).columns == ["id", "t", "c"]


def test_newest_per_key_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "id int, v int, t string")
    assert {r.id: r.t for r in K.newest_per_key(df, ["id"], ["v"]).collect()} == {1: "new", 2: "x"}
    path = K.replace_table(df, str(tmp_path), "v1", ["id", "v"])
    assert spark.read.parquet(path).count() == 3


def test_config_and_flags_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"channels": [{"url": "u1", "category": "a", "priority": 1}, {"url": "u2"}], "settings": {"skipShortThumbnails": True}}, indent=1))
    rows = R.read_config(spark, str(tmp_path / "c.json")).orderBy("ord").collect()
    assert [(r.url, r.include_shorts, r.skip_short_images) for r in rows] == [("u1", False, True), ("u2", False, True)]
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception):
        R.read_config(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "f.csv").write_text("﻿Analyze,channel_name,LINK,category\n Yes , A ,https://y/@Chef, food\nno,B,,x\nTRUE,C,https://y/@Two/x,\n", encoding="utf-8")
    rows = R.read_flags(spark, str(tmp_path / "f.csv")).collect()
    assert [(r.handle, r.analyze_enabled, r.category, r.label) for r in rows] == [("chef", True, "food", "A"), ("two", True, "", "C")]


def test_progress_and_resume(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(6)]
    log = [("a", t[0], 0, "start", None), ("a", t[1], 1, "progress", 5), ("a", t[2], 2, "failed", None), ("a", t[3], 3, "progress", 9), ("a", t[4], 4, "completed", None),
           ("a", t[5], 5, "update", 2), ("b", t[0], 6, "start", None), ("c", t[0], 7, "failed", None), ("c", t[1], 8, "failed", None), ("c", t[2], 9, "failed", None)]
    fold = O.progress_fold(spark.createDataFrame(log, "owner_id string, ts timestamp, seq int, event string, n int"))
    got = {r.owner_id: (r.status, r.items_processed, r.retry_count) for r in fold.collect()}
    assert got == {"a": ("completed", 11, 1), "b": ("pending", 0, 0), "c": ("failed", 0, 3)}
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "owner_id string")
    assert {r.owner_id: r.action for r in O.owners_to_process(wanted, fold).collect()} == {"a": "completed", "b": "resume", "c": None, "d": "start"}
    items = spark.createDataFrame([("a", f"v{i}", i) for i in range(5)] + [("b", f"w{i}", i) for i in range(3)], "o string, v string, p int")
    marks = spark.createDataFrame([("a", "v2"), ("b", "gone")], "o string, marker string")
    got = sorted(r.v for r in O.resume_after(items, marks, "o", "v", "p").collect())
    assert got == ["v3", "v4", "w0", "w1", "w2"]


def test_percent_rank_and_chunks(spark):
    pdf = pd.DataFrame({"id": range(300), "o": [i % 3 if i % 2 else 0 for i in range(300)], "v": [float(i * 37 % 50) for i in range(300)]})
    df = spark.createDataFrame(pdf)
    got = O.performance_percentile(df, "o", "v").toPandas().sort_values("id")
    rank, size = pdf.groupby("o").v.rank(method="min"), pdf.groupby("o").v.transform("size")
    assert got.percentile.to_numpy() == pytest.approx(((rank - 1) / (size - 1)).to_numpy())
    single = O.performance_percentile(spark.createDataFrame([("a", 1.0)], "o string, v double"), "o", "v").first()
    assert single.percentile == 0.0
    sizes = O.chunks(df, [], ["id"], 50).groupBy("chunk").count().collect()
    assert len(sizes) == 6 and all(r["count"] == 50 for r in sizes)


def test_table_reads(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(10)], "id int, f string")
    assert B.where_equal(df, f="a").count() == 5
    assert [r.id for r in B.page_after(df, "id", 6, 2).collect()] == [7, 8] and B.page_after(df, "id", None, 3).count() == 3
    flags = B.exists_flag(spark.createDataFrame([(3,), (99,)], "id int"), df, ["id"])
    assert {r.id: r.exists for r in flags.collect()} == {3: True, 99: False}


def raw_item(i, owner, **over):
    rec = {
        "id": f"vid{i:08d}", "channelId": owner, "snippet": {"title": f"t{i}", "description": "", "publishedAt": "2024-01-01T00:00:00Z", "thumbnails": {}, "categoryId": "26"},
        "contentDetails": {"duration": "PT5M"}, "statistics": {"viewCount": str(100 * i), "likeCount": "x"},
    }
    return json.dumps({**rec, **over})


def test_load_jobs(spark):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    short = {"contentDetails": {"duration": "PT10S"}}
    lines = [raw_item(1, UC), raw_item(2, UC, **short), raw_item(3, UC)]
    raw = spark.createDataFrame([(x,) for x in lines], "value string").select(F.from_json("value", S.RAW_ITEM).alias("r")).select("r.*")
    owners = spark.createDataFrame([(UC, 10)], "owner_id string, subscribers bigint")
    listed = spark.createDataFrame([(UC, 0, i, f"vid{i:08d}") for i in range(1, 5)], "owner_id string, page int, pos int, item_id string")
    res = J.full_load(listed, raw, owners, as_of)
    got = {r.item_id: r for r in res.items.collect()}
    assert set(got) == {"vid00000001", "vid00000003"} and got["vid00000003"].likes == 0 and got["vid00000003"].category_name == "Howto & Style"
    assert got["vid00000003"].calculated.viewsPerSubscriber == 30.0 and got["vid00000001"].tags == []
    assert [r.item_id for r in res.missing.collect()] == ["vid00000004"]
    again = J.incremental_load(listed, raw, res.items, owners, as_of, include_shorts=True)
    assert {r.item_id for r in again.loaded.collect()} == {"vid00000002"} and again.items.count() == 3
    newer = spark.createDataFrame([(raw_item(1, UC, statistics={"viewCount": "777"}),)], "value string").select(F.from_json("value", S.RAW_ITEM).alias("r")).select("r.*")
    fresh = {r.item_id: r for r in J.stats_refresh(res.items, newer, owners, as_of).collect()}
    assert fresh["vid00000001"].views == 777 and fresh["vid00000001"].title == "t1" and fresh["vid00000003"].views == 300
    resumed = J.full_load(listed, raw, owners, as_of, markers=spark.createDataFrame([(UC, "vid00000001")], "owner_id string, marker string"))
    assert {r.item_id for r in resumed.loaded.collect()} == {"vid00000003"}


def test_page_stop_misses_an_old_gap(spark):
    listed = spark.createDataFrame([("o", p, f"v{p}{i}") for p in range(3) for i in range(2)], "owner_id string, page int, item_id string")
    stored = spark.createDataFrame([("o", v) for v in ("v01", "v10", "v11")], "owner_id string, item_id string")
    assert {r.item_id for r in W.new_ids_until_known_page(listed, stored).collect()} == {"v00"}
    assert {r.item_id for r in W.new_ids(listed, stored, ["item_id"]).collect()} == {"v00", "v20", "v21"}


def test_percent_rank_without_metric_or_owner(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", None), (4, None, 5.0), (5, None, 6.0), (6, "b", None)], "id int, o string, v double")
    got = {r.id: r.percentile for r in O.performance_percentile(df, "o", "v").collect()}
    assert got == {1: 0.0, 2: 1.0, 3: None, 4: 0.0, 5: 1.0, 6: None}


def test_progress_sets_updates_add_and_start_resets(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(8)]
    log = [
        ("a", t[0], 0, "progress", 10), ("a", t[1], 1, "update", 5), ("a", t[2], 2, "progress", 40),
        ("b", t[0], 0, "progress", 7), ("b", t[1], 1, "failed", None), ("b", t[2], 2, "start", None), ("b", t[3], 3, "update", 2), ("b", t[4], 4, "update", 3), ("b", t[5], 5, "failed", None),
    ]
    rows = spark.createDataFrame(log, "owner_id string, ts timestamp, seq int, event string, n int")
    got = {r.owner_id: (r.status, r.items_processed, r.retry_count, r.update_new_items) for r in O.progress_fold(rows).collect()}
    assert got == {"a": ("in_progress", 40, 0, 5), "b": ("failed", 5, 1, 3)}


def test_null_clears_a_present_field(spark):
    old = spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "id int, subscribers int, name string")
    new = spark.createDataFrame([(1, None, None)], "id int, subscribers int, name string")
    got = {r.id: (r.subscribers, r.name) for r in K.upsert(old, new, ["id"], present=["subscribers"]).collect()}
    assert got == {1: (None, "x"), 2: (6, "y")}
    assert {r.id: r.subscribers for r in K.upsert(old, new, ["id"]).collect()} == {1: 5, 2: 6}


def test_duplicate_records_are_settled_alike_at_any_layout(spark):
    rows = [(1, 1, f"copy {k}") for k in range(20)]
    df = spark.createDataFrame(rows, "id int, v int, t string")
    assert len({K.newest_per_key(df.repartition(n), ["id"], ["v"]).first().t for n in (1, 2, 3, 7)}) == 1


def test_owners_without_a_handle_are_unmatched(spark):
    flags = spark.createDataFrame([("h1", True, "c", 1), ("h9", True, "c", 1)], "handle string, analyze_enabled boolean, category string, ord int")
    owners = spark.createDataFrame([("a", "@H1", None, None), ("b", None, None, None), ("c", "", True, "k")], "owner_id string, custom_url string, analyze_enabled boolean, category string")
    got = sorted((str(r.owner_id), r.status) for r in O.flag_sync(flags, owners).collect())
    assert got == [("None", "unmatched_flag"), ("a", "updated"), ("b", "unmatched_owner"), ("c", "unmatched_owner")]
