"""Versioned store, import job and stream merge: visibility, repeats, failures halfway."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from cohortlab import schemas as S
from cohortlab.functions.nested import bad_leaf
from cohortlab.plans import imports as I
from cohortlab.sources.versions import Store
from cohortlab.streaming import incremental as SI

AT = "TIMESTAMP_NTZ '2024-07-01 00:00:00'"
ITEM = "owner_id string, item_id string, title string, description string"


def files(root, table):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/data/{table}/**/*.parquet", recursive=True)}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}", i) for i in range(100)], "k long, name string, n int")
    store = Store.create(spark, str(tmp_path), {"t": (rows, ["k"])}, buckets=8)
    before = store.table("t")
    # an integer literal must find the bucket of the stored long
    new = spark.sql("SELECT 7 AS k, 'new' AS name, CAST(NULL AS INT) AS n, true AS extra")
    held = files(tmp_path, "t")
    change = store.upsert("t", new)
    assert len(change.parts) == 1 and files(tmp_path, "t").items() >= held.items()
    assert store.read("t").filter("k = 7").first().name == "v7"  # not visible yet
    assert store.commit("one", [change]) == 1
    after = store.table("t")
    assert {b for b in after.parts if after.parts[b] != before.parts[b]} == set(change.parts)
    got = {r.k: (r.name, r.n, r.extra) for r in store.read("t").collect()}
    assert len(got) == 100 and got[7] == ("new", 7, True) and got[8] == ("v8", 8, None)
    assert store.commit("one", [store.upsert("t", new.withColumn("name", F.lit("later")))]) == 1
    assert store.read("t").filter("k = 7").first().name == "new"


def test_present_columns_clear_and_empty_changes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x")], "k long, p string, q string")
    store = Store.create(spark, str(tmp_path), {"t": (rows, ["k"]), "e": (rows.limit(0), ["k"])})
    new = spark.createDataFrame([(1, None, None)], rows.schema)
    store.commit("clear", [store.upsert("t", new, ["p"]), store.upsert("e", rows.limit(0))])
    assert tuple(store.read("t").first()) == (1, None, "x") and store.read("e").count() == 0
    with pytest.raises(KeyError):
        store.read("unknown")


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k long, p string")
    store = Store.create(spark, str(tmp_path), {"t": (rows, ["k"])})
    head = store.head()
    store.commit("first", [])
    with pytest.raises(Exception, match="(?i)exist"):
        store._publish(head.version + 1, "second", [])


def line(owner, item, kind, text):
    return '{"key": "%s_%s_%s", "response": {"candidates": [{"content": {"parts": [{"text": %s}]}}]}}' % (owner, item, kind, text)


OWNER, KIND = "UC" + "0" * 22, "thumbnail"


def item(i):
    return f"{i:011d}"


def image(faces="1"):
    return '"{\\"humanPresence\\": {\\"faceCount\\": %s}}"' % faces


@pytest.fixture
def shop(spark, tmp_path):
    """A store with three jobs of one kind and a function that runs an import over given lines."""
    jobs = spark.createDataFrame(
        [("a", KIND, "JOB_STATE_SUCCEEDED", 1, None, "f1"), ("b", KIND, "JOB_STATE_SUCCEEDED", 2, None, "f2"), ("c", KIND, "JOB_STATE_RUNNING", 3, None, "f3")],
        "job_id string, kind string, state string, created_at int, imported_at timestamp_ntz, result_file string",
    )
    owners = spark.createDataFrame([(OWNER,)], "owner_id string")
    none = spark.createDataFrame([], "owner_id string, item_id string")
    store = Store.create(spark, str(tmp_path), {"jobs": (jobs, ["job_id"]), "owners": (owners, ["owner_id"]), "items": (spark.createDataFrame([], ITEM), I.KEYS), KIND: (none, I.KEYS)}, 4)

    def run(lines, **more):
        df = spark.createDataFrame([("f2", i, x) for i, x in enumerate(lines)] + [("f1", 0, line(OWNER, item(99), KIND, image()))], "file string, line_no int, line string")
        return I.run_import(store, KIND, df, S.struct_type(S.IMAGE_DOCUMENT), F.expr(AT), "m", "2.0", **more)

    return store, run


LINES = [line(OWNER, item(i), KIND, image()) for i in range(8)] + [
    "{broken", "  ", line(OWNER, item(3), KIND, image("7")), line(OWNER, item(20), KIND, image('\\"two\\"')), line("UC" + "9" * 22, item(21), KIND, image()),
]


def test_import_closes_the_newest_finished_job(spark, shop):
    store, run = shop
    out = run(LINES)
    assert (out.status, out.job_id, out.version) == ("imported", "b", 1)
    docs = {r.item_id: r for r in store.read(KIND).collect()}
    assert set(docs) == {item(i) for i in range(8)} and docs[item(3)].humanPresence.faceCount == 7  # the later line counts
    assert {(r.model_used, r.analysis_version, r.batch_mode) for r in docs.values()} == {("m", "2.0", True)}
    jobs = {r.job_id: r for r in store.read("jobs").collect()}
    s = jobs["b"].import_stats
    assert (s.total, s.imported, s.failed, s.parse_errors, s.aborted) == (12, 9, 2, 1, False)
    assert jobs["b"].imported_at is not None and jobs["a"].imported_at is None and jobs["b"].state == "JOB_STATE_SUCCEEDED"
    # the newest is done, an older one is not taken instead; named jobs are
    assert run(LINES).status == "no_job"
    assert run(LINES, job_id="b").status == "done_before" and run(LINES, job_id="c").status == "wrong_state" and run(LINES, job_id="x").status == "no_job"
    assert store.head().version == 1
    assert run(LINES, job_id="a").status == "imported" and store.read(KIND).count() == 9


def test_import_stops_at_the_failure_rate(spark, shop):
    store, run = shop
    bad = [line("UC" + "9" * 22, item(i), KIND, image()) for i in range(3)]
    out = run([line(OWNER, item(i), KIND, image()) for i in range(8)] + bad + [line(OWNER, item(50), KIND, image())])
    s = store.read("jobs").filter("job_id = 'b'").first().import_stats
    assert out.status == "imported" and (s.total, s.imported, s.failed, s.aborted) == (11, 8, 3, True)
    assert store.read(KIND).count() == 8


def test_a_failure_halfway_leaves_nothing_and_a_rerun_all(spark, shop, monkeypatch):
    store, run = shop
    calls = []
    whole = Store.upsert

    def failing(self, name, new, present=()):
        calls.append(name)
        if name == "jobs":
            raise RuntimeError("lost")
        return whole(self, name, new, present)

    monkeypatch.setattr(Store, "upsert", failing)
    with pytest.raises(RuntimeError, match="lost"):
        run(LINES)
    assert calls == [KIND, "jobs"] and store.read(KIND).count() == 0 and store.head().version == 0
    monkeypatch.setattr(Store, "upsert", whole)
    assert run(LINES).status == "imported" and store.read(KIND).count() == 8


def test_bad_leaf_names_the_value(spark):
    schema = S.struct_type("a STRUCT<n: INT, tags: ARRAY<STRING>, x: DOUBLE, in: STRUCT<ok: BOOLEAN>>, s STRING, list ARRAY<STRUCT<h: STRING>>")
    cases = [
        ('{"a": {"n": 1, "tags": ["x", null], "x": 1, "in": {"ok": true}}, "s": "t", "list": [{"h": "#"}]}', None), ('{}', None), ('{"a": null, "other": 3}', None),
        ('{"a": {"n": "1"}}', "a.n"), ('{"a": {"n": 1.5}}', "a.n"), ('{"a": {"tags": "x"}}', "a.tags"), ('{"a": {"tags": []}}', None), ('{"a": {"in": {"ok": "yes"}}}', "a.in.ok"),
        ('{"a": 5}', "a"), ('{"s": {"x": 1}}', "s"), ('{"list": ["#"]}', "list"), ('{"a": {"x": 0.25}}', None), ("{broken", None), (None, None),
    ]
    got = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(cases)], "i int, d string").select("i", bad_leaf("d", schema).alias("b")).collect()
    assert {r.i: r.b for r in got} == {i: want for i, (_, want) in enumerate(cases)}


def test_stream_batches_are_merged_once(spark, tmp_path):
    old = spark.createDataFrame([("o1", "i0", "kept", 5)], "owner_id string, item_id string, title string, at int")
    none = spark.createDataFrame([], "owner_id string, new_items long, updated_at timestamp")
    store = Store.create(spark, f"{tmp_path}/store", {"items": (old, ["owner_id", "item_id"]), "progress": (none, ["owner_id"])}, 4)
    schema = old.schema
    parts = [[("o1", "i0", "again", 9), ("o1", "i1", "first", 1), ("o1", "i1", "newer", 2)], [("o1", "i1", "late", 3), ("o1", "i2", "x", 1), ("o2", "i3", "y", 1)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")

    def drain(checkpoint):
        landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
        SI.merge_new_items(store, landed, lambda b: b, F.current_timestamp(), f"{tmp_path}/{checkpoint}", "run", order="at")

    drain("c1")
    items = {(r.owner_id, r.item_id): r.title for r in store.read("items").collect()}
    assert items[("o1", "i0")] == "kept" and items[("o1", "i1")] in ("newer", "late") and len(items) == 4
    told = {r.owner_id: r.new_items for r in store.read("progress").collect()}
    assert told == {"o1": 2, "o2": 1} and store.head().version == 2
    # a lost checkpoint replays the batches under their old names
    drain("c2")
    assert {r.owner_id: r.new_items for r in store.read("progress").collect()} == told and store.head().version == 2
