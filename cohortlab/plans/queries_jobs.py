"""Whole jobs over a versioned store: the import of finished batches, and the incremental load as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab import schemas as S
from cohortlab.functions import metrics as M
from cohortlab.operators import work as W
from cohortlab.operators.cohort import drop_shorts
from cohortlab.plans import bindings as D
from cohortlab.plans import imports as I
from cohortlab.plans.queries_load import IS_SHORT_SQL, LISTED_SQL, RAW_ITEM_SQL, available, flat_owners, listing
from cohortlab.plans.queries_work import ITEM, OWNER, STATE_SQL
from cohortlab.plans.registry import query
from cohortlab.scale import stage, stage_path
from cohortlab.sources import landed as R
from cohortlab.sources.versions import Store
from cohortlab.streaming import incremental as SI

KEYS = I.KEYS
MODEL, VERSION = "model-a", "2.0"
KINDS = ("title_description", "thumbnail")


# --- import of finished batches ---------------------------------------------------------

# orders are jobs of two kinds, each message gives a result line of each kind; files and failures follow from running numbers
IMPORT_SQL = f"""
jobs AS (
  SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'title_description' ELSE 'thumbnail' END AS kind, {STATE_SQL} AS state,
    o_orderdate AS created_at, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN o_orderdate END AS imported_at, o_orderkey % 3 AS slot
  FROM orders
),
newest AS (
  SELECT kind, job_id, slot, imported_at FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs WHERE state = 'JOB_STATE_SUCCEEDED') WHERE rn = 1
),
msgs AS (SELECT conv_id * 100 + turn AS n, conv_id, turn, role, text, {OWNER.format("conv_id % 50")} AS owner_id, {ITEM.format("conv_id * 100 + turn")} AS item_id FROM conversations),
lines AS (
  SELECT msgs.*, 'title_description' AS kind, CASE WHEN n % 9 = 0 THEN 'parse_error' WHEN conv_id % 5 = 0 AND n % 9 = 1 THEN 'bad_key'
    WHEN conv_id % 5 = 0 AND n % 9 = 2 THEN 'unknown_owner' WHEN conv_id % 5 = 0 AND n % 9 = 3 THEN 'empty_document' END AS reason FROM msgs
  UNION ALL
  SELECT msgs.*, 'thumbnail', CASE WHEN n % 9 = 0 THEN 'parse_error' WHEN n % 9 = 1 THEN 'bad_key' WHEN n % 18 = 5 THEN 'bad_leaf' END FROM msgs
),
mine AS (SELECT lines.*, j.job_id FROM lines JOIN newest j ON j.kind = lines.kind AND j.slot = conv_id % 3 WHERE j.imported_at IS NULL),
seen AS (
  SELECT *, count(*) OVER w AS k, count(*) FILTER (WHERE reason <> 'parse_error') OVER w AS bad FROM mine
  WINDOW w AS (PARTITION BY kind ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
stops AS (SELECT kind, min(n) AS stop FROM seen WHERE coalesce(reason, '') <> 'parse_error' AND k >= 10 AND bad / k > 0.2 GROUP BY ALL),
kept AS (SELECT seen.*, stop FROM seen LEFT JOIN stops USING (kind) WHERE stop IS NULL OR n <= stop),
stats AS (
  SELECT kind, min(job_id) AS job_id, count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS imported, count(*) FILTER (WHERE reason <> 'parse_error') AS failed,
    count(*) FILTER (WHERE reason = 'parse_error') AS parse_errors, bool_or(stop IS NOT NULL) AS aborted FROM kept GROUP BY ALL
),
stored AS (SELECT owner_id, item_id, 'title_description' AS kind FROM msgs WHERE n % 4 = 0),
docs AS (
  SELECT coalesce(k.kind, s.kind) AS kind, coalesce(k.owner_id, s.owner_id) AS owner_id, coalesce(k.item_id, s.item_id) AS item_id,
    coalesce(k.role, 'stored') AS pattern, CASE WHEN coalesce(k.kind, s.kind) = 'title_description' THEN coalesce(k.role, 'old') END AS niche, CASE WHEN s.kind IS NOT NULL THEN true END AS seasonal,
    CASE WHEN k.kind = 'thumbnail' THEN CAST(k.turn AS INTEGER) WHEN k.kind IS NOT NULL AND k.turn % 2 = 0 THEN CAST(length(k.text) AS INTEGER) END AS size,
    CASE WHEN k.kind IS NOT NULL THEN '{MODEL}/{VERSION}' END AS model
  FROM (SELECT * FROM kept WHERE reason IS NULL) k FULL JOIN stored s ON s.kind = k.kind AND s.owner_id = k.owner_id AND s.item_id = k.item_id
)"""


def import_jobs(spark, sf):
    o, k = D.table(spark, sf, "orders"), F.col("o_orderkey")
    kind = F.when(k % 2 == 0, KINDS[0]).otherwise(KINDS[1])
    state = F.expr(STATE_SQL.replace("CASE o_orderkey % 40 WHEN", "CASE CAST(o_orderkey % 40 AS INT) WHEN"))
    return o.select(
        k.alias("job_id"), kind.alias("kind"), state.alias("state"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), F.col("o_orderdate").cast("timestamp_ntz")).alias("imported_at"),
        F.concat(kind, F.lit("-"), (k % 3).cast("string")).alias("result_file"),
    )


def import_messages(spark, sf):
    msgs = D.table(spark, sf, "conversations").withColumn("n", F.col("conv_id") * 100 + F.col("turn"))
    return msgs.withColumns({"owner_id": D.owner_code(F.col("conv_id") % 50), "item_id": D.item_code(F.col("n"))})


def import_lines(spark, sf):
    """Landed result lines of all jobs: file, line number and text."""
    n = F.col("n")
    some = F.col("conv_id") % 5 == 0
    title = F.to_json(F.struct(F.struct(F.col("role").alias("pattern")).alias("structure"), F.struct(F.col("role").alias("niche")).alias("keywords")))
    faces = F.when(n % 18 == 5, F.lit('"two"')).otherwise(F.col("turn").cast("string"))
    image = F.concat(F.lit('{"humanPresence": {"facePresent": true, "faceCount": '), faces, F.lit('}, "scene": {"location": "'), F.col("role"), F.lit('"}}'))

    def lines(kind, document, bad_key, unknown):
        owner = F.when(unknown, D.owner_code(F.lit(999_999))).otherwise(F.col("owner_id"))
        key = F.concat(F.when(bad_key, F.lit("XX")).otherwise(F.lit("")), M.request_key(owner, F.col("item_id"), F.lit(kind)))
        part = F.struct(F.array(F.struct(F.struct(F.array(F.struct(document.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
        line = F.when(n % 9 == 0, F.concat(F.lit("{broken "), n.cast("string"))).otherwise(F.to_json(F.struct(key.alias("key"), part.alias("response"))))
        file = F.concat(F.lit(f"{kind}-"), (F.col("conv_id") % 3).cast("string"))
        return import_messages(spark, sf).select(file.alias("file"), n.alias("line_no"), line.alias("line"))

    titles = lines(KINDS[0], F.when(some & (n % 9 == 3), F.lit("{}")).otherwise(title), some & (n % 9 == 1), some & (n % 9 == 2))
    return titles.unionByName(lines(KINDS[1], image, n % 9 == 1, F.lit(False)))


def import_store(spark, sf):
    """A store of jobs, owners, item texts and the documents of both kinds."""
    msgs = import_messages(spark, sf)
    texts = msgs.filter("turn % 2 = 0").select("owner_id", "item_id", F.col("text").alias("title"), F.col("role").alias("description"))
    old = msgs.filter("n % 4 = 0").select(
        "owner_id", "item_id", F.struct(F.lit("stored").alias("pattern")).alias("structure"), F.struct(F.lit("old").alias("niche"), F.lit(True).alias("seasonal")).alias("keywords")
    )
    tables = {
        "jobs": (import_jobs(spark, sf), ["job_id"]), "owners": (msgs.select("owner_id").distinct(), ["owner_id"]), "items": (texts, I.KEYS),
        KINDS[0]: (old, I.KEYS), KINDS[1]: (old.select("owner_id", "item_id").limit(0), I.KEYS),
    }
    return Store.create(spark, stage_path(spark, "store"), tables, buckets=4)


def import_both(spark, sf, store):
    at = F.lit("2024-07-01 00:00:00").cast("timestamp_ntz")
    lines = import_lines(spark, sf)
    schemas = (S.struct_type(S.TITLE_DOCUMENT), S.struct_type(S.IMAGE_DOCUMENT))
    return [I.run_import(store, kind, lines, schema, at, MODEL, VERSION, with_texts=kind == KINDS[0]) for kind, schema in zip(KINDS, schemas, strict=True)]


@query(
    "import_job",
    f"""WITH {IMPORT_SQL} SELECT docs.kind, owner_id, item_id, pattern, niche, seasonal, size, model, job_id, total, imported, failed, parse_errors, aborted,
  CASE WHEN job_id IS NOT NULL THEN TIMESTAMP '2024-07-01' END AS imported_at FROM docs LEFT JOIN stats USING (kind)""",
)
def import_job(spark, sf):
    """The newest finished job of each kind, from its lines to its closed row."""
    store = import_store(spark, sf)
    done = import_both(spark, sf, store)
    again = import_both(spark, sf, store)
    if any(o.status == "imported" for o in again):
        raise RuntimeError("a job was imported twice")
    model = F.concat_ws("/", "model_used", "analysis_version")
    titles = store.read(KINDS[0]).select(
        F.lit(KINDS[0]).alias("kind"), *I.KEYS, F.col("structure.pattern").alias("pattern"), F.col("keywords.niche").alias("niche"), F.col("keywords.seasonal").alias("seasonal"),
        (F.col("structure.characterCount") if done[0].status == "imported" else F.lit(None)).cast("int").alias("size"),
        (F.nullif(model, F.lit("")) if done[0].status == "imported" else F.lit(None).cast("string")).alias("model"),
    )
    rows = titles
    if done[1].status == "imported":
        rows = titles.unionByName(
            store.read(KINDS[1]).select(
                F.lit(KINDS[1]).alias("kind"), *I.KEYS, F.col("scene.location").alias("pattern"), F.lit(None).cast("string").alias("niche"), F.lit(None).cast("boolean").alias("seasonal"),
                F.col("humanPresence.faceCount").cast("int").alias("size"), F.nullif(model, F.lit("")).alias("model"),
            )
        )
    jobs = store.read("jobs")
    if "import_stats" not in jobs.columns:
        empty = F.lit(None).cast("struct<total: bigint, imported: bigint, failed: bigint, parse_errors: bigint, aborted: boolean>")
        jobs = jobs.withColumn("import_stats", empty)
    closed = jobs.filter("import_stats IS NOT NULL").select(
        "kind", "job_id", *[f"import_stats.{c}" for c in ("total", "imported", "failed", "parse_errors", "aborted")], "imported_at"
    )
    return rows.join(F.broadcast(closed), "kind", "left")  # one row per kind


# --- incremental load as a stream -------------------------------------------------------


@query(
    "incremental_merge_stream",
    f"""WITH {LISTED_SQL},{RAW_ITEM_SQL},
paged AS (SELECT *, k // 5000 AS page, k % 3 = 0 AND NOT (c % 4 = 0 AND k // 5000 = 1) AS is_new FROM listed),
stops AS (SELECT owner_id, min(page) AS stop FROM (SELECT owner_id, page FROM paged GROUP BY ALL HAVING count(*) FILTER (WHERE is_new) = 0) GROUP BY ALL),
fresh AS (SELECT p.* FROM paged p LEFT JOIN stops USING (owner_id) WHERE is_new AND (stop IS NULL OR page < stop)),
loaded AS (SELECT f.owner_id, f.item_id, r.title, CAST(r.price AS BIGINT) AS views FROM fresh f JOIN raw_item r ON r.k = f.k AND r.k % 97 > 0 WHERE NOT {IS_SHORT_SQL}),
per AS (SELECT owner_id, count(*) AS owner_new FROM loaded GROUP BY ALL),
items AS (SELECT owner_id, item_id, title, views FROM loaded UNION ALL SELECT owner_id, item_id, 'stored', NULL FROM paged WHERE NOT is_new)
SELECT items.*, coalesce(owner_new, 0) AS owner_new FROM items LEFT JOIN per USING (owner_id)""",
)
def incremental_merge_stream(spark, sf):
    """Landed records merged into the stored items over several triggers, with the owners' progress."""
    listed = listing(spark, sf)
    known = ~((F.col("k") % 3 == 0) & ~((F.col("c") % 4 == 0) & (F.floor(F.col("k") / 5000) == 1)))
    old = listed.filter(known).select("owner_id", "item_id", F.lit("stored").alias("title"), F.lit(None).cast("long").alias("views"))
    wanted = stage(W.new_ids_until_known_page(listed.drop("c", "k"), old).select("owner_id", "item_id"), "wanted")
    none = spark.createDataFrame([], "owner_id string, new_items long, updated_at timestamp")
    store = Store.create(spark, stage_path(spark, "store"), {"items": (old, KEYS), "progress": (none, ["owner_id"])}, buckets=4)
    path = stage_path(spark, "landed")
    available(spark, sf).repartition(3).write.json(path)
    landed = spark.readStream.schema(S.RAW_ITEM).option("maxFilesPerTrigger", 1).json(path)
    owners = flat_owners(spark, sf)

    def to_rows(batch):
        mine = batch.join(wanted.select(F.col("item_id").alias("id")), "id", "left_semi")
        return drop_shorts(R.item_rows(mine, owners, D.as_of()), include_shorts=False).select("owner_id", "item_id", "title", "views", "published_at")

    SI.merge_new_items(store, landed, to_rows, D.as_of(), stage_path(spark, "landed-checkpoint"), "landed")
    told = store.read("progress").select("owner_id", F.col("new_items").alias("owner_new"))
    items = store.read("items").select("owner_id", "item_id", "title", "views")
    return items.join(told, "owner_id", "left").na.fill(0, ["owner_new"])
