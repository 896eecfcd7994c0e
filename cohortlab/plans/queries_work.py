"""Annotation work, imports, jobs, coverage and operating queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab import schemas as S
from cohortlab.functions import metrics as M
from cohortlab.operators import cohort as C
from cohortlab.operators import ops as O
from cohortlab.operators import work as W
from cohortlab.plans import bindings as D
from cohortlab.plans.registry import query
from cohortlab.scale import stage_path
from cohortlab.sources import landed as R
from cohortlab.sources import sinks as K

OWNER, ITEM = D.OWNER_ID_SQL, D.ITEM_ID_SQL



# --- assembly ---------------------------------------------------------------------

DOCS_SQL = """
docs AS (
  SELECT o_custkey AS owner_id, o_orderkey AS item_id, kind, doc FROM (
    SELECT *, 'title_description' AS kind, 'td' || o_orderstatus AS doc FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT *, 'title', 'old' || o_orderstatus FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT *, 'thumbnail', 'img' || o_orderpriority FROM orders WHERE o_orderkey % 5 > 0
  )
),
assembled AS (
  SELECT o_custkey AS owner_id, o_orderkey AS item_id, coalesce(td.doc, ti.doc) AS title_analysis, im.doc AS image_analysis, c_name AS owner_name
  FROM orders JOIN customer ON c_custkey = o_custkey
  LEFT JOIN docs td ON td.item_id = o_orderkey AND td.kind = 'title_description' LEFT JOIN docs ti ON ti.item_id = o_orderkey AND ti.kind = 'title'
  LEFT JOIN docs im ON im.item_id = o_orderkey AND im.kind = 'thumbnail'
  WHERE coalesce(td.doc, ti.doc) IS NOT NULL
)"""


def documents_of_orders(spark, sf):
    k = F.col("item_id")
    entry = F.array(
        F.when(k % 3 == 0, F.struct(F.lit("title_description").alias("kind"), F.concat(F.lit("td"), "status").alias("doc"))),
        F.when(k % 2 == 0, F.struct(F.lit("title").alias("kind"), F.concat(F.lit("old"), "status").alias("doc"))),
        F.when(k % 5 > 0, F.struct(F.lit("thumbnail").alias("kind"), F.concat(F.lit("img"), "content_type").alias("doc"))),
    )
    return D.bare_items(spark, sf).select("owner_id", "item_id", F.explode(F.array_compact(entry)).alias("e")).select("owner_id", "item_id", "e.*")


def assembled(spark, sf):
    items, owners = D.bare_items(spark, sf).select("owner_id", "item_id"), D.owners(spark, sf).select("owner_id", "owner_name")
    return C.assemble(owners, items, documents_of_orders(spark, sf)), owners, items


@query("video_analysis_assembly", f"WITH {DOCS_SQL} SELECT * FROM assembled")
def video_analysis_assembly(spark, sf):
    """Items with owner and documents; a legacy title document is the fallback."""
    return assembled(spark, sf)[0]


@query(
    "assembly_counts",
    f"WITH {DOCS_SQL} SELECT (SELECT count(*) FROM assembled) AS assembled, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS owners_without_items, (SELECT count(*) FROM orders) - (SELECT count(*) FROM assembled) AS items_without_analysis",
)
def assembly_counts(spark, sf):
    """What the assembly left out."""
    rows, owners, items = assembled(spark, sf)
    return C.assembly_counts(owners, items, rows)


# --- pending work -------------------------------------------------------------------


def doc_items(spark, sf):
    """Documents as items: source is the owner, one in ten is short."""
    d = D.texts(spark, sf)
    return d.select(
        F.col("source").alias("owner_id"), F.col("doc_id").alias("item_id"), "lang", "title", "description",
        F.when(F.col("doc_id") % 10 == 0, True).alias("is_short"), (F.col("doc_id") % 4 > 0).alias("has_title"),
    ).withColumn("title", F.when(F.col("has_title"), F.col("title")).otherwise(F.lit("  ")))


def label_docs(spark, sf):
    lab = D.table(spark, sf, "labels")
    entry = F.array_compact(F.array(F.lit("title_description"), F.when(F.col("quality") == 1, F.lit("thumbnail"))))
    return lab.select(F.col("doc_id").alias("item_id"), F.explode(entry).alias("kind"))


@query("unanalyzed_items", "SELECT source AS owner_id, doc_id AS item_id FROM documents WHERE doc_id % 10 > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def unanalyzed_items(spark, sf):
    """Non-short items without a document of the kind."""
    return W.unanalyzed(doc_items(spark, sf), label_docs(spark, sf), "title_description", ["item_id"]).select("owner_id", "item_id")


@query("new_items", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_items(spark, sf):
    """The full difference."""
    return W.new_ids(D.table(spark, sf, "documents").select("doc_id"), D.table(spark, sf, "labels"), ["doc_id"])


@query(
    "new_items_until_known_page",
    """WITH p AS (SELECT o_custkey AS owner_id, o_orderkey // 2000 AS page, o_orderkey AS item_id, o_orderpriority LIKE '1%' AS is_new FROM orders),
stops AS (SELECT owner_id, min(page) AS stop FROM (SELECT owner_id, page FROM p GROUP BY ALL HAVING count(*) FILTER (WHERE is_new) = 0) GROUP BY ALL)
SELECT owner_id, page, item_id FROM p LEFT JOIN stops USING (owner_id) WHERE is_new AND (stop IS NULL OR page < stop)""",
)
def new_items_until_known_page(spark, sf):
    """New ids before the first page on which all are known."""
    o = D.bare_items(spark, sf).withColumn("page", F.floor(F.col("item_id") / 2000))
    known = o.filter(~F.col("content_type").like("1%")).select("owner_id", "item_id")
    return W.new_ids_until_known_page(o.select("owner_id", "page", "item_id"), known)


@query(
    "missing_items",
    "SELECT o_orderkey // 50 AS batch, count(*) AS n_requested, count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n_missing FROM orders GROUP BY ALL",
)
def missing_items(spark, sf):
    """Orders without lines per batch of 50."""
    o = D.bare_items(spark, sf).select("item_id", F.floor(F.col("item_id") / 50).alias("batch"))
    return W.missing_from_source(o, D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id")), "item_id", "batch")


@query(
    "known_owner_validation",
    "SELECT k IN (SELECT c_custkey FROM customer) AS is_known, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 6 = 0 THEN -o_custkey ELSE o_custkey END AS k FROM orders) GROUP BY ALL",
)
def known_owner_validation(spark, sf):
    """Rows with an unknown owner are told apart."""
    o = D.bare_items(spark, sf).withColumn("owner_id", F.when(F.col("item_id") % 6 == 0, -F.col("owner_id")).otherwise(F.col("owner_id")))
    return W.split_known(o, D.owners(spark, sf), "owner_id").groupBy("is_known").agg(F.count(F.lit(1)).alias("n"))


REQUEST_SQL = """
items AS (
  SELECT source AS owner_id, doc_id AS item_id, doc_id % 4 > 0 AS has_title, CASE WHEN doc_id % 4 > 0 THEN title ELSE '  ' END AS title, description, doc_id % 10 = 0 AS short,
    doc_id IN (SELECT doc_id FROM labels) AS analyzed
  FROM texts
),
requests AS (
  SELECT *, source_key || '_' || item_id || '_title_description' AS key, regexp_matches(title, '[^\\s\\p{Z}]') AS ready,
    'TITLE:' || chr(10) || title || chr(10) || chr(10) || 'DESCRIPTION:' || chr(10) || CASE WHEN regexp_matches(description, '[^\\s\\p{Z}]') THEN description ELSE '(no description provided)' END AS body
  FROM (SELECT *, owner_id AS source_key FROM items) WHERE NOT short AND NOT analyzed
)"""
R_SQL = "WITH " + D.TEXTS_SQL + "," + REQUEST_SQL


def pending_requests(spark, sf):
    pending = W.unanalyzed(doc_items(spark, sf), label_docs(spark, sf), "title_description", ["item_id"])
    return W.request_rows(pending, "title_description")


@query("request_rows", f"{R_SQL} SELECT owner_id, item_id, key, CASE WHEN ready THEN length(body) END AS n_chars, CASE WHEN NOT ready THEN 'missing_data' END AS reject FROM requests")
def request_rows(spark, sf):
    """Key and request per pending item, or why there is none."""
    text = F.get_json_object("request", "$.request.text")
    return pending_requests(spark, sf).select("owner_id", "item_id", "key", F.length(text).cast("long").alias("n_chars"), "reject")


@query("request_jsonl_sink", f"{R_SQL} SELECT key, length(body) AS n_chars FROM requests WHERE ready ORDER BY owner_id, item_id LIMIT 300")
def request_jsonl_sink(spark, sf):
    """The first 300 requests written as JSON lines and read back."""
    path = stage_path(spark, "requests")
    rows = W.capped_requests(pending_requests(spark, sf), 300)
    line = F.to_json(F.struct("key", F.get_json_object("request", "$.request").alias("request")))
    K.write_json_lines(rows.select(line.alias("line")), path, "line")
    lines = spark.read.text(path)
    text = F.get_json_object(F.get_json_object("value", "$.request"), "$.text")
    return lines.select(F.get_json_object("value", "$.key").alias("key"), F.length(text).cast("long").alias("n_chars"))


@query("latest_prepared_file", f"{R_SQL} SELECT 'batch_title_description_20240102_000000' AS file, count(*) AS n_requests FROM requests WHERE ready")
def latest_prepared_file(spark, sf):
    """Newest prepared folder by name and its number of requests."""
    root = stage_path(spark, "prepared")
    rows = pending_requests(spark, sf).filter(F.col("reject").isNull())
    for day, part in (("20240101", rows.filter("item_id % 2 = 0")), ("20240102", rows)):
        K.write_json_lines(part.select(F.col("request").alias("line")), f"{root}/batch_title_description_{day}_000000", "line")
    return R.latest_prepared(spark, f"{root}/*")


@query(
    "prepare_stats",
    f"""WITH {D.TEXTS_SQL}, w AS (
  SELECT source AS owner_id, doc_id AS item_id, doc_id IN (SELECT doc_id FROM labels) AS analyzed, doc_id % 4 = 0 AS bad FROM texts
),
seq AS (SELECT *, sum(CASE WHEN NOT analyzed AND NOT bad THEN 1 ELSE 0 END) OVER (ORDER BY owner_id, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM w),
per AS (SELECT owner_id, count(*) FILTER (WHERE NOT analyzed AND NOT bad) AS ready, count(*) FILTER (WHERE analyzed) AS done, max(upto) AS upto FROM seq GROUP BY ALL),
own AS (SELECT *, upto - ready AS before, upto - ready < 200 AS scanned, greatest(0, least(ready, 200 - (upto - ready))) AS written FROM per)
SELECT CAST(sum(written) AS BIGINT) AS requests, CAST(coalesce(sum(done) FILTER (WHERE scanned), 0) AS BIGINT) AS already_analyzed, count(*) FILTER (WHERE scanned) AS owners_scanned,
  count(*) FILTER (WHERE written > 0) AS owners_with_work, count(*) FILTER (WHERE NOT scanned) AS owners_skipped,
  (SELECT count(*) FROM seq WHERE NOT analyzed AND bad AND upto < 200 AND owner_id IN (SELECT owner_id FROM own WHERE scanned)) AS missing_data
FROM own""",
)
def prepare_stats(spark, sf):
    """Counters of a preparation that stops at 200 requests."""
    done = label_docs(spark, sf).filter("kind = 'title_description'").select("item_id").withColumn("hit", F.lit(True))
    work = doc_items(spark, sf).join(done, "item_id", "left").select(
        "owner_id", "item_id", F.col("hit").isNotNull().alias("analyzed"), F.when(F.col("item_id") % 4 == 0, "missing_data").alias("reject")
    )
    return W.prepare_stats(work, 200)


# --- results ----------------------------------------------------------------------------

# one result line per message; the shape depends on a running number
RESULT_SQL = f"""
msgs AS (SELECT conv_id * 100 + turn AS n, conv_id, turn, role, text FROM conversations),
results AS (
  SELECT n, conv_id % 50 AS o, role, text, CASE n % 9 WHEN 0 THEN 'parse_error' WHEN 1 THEN 'bad_key' WHEN 2 THEN 'unknown_owner' WHEN 3 THEN 'empty_document' END AS reason,
    {OWNER.format("conv_id % 50")} AS owner_id, {ITEM.format("n")} AS item_id
  FROM msgs
)"""


def result_lines(spark, sf):
    n, k = F.col("n"), F.col("n") % 9
    msgs = D.table(spark, sf, "conversations").withColumn("n", F.col("conv_id") * 100 + F.col("turn"))
    owner = F.when(k == 2, D.owner_code(F.lit(999_999))).otherwise(D.owner_code(F.col("conv_id") % 50))
    key = F.concat(F.when(k == 1, F.lit("XX")).otherwise(F.lit("")), M.request_key(owner, D.item_code(n), F.lit("title_description")))
    doc = F.to_json(F.struct(F.struct(F.col("role").alias("pattern")).alias("structure"), F.struct(F.col("role").alias("niche")).alias("keywords")))
    text = F.when(k == 4, F.concat(F.lit("```json\n"), doc, F.lit("\n```"))).when(k == 3, F.lit("{}")).otherwise(doc)
    part = F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    line = F.when(k == 0, F.concat(F.lit("{broken "), n.cast("string"))).otherwise(F.to_json(F.struct(key.alias("key"), part.alias("response"))))
    return msgs.select("n", line.alias("line"))


def known_owners(spark, sf):
    return D.table(spark, sf, "conversations").select(D.owner_code(F.col("conv_id") % 50).alias("owner_id")).distinct()


def source_texts(spark, sf):
    """Texts of the even messages."""
    msgs = D.table(spark, sf, "conversations").filter("turn % 2 = 0")
    return msgs.select(
        D.owner_code(F.col("conv_id") % 50).alias("owner_id"), D.item_code(F.col("conv_id") * 100 + F.col("turn")).alias("item_id"),
        F.col("text").alias("title"), F.col("text").alias("description"),
    )


@query("result_jsonl_scan", f"WITH {RESULT_SQL} SELECT count(*) AS n_lines, count(*) FILTER (WHERE reason = 'parse_error') AS parse_errors, count(*) FILTER (WHERE reason IS NULL) AS with_document FROM results WHERE coalesce(reason, '') NOT IN ('never')")
def result_jsonl_scan(spark, sf):
    """Lines written as files and read in file order; blank lines are skipped."""
    path = stage_path(spark, "results")
    lines = result_lines(spark, sf)
    K.write_json_lines(lines.select("line").unionByName(lines.select(F.lit("   ").alias("line"))), path, "line")
    parsed = W.parse_results(R.read_result_lines(spark, path), "title_description")
    known = known_owners(spark, sf)
    good = W.import_results(parsed, known)
    return good.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~F.col("readable")).alias("parse_errors"), F.count_if(F.col("status") == "imported").alias("with_document"))


@query(
    "import_results",
    f"""WITH {RESULT_SQL} SELECT n, CASE WHEN reason IS NULL THEN 'imported' WHEN reason = 'parse_error' THEN 'parse_error' ELSE 'failed' END AS status, reason,
  reason IS NULL AND n % 100 % 2 = 0 AS features_merged, CASE WHEN reason IS NULL THEN role END AS pattern, CASE WHEN reason IS NULL AND n % 100 % 2 = 0 THEN CAST(length(text) AS INTEGER) END AS characters,
  CASE WHEN reason IS NULL AND n % 100 % 2 = 0 THEN CAST(length(text) AS INTEGER) END AS description_length
FROM results""",
)
def import_results(spark, sf):
    """Validated documents with text features merged in."""
    parsed = W.parse_results(result_lines(spark, sf), "title_description")
    rows = W.import_results(parsed, known_owners(spark, sf), source_texts(spark, sf), S.struct_type(S.TITLE_DOCUMENT))
    return rows.select(
        "n", "status", "reason", "features_merged", F.col("analysis.structure.pattern").alias("pattern"),
        F.col("analysis.structure.characterCount").alias("characters"), F.col("analysis.descriptionAnalysis.structure.length").alias("description_length"),
    )


@query(
    "import_stats",
    f"""WITH {RESULT_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS imported, count(*) FILTER (WHERE reason <> 'parse_error') AS failed,
  count(*) FILTER (WHERE reason = 'parse_error') AS parse_errors, count(*) FILTER (WHERE reason IS NULL AND n % 100 % 2 = 0) AS features_merged FROM results""",
)
def import_stats(spark, sf):
    """G34, N4."""
    parsed = W.parse_results(result_lines(spark, sf), "title_description")
    return W.import_stats(W.import_results(parsed, known_owners(spark, sf), source_texts(spark, sf)))


@query(
    "running_failure_abort",
    """WITH l AS (SELECT event_type AS file, event_id AS line_no, CASE WHEN event_id % 50 = 0 THEN 'parse_error' WHEN (event_type = 'error' AND event_id % 4 = 0) OR event_id % 9 = 1 THEN 'failed' ELSE 'imported' END AS status FROM events),
r AS (SELECT *, count(*) OVER w AS seen, count(*) FILTER (WHERE status = 'failed') OVER w AS bad FROM l WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT file, min(line_no) AS stop FROM r WHERE status <> 'parse_error' AND seen >= 10 AND bad / seen > 0.2 GROUP BY ALL)
SELECT file, count(*) AS n_kept, max(line_no) AS last_line, count(*) FILTER (WHERE status = 'failed') AS n_failed, bool_or(stop IS NOT NULL) AS aborted
FROM l LEFT JOIN s USING (file) WHERE stop IS NULL OR line_no <= stop GROUP BY ALL""",
)
def running_failure_abort(spark, sf):
    """An import stops at the first line over the failure rate."""
    status = F.when(F.col("event_id") % 50 == 0, "parse_error").when(
        ((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0)) | (F.col("event_id") % 9 == 1), "failed"
    ).otherwise("imported")
    lines = D.events(spark, sf).select(
        F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), F.floor(F.col("event_id") / 500).alias("block"), status.alias("status")
    )
    return W.failure_cutoff(lines, "file", "line_no", "block").groupBy("file").agg(
        F.count(F.lit(1)).alias("n_kept"), F.max("line_no").alias("last_line"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.bool_or("aborted").alias("aborted")
    )


# --- jobs ---------------------------------------------------------------------------------

STATE_SQL = """CASE WHEN o_orderstatus = 'F' THEN 'JOB_STATE_SUCCEEDED' WHEN o_orderstatus = 'P' THEN 'JOB_STATE_PAUSED' ELSE
  CASE o_orderkey % 40 WHEN 0 THEN 'JOB_STATE_RUNNING' WHEN 1 THEN 'JOB_STATE_PENDING' WHEN 2 THEN 'JOB_STATE_QUEUED' ELSE 'JOB_STATE_FAILED' END END"""
JOBS_SQL = f"""
jobs AS (
  SELECT o_orderkey AS job_id, 'k' || (o_custkey % 300) AS kind, {STATE_SQL} AS state, o_orderdate AS created_at,
    CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS imported_at, 'batches/' || repeat('x', CAST(o_orderkey % 40 AS BIGINT)) || o_orderkey AS job_name
  FROM orders
)"""


def jobs(spark, sf):
    o = D.table(spark, sf, "orders")
    state = F.expr(STATE_SQL.replace("CASE o_orderkey % 40 WHEN", "CASE CAST(o_orderkey % 40 AS INT) WHEN"))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("job_id"), F.concat(F.lit("k"), (F.col("o_custkey") % 300).cast("string")).alias("kind"), state.alias("state"),
        F.col("o_orderdate").alias("created_at"), F.when(k % 3 > 0, F.col("o_orderdate")).alias("imported_at"),
        F.concat(F.lit("batches/"), F.expr("repeat('x', CAST(o_orderkey % 40 AS INT))"), k.cast("string")).alias("job_name"),
    )


FIRST_SQL = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {order}created_at DESC, job_id DESC) AS rn FROM jobs {where}) WHERE rn = 1"


@query("latest_job", f"WITH {JOBS_SQL} {FIRST_SQL.format(cols='kind, job_id, state', order='', where='')}")
def latest_job(spark, sf):
    """Newest job per kind."""
    return W.latest_job(jobs(spark, sf)).select("kind", "job_id", "state")


@query("importable_job", f"""WITH {JOBS_SQL} {FIRST_SQL.format(cols='kind, job_id', order='', where="WHERE state = 'JOB_STATE_SUCCEEDED'")} AND imported_at IS NULL""")
def importable_job(spark, sf):
    """Newest succeeded job if not imported yet."""
    return W.importable_job(jobs(spark, sf)).select("kind", "job_id")


RANK_SQL = "CASE state WHEN 'JOB_STATE_RUNNING' THEN 0 WHEN 'JOB_STATE_PENDING' THEN 1 WHEN 'JOB_STATE_QUEUED' THEN 2 ELSE 3 END, "


@query("active_job", f"WITH {JOBS_SQL} {FIRST_SQL.format(cols='kind, job_id, state', order=RANK_SQL, where='')} AND state NOT IN ('JOB_STATE_SUCCEEDED', 'JOB_STATE_FAILED', 'JOB_STATE_CANCELLED')")
def active_job(spark, sf):
    """By state priority, newest first."""
    return W.active_job(jobs(spark, sf)).select("kind", "job_id", "state")


@query("recent_jobs", f"WITH {JOBS_SQL} SELECT job_id, CASE WHEN length(job_name) > 33 THEN '...' || right(job_name, 30) ELSE job_name END AS label, kind, state, imported_at IS NOT NULL AS imported FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 20")
def recent_jobs(spark, sf):
    """The last twenty jobs."""
    return W.recent_jobs(jobs(spark, sf))


POLL_SQL = "CASE event_type WHEN 'view' THEN 'JOB_STATE_RUNNING' WHEN 'click' THEN 'JOB_STATE_PENDING' WHEN 'purchase' THEN 'JOB_STATE_SUCCEEDED' WHEN 'error' THEN 'JOB_STATE_FAILED' ELSE 'JOB_STATE_CANCELLED' END"


@query(
    "job_state",
    f"SELECT user_id AS job_id, arg_max({POLL_SQL}, event_id) AS state, max(ts) AS observed_at, count(*) AS n_polls, arg_max({POLL_SQL}, event_id) IN ('JOB_STATE_SUCCEEDED', 'JOB_STATE_FAILED', 'JOB_STATE_CANCELLED') AS is_terminal FROM events GROUP BY ALL",
)
def job_state(spark, sf):
    """I8: current state per job from its poll log."""
    log = D.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.expr(POLL_SQL).alias("state"), F.col("ts").alias("observed_at"), F.col("event_id").alias("seq"))
    return W.job_state(log)


@query("finish_import", f"WITH {JOBS_SQL}, {RESULT_SQL} SELECT job_id, coalesce(CASE WHEN job_id = 7 THEN TIMESTAMP '2024-07-01' END, imported_at) AS imported_at, CASE WHEN job_id = 7 THEN (SELECT count(*) FILTER (WHERE reason IS NULL) FROM results) END AS imported FROM jobs")
def finish_import(spark, sf):
    """The imported job gets its time and statistics."""
    parsed = W.parse_results(result_lines(spark, sf), "title_description")
    stats = W.import_stats(W.import_results(parsed, known_owners(spark, sf)))
    done = W.finish_import(jobs(spark, sf), 7, stats, F.lit("2024-07-01 00:00:00").cast("timestamp_ntz"))
    return done.select("job_id", "imported_at", F.col("import_stats.imported").alias("imported"))


# --- coverage and progress -------------------------------------------------------------------


@query(
    "coverage_rollup",
    """WITH d AS (SELECT lang AS category, source AS owner_id, doc_id IN (SELECT doc_id FROM labels) AS td, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS th FROM documents WHERE doc_id % 10 > 0)
SELECT category, owner_id, CAST(grouping_id(category, owner_id) AS INTEGER) AS level, count(*) AS total, count(*) FILTER (WHERE th) AS thumbnail_done, count(*) FILTER (WHERE NOT th) AS thumbnail_left,
  count(*) FILTER (WHERE td) AS title_description_done, count(*) FILTER (WHERE NOT td) AS title_description_left FROM d GROUP BY ROLLUP (category, owner_id)""",
)
def coverage_rollup(spark, sf):
    """Done and left per owner, category and in total."""
    items = doc_items(spark, sf).withColumnRenamed("lang", "category").select("category", "owner_id", "item_id", "is_short")
    return W.coverage(items, label_docs(spark, sf), ["thumbnail", "title_description"])


@query(
    "analysis_progress",
    """SELECT event_type AS kind, count(*) AS total, count(*) FILTER (WHERE user_id % 4 < 3) AS processed, count(*) FILTER (WHERE user_id % 4 = 0) AS successful, count(*) FILTER (WHERE user_id % 4 = 1) AS failed,
  count(*) FILTER (WHERE user_id % 4 = 2) AS skipped, round(count(*) FILTER (WHERE user_id % 4 < 3) / count(*) * 100, 2) AS progress, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS elapsed_seconds
FROM events GROUP BY ALL""",
)
def analysis_progress(spark, sf):
    """G38."""
    u = F.col("user_id") % 4
    outcome = F.when(u == 0, "success").when(u == 1, "failed").when(u == 2, "skipped").otherwise("pending")
    return W.analysis_progress(D.events(spark, sf).select(F.col("event_type").alias("kind"), outcome.alias("outcome"), "ts"))


# owner event log: one row per event, its type decides what happened
LOG_SQL = "CASE WHEN event_id % 11 = 0 THEN 'start' ELSE CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'refresh' END END"


def owner_log(spark, sf):
    return D.table(spark, sf, "events").select(
        F.col("user_id").alias("owner_id"), "ts", F.col("event_id").alias("seq"), F.expr(LOG_SQL).alias("event"), F.floor("value").alias("n")
    )


PROGRESS_SQL = f"""
log AS (SELECT user_id AS owner_id, ts, event_id AS seq, {LOG_SQL} AS event, CAST(floor(value) AS BIGINT) AS n FROM events),
runs AS (SELECT *, count(*) FILTER (WHERE event = 'start') OVER w AS run, count(*) FILTER (WHERE event IN ('start', 'progress')) OVER w AS level FROM log
  WINDOW w AS (PARTITION BY owner_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT *, max(run) OVER (PARTITION BY owner_id) AS last_run, max(level) OVER (PARTITION BY owner_id) AS last_level FROM runs),
progress AS (
  SELECT owner_id, CASE arg_max(event, (ts, seq)) FILTER (WHERE event IN ('start', 'progress', 'completed', 'failed')) WHEN 'start' THEN 'pending' WHEN 'progress' THEN 'in_progress' WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'failed' END AS status,
    CAST(coalesce(sum(n) FILTER (WHERE level = last_level AND event IN ('progress', 'update')), 0) AS BIGINT) AS items_processed,
    count(*) FILTER (WHERE event = 'failed' AND run = last_run) AS retry_count, CAST(coalesce(arg_max(n, (ts, seq)) FILTER (WHERE event = 'update'), 0) AS BIGINT) AS update_new_items,
    count(*) FILTER (WHERE event = 'refresh') AS refreshes, min(ts) AS started_at, max(ts) AS last_processed_at
  FROM ends GROUP BY owner_id
)"""


@query("progress_fold", f"WITH {PROGRESS_SQL} SELECT * FROM progress")
def progress_fold(spark, sf):
    """I4: progress per owner folded from its event log."""
    return O.progress_fold(owner_log(spark, sf))


@query(
    "progress_summary",
    f"WITH {PROGRESS_SQL} SELECT count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'in_progress') AS in_progress, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(items_processed) AS BIGINT) AS total_items FROM progress",
)
def progress_summary(spark, sf):
    """G35."""
    return O.progress_summary(O.progress_fold(owner_log(spark, sf)))


@query(
    "owners_to_process",
    f"""WITH {PROGRESS_SQL} SELECT c_custkey AS owner_id, CASE WHEN status IS NULL THEN 'start' WHEN status = 'completed' THEN 'completed' WHEN status IN ('in_progress', 'pending') THEN 'resume' WHEN status = 'failed' AND retry_count < 3 THEN 'resume' END AS action
FROM customer LEFT JOIN progress ON owner_id = c_custkey""",
)
def owners_to_process(spark, sf):
    """W10."""
    wanted = D.owners(spark, sf).select("owner_id")
    return O.owners_to_process(wanted, O.progress_fold(owner_log(spark, sf))).select("owner_id", "action")


@query(
    "unresolved_fold",
    "SELECT 'u' || user_id AS id, count(*) AS retry_count, min(ts) AS first_seen_at, max(ts) AS last_attempt_at, arg_max(event_type, event_id) AS error_message, arg_max(props, event_id) AS source_url FROM events GROUP BY ALL",
)
def unresolved_fold(spark, sf):
    """I5."""
    log = D.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("error"), F.col("props").alias("source_url")
    )
    return O.unresolved_fold(log)


@query(
    "unresolved_split",
    f"""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'c_' || o_custkey ELSE {OWNER.format("o_orderkey")} END AS id, o_orderkey % 3 > 0 AS is_valid,
  CASE WHEN o_orderkey % 2 = 0 THEN 'url' || o_orderkey WHEN o_orderkey % 5 > 0 THEN o_orderpriority ELSE '' END AS source_url,
  CASE WHEN o_orderkey % 4 = 0 THEN 'boom' ELSE 'no error was recorded' END AS error_message, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 ELSE 0 END AS retry_count,
  o_orderdate AS first_seen_at, o_orderdate AS last_attempt_at FROM orders""",
)
def unresolved_split(spark, sf):
    """Rows whose id is not an owner id, with field defaults."""
    k = F.col("o_orderkey")
    rows = D.table(spark, sf, "orders").select(
        F.when(k % 3 == 0, F.concat(F.lit("c_"), F.col("o_custkey").cast("string"))).otherwise(D.owner_code(k)).alias("id"),
        F.when(k % 2 == 0, F.concat(F.lit("url"), k.cast("string"))).otherwise("").alias("source_url"), F.when(k % 5 > 0, F.col("o_orderpriority")).alias("title"),
        F.when(k % 4 == 0, "boom").alias("error_message"), F.when(k % 7 > 0, k % 7).alias("retry_count"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("last_processed_at"),
    )
    return O.unresolved_split(rows)


@query(
    "session_report",
    "SELECT count(*) FILTER (WHERE c_acctbal > 0) AS owners_processed, count(*) FILTER (WHERE c_acctbal <= 0) AS owners_failed, count(*) AS owners_total, CAST(sum(c_nationkey) FILTER (WHERE c_acctbal > 0) AS BIGINT) AS items, CAST(sum(c_nationkey * 2) FILTER (WHERE c_acctbal > 0) AS BIGINT) AS images, max(c_custkey) AS quota_used FROM customer",
)
def session_report(spark, sf):
    """I6."""
    c = D.table(spark, sf, "customer")
    return O.session_report(c.select((F.col("c_acctbal") > 0).alias("success"), F.col("c_nationkey").alias("n_items"), (F.col("c_nationkey") * 2).alias("n_images"), F.col("c_custkey").alias("quota_used")))


@query("quota_used_today", "SELECT coalesce(max(user_id) FILTER (WHERE strftime(timezone('America/Los_Angeles', timezone('UTC', ts)), '%Y-%m-%d') = '2024-01-10'), 0) AS quota_used FROM events")
def quota_used_today(spark, sf):
    """Highest use recorded on one Pacific day."""
    rows = D.events(spark, sf).select(M.local_date(F.col("ts")).alias("quota_date"), F.col("user_id").alias("quota_used"))
    return O.quota_used_on(rows, F.lit("2024-01-10"))


@query(
    "quota_ledger",
    """WITH l AS (SELECT event_id, CAST(user_id % 5 AS BIGINT) AS cost, strftime(timezone('America/Los_Angeles', timezone('UTC', ts)), '%Y-%m-%d') AS day FROM events),
r AS (SELECT event_id, CAST(sum(cost) OVER (PARTITION BY day ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM l)
SELECT event_id, used, greatest(0, 10000 - used) AS remaining, 10000 - used <= 500 AS is_low FROM r""",
)
def quota_ledger(spark, sf):
    """Running use in call order, from 0 on each Pacific day."""
    calls = D.events(spark, sf).select("event_id", (F.col("user_id") % 5).alias("cost"), M.local_date(F.col("ts")).alias("day"))
    return O.quota_ledger(calls, ["event_id"], keys=["day"]).select("event_id", "used", "remaining", "is_low")


# --- flags, images, order, owner statistics ------------------------------------------------------


@query(
    "flag_sync",
    """WITH f AS (SELECT 'h' || (c_custkey * 2) AS handle, c_custkey % 2 = 0 AS new_enabled, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS new_category FROM customer),
o AS (SELECT c_custkey AS owner_id, CASE WHEN c_custkey % 7 > 0 THEN 'h' || c_custkey ELSE '' END AS handle, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 4 = 0 END AS old_enabled, 'BUILDING' AS old_category FROM customer)
SELECT coalesce(f.handle, o.handle) AS handle, owner_id, CASE WHEN owner_id IS NULL THEN 'unmatched_flag' WHEN new_enabled IS NULL THEN 'unmatched_owner'
    WHEN old_enabled IS DISTINCT FROM new_enabled OR (new_category <> '' AND old_category IS DISTINCT FROM new_category) THEN 'updated' ELSE 'unchanged' END AS status,
  coalesce(new_enabled, old_enabled) AS analyze_enabled, CASE WHEN new_category <> '' AND old_category IS DISTINCT FROM new_category THEN new_category ELSE coalesce(old_category, new_category) END AS category
FROM f FULL JOIN o ON f.handle = o.handle""",
)
def flag_sync(spark, sf):
    """Sheet against stored owners by handle; the last sheet row wins."""
    k, c = F.col("c_custkey"), D.table(spark, sf, "customer")
    sheet = c.select(
        F.concat(F.lit("h"), (k * 2).cast("string")).alias("handle"), (k % 2 == 0).alias("analyze_enabled"),
        F.when(k % 3 > 0, F.col("c_mktsegment")).otherwise("").alias("category"), F.lit(2).alias("ord"),
    )
    older = sheet.select("handle", (~F.col("analyze_enabled")).alias("analyze_enabled"), F.lit("OLD").alias("category"), F.lit(1).alias("ord"))
    owners = c.select(
        k.alias("owner_id"), F.when(k % 7 > 0, F.concat(F.lit("@H"), k.cast("string"))).alias("custom_url"), F.when(k % 5 > 0, k % 4 == 0).alias("analyze_enabled"), F.lit("BUILDING").alias("category"),
    )
    return O.flag_sync(sheet.unionByName(older), owners)


@query("handle_category_lookup", "SELECT s_suppkey AS owner_id, coalesce(c_mktsegment, 'unknown') AS category FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 20")
def handle_category_lookup(spark, sf):
    """Configured category by handle with a default."""
    owners = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("owner_id"), (F.col("s_suppkey") * 20).cast("string").alias("handle"))
    config = D.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("handle"), F.col("c_mktsegment").alias("category"), F.lit(0).alias("ord"))
    return O.category_lookup(owners, config).select("owner_id", "category")


@query("enabled_channel_count", "SELECT count(*) FILTER (WHERE c_acctbal > 0) AS enabled, count(*) AS total FROM customer")
def enabled_channel_count(spark, sf):
    """G44."""
    return O.enabled_count(D.table(spark, sf, "customer").withColumn("analyze_enabled", F.col("c_acctbal") > 0))


@query("unmatched_both_sides", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT vec_id, 'right' FROM embeddings WHERE false")
def unmatched_both_sides(spark, sf):
    """Keys on one side only."""
    return O.unmatched_both_sides(D.table(spark, sf, "documents"), D.table(spark, sf, "labels"), "doc_id")


IMAGE_SQL = "SELECT o_orderkey AS item_id, o_custkey AS owner_id, o_orderkey % 9 = 0 AS is_short, CASE WHEN o_orderkey % 4 = 0 THEN 'old/' || o_orderkey WHEN o_orderkey % 4 = 1 THEN '' END AS image_path FROM orders"


def image_items(spark, sf):
    k = F.col("item_id")
    return D.bare_items(spark, sf).select(
        "item_id", "owner_id", (k % 9 == 0).alias("is_short"), F.when(k % 4 == 0, F.concat(F.lit("old/"), k.cast("string"))).when(k % 4 == 1, F.lit("")).alias("image_path")
    )


@query("thumbnail_path_backfill", f"SELECT item_id, CASE WHEN item_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'new/' || item_id ELSE image_path END AS image_path FROM ({IMAGE_SQL})")
def thumbnail_path_backfill(spark, sf):
    """Paths of items whose image was stored."""
    k = F.col("l_orderkey")
    results = D.table(spark, sf, "lineitem").select(k.alias("item_id"), (F.col("l_returnflag") == "R").alias("ok"), F.concat(F.lit("new/"), k.cast("string")).alias("path"))
    return O.backfill_paths(image_items(spark, sf), results).select("item_id", "image_path")


@query("shorts_with_thumbnails", f"SELECT count(*) AS n_items, count(DISTINCT owner_id) AS n_owners FROM ({IMAGE_SQL}) WHERE is_short AND coalesce(image_path, '') <> ''")
def shorts_with_thumbnails(spark, sf):
    """Short items that still have an image."""
    return O.shorts_with_images(image_items(spark, sf)).agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("owner_id").alias("n_owners"))


@query("clear_short_thumbnails", f"SELECT item_id, CASE WHEN is_short AND coalesce(image_path, '') <> '' THEN '' ELSE image_path END AS image_path FROM ({IMAGE_SQL})")
def clear_short_thumbnails(spark, sf):
    """Their paths cleared."""
    return O.clear_short_images(image_items(spark, sf)).select("item_id", "image_path")


@query("thumbnail_stats", "SELECT l_suppkey AS batch, count(*) AS total, count(*) FILTER (WHERE l_returnflag <> 'R') AS ok, count(*) FILTER (WHERE l_returnflag = 'R') AS failed FROM lineitem GROUP BY ALL")
def thumbnail_stats(spark, sf):
    """Results per batch."""
    return O.image_stats(D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("batch"), (F.col("l_returnflag") != "R").alias("ok")), ["batch"])


@query("failed_thumbnails", "SELECT DISTINCT l_orderkey AS item_id FROM lineitem WHERE l_returnflag = 'R'")
def failed_thumbnails(spark, sf):
    """The failed ids as rows."""
    rows = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), (F.col("l_returnflag") != "R").alias("ok"))
    return O.failed_images(rows).select("item_id").distinct()


@query(
    "resume_after_marker",
    """WITH m AS (SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS marker FROM orders WHERE o_custkey % 3 > 0 GROUP BY ALL)
SELECT o_custkey AS owner_id, o_orderkey AS item_id FROM orders LEFT JOIN m USING (o_custkey) WHERE o_orderkey > coalesce(marker, -1)""",
)
def resume_after_marker(spark, sf):
    """Rows after each owner's marker."""
    o = D.bare_items(spark, sf).select("owner_id", "item_id", F.col("item_id").alias("pos"))
    marks = o.filter(F.col("owner_id") % 3 > 0).groupBy("owner_id").agg(F.max(F.when(F.col("item_id") % 3 == 0, F.col("item_id"))).alias("marker"))
    return O.resume_after(o, marks, "owner_id", "item_id", "pos").select("owner_id", "item_id")


@query("chunks", "SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50 AS chunk FROM events")
def chunks(spark, sf):
    """Ordered groups of 50 per key."""
    return O.chunks(D.events(spark, sf).select("event_type", "event_id"), ["event_type"], ["event_id"])


@query("global_chunks", "SELECT o_orderkey AS item_id, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 500 AS chunk FROM orders")
def global_chunks(spark, sf):
    """Groups of 500 over one global order."""
    return O.chunks(D.bare_items(spark, sf).select("item_id", "views"), [], ["views", "item_id"], 500).select("item_id", "chunk")


@query(
    "owner_stats",
    "WITH "
    + D.METRICS_SQL
    + """ SELECT owner_id, count(*) AS n_items, round(avg(views), 6) AS avg_views, round(avg(engagement), 6) AS avg_engagement,
  round(count(*) / greatest(1, date_diff('day', min(published_at), max(published_at))) * 7, 6) AS uploads_per_week FROM measured GROUP BY ALL""",
)
def owner_stats(spark, sf):
    """G40."""
    stats = O.owner_stats(D.measured(spark, sf))
    return stats.select("owner_id", "n_items", *[F.round(c, 6).alias(c) for c in ("avg_views", "avg_engagement", "uploads_per_week")])


@query("performance_percentile", "SELECT o_orderkey AS item_id, CASE WHEN o_custkey % 20 > 0 THEN o_custkey % 20 END AS grp, CASE WHEN o_orderkey % 7 > 0 THEN round(percent_rank() OVER (PARTITION BY o_custkey % 20, o_orderkey % 7 > 0 ORDER BY o_totalprice), 8) END AS percentile FROM orders")
def performance_percentile(spark, sf):
    """Percent rank in the owner, here in twenty groups of owners."""
    group = F.col("owner_id") % 20
    o = D.bare_items(spark, sf).select("item_id", F.when(group > 0, group).alias("grp"), F.when(F.col("item_id") % 7 > 0, F.col("views")).alias("views"))
    return O.performance_percentile(o, "grp", "views").select("item_id", "grp", F.round("percentile", 8).alias("percentile"))
