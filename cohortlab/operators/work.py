"""Annotation work: pending items, request rows, result imports, job records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions import metrics as M
from cohortlab.functions import text as X
from cohortlab.functions.nested import deep_merge, document_json, non_empty_document, response_text
from cohortlab.scale import lookup_join, row_numbers, running_total

# Job states, abort rule, listing limits.
ACTIVE_STATES = ["JOB_STATE_RUNNING", "JOB_STATE_PENDING", "JOB_STATE_QUEUED"]
SUCCEEDED = "JOB_STATE_SUCCEEDED"
TERMINAL_STATES = ["JOB_STATE_SUCCEEDED", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED"]
ABORT_RATE, ABORT_MIN_ROWS = 0.2, 10
BATCH_REQUESTS = 50_000
RECENT_JOBS, NAME_WIDTH, NAME_TAIL = 20, 33, 30


def unanalyzed(
    items: DataFrame, documents: DataFrame, kind: str, on: Sequence[str] = ("owner_id", "item_id"),
    short_flag: str = "is_short",
) -> DataFrame:
    """Non-short items without a document of the kind."""
    done = documents.filter(F.col("kind") == kind).select(*on)
    return items.filter(~F.coalesce(F.col(short_flag), F.lit(False))).join(done, list(on), "left_anti")


def new_ids(listed: DataFrame, stored: DataFrame, on: Sequence[str]) -> DataFrame:
    """Listed ids that are not stored yet (the full difference)."""
    return listed.join(stored.select(*on), list(on), "left_anti")


def new_ids_until_known_page(
    listed: DataFrame, stored: DataFrame, owner: str = "owner_id", page: str = "page", item: str = "item_id"
) -> DataFrame:
    """New ids of the pages before the first page on which all ids are known."""
    known = stored.select(owner, item).distinct().withColumn("_known", F.lit(True))
    marked = listed.join(known, [owner, item], "left").withColumn("_new", F.col("_known").isNull())
    pages = marked.groupBy(owner, page).agg(F.count_if("_new").alias("_n"))
    stops = pages.filter(F.col("_n") == 0).groupBy(owner).agg(F.min(page).alias("_stop"))
    return (
        lookup_join(marked.filter("_new"), stops, [owner], "left")
        .filter(F.col("_stop").isNull() | (F.col(page) < F.col("_stop")))
        .drop("_known", "_new", "_stop")
    )


def missing_from_source(requested: DataFrame, returned: DataFrame, item: str, batch: str) -> DataFrame:
    """Requested and missing (deleted or private) ids per batch."""
    got = returned.select(item).distinct().withColumn("_got", F.lit(True))
    return requested.join(got, item, "left").groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_requested"), F.count_if(F.col("_got").isNull()).alias("n_missing")
    )


def split_known(df: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Flag rows whose key exists in ``known``."""
    keys = known.select(on).distinct().withColumn("_hit", F.lit(True))
    return df.join(keys, on, "left").withColumn("is_known", F.col("_hit").isNotNull()).drop("_hit")


# --- requests -------------------------------------------------------------


def request_rows(items: DataFrame, kind: str, model: str = "model") -> DataFrame:
    """Key and request per item; ``reject`` says why there is no request."""
    if kind == "thumbnail":
        ready = F.coalesce(F.col("image_path"), F.lit("")) != ""
        body = F.struct(F.lit(model).alias("model"), F.col("image_path").alias("image"))
    else:
        ready = F.coalesce(F.col("title"), F.lit("")).rlike(rf"[^{X.SPACE}]")
        body = F.struct(
            F.lit(model).alias("model"),
            X.analysis_input_text(F.col("title"), F.col("description")).alias("text"),
        )
    return items.select(
        "owner_id", "item_id",
        M.request_key(F.col("owner_id").cast("string"), F.col("item_id").cast("string"), F.lit(kind)).alias("key"),
        F.when(ready, F.to_json(F.struct(body.alias("request")))).alias("request"),
        F.when(~ready, F.lit("missing_data")).alias("reject"),
    )


def capped_requests(requests: DataFrame, limit: int = BATCH_REQUESTS, order: Sequence[str] = ("owner_id", "item_id")) -> DataFrame:
    """The first ``limit`` requests in a total order.

    Only keys are ranked; request bodies stay where they are until the kept
    keys select them.
    """
    ready = requests.filter(F.col("reject").isNull())
    keys = ready.select(*order)
    first = row_numbers(keys, list(order), "_rn").filter(F.col("_rn") <= limit).drop("_rn")
    return lookup_join(ready, first, list(order), "left_semi", max_rows=BATCH_REQUESTS)


def prepare_stats(work: DataFrame, limit: int = BATCH_REQUESTS) -> DataFrame:
    """Counters of a preparation run over labelled work.

    ``work`` has owner_id, item_id, analyzed and reject. Owners are taken in
    order until the batch is full.
    """
    ready = ~F.col("analyzed") & F.col("reject").isNull()
    per_owner = work.groupBy("owner_id").agg(
        F.count_if(ready).alias("_ready"), F.count_if("analyzed").alias("_analyzed"),
    )
    totals = row_totals_before(per_owner, "owner_id", "_ready")
    owners = totals.withColumn("scanned", F.col("_before") < limit).withColumn(
        "written", F.when(F.col("scanned"), F.least(F.col("_ready"), F.lit(limit) - F.col("_before"))).otherwise(F.lit(0))
    )
    # items of the last owner that come after the batch is full are not looked at
    seen = missing_before_full(work, owners, limit)
    return owners.agg(
        F.sum("written").cast("long").alias("requests"),
        F.coalesce(F.sum(F.when(F.col("scanned"), F.col("_analyzed"))), F.lit(0)).cast("long").alias("already_analyzed"),
        F.count_if("scanned").alias("owners_scanned"),
        F.count_if(F.col("written") > 0).alias("owners_with_work"),
        F.count_if(~F.col("scanned")).alias("owners_skipped"),
    ).withColumn("missing_data", seen)


def row_totals_before(df: DataFrame, order: str, amount: str) -> DataFrame:
    """Running total of the earlier rows (0 for the first)."""
    return running_total(df, [order], {"_upto": F.col(amount)}).withColumn("_before", F.col("_upto") - F.col(amount)).drop(
        "_upto"
    )


def missing_before_full(work: DataFrame, owners: DataFrame, limit: int) -> Column:
    """Rejected rows reached before the batch filled up, as a scalar."""
    bad = (~F.col("analyzed") & F.col("reject").isNotNull()).cast("long")
    whole = owners.filter(F.col("scanned") & (F.col("_before") + F.col("_ready") < limit)).select("owner_id")
    last = owners.filter(F.col("scanned") & (F.col("_before") + F.col("_ready") >= limit)).select("owner_id", "_before")
    in_whole = work.join(whole, "owner_id", "left_semi").agg(F.coalesce(F.sum(bad), F.lit(0)).alias("n"))
    # one owner at most: cut at the item that fills the batch
    edge = work.join(F.broadcast(last), "owner_id").filter(~F.col("analyzed"))
    edge = running_total(edge, ["item_id"], {"_ready_upto": F.col("reject").isNull().cast("long")})
    full_at = edge.filter(F.col("_before") + F.col("_ready_upto") >= limit).agg(F.min("item_id")).scalar()
    in_edge = edge.withColumn("_full", full_at).filter(F.col("item_id") <= F.col("_full")).agg(
        F.coalesce(F.sum(bad), F.lit(0)).alias("n")
    )
    return in_whole.scalar() + in_edge.scalar()


# --- results --------------------------------------------------------------


def parse_results(lines: DataFrame, kind: str, line: str = "line") -> DataFrame:
    """Key, owner, item and document of each non-blank result line."""
    rows = lines.filter(F.col(line).rlike(r"\S"))
    readable = F.try_parse_json(line).isNotNull()
    key = F.when(readable, F.get_json_object(line, "$.key"))
    ids = M.parse_request_key(F.coalesce(key, F.lit("")), kind)
    return rows.withColumns(
        {
            "readable": readable,
            "key": key,
            "owner_id": ids["owner_id"],
            "item_id": ids["item_id"],
            "document": non_empty_document(document_json(response_text(F.when(readable, F.col(line))))),
        }
    )


def import_results(
    parsed: DataFrame, owners: DataFrame, texts: DataFrame | None = None, doc_schema: T.StructType | None = None
) -> DataFrame:
    """Status and reason per result; text features merged in where texts exist.

    ``texts`` has (owner_id, item_id, title, description). Without
    ``doc_schema`` the document stays JSON and no features are merged. A row
    with a ``bad_leaf`` (see ``nested.bad_leaf``) fails.
    """
    known = owners.select(F.col("owner_id")).distinct().withColumn("_known", F.lit(True))
    rows = parsed.join(known, "owner_id", "left")
    reason = (
        F.when(~F.col("readable"), "parse_error")
        .when(F.col("owner_id").isNull(), "bad_key")
        .when(F.col("_known").isNull(), "unknown_owner")
        .when(F.col("document").isNull(), "empty_document")
    )
    if "bad_leaf" in parsed.columns:
        reason = reason.when(F.col("bad_leaf").isNotNull(), "bad_leaf")
    rows = rows.withColumn("reason", reason).withColumn(
        "status",
        F.when(F.col("reason").isNull(), "imported").when(F.col("reason") == "parse_error", "parse_error").otherwise("failed"),
    ).drop("_known")
    if texts is None:
        return rows.withColumn("features_merged", F.lit(False))
    return with_features(rows, texts, doc_schema)


def with_features(rows: DataFrame, texts: DataFrame, doc_schema: T.StructType | None = None) -> DataFrame:
    """Add ``features_merged`` and, with a schema, ``analysis``: the document of imported lines with text features merged in."""
    found = texts.select("owner_id", "item_id", "title", "description").withColumn("_text", F.lit(True))
    rows = rows.join(found, ["owner_id", "item_id"], "left")
    merged = (F.col("status") == "imported") & F.col("_text").isNotNull()
    rows = rows.withColumn("features_merged", F.coalesce(merged, F.lit(False)))
    if doc_schema is not None:
        features = X.text_features(F.col("title"), F.col("description"))
        rows = rows.withColumn("_features", F.when(F.col("features_merged"), features))
        over = rows.schema["_features"].dataType
        base = F.from_json("document", doc_schema)
        merged_doc = deep_merge(base, doc_schema, F.col("_features"), over)
        rows = rows.withColumn("analysis", F.when(F.col("status") == "imported", merged_doc)).drop("_features")
    return rows.drop("title", "description", "_text")


def import_stats(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), n("imported").alias("imported"), n("failed").alias("failed"),
        n("parse_error").alias("parse_errors"), F.count_if("features_merged").alias("features_merged"),
    )


def failure_cutoff(
    results: DataFrame, file: str, line_no: str, block: str, rate: float = ABORT_RATE, min_rows: int = ABORT_MIN_ROWS
) -> DataFrame:
    """Keep rows up to the first line at which an import would stop.

    Stops at the first line (not a parse error) with at least ``min_rows``
    seen and more than ``rate`` failed. Counts are prefix sums: per block of
    consecutive lines first, then inside each block, so no window holds a file.
    """
    failed = (F.col("status") == "failed").cast("long")
    blocks = results.groupBy(file, block).agg(F.count(F.lit(1)).alias("_n"), F.sum(failed).alias("_f"))
    earlier = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        file, block,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_f").over(earlier), F.lit(0)).alias("_f0"),
    )
    here = Window.partitionBy(file, block).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    seen = results.join(before, [file, block]).withColumns(
        {
            "rows_seen": F.col("_n0") + F.count(F.lit(1)).over(here),
            "rows_failed": F.col("_f0") + F.sum(failed).over(here),
        }
    )
    stop_here = (
        (F.col("status") != "parse_error") & (F.col("rows_seen") >= min_rows)
        & (F.col("rows_failed") / F.col("rows_seen") > rate)
    )
    stops = seen.filter(stop_here).groupBy(file).agg(F.min(line_no).alias("_stop"))
    return (
        lookup_join(seen, stops, [file], "left")
        .filter(F.col("_stop").isNull() | (F.col(line_no) <= F.col("_stop")))
        .withColumn("aborted", F.col("_stop").isNotNull())
        .drop("_stop", "_n0", "_f0")
    )


# --- jobs -----------------------------------------------------------------


def latest_job(jobs: DataFrame, state: str | None = None) -> DataFrame:
    """Newest job per kind, optionally of one state."""
    rows = jobs if state is None else jobs.filter(F.col("state") == state)
    newest = Window.partitionBy("kind").orderBy(F.desc("created_at"), F.desc("job_id"))
    return rows.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") == 1).drop("_rn")


def importable_job(jobs: DataFrame) -> DataFrame:
    """The newest succeeded job per kind if it was not imported yet."""
    return latest_job(jobs, SUCCEEDED).filter(F.col("imported_at").isNull())


def active_job(jobs: DataFrame) -> DataFrame:
    """Running, else pending, else queued, else the newest one if not terminal."""
    rank = F.lit(len(ACTIVE_STATES))
    for i, state in reversed(list(enumerate(ACTIVE_STATES))):
        rank = F.when(F.col("state") == state, F.lit(i)).otherwise(rank)
    first = Window.partitionBy("kind").orderBy("_rank", F.desc("created_at"), F.desc("job_id"))
    # the fallback is the newest job of any state: with no active job all ranks are equal
    return (
        jobs.withColumn("_rank", rank)
        .withColumn("_rn", F.row_number().over(first))
        .filter((F.col("_rn") == 1) & ~F.col("state").isin(TERMINAL_STATES))
        .drop("_rn", "_rank")
    )


def recent_jobs(jobs: DataFrame, n: int = RECENT_JOBS) -> DataFrame:
    name = F.col("job_name")
    label = F.when(F.length(name) > NAME_WIDTH, F.concat(F.lit("..."), F.right(name, F.lit(NAME_TAIL)))).otherwise(name)
    return (
        jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)
        .select("job_id", label.alias("label"), "kind", "state", F.col("imported_at").isNotNull().alias("imported"))
    )


def job_state(observations: DataFrame) -> DataFrame:
    """Current state per job from a log of observed states."""
    return observations.groupBy("job_id").agg(
        F.max_by("state", F.struct("observed_at", "seq")).alias("state"),
        F.max("observed_at").alias("observed_at"),
        F.count(F.lit(1)).alias("n_polls"),
    ).withColumn("is_terminal", F.col("state").isin(TERMINAL_STATES))


def finish_import(jobs: DataFrame, job_id: str, stats: DataFrame, imported_at: Column) -> DataFrame:
    """Stamp one job with its import statistics (one row, see import_stats)."""
    fields = F.struct(*[F.col(c) for c in stats.columns])
    value = stats.select(fields.alias("s")).scalar()
    mine = F.col("job_id") == job_id
    return jobs.withColumn("imported_at", F.when(mine, imported_at).otherwise(F.col("imported_at"))).withColumn(
        "import_stats", F.when(mine, value)
    )


# --- coverage -------------------------------------------------------------


def coverage(
    items: DataFrame, documents: DataFrame, kinds: Sequence[str], category: str = "category", owner: str = "owner_id"
) -> DataFrame:
    """Done and left per owner with category and grand totals (rollup).

    Documents collapse to one row per item before the join, so items keep
    their row count.
    """
    done = documents.groupBy("item_id").agg(
        *[F.bool_or(F.col("kind") == k).alias(f"_{k}") for k in kinds]
    )
    rows = items.filter(~F.coalesce(F.col("is_short"), F.lit(False))).join(done, "item_id", "left")
    aggs = [F.count(F.lit(1)).alias("total")]
    for k in kinds:
        hit = F.coalesce(F.col(f"_{k}"), F.lit(False))
        aggs += [F.count_if(hit).alias(f"{k}_done"), F.count_if(~hit).alias(f"{k}_left")]
    return rows.rollup(category, owner).agg(F.grouping_id().cast("int").alias("level"), *aggs)


def analysis_progress(events: DataFrame) -> DataFrame:
    """Outcome counts, percent done and elapsed seconds per analysis kind."""
    def n(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    processed = n("success") + n("failed") + n("skipped")
    return events.groupBy("kind").agg(
        F.count(F.lit(1)).alias("total"), processed.alias("processed"), n("success").alias("successful"),
        n("failed").alias("failed"), n("skipped").alias("skipped"),
        F.round(processed / F.count(F.lit(1)) * 100, 2).alias("progress"),
        F.round((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6, 3).alias("elapsed_seconds"),
    )
