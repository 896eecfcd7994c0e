"""The import job: results of the newest finished batch into the stored documents, as one version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.nested import bad_leaf
from cohortlab.operators.work import SUCCEEDED, failure_cutoff, import_results, import_stats, importable_job, parse_results, with_features
from cohortlab.scale import stage
from cohortlab.sources.sinks import newest_per_key
from cohortlab.sources.versions import Store

# Lines of a result file that are counted together before they are counted one by one.
BLOCK_LINES = 1_000
KEYS = ["owner_id", "item_id"]


@dataclass
class Outcome:
    """What a run did: ``imported``, or why it changed nothing (``no_job``, ``wrong_state``, ``done_before``)."""

    status: str
    job_id: object = None
    version: int | None = None


def checked_lines(lines: DataFrame, kind: str, owners: DataFrame, schema: T.StructType) -> DataFrame:
    """Result lines with status and reason, up to the line at which an import stops."""
    parsed = parse_results(lines, kind)
    rows = import_results(parsed.withColumn("bad_leaf", bad_leaf("document", schema)), owners)
    rows = rows.withColumn("_block", F.floor(F.col("line_no") / BLOCK_LINES)).drop("line")
    # staged: the place to stop is found in one pass over the status, and cuts the next
    return failure_cutoff(stage(rows, "checked"), "file", "line_no", "_block").drop("_block")


def with_analysis(rows: DataFrame, schema: T.StructType, texts: DataFrame | None) -> DataFrame:
    """Add the typed document of imported lines, with text features merged in where the item's texts are known."""
    good = F.col("status") == "imported"
    if texts is None:
        return rows.withColumn("analysis", F.when(good, F.from_json("document", schema)))
    return with_features(rows.drop("features_merged"), texts, schema)


def stamped(rows: DataFrame, at: Column, model: str, version: str) -> DataFrame:
    """Documents to store, the last line of an item counts: keys, leaves, and where they come from."""
    good = rows.filter(F.col("analysis").isNotNull())
    docs = newest_per_key(good.select(*KEYS, "line_no", "analysis"), KEYS, ["line_no"])
    return docs.select(
        *KEYS, "analysis.*", at.alias("analyzed_at"), F.lit(model).alias("model_used"), F.lit(version).alias("analysis_version"),
        F.lit(True).alias("batch_mode"),
    )


def run_import(
    store: Store, kind: str, lines: DataFrame, schema: T.StructType, at: Column, model: str, version: str,
    job_id=None, with_texts: bool = False,
) -> Outcome:
    """Import the results of one job into table ``kind`` of the store and close the job.

    The store has the tables ``jobs`` (job_id, kind, state, created_at,
    imported_at, result_file), ``owners``, ``items`` (title, description) and one
    per kind of document. ``lines`` (file, line_no, line) are landed results.
    Without ``job_id`` it is the newest succeeded job of the kind, if that was
    not imported yet. Documents and job row become visible in one version
    named after the job, so a repeated run, also one after a failure halfway,
    either does the whole work or nothing.
    """
    jobs = store.read("jobs").filter(F.col("kind") == kind)
    found = (importable_job(jobs) if job_id is None else jobs.filter(F.col("job_id") == job_id)).limit(1).collect()
    if not found:
        return Outcome("no_job", job_id)
    job = found[0]
    run = f"import-{kind}-{job.job_id}"
    if store.has(run):
        return Outcome("done_before", job.job_id)
    if job.state != SUCCEEDED:
        return Outcome("wrong_state", job.job_id)
    texts = store.read("items").select(*KEYS, "title", "description") if with_texts else None
    rows = checked_lines(lines.filter(F.col("file") == job.result_file), kind, store.read("owners"), schema)
    rows = stage(with_analysis(rows, schema, texts), "import")
    stats = import_stats(rows).withColumn("aborted", rows.agg(F.coalesce(F.bool_or("aborted"), F.lit(False))).scalar())
    closed = stats.select(
        F.lit(job.job_id).alias("job_id"), at.alias("imported_at"), F.struct(*stats.columns).alias("import_stats")
    )
    changes = [store.upsert(kind, stamped(rows, at, model, version)), store.upsert("jobs", closed)]
    return Outcome("imported", job.job_id, store.commit(run, changes))
