"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is drained into the no-op sink, after one untimed query that warms
up the session. ``queries`` holds the last run of each, ``first`` the first;
BENCH_RUNS (default 2) sets the runs. BENCH_ALL=1 runs every registered query.
"""

from __future__ import annotations

import json
import os
import time

from cohortlab.plans.catalogue import QUERIES
from cohortlab.session import local_session

HEADLINE = [
    # insights
    "cohort_bool_profile", "feature_profile", "engagement_profile", "feature_correlations", "top_performer_split", "topic_gaps",
    "keyword_gaps", "format_gaps", "image_elements", "timing_profile", "timing_insights", "insights_job",
    # load and metrics
    "engagement_metrics", "video_api_scan", "full_load", "upsert_merge", "indexed_top_by_owner", "performance_percentile",
    # text
    "text_features", "title_formatting", "description_features", "url_classes",
    # work
    "unanalyzed_items", "import_results", "running_failure_abort", "coverage_rollup", "quota_ledger", "global_chunks",
    # recommendation and streams
    "recommendation_rows", "idea_rows", "rate_limit_batch", "rate_limit_stream",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=8)
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    drain(QUERIES["engagement_metrics"](spark, sf))
    last, first = {}, {}
    for name in names:
        for attempt in range(runs):
            begin = time.perf_counter()
            drain(QUERIES[name](spark, sf))
            spent = round(time.perf_counter() - begin, 3)
            if attempt == 0:
                first[name] = spent
            last[name] = spent
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(last.values()), 3), "unit": "sec", "queries": last, "first": first,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": cpus,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
