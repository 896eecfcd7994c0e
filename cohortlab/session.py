"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for the jobs on any cluster. Executor counts, memory
# and the number of shuffle partitions belong to the deployment.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A session for tests and the local bench (not for clusters).

    ``shared`` is the folder for staged tables; a new one is made if neither
    it nor SPARK_CHECKPOINT_DIR is given.
    """
    shared = shared or os.environ.get("SPARK_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="cohortlab-")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortlab")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("COHORTLAB_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.checkpoint.dir", shared)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
