"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.scale import stage_path

# Rows per Arrow batch handed to Python: some megabytes of ordinary texts.
ARROW_ROWS = 512
# Most bytes of a batch; a single longer text makes a batch of its own.
ARROW_BYTES = 4 << 20

# Most bytes of a side that may be sent to every executor. A side is staged
# first, so its size is known; beyond the bound the join is shuffled.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows and bytes, for very long texts.

    Spark reads both settings when the plan runs, so they stay set in the
    session. A worker that goes on to other tasks gives its buffers back.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder (zstd Parquet) and read it back.

    A lost executor then costs a re-read of one file, not the whole lineage.
    Spark removes the shuffle files of a query when it has ended, instead of
    when the driver next collects garbage; the setting stays in the session.
    """
    path = stage_path(df.sparkSession, name)
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(staged: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table may be broadcast: the sum of its row sizes is known and below ``limit``."""
    size = staged.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes).cast("long")).first()[0]
    return (size or 0) <= limit


def sized(staged: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a staged side for broadcast if its measured size allows it; otherwise it is joined by shuffle."""
    return F.broadcast(staged) if fits(staged, row_bytes, limit) else staged


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(df: DataFrame, rows: int, key: str, strata: str) -> DataFrame:
    """About ``rows`` rows per value of ``strata``, chosen by a hash of ``key``: the same rows at every layout.

    Strata are counted over the whole table; there must be at most 1,000 of
    them. The result has no more than 1.5 times ``rows`` rows per stratum.
    """
    counts = df.groupBy(strata).count().limit(1001).collect()
    if len(counts) > 1000:
        raise ValueError(f"{strata} has more than 1,000 values")
    rank = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000))
    keep = F.lit(False)
    for value, n in counts:
        if value is not None:
            keep = keep | ((F.col(strata) == F.lit(value)) & (rank < max(1, round(1_000_000 * min(1.0, rows / n)))))
    return df.filter(keep).limit(int(rows * 1.5) * max(1, len(counts)))
