"""Tables that change together: bucket folders that are never rewritten, and versions that name them.

A table's rows lie in folders by a hash of their key. An upsert reads and
writes only the buckets that new rows fall into; the folders of all others stay
as they are and are named again by the next version. A version is one committed
row that names the folders of every table, so all changes of a run become
visible at once, and a run that fails leaves only folders that nothing names.
Each version carries the name of the run that made it: a run that was committed
before is not repeated. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.scale import stage
from cohortlab.sources.sinks import upsert

BUCKETS = 16
VERSION = (
    "version BIGINT, run STRING, tables ARRAY<STRUCT<name: STRING, keys: ARRAY<STRING>, buckets: INT, schema: STRING, "
    "parts: ARRAY<STRUCT<bucket: INT, path: STRING>>>>"
)
BUCKET = "part_bucket"


@dataclass
class Change:
    """New folders of some buckets of a table, not visible before they are committed."""

    table: str
    keys: list[str]
    buckets: int
    schema: T.StructType
    parts: dict[int, str]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, Sequence[str]]], buckets: int = BUCKETS) -> Store:
        """A new store with these tables and their keys, as version 0."""
        store = cls(spark, root)
        changes = []
        for name, (df, keys) in tables.items():
            rows = stage(df.withColumn(BUCKET, store._bucket(keys, buckets)), "rows")
            used = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most ``buckets``
            changes.append(Change(name, list(keys), buckets, df.schema, store._write(name, rows, keys, used)))
        store._publish(0, "create", changes)
        return store

    @staticmethod
    def _bucket(keys: Sequence[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, keys: Sequence[str], used: Iterable[int]) -> dict[int, str]:
        path = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        # four tasks a bucket, so that one large bucket does not wait for one task
        rows.repartition(BUCKET, F.pmod(F.hash(*keys), F.lit(4))).write.partitionBy(BUCKET).parquet(path)
        return {b: f"{path}/{BUCKET}={b}" for b in used}

    def versions(self) -> DataFrame:
        return self.spark.read.schema(VERSION).option("recursiveFileLookup", "true").json(f"{self.root}/versions")

    def head(self) -> Row:
        """The newest version: a row with a folder per table and bucket."""
        return self.versions().orderBy(F.desc("version")).limit(1).collect()[0]

    def has(self, run: str) -> bool:
        return bool(self.versions().filter(F.col("run") == run).limit(1).count())

    def table(self, name: str) -> Change:
        found = next((t for t in self.head().tables if t.name == name), None)
        if found is None:
            raise KeyError(f"no table {name}")
        return Change(name, list(found.keys), found.buckets, T.StructType.fromJson(json.loads(found.schema)), {p.bucket: p.path for p in found.parts})

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as of the newest version, or some of its buckets."""
        t = self.table(name)
        paths = [p for b, p in sorted(t.parts.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(t.schema).parquet(*paths) if paths else self.spark.createDataFrame([], t.schema)

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """Buckets of a table that these rows fall into: at most as many as it has."""
        t = self.table(name)
        return sorted(r[0] for r in self._typed(t, rows).select(self._bucket(t.keys, t.buckets)).distinct().collect())

    @staticmethod
    def _typed(t: Change, rows: DataFrame) -> DataFrame:
        """Keys in the stored types: the hash of a number depends on its type."""
        return rows.withColumns({k: F.col(k).cast(t.schema[k].dataType) for k in t.keys})

    def upsert(self, name: str, new: DataFrame, present: Sequence[str] = ()) -> Change:
        """Merge ``new`` (unique keys, see ``sinks.upsert``) into the buckets it touches."""
        t = self.table(name)
        new = stage(self._typed(t, new), "merge")
        used = self.touched(name, new)
        merged = upsert(self.read(name, used), new, t.keys, present)
        if not used:
            return Change(name, t.keys, t.buckets, t.schema, {})
        rows = merged.withColumn(BUCKET, self._bucket(t.keys, t.buckets))
        return Change(name, t.keys, t.buckets, merged.schema, self._write(name, rows, t.keys, used))

    def commit(self, run: str, changes: Sequence[Change]) -> int:
        """Make the changes of a run visible together; a run that is known already changes nothing."""
        known = self.versions().filter(F.col("run") == run).limit(1).collect()
        if known:
            return known[0].version
        head = self.head()
        new = {c.table: c for c in changes}
        after = []
        for name in [t.name for t in head.tables]:
            old = self.table(name)
            change = new.get(name)
            after.append(old if change is None else Change(name, old.keys, old.buckets, change.schema, {**old.parts, **change.parts}))
        return self._publish(head.version + 1, run, after)

    def _publish(self, version: int, run: str, tables: Sequence[Change]) -> int:
        rows = [(t.table, t.keys, t.buckets, t.schema.json(), sorted(t.parts.items())) for t in tables]
        df = self.spark.createDataFrame([(version, run, rows)], VERSION).coalesce(1)
        # a folder per version: a second writer of the same version fails here
        df.write.mode("errorifexists").json(f"{self.root}/versions/{version:012d}")
        return version
