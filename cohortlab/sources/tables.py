"""Reads over stored tables: keys, counts, pages, ordered heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def children_of(df: DataFrame, owner: str, owner_id) -> DataFrame:
    """Rows of one parent; the predicate reaches the scan."""
    return df.filter(F.col(owner) == owner_id)


def existing(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The stored rows among ``keys`` (bulk lookup with payload)."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def exists_flag(keys: DataFrame, df: DataFrame, on: Sequence[str]) -> DataFrame:
    """``keys`` with an ``exists`` flag."""
    stored = df.select(*on).distinct().withColumn("_hit", F.lit(True))
    return keys.join(stored, list(on), "left").withColumn("exists", F.col("_hit").isNotNull()).drop("_hit")


def where_equal(df: DataFrame, *predicates: Column, **values) -> DataFrame:
    """Equality filters and the caller's own predicates; rows without the field are left out."""
    for predicate in predicates:
        df = df.filter(predicate)
    for name, value in values.items():
        df = df.filter(F.col(name) == value)
    return df


def page_after(df: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """Next page in key order (keyset paging)."""
    rows = df if cursor is None else df.filter(F.col(key) > cursor)
    return rows.orderBy(key).limit(size)


def ids(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def heads(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key; Catalyst limits each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
