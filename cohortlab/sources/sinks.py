"""Sinks: merge, patch, overwrite, append, delete, JSON lines and reports.

Parquet has no in-place update: each function returns the new table state,
and ``replace_table`` writes it to a new version folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _merge_value(old: Column, new: Column, dtype: T.DataType, new_type: T.DataType | None = None) -> Column:
    """New value where present; structs merge field by field, fields that one side has are kept."""
    new_type = new_type or dtype
    if isinstance(dtype, T.StructType) and isinstance(new_type, T.StructType):
        theirs = {f.name: f.dataType for f in new_type.fields}
        mine = {f.name for f in dtype.fields}
        fields = [
            _merge_value(old.getField(f.name), new.getField(f.name), f.dataType, theirs[f.name]) if f.name in theirs else old.getField(f.name)
            for f in dtype.fields
        ]
        fields = [c.alias(f.name) for c, f in zip(fields, dtype.fields, strict=True)] + [new.getField(n).alias(n) for n in theirs if n not in mine]
        return F.when(old.isNotNull() | new.isNotNull(), F.struct(*fields))
    return F.coalesce(new, old)


def _sided(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys], F.lit(True).alias("_here")).alias(side))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], present: Sequence[str] = ()) -> DataFrame:
    """Insert new keys; on known keys overwrite only the fields present.

    A null in ``new`` means "not in this record", but for the columns in
    ``present``, which every record of this kind carries: there a null clears the
    stored value. Columns that only one side has are kept. Keys must be
    unique per side (see ``newest_per_key``).
    """
    keys = list(keys)
    joined = _sided(old, keys, "_o").join(_sided(new, keys, "_n"), keys, "full_outer")
    names = [c for c in old.columns if c not in keys] + [c for c in new.columns if c not in keys and c not in old.columns]
    out = []
    for name in names:
        if name not in new.columns:
            value = F.col(f"_o.{name}")
        elif name not in old.columns:
            value = F.col(f"_n.{name}")
        elif name in present:
            value = F.when(F.col("_n").isNull(), F.col(f"_o.{name}")).otherwise(F.col(f"_n.{name}"))
        else:
            value = _merge_value(F.col(f"_o.{name}"), F.col(f"_n.{name}"), old.schema[name].dataType, new.schema[name].dataType)
        out.append(value.alias(name))
    return joined.select(*keys, *out)


def update_columns(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Upsert limited to some columns, all of which each record carries (statistics refresh)."""
    return upsert(old, new.select(*keys, *columns), keys, present=columns)


def patch_existing(old: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overwrite fields of known keys; unknown keys are not inserted."""
    keys = list(keys)
    joined = _sided(old, keys, "_o").join(_sided(patch, keys, "_n"), keys, "left")
    out = []
    for name in [c for c in old.columns if c not in keys]:
        value = F.col(f"_o.{name}")
        if name in patch.columns:
            value = _merge_value(value, F.col(f"_n.{name}"), old.schema[name].dataType, patch.schema[name].dataType)
        out.append(value.alias(name))
    return joined.select(*keys, *out)


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the newest; combined map-side, so hot keys are fine.

    Rows of the same age are settled by a hash of their content, so the
    result does not depend on how the rows are partitioned.
    """
    rest = [c for c in df.columns if c not in keys]
    content = F.xxhash64(F.to_json(F.struct(*rest)))
    best = F.max_by(F.struct(*rest), F.struct(*order, content)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*")


def delete_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def truncate(df: DataFrame, path: str) -> None:
    """Leave an empty table with the same schema."""
    df.limit(0).write.mode("overwrite").parquet(path)


def replace_table(df: DataFrame, path: str, version: str, cluster_by: Sequence[str] = ()) -> str:
    """Write a table state to ``path/version`` and return that folder."""
    target = f"{path.rstrip('/')}/{version}"
    # range, not hash: a hot first key then spreads over several files
    writer = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
    writer.write.mode("errorifexists").parquet(target)
    return target


def overwrite_documents(df: DataFrame, path: str, partition: str) -> None:
    """Replace whole documents: only the partitions in ``df`` are rewritten."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    )


def append_with_id(df: DataFrame, path: str, saved_at: Column) -> None:
    df.withColumns({"id": F.uuid(), "saved_at": saved_at}).write.mode("append").parquet(path)


def write_json_lines(df: DataFrame, path: str, line: str) -> None:
    """One JSON text per line."""
    df.select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, root: str, name: str, run_id: str) -> str:
    """JSON report ``{name}_{run_id}``; non-ASCII text is kept as is."""
    target = f"{root.rstrip('/')}/{name}_{run_id}"
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(target)
    return target


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
