"""Temporary SQL functions for the scalar rules, usable from ``spark.sql``.

They are SQL expressions, so Catalyst inlines them like the Column versions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "days_since_publish": (
        "ts TIMESTAMP, as_of TIMESTAMP", "BIGINT",
        "greatest(1, abs(unix_millis(as_of) - unix_millis(ts)) div 86400000)",
    ),
    "recency_weight": (
        "ts TIMESTAMP, as_of TIMESTAMP, half_life_days DOUBLE", "DOUBLE",
        "coalesce(exp(-ln(2) * greatest(0D, (unix_micros(as_of) - unix_micros(ts)) / 86400e6D) / half_life_days), 1D)",
    ),
    "confidence_label": ("n BIGINT", "STRING", "CASE WHEN n < 10 THEN 'low' WHEN n < 50 THEN 'medium' ELSE 'high' END"),
    "is_significant": ("all_rate DOUBLE, top_rate DOUBLE", "BOOLEAN", "abs(top_rate - all_rate) > 0.05D"),
    "hour_label": (
        "h INT", "STRING",
        "CASE WHEN h BETWEEN 6 AND 11 THEN 'Morning' WHEN h BETWEEN 12 AND 16 THEN 'Afternoon' "
        "WHEN h BETWEEN 17 AND 21 THEN 'Evening' ELSE 'Night' END",
    ),
    "views_per_subscriber": ("views DOUBLE, subscribers DOUBLE", "DOUBLE", "CASE WHEN subscribers > 0 THEN views / subscribers ELSE 0D END"),
    "doc_name": ("content_type STRING", "STRING", "lower(translate(content_type, ' /,', '___'))"),
}


def register(spark: SparkSession, names: list[str] | None = None) -> list[str]:
    """Create the functions in the session; returns their names."""
    wanted = names or list(FUNCTIONS)
    for name in wanted:
        args, returns, body = FUNCTIONS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    return wanted
