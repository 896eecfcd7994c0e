"""Registry of queries over the driver's tables and their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def steady(sql: str) -> str:
    """``round(x, 2|3)`` as the operators do it: noise digits are dropped first."""
    out, at = "", 0
    for match in re.finditer(r"\bround\(", sql):
        if match.start() < at:
            continue
        depth, comma, end = 1, None, match.end()
        while depth:
            char = sql[end]
            depth += (char in "([") - (char in ")]")
            if char == "," and depth == 1:
                comma = end
            end += 1
        inner, digits = steady(sql[match.end() : comma]), sql[comma + 1 : end - 1].strip()
        call = f"round({inner}, {digits})" if digits not in ("2", "3") else f"round(round({inner}, {int(digits) + 6}), {digits})"
        out, at = out + sql[at : match.start()] + call, end
    return out + sql[at:]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = steady(sql)
        return fn

    return register
