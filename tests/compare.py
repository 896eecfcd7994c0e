"""Run registered queries next to their DuckDB twins.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = os.environ.get("COHORTLAB_TESTDATA", "/root/testdata")


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(cell(v) for v in value) + "]"
    return str(value)


def kind(dtype: str) -> str:
    """Coarse type name shared by both engines."""
    d = dtype.lower()
    for names, out in [
        (("bigint", "long"), "long"), (("integer", "int"), "int"), (("double",), "double"), (("boolean",), "bool"),
        (("varchar", "string", "json"), "string"), (("timestamp",), "timestamp"), (("hugeint",), "hugeint"), (("decimal",), "decimal"),
        (("date",), "date"), (('"null"', "null", "void"), "null"),
    ]:
        if d.startswith(names):
            return out + ("[]" if d.endswith("[]") else "")
    if d.startswith("array<"):
        return kind(d[6:-1]) + "[]"
    return d


def spark_rows(df) -> tuple[dict[str, str], list[tuple[str, ...]]]:
    types = {n: kind(t) for n, t in df.dtypes}
    names = sorted(types)
    rows = df.collect()
    return types, sorted(tuple(cell(r[n]) for n in names) for r in rows)


def duck_rows(con, sql: str) -> tuple[dict[str, str], list[tuple[str, ...]]]:
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    rows = cur.fetchall()
    index = {n: i for i, n in enumerate(cols)}
    names = sorted(cols)
    return types, sorted(tuple(cell(r[index[n]]) for n in names) for r in rows)


def differences(spark, con, sf: str, fn, sql: str) -> tuple[list[str], int]:
    """Problems found for one query, and its row count."""
    left_types, left = spark_rows(fn(spark, sf))
    right_types, right = duck_rows(con, sql)
    problems = []
    if left_types != right_types:
        problems.append(f"types {sorted(left_types.items())} != {sorted(right_types.items())}")
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    if left != right:
        a, b = set(left), set(right)
        problems.append(f"values differ: spark only {sorted(a - b)[:3]} duck only {sorted(b - a)[:3]} ({len(a - b)}/{len(b - a)})")
    return problems, len(left)


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from cohortlab.session import local_session

    args = sys.argv[1:]
    sf = f"{TESTDATA}/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark, con = local_session(8), duck(sf)
    all_queries, oracles = queries(), oracle_sql()
    bad = 0
    for name in args or list(all_queries):
        begin = time.time()
        try:
            if name in oracles:
                problems, n = differences(spark, con, sf, all_queries[name], oracles[name])
            else:
                problems, n = [], len(spark_rows(all_queries[name](spark, sf))[1])
        except Exception as e:  # noqa: BLE001 - report and go on
            problems, n = [f"{type(e).__name__}: {str(e)[:1500]}"], -1
        mark = "ok  " if not problems else "FAIL"
        bad += bool(problems)
        print(f"{mark} {name} rows={n} {time.time() - begin:.1f}s{'' if name in oracles else ' (no oracle)'}", flush=True)
        for p in problems:
            print("     ", p[:1800], flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
