import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op3_decontaminate", "op12_merkle_manifest", "op13_vector_codes"])
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    twin = con.execute(entry.oracle_sql()[name])
    names = sorted(d[0] for d in twin.description)
    order = [[d[0] for d in twin.description].index(n) for n in names]
    want = sorted(tuple(r[i] for i in order) for r in twin.fetchall())
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want
