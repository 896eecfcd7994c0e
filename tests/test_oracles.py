"""Every registered query against its DuckDB twin on whole tables."""

import pytest
from compare import TESTDATA, differences, duck, spark_rows

from cohortlab.plans.catalogue import ORACLES, QUERIES

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        problems, _ = differences(spark, con, SF, QUERIES[name], ORACLES[name])
        assert not problems
    else:
        types, rows = spark_rows(QUERIES[name](spark, SF))
        assert types and rows


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).columns
    assert set(oracle_sql()) <= set(queries())
