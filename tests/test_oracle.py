"""Every registered query against its SQL in DuckDB."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    verdict, count = compare(spark, duck, ROOT, QUERIES[name], ORACLES.get(name))
    assert verdict in ("ok", "rows only")
    assert count > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["period", "avg_value", "min_value", "max_value", "count", "std_dev"]
    assert df.count() > 0
