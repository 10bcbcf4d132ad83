"""Every registered query against its DuckDB oracle on the smallest test tables, plus the
driver entry point."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, duck_conn  # noqa: E402
from conftest import SMALL  # noqa: E402

from batchtrace.plans.catalog import QUERIES  # noqa: E402
from batchtrace.plans.oracle import SQL as ORACLE  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return duck_conn(SMALL)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "base_code" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, name, QUERIES[name](spark, SMALL), ORACLE[name])
