"""Every registered query with an SQL twin, against DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry_module
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, con, key):
    ok, note, _ = compare(spark, con, SF, key, QUERIES[key], ORACLES[key])
    assert ok, note


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
