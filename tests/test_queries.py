"""Every registered query that has SQL must give DuckDB's rows; the others must run."""

import pytest

import __spark_entry__ as entry
from millrace.plans import catalog
from tests.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_duckdb(spark, name):
    assert differences(spark, catalog.QUERIES[name], catalog.SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
