"""Every named query equals its SQL on an independent engine."""

import pytest

import __spark_entry__ as contract
from spindlewise.contract.oracles import ORACLES
from spindlewise.contract.queries import QUERIES
from tests.compare import duckdb_rows, spark_rows

FOLDER = "/root/testdata/sf0.01"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    got_names, got = spark_rows(contract.queries()[name](spark, FOLDER))
    want_names, want = duckdb_rows(contract.oracle_sql()[name], FOLDER)
    assert got_names == want_names
    assert got == want


def test_entry(spark):
    assert contract.entry(spark).count() > 100
