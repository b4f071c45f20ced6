"""Every registered query of the library against its SQL, or for its rows where there is none."""

import pytest
from pyspark.sql import functions as F

from compare import assert_same, database

from tracewright import queries_events, queries_more, queries_native, queries_python, queries_tables  # noqa: F401
from tracewright.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, name):
    """Values of these are held to plain versions in the other tests; here every query gives rows without NULL keys."""
    got = QUERIES[name](spark, SF)
    assert got.count() > 0 and got.where(F.col(got.columns[0]).isNull()).count() == 0


def test_entry_registers_everything(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
