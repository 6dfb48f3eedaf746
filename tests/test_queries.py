"""Every query with SQL gives the rows of its SQL on the smallest tables; the others run and have a stable schema."""

import pytest

from tests.oracle import connect, difference
from tidemark.queries import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLE)))
def test_same_rows_as_sql(spark, con, name):
    assert not difference(catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() >= 0
    assert len(set(df.columns)) == len(df.columns)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
