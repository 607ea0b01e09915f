"""Every registered query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, folder, con, name):
    df = entry.queries()[name](spark, folder)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    row = entry.entry(spark).first()
    assert (row.source_only_rows, row.target_only_rows, row.matching_rows, row.different_rows) == (89, 79, 1202, 209)
