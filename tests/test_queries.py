"""Every registered query against its SQL twin on the smallest data set."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert compare(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_names_cover_each_other():
    assert set(SQL) <= set(QUERIES)
