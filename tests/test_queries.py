"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.run import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert compare(got, duck.sql(SQL[name])) is None
    else:
        assert len(got.toPandas().columns) > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_names_are_unique_and_sql_has_a_query():
    from checks import all_cases

    names = [c.name for c in all_cases()]
    assert len(names) == len(set(names))
    assert set(SQL) <= set(QUERIES)
