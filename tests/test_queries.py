"""Every registered query against its SQL, over the whole small tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, con, name):
    assert compare(spark, con, data, entry.queries()[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_runs(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry(spark, data):
    rows = entry.entry(spark).collect()
    assert len(rows) == 11
    assert all(0 <= r["overall_quality_score"] <= 100 for r in rows)


def test_each_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
