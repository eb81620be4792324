import pytest

import __spark_entry__ as entry
from strataframe import queries as core

WITHOUT_SQL = sorted(set(core.QUERIES) - set(core.SQL))


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(name, core.QUERIES[name], core.SQL[name])


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(name, spark, sf):
    assert core.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(core.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
