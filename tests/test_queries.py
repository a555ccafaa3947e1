"""Every query runs over its whole tables; those with SQL give the rows DuckDB gives."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, rows

CORE = [n for m in entry.MODULES if "llm" not in m.__name__ for n in m.QUERIES]


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, folder, duck, name):
    got = entry.queries()[name](spark, folder).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    sql = entry.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(duck.execute(sql).fetchdf())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
