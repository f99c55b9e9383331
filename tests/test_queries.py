"""Every query with SQL gives the same rows as DuckDB; the others give rows of a stable schema."""

import pytest
from helpers import DATA, values

from scholion.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in q.ORACLE_SQL:
        want = duck.sql(q.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert values(rows, df.columns) == values(want.fetchall(), want.columns)


def test_every_query_is_documented():
    assert all(f.__doc__ for f in q.QUERIES.values())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
