"""Every registered query against its SQL on the smallest tables."""

import oracle_check
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle_check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    if name in SQL:
        ok, note, _ = oracle_check.compare(df, duck, SQL[name])
        assert ok, note
    else:
        assert df.columns and df.count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 20
