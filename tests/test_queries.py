"""Every named query against its SQL; those without SQL must run and give rows."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, sf_dir, con, name):
    df = entry_module.queries()[name](spark, sf_dir)
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) is None


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert sum(r.n_rows for r in rows) == 20
    assert all(r.n_prompt_tokens > 0 and r.n_response_tokens > 0 for r in rows)


def test_every_sql_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
