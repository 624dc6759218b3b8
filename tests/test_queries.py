"""Every query with an oracle gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from fluvia import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def shown(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


def same(df, result):
    columns = sorted(df.columns)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    return got == sorted(tuple(shown(row[i]) for i in at) for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_against_sql(spark, sf_dir, duck, name):
    assert same(q.QUERIES[name](spark, sf_dir), duck.sql(q.SQL[name]))


def test_entry(spark):
    assert entry.entry(spark).count() == 228
    assert set(entry.oracle_sql()) <= set(entry.queries())
