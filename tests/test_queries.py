"""Every registered query with SQL gives the same rows as the SQL, over the whole tables of the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
SQL = __spark_entry__.core.oracle_sql()


def plain(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(cursor.fetchall())
