"""Queries of the subpackage with SQL give the same rows as the SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from bibspark.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = __spark_entry__.queries()[name](spark, DATA)
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(cursor.fetchall())


def test_columns(spark):
    wanted = {
        "p1_found": {"name_a": "string", "name_b": "string"}, "p2_found": {"group_id": "int", "survivor_id": "bigint", "doi_id": "bigint", "year_id": "bigint", "venue_id": "bigint"},
        "p4_found": {"id_a": "bigint", "id_b": "bigint"}, "p5_found": {"field": "string", "publication_id": "bigint"}, "p7_ids": {"doc_id": "bigint", "ids": "array<int>"},
        "p8_found": {"item_id": "bigint", "doc_id": "bigint"}, "p9_found": {"doc_id": "bigint"},
    }
    if os.path.isdir(DATA):
        for name, columns in wanted.items():
            assert dict(queries.queries()[name](spark, DATA).dtypes) == columns
