"""Queries with a SQL twin, on the smallest given tables."""

import duckdb
import pytest

from loomfold.llm import queries

SF = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    columns = sorted(d[0] for d in cur.description)
    want = [dict(zip([d[0] for d in cur.description], row)) for row in cur.fetchall()]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    rows = lambda found: sorted(tuple(plain(r[c]) for c in columns) for r in found)
    assert rows(df.collect()) == rows(want)
