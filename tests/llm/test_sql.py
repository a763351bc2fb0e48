"""Every query of the subpackage that has SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strandframe.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_every_oracle_is_sql():
    import __spark_entry__

    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
