"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from strandframe.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_motif_graph_holds_motifs_of_every_first_letter(spark):
    rows = catalog.QUERIES["join_motif_graph_whole"](spark, DATA).collect()
    assert {r["a"][0] for r in rows} | {r["b"][0] for r in rows} >= set("ACGT")


@pytest.mark.parametrize("name, kind", [("agg_members_whole", None), ("sort_natural_chrom_whole", "gene"), ("join_interval_sequence_whole", "gene")])
def test_whole_queries_see_short_features(spark, name, kind):
    from strandframe.sources.views import Views

    features = Views(spark, DATA).features
    wanted = features.filter(f"feature_type = '{kind}'") if kind else features
    got = catalog.QUERIES[name](spark, DATA)
    if name == "join_interval_sequence_whole":  # genes past the end of their chromosome have no sequence
        assert got.filter("end_pos - start_pos <= 40").count() > 0
    else:
        assert got.count() == wanted.count()
