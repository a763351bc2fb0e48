"""What jobs leave on disk while they go on."""

from pathlib import Path

from pyspark.sql import functions as F
from strandframe.llm import minhash
from strandframe.operators import graph
from strandframe.operators.storage import recorded


def left(paths):
    return [p for p in paths if Path(p.removeprefix("file:")).exists()]


def test_components_keep_the_last_round_only(spark):
    edges = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    with recorded() as paths:
        got = graph.components(edges)
    assert len(paths) > 3 and len(left(paths)) == 1
    assert {tuple(r) for r in got.select("node", "component").collect()} == {(n, 0) for n in range(41)}


def test_components_of_stars_take_no_round(spark):
    stars = spark.range(1, 40).select((F.col("id") * 100 % 7).alias("u"), (F.col("id") + 100).alias("v"))
    with recorded() as paths:
        got = graph.components(stars)
    assert len(paths) == 1
    assert {tuple(r) for r in got.collect()} == {(r.v, r.u) for r in stars.collect()} | {(n, n) for n in range(7)}


def test_more_links_join_what_was_joined(spark):
    links = lambda *x: spark.createDataFrame(list(x), "u long, v long")
    joined = graph.joined_further(graph.joined_to(links((5, 6), (6, 7), (2, 9))), links((7, 9), (3, 4), (1, 3), (6, 5)))
    assert sorted(map(tuple, joined.collect())) == [(3, 1), (4, 1), (5, 2), (6, 2), (7, 2), (9, 2)]


def test_waves_are_all_rows_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "WAVE_ROWS", 40)
    waves = [[r[0] for r in w.collect()] for w in minhash._waves(spark.range(100), "id")]
    assert len(waves) == 3 and all(waves) and sorted(sum(waves, [])) == list(range(100))
    assert len(list(minhash._waves(spark.range(1000), "id"))) == minhash.WAVES
