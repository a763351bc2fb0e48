"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize, recorded, tidy


def _round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star pass (Kiveris et al., 2014) over edges with u > v, each by an aggregate and a join: no
    node's neighbours are ever gathered in one row. Edges meet at their larger end after the first pass, where the second
    needs them, so both take three exchanges."""

    def least(at: DataFrame) -> DataFrame:
        return at.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
    large = both.join(least(both).hint("shuffle_hash"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
    small = large.join(least(large).hint("shuffle_hash"), "u")
    edge = lambda k: F.struct(F.col(k).alias("u"), F.col("m").alias("v"))
    return small.select(F.explode(F.array(edge("v"), edge("u"))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges with u > v are stars about their smallest nodes: no node has two edges down or edges of both kinds."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    held = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return held.filter("down > 1 or (down = 1 and up = 1)").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (long columns u, v), as of ``joined_to``."""
    named = joined_to(edges, max_rounds)
    roots = named.select("component").distinct().select(F.col("component").alias("node"), "component")
    return named.union(roots)


def joined_to(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` that reach a smaller one: component is the smallest.

    Loops, repeated edges and edges with a null end are ignored. Each round stores its edges in the shared folder and
    lets go of those of the round before; the number of rounds grows with the logarithm of the largest component.
    """
    spark = edges.sparkSession
    with recorded() as last:
        ends = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
        current = materialize(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(current):
            break
        with recorded() as paths:
            current = materialize(_round(current))
        discard(spark, last)
        last = paths
        tidy(spark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


def joined_further(joined: DataFrame, links: DataFrame) -> DataFrame:
    """``joined``, from ``joined_to``, after more ``links`` (u, v), stored: only the components that these join are looked at."""
    label = lambda k: joined.toDF(k, f"_{k}")
    met = links.select("u", "v").join(label("u"), "u", "left").join(label("v"), "v", "left")
    roots = joined_to(met.select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")))
    known = joined.join(roots.toDF("component", "_root"), "component", "left").select("node", F.coalesce("_root", "component").alias("component"))
    return materialize(known.union(roots))
