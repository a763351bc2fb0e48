"""Exact top-k inner products of a query set against all vectors.

Candidates are sorted by length, longest first, and dealt to groups in that order. All queries meet the longest group,
in lanes, and take their k-th best score there as a threshold. A query is then sent only to groups whose greatest length
times its own can reach the threshold (Cauchy-Schwarz), and a group only to the parts of the queries that ask for it: what
can't matter is not shipped. Where they meet, vectors are rotated to the axes of the corpus' second moments, so that the
first axes hold most of an inner product; a pair is given up as soon as its partial sum and the bound of the rest can't
reach the threshold, whole blocks go by their greatest length alone, and what is left is scored in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

GROUP, QUERY_GROUP, BLOCK, LANES = 8192, 4096, 1024, 8
STEPS = 64  # thresholds are rounded down to powers of 2 ** (1 / STEPS)
HITS = "query_id long, vec_id long, score long"


def _integer_rows(vectors: DataFrame, id_col: str, vec_col: str, scale: int, dim: int) -> DataFrame:
    """(vec_id, v, norm): components as floor(scale * x), 64-bit integers; vectors with an invalid component go."""

    def convert(batches):
        for batch in batches:
            column = batch.column(1)
            keep, rows = [], []
            for i, values in enumerate(column.to_pylist()):
                if values is None or None in values:
                    continue
                x = np.asarray(values, dtype=np.float64)
                if np.isfinite(x).all():
                    keep.append(i)
                    rows.append(np.pad(np.floor(scale * x), (0, dim - len(x))).astype(np.int64))
            norms = [float(np.sqrt((r.astype(np.float64) ** 2).sum())) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "v", "norm"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>")).filter("vec_id is not null").mapInArrow(convert, "vec_id long, v binary, norm double")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(-1, dim)


def principal_axes(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, the greatest first, from their summed outer products (dim * dim cells)."""

    def outer(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["cell", "x"])

    cells = rows.select("v").mapInArrow(outer, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros(dim * dim)
    for cell, x in cells:
        gram[cell] = x
    return np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1].copy()


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best distinct candidates of each query."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    new = np.r_[True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])] if len(query) else np.zeros(0, bool)
    query, ids, score = query[new], ids[new], score[new]
    start = np.searchsorted(query, query)
    keep = np.arange(len(query)) - start < k
    return query[keep], ids[keep], score[keep]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _search(axes: np.ndarray, k: int, dim: int):
    first, second = max(1, dim // 4), max(1, dim // 2)

    def search(left, right):
        found = (np.zeros(0, np.int64),) * 3
        if left.num_rows and right.num_rows:
            order = np.argsort(-left.column("norm").to_numpy(), kind="stable")
            c = _matrix(left.column("v"), dim)[order]
            cid, cnorm = left.column("vec_id").to_numpy()[order], left.column("norm").to_numpy()[order]
            q, qid, qnorm = _matrix(right.column("asked"), dim), right.column("query_id").to_numpy(), right.column("length").to_numpy()
            least = right.column("least").to_numpy().astype(np.float64)
            cr, qr = c @ axes, q @ axes
            rest = lambda x, h: np.sqrt(np.maximum((x[:, h:] ** 2).sum(axis=1), 0))
            c1, q1, c2, q2 = rest(cr, first), rest(qr, first), rest(cr, second), rest(qr, second)
            slack = 1e-9 * max(1.0, float(qnorm.max() * cnorm.max()))
            for at in range(0, len(c), BLOCK):
                to = min(at + BLOCK, len(c))
                live = np.flatnonzero(qnorm * cnorm[at] >= least - slack)
                if not len(live):
                    break
                bound = qr[live, :first] @ cr[at:to, :first].T + q1[live, None] * c1[None, at:to]
                i, j = np.nonzero(bound >= (least[live] - slack)[:, None])
                i, j = live[i], j + at
                ok = np.zeros(len(i), dtype=bool)
                for s in range(0, len(i), 1 << 16):
                    a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    ok[s : s + (1 << 16)] = _dot(qr[a, :second], cr[b, :second]) + q2[a] * c2[b] >= least[a] - slack
                ok &= qid[i] != cid[j]
                i, j = i[ok], j[ok]
                score = np.concatenate([_dot(q[i[s : s + (1 << 16)]], c[j[s : s + (1 << 16)]]) for s in range(0, len(i), 1 << 16)] or [np.zeros(0, np.int64)])
                found = _best(np.r_[found[0], i], np.r_[found[1], cid[j]], np.r_[found[2], score], k)
                ends = np.flatnonzero(np.r_[found[0][1:] != found[0][:-1], True]) if len(found[0]) else np.zeros(0, int)
                full = ends[ends - np.searchsorted(found[0], found[0][ends]) == k - 1]
                least[found[0][full]] = np.maximum(least[found[0][full]], found[2][full])
            found = (qid[found[0]], found[1], found[2])
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    return search


def _bucket(x: Column) -> Column:
    return F.floor(F.log2(x) * STEPS)


def _reach(stored: DataFrame, asked: DataFrame, groups: int) -> DataFrame:
    """``asked`` with reach, the last group that can hold a score of ``least`` or more, as far as lengths tell; queries
    that no later group can serve are left out. The table of steps is bounded by the range of a double, so it is
    broadcast."""
    tops = stored.filter("grp > 0").groupBy("grp").agg(F.max("norm").alias("norm")).filter("norm > 0")
    steps = tops.groupBy(_bucket(F.col("norm")).alias("step")).agg(F.max("grp").alias("last"))
    low, high = steps.agg(F.min("step"), F.max("step")).first()
    some = (F.col("least") > 0) & (F.col("length") > 0)
    if low is None:  # all other candidates are zero
        return asked.filter(~some).withColumn("reach", F.lit(groups - 1))
    line = asked.sparkSession.range(low, high + 1).withColumnRenamed("id", "step").join(steps, "step", "left")
    line = line.withColumn("reach", F.max("last").over(Window.orderBy(F.col("step").desc()))).drop("last")
    step = F.greatest(F.lit(low), _bucket(F.col("least") / F.col("length") * (1 - 1e-9)))
    told = asked.withColumn("step", F.when(some, step)).join(F.broadcast(line), "step", "left").drop("step")
    return told.withColumn("reach", F.when(some, F.col("reach")).otherwise(groups - 1)).filter("reach > 0")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best scores of every query row, ties to the smaller id, rank from 1.

    ``is_query`` is a condition on the column vec_id. A row is no candidate of a query with its id; equal rows are one,
    and rows that share an id are one candidate, and one query, for each of their vectors. Null vectors, null ids and vectors with a null or non-finite
    component take no part; shorter vectors count as zero where others go on; an empty table gives an empty one. Work is
    queries times candidates less what the bounds save; a task holds GROUP candidates and QUERY_GROUP queries.
    """
    dim = vectors.agg(F.max(F.size(F.col(vec_col)))).first()[0] or 1
    dim = max(1, dim)
    rows = materialize(_integer_rows(vectors, id_col, vec_col, scale, dim))
    axes = principal_axes(rows, dim)
    n = rows.count()
    groups = max(1, -(-n // GROUP))
    sorted_rows = rows.repartitionByRange(groups, F.col("norm").desc(), F.col("vec_id")) if groups > 1 else rows.repartition(1)
    stored = materialize(sorted_rows.withColumn("grp", F.spark_partition_id()))
    queries = materialize(stored.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("asked"), F.col("norm").alias("length")))
    parts = max(1, -(-queries.count() // QUERY_GROUP))
    search, cell = _search(axes, k, dim), ["cell", "part"]

    every = F.sequence(F.lit(0), F.lit(parts - 1))
    lanes = stored.filter("grp = 0").withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.lit(LANES)).cast("int")).withColumn("part", F.explode(every))
    asked = queries.withColumn("least", F.lit(float("-inf"))).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    hits = first = materialize(lanes.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(search, HITS))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    if groups > 1:
        least = first.distinct().withColumn("_k", F.row_number().over(best)).filter(F.col("_k") == k).select("query_id", F.col("score").cast("double").alias("least"))
        asked = queries.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        reached = _reach(stored, asked, groups)
        # queries of a like reach form parts; there are at most as many kinds of them as bits in a group's number
        reached = materialize(reached.withColumn("kind", F.floor(F.log2(F.col("reach").cast("double"))).cast("int")))
        kinds = [(r["kind"], r["reach"], -(-r["n"] // QUERY_GROUP)) for r in reached.groupBy("kind").agg(F.max("reach").alias("reach"), F.count(F.lit(1)).alias("n")).collect()]
        spread = F.lit(1)
        for kind, _, lanes in kinds:
            spread = F.when(F.col("kind") == kind, lanes).otherwise(spread)
        reached = reached.withColumn("part", (F.col("kind") * (1 << 24) + F.pmod(F.xxhash64("query_id"), spread)).cast("int")).drop("kind")
        ranges = vectors.sparkSession.createDataFrame(kinds, "kind int, reach int, lanes int")
        wanted = ranges.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("lanes") - 1), lambda x: F.col("kind") * (1 << 24) + x)))
        wanted = wanted.select("part", F.explode(F.sequence(F.lit(1), F.col("reach"))).alias("grp"))
        later = stored.filter("grp > 0").join(wanted, "grp").withColumnRenamed("grp", "cell")
        asked = reached.withColumn("cell", F.explode(F.sequence(F.lit(1), F.col("reach")))).drop("reach")
        hits = first.union(later.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(search, HITS))
    return hits.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, 256)


OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM (SELECT DISTINCT * FROM scored)
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
