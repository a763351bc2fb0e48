"""Approximate nearest neighbours by an adaptive scan of dimensions within the lists of an inverted file.

Vectors of length one are turned by one random rotation, so that any few of their dimensions are a fair sample of a
distance. Centres fitted on a bounded sample cut them into lists. A query meets its nearest list first and takes its k-th
best score there as a threshold; then it goes to the next lists. In a list the rotated vectors lie in blocks of columns.
After each block a test asks whether a distance as large as what the columns so far make likely could still be within the
threshold (Gao and Long, 2023: observed * D / d > (1 + e / sqrt(d))^2 * threshold); pairs that fail it are left at once.
What is left is scored by the cosine of the vectors as they were given.

Some queries are first compared with all vectors, which tells how many lists are needed. Where the search then finds too few
of their true best, all queries read twice as many lists; at last all lists without the test, which is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SAMPLE, LISTS = 16_384, 1024  # vectors that centres are fitted on, and centres, at most
BLOCK, PART = 8192, 1024  # vectors and queries of one task, at most about
COLUMNS, STRICT = 16, 2.5  # columns of a block; deviations of the test
SEED, CHUNK = 64, 1024  # vectors scored in full before there is a threshold, and then met at once
PROBES, AUDIT, AIM = 8, 128, 0.98
SALTS = 32

HIT = "qhi long, qlo long, hi long, lo long, least_id long, score double"


def _takes_part(id_col: str, vec_col: str) -> Column:
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(id_col).isNotNull() & finite & F.exists(F.col(vec_col), lambda x: x != 0), F.lit(False))


def _marked(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, hi, lo, v) of the rows that take part: the vector as doubles, told by hi and lo."""

    def convert(batches):
        import xxhash

        for batch in batches:
            rows = []
            for values in batch.column(1).to_pylist():
                x = np.asarray(values, dtype=np.float64) + 0.0
                rows.append(x[: np.flatnonzero(x)[-1] + 1].tobytes())  # zeros at the end say nothing
            marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r) for r in rows), dtype=">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(rows, pa.binary())], ["vec_id", "hi", "lo", "v"])

    chosen = vectors.filter(_takes_part(id_col, vec_col)).select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"))
    return chosen.mapInArrow(convert, "vec_id long, hi long, lo long, v binary")


def _vectors(column, dim: int) -> np.ndarray:
    """Rows as doubles, scaled by powers of two so that no square is too large or small; a cosine stays the same."""
    x = np.frombuffer(b"".join(r.ljust(8 * dim, b"\0") for r in column.to_pylist()), dtype=np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diagonal(r))


def _centres(nodes: DataFrame, n: int, dim: int) -> np.ndarray:
    """Unit vectors about which the lists lie: spherical k-means over a sample of SAMPLE nodes at most, in one task."""
    share, k = min(1.0, 0.9 * SAMPLE / n), int(min(LISTS, max(1, round(n**0.5))))

    def fit(key, sample):
        sample = sample.take(pa.array(np.lexsort((sample.column("lo").to_numpy(), sample.column("hi").to_numpy()))))
        x = _vectors(sample.column("v"), dim)
        x = x / _lengths(x)[:, None]
        centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
        for _ in range(8):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            size = _lengths(sums)
            centres[size > 0] = sums[size > 0] / size[size > 0, None]
        return pa.table({"c": pa.array([c.tobytes() for c in centres], pa.binary())})

    some = nodes.filter(F.pmod(F.xxhash64("hi", "lo", F.lit(11)), F.lit(1_000_000)) < share * 1_000_000).select(F.lit(0).alias("one"), "hi", "lo", "v")
    told = some.groupBy("one").applyInArrow(fit, "c binary").collect()
    if not told:  # no node of a small table fell into the sample
        told = nodes.limit(1).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(fit, "c binary").collect()
    return np.frombuffer(b"".join(r["c"] for r in told), dtype=np.float64).reshape(-1, dim)


def _nearest_lists(rows: DataFrame, centres: np.ndarray, dim: int, first: int, last: int) -> DataFrame:
    """``rows`` once for each of the lists that are the ``first`` to ``last`` (from 0, without) nearest, as a column list."""
    names = rows.columns

    def near(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _vectors(part.column(names.index("v")), dim)
                cos = x @ centres.T
                order = np.argsort(-cos, axis=1, kind="stable")[:, first:last]
                again = part.take(pa.array(np.repeat(np.arange(len(x)), order.shape[1])))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(order.ravel().astype(np.int32))], [*names, "list"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(near, f"{kinds}, list int")


def _scan(k: int, dim: int, strict: float):
    """The ``k`` best vectors of one block of a list for each query of a part that asks for it."""
    turn = _rotation(dim)
    bounds = [*range(0, dim, COLUMNS), dim]

    def scan(left, right):
        ids = lambda t, c: t.column(c).to_numpy()
        order = np.lexsort((ids(left, "lo"), ids(left, "hi")))
        x, q = _vectors(left.column("v"), dim)[order], _vectors(right.column("v"), dim)
        nx, nq = _lengths(x), _lengths(q)
        rx, rq = (x / nx[:, None]) @ turn, (q / nq[:, None]) @ turn
        blocks = [(np.ascontiguousarray(rx[:, a:b]), np.ascontiguousarray(rq[:, a:b])) for a, b in zip(bounds, bounds[1:])]
        least_id = ids(left, "least_id")[order]
        need = ids(right, "need").astype(np.float64).copy()
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def score(i, j):
            out = np.empty(len(i))
            for s in range(0, len(i), 1 << 15):
                a, b = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
                out[s : s + (1 << 15)] = np.einsum("ij,ij->i", q[a], x[b]) / (nq[a] * nx[b])
            return out

        at = 0
        while at < len(x):
            to = min(len(x), at + (CHUNK if at else SEED))
            within = 2 - 2 * need  # the square of the distance that the k-th best has
            (bx, bq), seen = blocks[0], bounds[1]
            part = (bq * bq).sum(axis=1)[:, None] + (bx[at:to] ** 2).sum(axis=1) - 2 * (bq @ bx[at:to].T)
            i, j = np.nonzero(part * (dim / seen) <= (1 + strict / seen**0.5) ** 2 * within[:, None] + 1e-9)
            d, j = part[i, j], j + at
            for (bx, bq), seen in zip(blocks[1:], bounds[2:]):
                if seen == dim:
                    break  # the score itself takes the last columns in
                for s in range(0, len(i), 1 << 15):
                    diff = bq[i[s : s + (1 << 15)]] - bx[j[s : s + (1 << 15)]]
                    d[s : s + (1 << 15)] += np.einsum("ij,ij->i", diff, diff)
                go = d * (dim / seen) <= (1 + strict / seen**0.5) ** 2 * within[i] + 1e-9
                i, j, d = i[go], j[go], d[go]
            cos = score(i, j)
            go = cos >= need[i]
            i, j, cos = (np.concatenate(p) for p in zip(best, (i[go], j[go], cos[go])))
            by = np.lexsort((least_id[j], -cos, i))
            i, j, cos = i[by], j[by], cos[by]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            best = i, j, cos = i[keep], j[keep], cos[keep]
            ends = np.flatnonzero(np.r_[i[1:] != i[:-1], True]) if len(i) else np.zeros(0, int)
            full = ends[ends - np.searchsorted(i, i[ends]) == k - 1]
            need[i[full]] = np.maximum(need[i[full]], cos[full])
            at = to
        i, j, cos = best
        found = [pa.array(ids(right, c)[i]) for c in ("hi", "lo")] + [pa.array(ids(left, c)[order][j]) for c in ("hi", "lo", "least_id")]
        return pa.table([*found, pa.array(cos)], names=["qhi", "qlo", "hi", "lo", "least_id", "score"])

    def cell(left, right):
        if left.num_rows and right.num_rows:
            return scan(left, right)
        return pa.table({c: pa.array([], pa.float64() if c == "score" else pa.int64()) for c in ("qhi", "qlo", "hi", "lo", "least_id", "score")})

    return cell


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best vectors of each query, ties to that of the smallest id."""
    by = Window.partitionBy("qhi", "qlo").orderBy(F.col("score").desc(), "least_id", "hi", "lo")
    return hits.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).drop("_r")


def _met(listed: DataFrame, sizes: DataFrame, asked: DataFrame, k: int, dim: int, strict: float) -> DataFrame:
    """Hits of queries with the lists that they ask for. ``sizes`` has one row a list (LISTS at most)."""
    parts = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    wide = F.broadcast(sizes.join(parts, "list"))
    left = listed.join(wide, "list").withColumn("block", F.pmod(F.xxhash64("hi", "lo"), F.col("blocks")).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "block", "part", "hi", "lo", "least_id", "v")
    right = asked.join(wide, "list").withColumn("part", F.pmod(F.xxhash64("hi", "lo"), F.col("parts")).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "part", "hi", "lo", "v", "need")
    at = ["list", "block", "part"]
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_scan(k, dim, strict), HIT)


def _truth(listed: DataFrame, audited: list, k: int, dim: int) -> DataFrame:
    """The ``k`` best of all vectors, and their lists, for each of the audited queries (2 * AUDIT at most, so they go to
    every task)."""
    hi, lo = (np.array([r[c] for r in audited], dtype=np.int64) for c in ("hi", "lo"))
    q = _vectors(pa.array([bytes(r["v"]) for r in audited], pa.binary()), dim)
    nq = _lengths(q)

    def brute(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                x = _vectors(part.column(4), dim)
                cos = (q @ x.T) / (nq[:, None] * _lengths(x))
                j = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                i = np.repeat(np.arange(len(q)), j.shape[1])
                rest = part.select([0, 1, 2, 3]).take(pa.array(j.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(hi[i]), pa.array(lo[i]), *rest.columns, pa.array(np.take_along_axis(cos, j, 1).ravel())], ["qhi", "qlo", "hi", "lo", "least_id", "list", "score"])

    return _best(listed.select("hi", "lo", "least_id", "list", "v").mapInArrow(brute, "qhi long, qlo long, hi long, lo long, least_id long, list int, score double"), k)


def _probes(audited: list, truth: list, centres: np.ndarray, dim: int, aim: float) -> int:
    """How many lists the audited queries must read to meet ``aim`` of their true best, half of what may be missed kept
    for the test."""
    order = np.argsort(-(_vectors(pa.array([bytes(r["v"]) for r in audited], pa.binary()), dim) @ centres.T), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    at = {(r["hi"], r["lo"]): i for i, r in enumerate(audited)}
    needed = np.sort([rank[at[r["qhi"], r["qlo"]], r["list"]] for r in truth])
    return max(PROBES, int(needed[int(np.ceil((1 + aim) / 2 * len(needed))) - 1]) + 1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", aim: float = AIM) -> DataFrame:
    """(query_id, rank, vec_id, score, recall): the ``k`` nearest rows found of every query row by cosine, nearest first,
    ties to the smaller id, rank from 1.

    ``is_query`` is a condition on the column vec_id. A row is no candidate of a query of its id. Null vectors, null ids,
    vectors that are empty, all zero or hold a null or non-finite component take no part; shorter vectors count as zero
    where longer ones go on. Equal vectors are searched as one and their rows all compete; equal rows are one; rows that
    share an id but differ are candidates of their own, and a query id takes the best over its vectors. An empty table,
    or one without queries, gives an empty one; other columns are left out.

    recall is what the last audit measured: the share of the true best of AUDIT queries, against all vectors, that was
    found; it is at least ``aim``, as at last all lists are read without the test. Centres are fitted on a sample of SAMPLE
    vectors; every vector is in a list. There are LISTS lists at most, so beyond about LISTS ** 2 vectors a query's work
    grows with the table. A task holds BLOCK vectors and PART queries.
    """
    spark, most = vectors.sparkSession, k + 1
    rows = materialize(_marked(vectors, id_col, vec_col))
    dim = (rows.agg(F.max(F.length("v"))).first()[0] or 8) // 8
    # of equal vectors only the most smallest ids can be among a query's best
    own = Window.partitionBy("hi", "lo", "_salt").orderBy("vec_id")
    few = rows.dropDuplicates(["hi", "lo", "vec_id"]).withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    few = few.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= most)
    among = Window.partitionBy("hi", "lo").orderBy("vec_id")
    members = materialize(few.withColumn("place", F.row_number().over(among)).filter(F.col("place") <= most).drop("_salt", "_r"))
    nodes = members.filter("place = 1").select("hi", "lo", F.col("vec_id").alias("least_id"), "v")
    asking = materialize(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "hi", "lo").distinct())
    schema = "query_id long, rank int, vec_id long, score double, recall double"
    n = nodes.count()
    if not n or asking.isEmpty():
        return spark.createDataFrame([], schema)
    centres = _centres(nodes, n, dim)
    lists = len(centres)
    listed = materialize(_nearest_lists(nodes, centres, dim, 0, 1))
    sizes = materialize(listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    queries = materialize(nodes.join(asking.select("hi", "lo").distinct(), ["hi", "lo"], "left_semi").select("hi", "lo", "v"))

    share = int(min(1.0, AUDIT / queries.count()) * 1_000_000)
    audited = queries.filter(F.pmod(F.xxhash64("hi", "lo", F.lit(5)), F.lit(1_000_000)) < share).limit(2 * AUDIT).collect()
    audited = audited or queries.limit(1).collect()
    truth = _truth(listed, audited, most, dim).collect()
    true = {(r["qhi"], r["qlo"], r["hi"], r["lo"]) for r in truth}
    those = vectors.sparkSession.createDataFrame([(r["hi"], r["lo"]) for r in audited], "qhi long, qlo long")

    hits, strict, first, last = None, STRICT, 0, 1
    probes = min(lists, _probes(audited, truth, centres, dim, aim))
    while True:
        if hits is None:
            asked = queries.withColumn("need", F.lit(-1.0))
        else:
            least = hits.groupBy("qhi", "qlo").agg(F.when(F.count(F.lit(1)) == most, F.min("score")).otherwise(-1.0).alias("need"))
            asked = queries.join(least.select(F.col("qhi").alias("hi"), F.col("qlo").alias("lo"), "need"), ["hi", "lo"], "left").withColumn("need", F.coalesce("need", F.lit(-1.0)))
        found = _met(listed, sizes, _nearest_lists(asked, centres, dim, first, last), most, dim, strict)
        hits = materialize(_best((found if hits is None else found.union(hits)).distinct(), most))
        if last >= probes:
            of_audited = hits.join(F.broadcast(those), ["qhi", "qlo"], "left_semi").select("qhi", "qlo", "hi", "lo").collect()
            recall = len(true & set(map(tuple, of_audited))) / len(true)
            if recall >= aim or strict == float("inf"):
                break
            probes = min(lists, 2 * probes)
        first, last = last, probes
        if first == last:  # all lists were read
            first, strict = 0, float("inf")

    best = _best(hits, most).select("qhi", "qlo", "hi", "lo", "score").join(members.select("hi", "lo", "vec_id"), ["hi", "lo"])
    by = Window.partitionBy("qhi", "qlo").orderBy(F.col("score").desc(), "vec_id")
    few = materialize(best.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= most).select(F.col("qhi").alias("hi"), F.col("qlo").alias("lo"), "vec_id", "score"))
    told = asking.join(few, ["hi", "lo"]).filter("vec_id <> query_id")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return told.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.lit(float(recall)).alias("recall"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
