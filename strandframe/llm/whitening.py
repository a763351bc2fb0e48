"""Whitening of embeddings by spectrum slicing.

Sums and centred second moments of the distinct vectors come from Spark, one row a dimension or a cell. The covariance
(dim x dim, whatever the number of rows) is taken apart on the driver: an LDLᵀ factorisation of V - s I has as many
positive pivots as V has eigenvalues above s, so bisecting s isolates each leading eigenvalue. Rayleigh quotient iteration
converges within its interval, cubically, and two more counts certify that it is the i-th. Rows are projected where they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

COMPONENTS = 16
PIVOT = (1 + 17**0.5) / 8  # a diagonal pivot is taken where it is at least this share of the largest entry
EPS = np.finfo(np.float64).eps
LIMIT = 2**62
NEGLIGIBLE = 1e-13  # eigenvalues up to this share of the trace are zero


# --- eigenpairs of one symmetric matrix --------------------------------------------------------------------------


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are greater than ``shift``: the positive pivots of an LDLᵀ
    factorisation, blocks of two where no diagonal entry will do."""
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        size = np.abs(a)
        d = int(np.diagonal(size).argmax())
        p, q = divmod(int(size.argmax()), len(a))
        if size[p, q] == 0:
            break
        if p == q or size[d, d] >= PIVOT * size[p, q]:
            positive += a[d, d] > 0
            rest = np.delete(np.arange(len(a)), d)
            column = a[rest, d]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[d, d])
        else:  # such a block has one eigenvalue of either sign
            positive += 1
            rest, both = np.delete(np.arange(len(a)), [p, q]), [p, q]
            columns = a[np.ix_(rest, both)]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_(both, both)], columns.T)
    return int(positive)


def _towards(v: np.ndarray, known: np.ndarray) -> np.ndarray | None:
    """``v`` without its parts along ``known``, of length one; None if nothing is left."""
    for _ in range(2):
        v = v - known @ (known.T @ v)
    length = np.sqrt(v @ v)
    return v / length if length > 0 and np.isfinite(length) else None


def _solved(matrix: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    for nudge in (0.0, EPS, 8 * EPS, 64 * EPS):
        try:
            w = np.linalg.solve(matrix - (shift + nudge * scale) * np.eye(len(matrix)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(w).all():
            return w
    raise ArithmeticError("no shift near an eigenvalue gives a solution")


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` greatest eigenvalues of a positive semidefinite matrix, falling, and their unit eigenvectors as
    columns. Those that are nothing but rounding (up to NEGLIGIBLE of the trace) are left out. Eigenvalues that are
    equal to the last digits share a space, of which an orthonormal basis is given."""
    n, trace = len(matrix), float(np.trace(matrix))
    scale = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if not trace > 0:
        return np.zeros(0), np.zeros((n, 0))
    finest, counts = 4 * EPS * scale, {}

    def over(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(matrix, shift)
        return counts[shift]

    values, vectors = [], np.zeros((n, 0))
    start = np.random.default_rng(n)
    floor, top = NEGLIGIBLE * trace, scale * (1 + 8 * EPS)
    for i in range(1, min(count, n) + 1):
        if over(floor) < i:
            break
        low, high = floor, top  # the i-th eigenvalue is above low and not above high
        for s in counts:
            low, high = (max(low, s), high) if counts[s] >= i else (low, min(high, s))
        while True:
            while over(low) - over(high) > 1 and high - low > finest:
                middle = (low + high) / 2
                low, high = (middle, high) if over(middle) >= i else (low, middle)
            alone = over(low) - over(high) == 1
            v, shift, best = _towards(start.normal(size=n), vectors), (low + high) / 2, None
            for step in range(40):
                w = _towards(_solved(matrix, shift, v, scale), vectors)
                if w is None:
                    break
                v = w
                rho = float(v @ matrix @ v)
                left = float(np.sqrt(((matrix @ v - rho * v) ** 2).sum()))
                if best is None or left < best[0]:
                    best, since = (left, rho, v), step
                if best[0] <= 2 * EPS * scale or step - since >= 3:
                    break
                # the quotient leads only once it is in the interval and closer to an eigenvalue than to its ends
                if alone and low <= rho <= high and left < min(rho - low, high - rho):
                    shift = rho
            inside = best is not None and low - finest - best[0] <= best[1] <= high + finest + best[0]
            if inside and best[0] <= 64 * n * EPS * scale or high - low <= finest:
                break
            middle = (low + high) / 2
            low, high = (middle, high) if over(middle) >= i else (low, middle)
        left, rho, v = best
        slack = left + 8 * n * EPS * scale
        if not over(rho + slack) < i <= over(rho - slack):
            raise ArithmeticError(f"eigenvalue {i} is not certified: {over(rho + slack)} above it, {over(rho - slack)} with it")
        values.append(rho)
        vectors = np.column_stack([vectors, v])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[:, order]


# --- the rows ----------------------------------------------------------------------------------------------------


def _whole_numbers(vectors: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, x): floor(scale * c) + shift of every component as 64-bit integers; rows that take no part go."""

    def convert(batches):
        for batch in batches:
            keep, rows = [], []
            for i, values in enumerate(batch.column(1).to_pylist()):
                if values is None or None in values:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    c = np.floor(scale * np.asarray(values, dtype=np.float64))
                if (np.abs(c) < LIMIT / 2).all():
                    keep.append(i)
                    rows.append((c.astype(np.int64) + shift).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(rows, pa.binary())], ["vec_id", "x"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(convert, "vec_id long, x binary")


def _matrix(column: pa.Array, dim: int, shift: int) -> np.ndarray:
    raw = column.to_pylist()
    if any(len(r) != 8 * dim for r in raw):  # shorter vectors count as zero where longer ones go on
        rest = np.full(dim, shift, dtype=np.int64).tobytes()
        raw = [r + rest[len(r) :] for r in raw]
    return np.frombuffer(b"".join(raw), dtype=np.int64).reshape(len(raw), dim)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list]:
    """(x - S / n as doubles, the sum of (n * x - S) ** 2 as integers, None where 64 bits don't hold it)."""
    wide = max([1, *map(abs, sums)]) + n * int(np.abs(x).max(initial=0)) >= LIMIT
    d = (x.astype(object) if wide else x) * n - np.array(sums, dtype=object if wide else np.int64)
    near = d.astype(np.float64)
    squares = (near * near).sum(axis=1)
    told = (d * d).sum(axis=1).tolist() if (squares < LIMIT).all() else [sum(int(v) ** 2 for v in row) for row in d]
    return near / n, [v if v < 2**63 else None for v in told]


def _summed(rows: DataFrame, cells_of) -> dict[int, float | int]:
    """Sums by cell of what ``cells_of`` makes of each batch; a task sends each cell once."""

    def add(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                new = cells_of(batch.column(0))
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "s"])

    kind = "long" if getattr(cells_of, "whole", False) else "double"
    return dict(map(tuple, rows.mapInArrow(add, f"cell long, s {kind}").groupBy("cell").agg(F.sum("s").alias("s")).collect()))


def _dense(cells: dict[int, float], n: int) -> np.ndarray:
    return np.array([cells[i] for i in range(n)])


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row for each row and component.

    A component c of a vector counts as x = floor(scale * c) + shift. Mean and covariance are those of the n distinct
    vectors (divisor n, centred before they are multiplied); every row that takes part is projected on the unit
    eigenvectors of the greatest ``components`` eigenvalues, numbered from 1, over the root of the eigenvalue.
    deviation is the exact sum of (n * x - S) ** 2, null where 64 bits don't hold it; explained the eigenvalue's share of
    the trace; identity_error the largest entry of the whitened vectors' covariance less the identity.

    A vector that is null or holds null or non-finite components, or some whose x 62 bits don't hold, takes no part; null
    ids stay. Shorter vectors count as zero where longer ones go on, so an empty one is all zero. Repeated rows each have
    their rows and are one vector for the fit. Directions without variance are no components: fewer than ``components``
    dimensions or different vectors give fewer, one vector or an empty table none. Other columns are left out. The driver
    holds dim x dim numbers; equal vectors meet after each task has sent one of them.
    """
    rows = materialize(_whole_numbers(vectors, id_col, vec_col, scale, shift))
    dim = (rows.agg(F.max(F.length("x"))).first()[0] or 0) // 8
    distinct = rows.select("x")
    if dim:  # the same vector in a shorter form is the same vector
        filler = bytearray(np.full(dim, shift, dtype=np.int64).tobytes())
        distinct = distinct.select(F.when(F.length("x") == 8 * dim, F.col("x")).otherwise(F.concat("x", F.substring(F.lit(filler), F.length("x") + 1, 8 * dim))).alias("x"))
    fit = materialize(distinct.distinct())
    n = fit.count()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if n < 2 or not dim:
        return vectors.sparkSession.createDataFrame([], schema)

    def sums_of(column):
        return _matrix(column, dim, shift).sum(axis=0)

    sums_of.whole = True
    summed = _summed(fit, sums_of)
    sums = [int(summed[i]) for i in range(dim)]

    def products(column):
        y = _deviations(_matrix(column, dim, shift), n, sums)[0]
        return (y.T @ y).ravel()

    covariance = _dense(_summed(fit, products), dim * dim).reshape(dim, dim) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = leading(covariance, components)
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    explained, to = values / np.trace(covariance), axes / np.sqrt(values)

    def moments(column):
        w = _deviations(_matrix(column, dim, shift), n, sums)[0] @ to
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    told = _dense(_summed(fit, moments), k + k * k) / n
    error = float(np.abs(told[k:].reshape(k, k) - np.outer(told[:k], told[:k]) - np.eye(k)).max())

    def project(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                y, deviation = _deviations(_matrix(part.column(1), dim, shift), n, sums)
                m = len(y)
                place = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column(0).take(place), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(deviation, pa.int64()).take(place), pa.array((y @ to).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), COMPONENTS)
