"""Whitening of embeddings by their leading principal components.

Spark sums up the vectors, then the products of the centred vectors, one matrix a task. The covariance, whose size is that
of the dimensions alone, is decomposed on the driver: Householder reflections make it tridiagonal, bisection by Sturm
counts finds the leading eigenvalues, and inverse iteration their vectors, made orthogonal again within clusters. Tasks
then project all vectors on the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import forget, stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Eigenvalues whose gaps are below this share of the matrix's norm are a cluster.
CLUSTER = 1e-3


# --- the eigenproblem -----------------------------------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the reflectors of a symmetric matrix brought to tridiagonal form."""
    a, n, reflectors = v.astype(np.float64, copy=True), len(v), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        rest = np.linalg.norm(x[1:])
        if rest == 0:
            reflectors.append(np.zeros(n - k - 1))
            continue
        x[0] += np.copysign(np.hypot(x[0], rest), x[0])
        u = x / np.linalg.norm(x)
        reflectors.append(u)
        # The lower right block is reflected from both sides by one update of rank two.
        b = a[k + 1 :, k + 1 :]
        p = b @ u
        q = 2 * (p - (u @ p) * u)
        b -= np.outer(u, q) + np.outer(q, u)
        column = a[k + 1 :, k]
        column -= 2 * u * (u @ column)
        column[1:] = 0
        a[k, k + 1 :] = column
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_count(d: np.ndarray, e2: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues are below each x: the negative pivots of the shifted matrix."""
    q = d[0] - x
    count = (q < 0).astype(int)
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < least, -least, q)
        q = d[k] - x - e2[k - 1] / q
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, many: int) -> np.ndarray:
    """The many largest eigenvalues, falling, by bisection down to neighbouring numbers."""
    n = len(d)
    if not n:
        return np.zeros(0)
    reach = np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    low, high = float((d - reach).min()), float((d + reach).max())
    pad = 4 * np.finfo(float).eps * max(abs(low), abs(high)) + np.finfo(float).tiny
    many = min(many, n)
    lo, hi = np.full(many, low - pad), np.full(many, high + pad)
    # The k-th largest has n - k eigenvalues below it, so more than that are below any number above it.
    rank, e2 = n - np.arange(1, many + 1), e**2
    least = max(float(np.finfo(float).eps) * max(abs(low), abs(high)) * 2.0**-60, np.finfo(float).tiny * 4)
    for _ in range(200):
        mid = (lo + hi) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            break
        above = sturm_count(d, e2, mid, least) > rank
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
    return (lo + hi) / 2


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """x of (T - shift) x = b, by elimination with partial pivoting; pivots of zero become least."""
    n = len(d)
    main, up, up2, x = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    for k in range(n - 1):
        below = e[k]
        if abs(main[k]) >= abs(below):
            f = below / (main[k] if main[k] else least)
            main[k + 1] -= f * up[k]
            x[k + 1] -= f * x[k]
        else:
            f = main[k] / below
            main[k], up[k], main[k + 1] = below, main[k + 1], up[k] - f * main[k + 1]
            up2[k], up[k + 1] = up[k + 1], -f * up[k + 1]
            x[k], x[k + 1] = x[k + 1], x[k] - f * x[k + 1]
    for k in range(n - 1, -1, -1):
        x[k] -= (up[k] * x[k + 1] if k + 1 < n else 0) + (up2[k] * x[k + 2] if k + 2 < n else 0)
        x[k] /= main[k] if abs(main[k]) > least else np.copysign(least, main[k])
        if abs(x[k]) > 1e100:
            x /= abs(x[k])
    return x


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One unit eigenvector of the tridiagonal matrix a column, for falling eigenvalues.

    Equal starts from a fixed seed; within a cluster each vector is made orthogonal to the earlier ones at every step.
    """
    n, rng = len(d), np.random.default_rng(1)
    norm = max(float(np.max(np.abs(d), initial=0)), float(np.max(np.abs(e), initial=0)), np.finfo(float).tiny)
    out, first = np.zeros((n, len(values))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # Values that coincide are told apart by a few units in the last place, so that the solutions differ.
        x, near = rng.standard_normal(n), value - (k - first) * 8 * np.finfo(float).eps * norm
        for _ in range(5):
            x = _solve(d, e, near, x / np.linalg.norm(x), np.finfo(float).eps * norm)
            for _ in range(2):
                x /= np.linalg.norm(x)
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def leading(v: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The many largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors, one a column."""
    if not np.any(v):
        return np.zeros(min(many, len(v))), np.eye(len(v), min(many, len(v)))
    d, e, reflectors = tridiagonal(v)
    values = leading_values(d, e, many)
    x = leading_vectors(d, e, values)
    for k in range(len(reflectors) - 1, -1, -1):
        u = reflectors[k]
        x[k + 1 :] -= 2 * np.outer(u, u @ x[k + 1 :])
    # What is left of rounding between the components: orthonormal again, in their order, and values from the matrix.
    for k in range(x.shape[1]):
        x[:, k] -= x[:, :k] @ (x[:, :k].T @ x[:, k])
        x[:, k] /= np.linalg.norm(x[:, k])
    return np.einsum("ik,ik->k", x, v @ x), x


# --- the data -------------------------------------------------------------------------------------------------------


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, whole numbers, as a table; without vectors that are null or hold null or non-finite entries."""
    v = F.transform(vector_col, lambda c: c.cast("double"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & sound)
    return stored(rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x")), "x")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _summed(rows: DataFrame, of, dim: int) -> np.ndarray:
    """The sum over all rows of a matrix that of() makes of a batch; a task adds up its own, Spark adds the tasks'."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = of(batch)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total))], ["i", "row"])

    kind = "long" if of is _sums else "double"
    each = rows.mapInArrow(add, f"i long, row array<{kind}>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((dim, dim) if of is not _sums else (1, dim), dtype=np.int64 if of is _sums else np.float64)
    for r in each.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i, r.j] = r.v
    return out


def _sums(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return _matrix(column, len(column.flatten()) // max(1, len(column))).sum(axis=0)[None, :]


def covariance(x: DataFrame, sums: np.ndarray, n: int) -> np.ndarray:
    """The covariance of x by n, from products of centred vectors."""
    mean, dim = sums / n, len(sums)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        c = _matrix(batch.column(0), dim) - mean
        return c.T @ c

    v = _summed(x.select("x"), products, dim) / n
    return (v + v.T) / 2


def deviations(x: np.ndarray, sums: np.ndarray, n: int) -> list[int | None]:
    """The sum over dimensions of (n*x - S)^2 of each row, exact; null where it does not fit into 64 bits."""
    far = n * np.abs(x - sums / n).max(axis=1, initial=0)
    if len(x) and far.max() * far.max() * x.shape[1] < 2**62 and n * np.abs(x).max(initial=0) < 2**62:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in exact]


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each sound row of vectors (vec_id, embedding) and component: vec_id, component (from 1), n, deviation,
    whitened, explained, identity_error.

    Of vectors of several lengths, those of the most frequent length count, of the longer one of two equally frequent.
    Repeated rows count as often as they stand there, a null id is a value like any other. Components whose eigenvalue
    is zero to working precision (constant dimensions, too few vectors) can't be whitened and give no rows; so do an
    empty table and vectors without entries. deviation is null where it does not fit into a long. Other columns are not
    read.
    """
    whole = quantised(vectors, id_col, vector_col)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usual = whole.groupBy(F.size("x").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    if not usual or not usual.dim:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, n = usual
    x = whole.filter(F.size("x") == dim)
    sums = _summed(x.select("x"), _sums, dim)[0]
    v = covariance(x, sums, n)
    values, basis = leading(v, components)
    trace = float(np.trace(v))
    kept = values > dim * np.finfo(float).eps * max(trace, 0.0)
    values, basis = values[kept], basis[:, kept]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast((sums, basis / np.sqrt(values)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, frame = shared.value
        for batch in batches:
            rows = _matrix(batch.column(1), len(total))
            y = (rows - total / n) @ frame
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(rows, total, n), pa.int64()), pa.array(list(y), pa.list_(pa.float64()))], ["vec_id", "deviation", "y"])

    rows = stored(x.select("vec_id", "x").mapInArrow(project, "vec_id long, deviation long, y array<double>"), "whitened")
    forget(whole)
    error = identity_error(rows, len(values))
    shares = F.array(*[F.lit(float(e) / trace) for e in values])
    out = rows.select("vec_id", "deviation", F.posexplode("y").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(rows: DataFrame, dim: int) -> float:
    """The largest entry of the covariance of y minus the identity, over all rows."""
    at = lambda i: F.get("y", F.lit(i))
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    means = [F.avg(at(i)).alias(f"m{i}") for i in range(dim)]
    products: list[Column] = [F.avg(at(i) * at(j)).alias(f"p{i}_{j}") for i, j in pairs]
    r = rows.agg(*means, *products).first()
    return max((abs(r[f"p{i}_{j}"] - r[f"m{i}"] * r[f"m{j}"] - (i == j)) for i, j in pairs), default=0.0)
