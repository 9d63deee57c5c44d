"""Embedding whitening by mixed-precision refinement.

The covariance is summed in tasks, as matrix products of centred blocks. Its
eigenvectors are found in float32 and corrected in float64 by the iterations of
Ogita and Aishima, which use matrix products only: the residuals of
orthogonality and of diagonality give a first-order correction of all vectors
at once. Where eigenvalues are too close for that correction, the vectors of a
cluster are right as a subspace only; a small eigenproblem inside the subspace,
shifted by the cluster's mean, settles them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import stage

#: Matrices of this many rows and columns at most come to the driver.
MOST_DIMENSIONS = 4096
#: Refinements at most; each squares the error, so float32 vectors need two or three.
MOST_STEPS = 12
#: Rows of a block in a task.
BLOCK = 4096


def grid(vector: Column) -> Column:
    """floor(256 * c) of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(F.lit(256.0) * c.cast("double")))


def usable(vector: Column) -> Column:
    """True where the vector has entries and all are there and finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _blocks(batch: pa.RecordBatch, column: str, dims: int) -> Iterator[np.ndarray]:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    for at in range(0, batch.num_rows, BLOCK):
        yield flat[at * dims:min(at + BLOCK, batch.num_rows) * dims].reshape(-1, dims)


def _summed(rows: DataFrame, column: str, dims: int, block, width: int, kind) -> np.ndarray:
    """Sum of ``block(rows x dims)``, ``width`` numbers, over all rows: tasks add
    up their blocks, a grouped sum the tasks; ``width`` numbers come back."""
    name, arrow = ("long", pa.int64()) if kind is np.int64 else ("double", pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, kind)
        for batch in batches:
            for x in _blocks(batch, column, dims):
                total += block(x)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total, arrow)], ["i", "v"])

    out = np.zeros(width, kind)
    for i, v in rows.select(column).mapInArrow(run, f"i int, v {name}").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    return out


def covariance(rows: DataFrame, column: str, dims: int, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance of the vectors with divisor n, centred before multiplying."""
    def block(x):
        z = x.astype(np.float64) - mean
        return (z.T @ z).ravel()
    found = _summed(rows, column, dims, block, dims * dims, np.float64).reshape(dims, dims) / n
    return (found + found.T) / 2


def _clusters(value: np.ndarray, close: float) -> Iterator[np.ndarray]:
    """Index sets of neighbouring eigenvalues (rising) that are at most ``close`` apart."""
    cut = np.flatnonzero(np.diff(value) > close) + 1
    return (part for part in np.split(np.arange(len(value)), cut) if len(part) > 1)


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of the symmetric ``a`` in
    double precision, from vectors ``x`` of lower precision.

    R = I - X'X and S = X'AX give the eigenvalues d = S_ii / (1 - R_ii) and the
    correction E_ij = (S_ij + d_j R_ij) / (d_j - d_i), or R_ij / 2 where the gap
    is within the error bound of S and R; X(I + E) is the next X. Vectors of gaps
    within that bound form clusters; each is rotated by the eigenvectors of the
    small matrix X_J'(A - mI)X_J, m the cluster's mean, whose gaps are wide
    against its own size."""
    p, size = len(a), np.linalg.norm(a, 2) if a.size else 0.0
    x = x.astype(np.float64)
    if size == 0.0:
        return np.zeros(p), np.eye(p)
    last = np.inf
    for _ in range(MOST_STEPS):
        r = np.eye(p) - x.T @ x
        s = x.T @ a @ x
        s = (s + s.T) / 2  # rounding that is not symmetric would cost orthogonality
        d = np.diag(s) / (1.0 - np.diag(r))
        order = np.argsort(d, kind="stable")
        x, r, s, d = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], d[order]
        close = 2.0 * (np.linalg.norm(s - np.diag(d), 2) + size * np.linalg.norm(r, 2))
        gap = d[None, :] - d[:, None]
        far = np.abs(gap) > close
        e = np.where(far, (s + d[None, :] * r) / np.where(far, gap, 1.0), r / 2.0)
        x = x + x @ e
        for part in _clusters(d, close):
            q, _ = np.linalg.qr(x[:, part])
            middle = d[part].mean()
            _, w = np.linalg.eigh(q.T @ (a @ q - middle * q))
            x[:, part] = q @ w
        change = np.abs(e).max()
        if change < 4 * np.finfo(np.float64).eps or change >= last and last < 1e-12:
            break
        last = change
    s, r = x.T @ a @ x, np.eye(p) - x.T @ x
    d = np.diag(s) / (1.0 - np.diag(r))
    order = np.argsort(d, kind="stable")
    x = x[:, order]
    return d[order], x / np.linalg.norm(x, axis=0)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns): float32, refined in float64."""
    scale = np.abs(a).max() if a.size else 0.0
    _, rough = np.linalg.eigh((a / scale if scale else a).astype(np.float32))
    value, vector = refine(a, rough)
    return value[::-1], vector[:, ::-1]


def whiten(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = 4) -> DataFrame:
    """A row for each usable row of ``rows`` and each of the first ``components``
    components: vec_id, component, n, deviation, whitened, explained,
    identity_error.

    Entries become x = floor(256 * c). The fit list is each distinct x-vector
    once: n of them with sums S. deviation is the sum over the dimensions of
    (n * x - S)^2, exact (NULL where it does not fit a long); whitened the
    projection of x - S/n on a unit eigenvector of the list's covariance over
    the root of its eigenvalue; explained the eigenvalue's share of the trace;
    identity_error the largest entry of the whitened list's covariance minus
    the identity, measured over the list.

    A NULL or empty vector or one with a NULL or non-finite entry gives no row. A NULL id
    stays, repeated rows give repeated results and count once in the fit; equal
    eigenvalues (ties) have some orthonormal basis of their space, the same for
    all rows. Where an eigenvalue is not above rounding (constant dimensions, one
    distinct vector) whitened is NULL and identity_error leaves the component
    out; explained is NULL where the trace is 0. Fewer dimensions than
    ``components`` give fewer rows, no usable rows give none.
    Vectors of different lengths raise ValueError, as do more than
    MOST_DIMENSIONS dimensions or sums beyond a long. Other columns are not
    looked at."""
    spark = rows.sparkSession
    v = F.col(vector)
    points = rows.where(usable(v)).select(F.col(row_id).alias("vec_id"), grid(v).alias("x"))
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = stage(points.select("x").distinct(), "fit")
    n, low, dims, top = fit.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")),
                                F.max(F.array_max(F.transform("x", lambda c: F.abs(c))))).first()
    if not n:
        return spark.createDataFrame([], out)
    if low != dims or dims > MOST_DIMENSIONS:
        raise ValueError(f"vectors of one length, {MOST_DIMENSIONS} at most, are expected; found {low} to {dims}")
    if n * top >= 1 << 62:
        raise ValueError("sums of the entries do not fit a long")
    total = _summed(fit, "x", dims, lambda x: x.sum(axis=0), dims, np.int64)
    mean = total / n
    cov = covariance(fit, "x", dims, mean, n)
    value, basis = eigen(cov)
    k = min(components, dims)
    live = int(np.sum(value[:k] > dims * np.finfo(np.float64).eps * max(value[0], 0.0)))
    matrix = basis[:, :live] / np.sqrt(value[:live])
    trace = float(np.trace(cov))
    error = None
    if live:
        def one(x):
            return ((x - mean) @ matrix).sum(axis=0)

        centre = _summed(fit, "x", dims, one, live, np.float64) / n

        def two(x):
            w = (x - mean) @ matrix - centre
            return (w.T @ w).ravel()
        found = _summed(fit, "x", dims, two, live * live, np.float64).reshape(live, live) / n
        error = float(np.abs(found - np.eye(live)).max())
    explained = [float(value[i]) / trace if trace > 0 else None for i in range(k)]
    exact = dims * (n * top + int(np.abs(total).max())) ** 2 < 1 << 63

    def deviations(x):
        if exact:
            z = x * n - total
            return (z * z).sum(axis=1)
        sums = [sum((int(n) * int(c) - int(s)) ** 2 for c, s in zip(row, total)) for row in x]
        return np.array([s if s < 1 << 63 else None for s in sums], object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(batch, "x", dims):
                m = len(x)
                w = np.full((m, k), np.nan)
                w[:, :live] = (x - mean) @ matrix
                ids = batch.column("vec_id").slice(at, m)
                at += m
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(deviations(x), k), pa.int64()),
                    pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel())),
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64())], [c.split()[0] for c in out.split(", ")])

    return points.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, out)
