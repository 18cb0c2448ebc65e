"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided
Jacobi on the triangular factor.

Method.  A component ``c`` becomes the whole number ``x = floor(64 c) +
1000000``.  ``n`` and the sums S are exact; the scatter sums products of
``x - S/n`` (centred before multiplying).  Cholesky with complete pivoting
factors the scatter as ``G G'`` and ends at its numerical rank; plane rotations
of G's columns (never of the scatter) make them orthogonal.  Then a column's
squared norm is an eigenvalue of the scatter and the column over its norm the
eigenvector, small eigenvalues to high relative accuracy.  A row's whitened
values are its centred x projected on the components, over the square root of
the covariance's eigenvalue.

Scale.  Three passes over the vectors: sums, scatter, and the covariance of
what was whitened.  Each task adds up its rows and sends one row a dimension
(or pair of dimensions); the totals, bounded by the square of the dimension,
come to the driver, where they are factored.  The last pass writes the rows.

Defined cases.  Null vectors and those with null or non-finite components are
left out.  If lengths differ, vectors of the commonest length take part (of two
as common, the longer) and the others are left out; empty vectors have no
components and give no rows.  Directions without variance (beyond the numerical
rank) are no components, so one row alone, or equal rows only, give no rows.
Repeated rows and null ids are kept as they are.  A component beyond 2^52 / 64
in size, or a deviation beyond 64 bits, ends the job with an error rather than
with a wrong number.  An empty table gives no rows.  Of the input only the id
and vector columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: components returned
COMPONENTS = 32
# Fixed values of the whole-number form.
GRID, SHIFT = 64, 1_000_000
#: a pivot below this share of the largest ends the factorisation
RANK_EPS = 1e-14
#: columns are orthogonal when their cosine is below this
JACOBI_EPS = 1e-15


def cholesky(scatter: np.ndarray, eps: float = RANK_EPS) -> np.ndarray:
    """G (d x rank) with ``G G' = scatter``, by complete pivoting: in the order
    of the pivots its rows are lower triangular."""
    d = len(scatter)
    left = np.diag(scatter).astype(np.float64).copy()
    g, free = np.zeros((d, d)), np.ones(d, bool)
    first = left.max(initial=0.0)
    for k in range(d):
        p = int(np.argmax(np.where(free, left, -1.0)))
        if left[p] <= eps * first or left[p] <= 0:
            return g[:, :k]
        free[p] = False
        root = np.sqrt(left[p])
        g[free, k] = (scatter[free, p] - g[free, :k] @ g[p, :k]) / root
        g[p, k] = root
        left -= g[:, k] ** 2
    return g


def jacobi(g: np.ndarray, eps: float = JACOBI_EPS, sweeps: int = 60) -> np.ndarray:
    """G with its columns rotated against each other until all are orthogonal.
    A round rotates disjoint pairs; ``r - 1`` rounds meet every pair once."""
    g = g.copy()
    r = g.shape[1]
    if r < 2:
        return g
    size = r + r % 2  # an odd one sits out
    ring = np.arange(size)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(size - 1):
            a, b = ring[: size // 2], ring[size // 2 :][::-1]
            use = (a < r) & (b < r)
            a, b = a[use], b[use]
            x, y = g[:, a], g[:, b]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(xy) / np.maximum(np.sqrt(xx * yy), 1e-300)
            worst = max(worst, float(cosine.max()))
            turn = cosine > eps
            safe = np.where(turn, xy, 1.0)
            zeta = (yy - xx) / (2.0 * safe)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            c = 1.0 / np.hypot(1.0, t)
            g[:, a], g[:, b] = c * x - c * t * y, c * t * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst <= eps:
            break
    return g


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the scatter."""
    g = jacobi(cholesky(scatter))
    norms = np.sqrt((g * g).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    if not len(order):
        return np.zeros(0), np.zeros((len(scatter), 0))
    u = g[:, order] / norms[order]
    largest = np.abs(u).argmax(0)
    return norms[order] ** 2, u * np.sign(u[largest, np.arange(u.shape[1])])


def _whole(batch: pa.RecordBatch) -> np.ndarray:
    """x less the shift, as whole numbers."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and np.abs(flat).max() >= (1 << 52) / GRID:
        raise ValueError("a vector component is too large for the whole-number form")
    return np.floor(GRID * flat).astype(np.int64).reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dimension, sum) of a task; sums in pieces that fit 64 bits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        y = _whole(batch)  # below 2^52 in size, at most 10,000 rows: the sum of halves fits
        high, low = (y >> 26).sum(0), (y & ((1 << 26) - 1)).sum(0)
        yield pa.record_batch([pa.array(np.arange(y.shape[1], dtype=np.int32)), pa.array(high), pa.array(low)], names=["i", "high", "low"])


def _pairs(total: np.ndarray) -> pa.RecordBatch:
    d = len(total)
    i, j = np.triu_indices(d)
    return pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])


def _scatter(mean: np.ndarray, turn: np.ndarray | None):
    """(i, j, sum of products) of a task's centred rows, turned by ``turn`` if
    given; index d stands for the constant 1, so sums come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _whole(batch) - mean
            z = z if turn is None else z @ turn
            z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield _pairs(total)

    return run


def _gather(rows: DataFrame, mean: np.ndarray, turn: np.ndarray | None, d: int) -> np.ndarray:
    total = np.zeros((d + 1, d + 1))
    for i, j, v in rows.select("vector").mapInArrow(_scatter(mean, turn), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():  # (d + 1)^2 / 2 numbers
        total[i, j] = total[j, i] = v
    return total


def _project(mean: np.ndarray, turn: np.ndarray, n: int, sums: list[int]):
    exact = np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _whole(batch)
            z = (y - mean) @ turn
            bound = (n * float(np.abs(y).max()) + float(max(map(abs, sums), default=0))) ** 2 * y.shape[1]
            if bound < 2.0**62:
                deviation = ((n * y - np.array(sums, np.int64)) ** 2).sum(1)
            else:  # whole numbers of any size
                deviation = [int(x) for x in ((n * y.astype(object) - exact) ** 2).sum(1)]
            at = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], pa.int32())
            yield pa.record_batch([batch.column("id"), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(at, pa.array(z.ravel()))], names=["id", "deviation", "z"])

    return run


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.filter(F.col(vector_col).isNotNull() & ~bad).select(F.col(id_col).alias("id"), v.alias("vector"))
    lengths = kept.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return kept.filter(F.size("vector") == d)


def whiten(rows: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error):
    a row for each vector and component."""
    kind = rows.schema[id_col].dataType.simpleString()
    kept = usable(rows, id_col, vector_col)
    n = kept.count()
    wide = "decimal(38,0)"
    got = kept.select("vector").mapInArrow(_sums, "i int, high long, low long").groupBy("i").agg(F.sum(F.col("high").cast(wide)), F.sum(F.col("low").cast(wide))).collect()
    sums = [0] * len(got)
    for i, high, low in got:  # one row a dimension
        sums[i] = int(high) * (1 << 26) + int(low)
    mean = np.array([s / n for s in sums])
    scatter = _gather(kept, mean, None, len(sums))[: len(sums), : len(sums)] if sums else np.zeros((0, 0))
    e, u = components(scatter)
    trace = float(np.trace(scatter))
    e, u = e[:k], u[:, :k]
    turn = u / np.sqrt(e / max(n, 1))
    check = _gather(kept, mean, turn, len(e)) / max(n, 1)
    centre = check[: len(e), len(e)]
    error = float(np.abs(check[: len(e), : len(e)] - np.outer(centre, centre) - np.eye(len(e))).max(initial=0.0))
    share = F.array(*(F.lit(float(x)) for x in e / trace)) if len(e) else F.array().cast("array<double>")
    out = kept.mapInArrow(_project(mean, turn, n, sums), f"id {kind}, deviation long, z array<double>")
    return out.select("id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
