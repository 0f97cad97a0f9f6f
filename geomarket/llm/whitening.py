"""Whitening of embeddings: principal components of their covariance, and every vector in their coordinates.

Two passes over the vectors make the covariance: sums for each dimension, then products of the
centred entries, d x d numbers a task. Entries are whole numbers and are centred at the whole
number next to their mean, so that products and sums are exact whatever the order in which
tasks end; what remains of the mean, below 0.5, is taken off afterwards. The matrix, bounded by
the dimension, is made tridiagonal by Householder reflections; bisection on Sturm counts finds
the leading eigenvalues, and inverse iteration, with vectors of close eigenvalues kept
orthogonal, the components. They are broadcast, and each vector is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomarket.llm.tasks import fields, rows_from

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
# Entries beyond this count as this, so that whole numbers stay within 64 bits.
LARGEST = 2.0**30
# Rows turned at once.
BLOCK = 4096
_EPS = float(np.finfo(float).eps)


class Tridiagonal(NamedTuple):
    diagonal: np.ndarray
    beside: np.ndarray
    reflections: np.ndarray  # row k is the unit vector of the k-th reflection, or zero


def tridiagonalise(matrix: np.ndarray) -> Tridiagonal:
    """Householder reflections, one for each column, of a symmetric matrix."""
    a = np.array(matrix, dtype=float)
    d = len(a)
    mirrors = np.zeros((max(d - 2, 0), d))
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        size = np.abs(x).max()
        if size == 0 or not np.any(x[1:]):
            continue
        x /= size
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        v = x / np.linalg.norm(x)
        mirrors[k, k + 1:] = v
        p = a[k + 1:, k + 1:] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1:, k + 1:] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
    return Tridiagonal(np.diag(a).copy(), np.diag(a, -1).copy(), mirrors)


def below(t: Tridiagonal, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: the negative pivots of the shifted matrix."""
    tiny = _EPS**2 * max(np.abs(t.diagonal).max(), np.abs(t.beside).max(initial=0.0)) + np.finfo(float).tiny
    squares = t.beside**2
    count, pivot = np.zeros(len(shifts), dtype=int), 1.0
    for k in range(len(t.diagonal)):
        pivot = t.diagonal[k] - shifts - (squares[k - 1] / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_eigenvalues(t: Tridiagonal, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until no number lies between its bounds."""
    d = len(t.diagonal)
    reach = np.zeros(d)
    reach[:-1] += np.abs(t.beside)
    reach[1:] += np.abs(t.beside)
    bottom, top = (t.diagonal - reach).min(), (t.diagonal + reach).max()
    margin = 2 * _EPS * max(abs(bottom), abs(top)) * d + np.finfo(float).tiny
    low, high = np.full(k, bottom - margin), np.full(k, top + margin)
    # The j-th largest is the first number that d - j eigenvalues lie below.
    rank = d - 1 - np.arange(k)
    for _ in range(200):
        middle = low + (high - low) / 2
        if not np.any((middle > low) & (middle < high)):
            break
        upper = below(t, middle) > rank
        high = np.where(upper, middle, high)
        low = np.where(upper, low, middle)
    return low + (high - low) / 2


def _solve(diagonal: np.ndarray, beside: np.ndarray, right: np.ndarray, tiny: float) -> np.ndarray:
    """Elimination with row exchanges for a symmetric tridiagonal matrix; a vanishing pivot becomes ``tiny``."""
    d = len(diagonal)
    main, under, x = diagonal.tolist(), beside.tolist(), right.tolist()
    over, far = [*under, 0.0], [0.0] * d
    for k in range(d - 1):
        if abs(under[k]) > abs(main[k]):
            factor = main[k] / under[k]
            main[k], over[k], far[k], main[k + 1], over[k + 1] = (
                under[k], main[k + 1], over[k + 1], over[k] - factor * main[k + 1], -factor * over[k + 1])
            x[k], x[k + 1] = x[k + 1], x[k] - factor * x[k + 1]
        else:
            main[k] = main[k] or tiny
            factor = under[k] / main[k]
            main[k + 1] -= factor * over[k]
            x[k + 1] -= factor * x[k]
    for k in range(d - 1, -1, -1):
        known = (over[k] * x[k + 1] if k + 1 < d else 0.0) + (far[k] * x[k + 2] if k + 2 < d else 0.0)
        x[k] = (x[k] - known) / (main[k] if abs(main[k]) > tiny else tiny)
    return np.array(x)


def components(t: Tridiagonal, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector of the original matrix for each value, as rows, orthogonal to each other.

    Inverse iteration cannot tell the vectors of close values apart, so each is kept
    orthogonal to the ones found before in its cluster.
    """
    d, norm = len(t.diagonal), max(np.abs(t.diagonal).max(), np.abs(t.beside).max(initial=0.0)) or 1.0
    numbers = np.random.default_rng(d)
    found = np.zeros((len(values), d))
    for j, value in enumerate(values):
        # Equal values are shifted apart by rounding's width, or their iterations would be the same.
        cluster = [i for i in range(j) if values[i] - value <= 1e-3 * norm]
        shifted = t.diagonal - (value - len(cluster) * 4 * _EPS * norm)
        z = numbers.standard_normal(d)
        for _ in range(6):
            for _ in range(2):
                for i in cluster:
                    z -= (found[i] @ z) * found[i]
            z /= np.abs(z).max()
            z /= np.linalg.norm(z)
            z = _solve(shifted, t.beside, z, _EPS * norm)
        z /= np.abs(z).max()
        for _ in range(2):
            for i in cluster:
                z -= (found[i] @ z) * found[i]
        found[j] = z / np.linalg.norm(z)
    for mirror in t.reflections[::-1]:
        found -= 2 * np.outer(found @ mirror, mirror)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


class Fit(NamedTuple):
    n: int
    sums: np.ndarray  # of each dimension, exact
    values: np.ndarray  # leading eigenvalues of the covariance, falling
    axes: np.ndarray  # a unit eigenvector a row
    trace: float

    @property
    def near(self) -> np.ndarray:
        """The whole number next to each mean."""
        return (2 * self.sums + self.n) // (2 * self.n)

    @property
    def rest(self) -> np.ndarray:
        """What the mean has beyond it."""
        return (self.sums - self.n * self.near) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near - self.rest) @ self.axes.T / np.sqrt(self.values)


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose entries are all there and finite, every row's number of entries, and all entries, one after another."""
    column = column.cast(pa.large_list(pa.float64()))
    present = column.is_valid().to_numpy(zero_copy_only=False)
    entries = column.flatten()
    size = np.where(present, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    flat = entries.fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    end = np.cumsum(size)
    return present & (size > 0) & (bad[end] == bad[end - size]), size, flat


def whole_numbers(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable vector of d entries, and these as whole numbers."""
    good, size, flat = _usable(column)
    good &= size == d
    x = np.floor(SCALE * np.clip(flat[np.repeat(good, size)], -LARGEST, LARGEST)).astype(np.int64) + SHIFT
    return np.flatnonzero(good), x.reshape(-1, d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows and sums of each dimension, for every length of vector in a batch."""
    for batch in batches:
        good, size, _ = _usable(batch["vector"])
        for d in np.unique(size[good]).tolist():
            _, x = whole_numbers(batch["vector"], d)
            yield {"size": np.full(d, d, dtype=np.int32), "at": np.arange(d, dtype=np.int32),
                   "rows": np.full(d, len(x)), "total": x.sum(axis=0)}


def _products(vectors, width: int):
    """Sums of the products of every two columns of ``vectors(batch)``, over a partition."""
    first, second = np.triu_indices(width)

    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((width, width))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                y = vectors(batch.slice(start, BLOCK))
                total += y.T @ y
        for start in range(0, len(first), 1 << 16):
            i, j = first[start:start + (1 << 16)], second[start:start + (1 << 16)]
            yield {"i": i.astype(np.int32), "j": j.astype(np.int32), "total": total[i, j]}
    return produce


def _matrix(rows: DataFrame, vectors, width: int) -> np.ndarray:
    """The sums of products over all rows; only width x width numbers reach the driver."""
    cells = rows_from(rows, _products(vectors, width), fields(i="int", j="int", total="double")).groupBy("i", "j").agg(
        F.sum("total").alias("total")).toArrow()
    matrix = np.zeros((width, width))
    i, j = cells["i"].to_numpy(), cells["j"].to_numpy()
    matrix[i, j] = matrix[j, i] = cells["total"].to_numpy()
    return matrix


def fit(rows: DataFrame, k: int = COMPONENTS) -> Fit | None:
    """Sums, leading eigenvalues and components of the column ``vector``; None without a usable vector."""
    sums = rows_from(rows, _sums, fields(size="int", at="int", rows="long", total="long")).groupBy("size", "at").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    most = sums.where("at = 0").orderBy(F.desc("rows"), F.desc("size")).first()
    if most is None:
        return None
    d, n = most["size"], most["rows"]
    total = np.array([int(r.total) for r in sums.where(F.col("size") == d).orderBy("at").collect()], dtype=object)
    start = Fit(n, total.astype(np.int64), np.ones(1), np.eye(1, d), 0.0)
    near, rest = start.near, start.rest

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return (whole_numbers(batch["vector"], d)[1] - near).astype(float)

    covariance = _matrix(rows, centred, d) / n - np.outer(rest, rest)
    t = tridiagonalise(covariance)
    values = leading_eigenvalues(t, min(k, d))
    # A component without variance has no unit to be measured in.
    values = values[values > 16 * d * _EPS * max(np.trace(covariance), 0.0)]
    return start._replace(values=values, axes=components(t, values), trace=float(np.trace(covariance)))


def whiten(embeddings: DataFrame, k: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained and identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so
    are vectors of another length than most have (the longer length, where two are equally
    frequent). Entries beyond 2^30 count as 2^30. Repeated rows and rows without a vec_id count
    like others. Components whose variance is nothing but rounding are left out, so equal
    vectors give no rows, as an empty table does. ``deviation`` is null where it exceeds a long.
    Other columns are ignored.
    """
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    schema = fields(vec_id="long", component="int", n="long", deviation="long", whitened="double", explained="double",
                    identity_error="double")
    fitted = fit(rows, k)
    if fitted is None or not len(fitted.values):
        return embeddings.sparkSession.createDataFrame([], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
    # As a plain tuple: a broadcast, unlike a task, does not carry this module's classes along.
    model = embeddings.sparkSession.sparkContext.broadcast(tuple(fitted))
    d, k = len(fitted.sums), len(fitted.values)

    def with_one(batch: pa.RecordBatch) -> np.ndarray:
        w = Fit(*model.value).whitened(whole_numbers(batch["vector"], d)[1])
        return np.column_stack([w, np.ones(len(w))])

    measured = _matrix(rows, with_one, k + 1) / fitted.n
    mean = measured[k, :k]
    error = float(np.abs(measured[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = Fit(*model.value)
        explained = own.values / own.trace
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                good, x = whole_numbers(batch["vector"], d)
                apart = own.n * x - own.sums
                fits = (apart.astype(float)**2).sum(axis=1) < 2.0**63
                deviation = pa.array((apart * apart).sum(axis=1), mask=~fits)
                ids = batch["id"].take(pa.array(good))
                each = pa.array(np.repeat(np.arange(len(good)), k))
                yield {
                    "vec_id": ids.take(each), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(good)),
                    "n": np.full(len(good) * k, own.n), "deviation": deviation.take(each),
                    "whitened": own.whitened(x).ravel(), "explained": np.tile(explained, len(good)),
                    "identity_error": np.full(len(good) * k, error)}

    return rows_from(rows, project, schema)
