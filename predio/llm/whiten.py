"""Whitening of embeddings: leading components of the covariance by contour integration (FEAST).

Spark computes sums, the covariance and the projections of all rows; the covariance, whose size is
that of one vector squared, is decomposed on the driver.  Its eigenvalues are enclosed by inertia
counts: the number of negative pivots of the shifted matrix is the number of eigenvalues below the
shift.  For every interval so found, a rational filter built from complex shifted solves at the
nodes of a Gauss-Legendre rule on a circle around it projects random vectors onto the interval's
eigenspace, and a Rayleigh-Ritz step extracts its eigenpairs.  An interval is done when it yields as
many pairs, with small residuals, as the inertia counts say it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from predio.llm.frames import without
from predio.scale import settle

NODES = 8  # quadrature nodes on the upper half circle
ROUNDS = 30
SEED = 7
_BLOCK = 1 << 12  # vectors worked on at once


# --- eigenpairs in an interval ------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a, n = matrix.astype(np.float64).copy(), len(matrix)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0.0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        part = a[k + 1 :, k:]
        part -= 2.0 * np.outer(x, x @ part)
        part = a[k:, k + 1 :]
        part -= 2.0 * np.outer(part @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


class Inertia:
    """Counts of eigenvalues below a shift, by Sylvester's law."""

    def __init__(self, matrix: np.ndarray):
        self.diagonal, self.off = tridiagonal(matrix)
        self.tiny = np.finfo(np.float64).tiny / np.finfo(np.float64).eps + np.finfo(np.float64).eps ** 2 * np.abs(matrix).max(initial=0.0)

    def below(self, shift: float) -> int:
        count, pivot = 0, 1.0
        for i, d in enumerate(self.diagonal):
            pivot = d - shift - (self.off[i - 1] ** 2 / pivot if i else 0.0)
            if abs(pivot) < self.tiny:
                pivot = -self.tiny
            count += pivot < 0
        return int(count)


def _enclose(inertia: Inertia, low: float, high: float, wanted: int, total: int, apart: float) -> list[tuple[float, float, int]]:
    """Intervals ``(a, b, count)``, highest first, that hold the ``wanted`` largest eigenvalues.

    An interval is halved while it holds more than one eigenvalue and is wider than ``apart``; one
    that stays shorter than that holds eigenvalues that are equal for all purposes.
    """
    out, found = [], 0
    stack = [(low, high, inertia.below(low), total)]
    while stack and found < wanted:
        a, b, under, until = stack.pop()
        if until == under:
            continue
        if until - under == 1 or b - a <= apart:
            out.append((a, b, until - under))
            found += until - under
            continue
        middle = (a + b) / 2
        between = inertia.below(middle)
        stack += [(a, middle, under, between), (middle, b, between, until)]  # the upper half first
    return out


def _tighten(inertia: Inertia, a: float, b: float, count: int, apart: float) -> tuple[float, float]:
    """A shorter interval with the same eigenvalues well inside and none of the others near its circle."""
    under = inertia.below(a)
    low, high = a, b
    while high - low > apart:
        middle = (low + high) / 2
        n = inertia.below(middle)
        if n == under:
            low = middle
        elif n == under + count:
            high = middle
        else:
            break
    # The circle may reach out to where the interval before it began.
    room = max(high - low, apart)
    return max(a, low - room), min(b, high + room)


def contour_pairs(matrix: np.ndarray, a: float, b: float, count: int, scale: float, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues (ascending) and unit eigenvectors of ``matrix`` in ``[a, b]``."""
    n = len(matrix)
    width = min(n, max(2 * count, count + 4))
    points, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 - points)  # the upper half circle; the lower one is its conjugate
    center, radius = (a + b) / 2, (b - a) / 2
    vectors = np.random.default_rng(seed).standard_normal((n, width))
    best, eye = None, np.eye(n)
    for _ in range(ROUNDS):
        filtered = np.zeros_like(vectors)
        for angle, weight in zip(angles, weights):
            turn = radius * np.exp(1j * angle)
            solved = np.linalg.solve((center + turn) * eye - matrix, vectors.astype(np.complex128))
            filtered += (weight / 2) * (turn * solved).real
        basis, size, _ = np.linalg.svd(filtered, full_matrices=False)
        basis = basis[:, size > size[0] * 1e-14] if size[0] > 0 else basis
        values, small = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ small
        # Ritz values nearest to the interval's middle are the candidates.
        inside = np.sort(np.argsort(np.abs(values - center), kind="stable")[:count])
        residual = np.linalg.norm(matrix @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0).max()
        slack = scale * 1e-13
        fits = bool(np.all((values[inside] >= a - slack) & (values[inside] <= b + slack)))
        if fits and len(inside) == count and (best is None or residual < best[0]):
            improved = best is None or residual < 0.5 * best[0]
            best = (residual, values[inside], vectors[:, inside])
        else:
            improved = False
        if best is not None and (best[0] <= scale * 1e-15 or (not improved and best[0] <= scale * 1e-12)):
            break
        if vectors.shape[1] < width:  # directions lost: fill up
            more = np.random.default_rng(seed + 1).standard_normal((n, width - vectors.shape[1]))
            vectors = np.hstack([vectors, more])
    if best is None or best[0] > scale * 1e-10:
        raise ArithmeticError(f"the contour around [{a}, {b}] did not give its {count} eigenpairs")
    vectors = best[2] / np.linalg.norm(best[2], axis=0)
    return best[1], vectors


def leading_pairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) of a covariance and their unit eigenvectors.

    The sign of a vector makes its entry of largest size positive.  Eigenvalues that vanish against
    the largest one (below its 1e-12) have no components.
    """
    n = len(matrix)
    bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger
    if n == 0 or bound == 0.0:
        return np.empty(0), np.empty((n, 0))
    inertia = Inertia(matrix)
    apart = bound * 1e-11
    low, high = -bound * 1.0001 - apart, bound * 1.0001 + apart
    vectors = []
    for a, b, count in _enclose(inertia, low, high, wanted, n, apart):
        a, b = _tighten(inertia, a, b, count, apart)
        if inertia.below(b) - inertia.below(a) != count:
            raise ArithmeticError("the interval lost an eigenvalue")
        vectors.append(contour_pairs(matrix, a, b, count, bound)[1])
    # Vectors of close eigenvalues in two intervals are made orthogonal by one more Rayleigh-Ritz step.
    basis, _ = np.linalg.qr(np.hstack(vectors))
    values, small = np.linalg.eigh(basis.T @ matrix @ basis)
    values, vectors = values[::-1][:wanted], (basis @ small)[:, ::-1][:, :wanted]
    kept = values > values[0] * 1e-12
    values, vectors = values[kept], vectors[:, kept]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.sign(top)


# --- over the rows ------------------------------------------------------------


def integral(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * entry)`` of every entry, as longs; null for a vector with an entry that is no number."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    # NaN and the infinities are the values that differ from themselves minus themselves plus zero.
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(entries, lambda c: F.floor(c * scale).cast("bigint")))


def _matrix(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64).reshape(-1, dim)


def _total(df: DataFrame, width: int, work) -> np.ndarray:
    """Sum over all tasks of the double arrays of ``width`` entries that ``work`` gives for blocks of rows."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(width), False
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                any_rows = True
                total += work(batch.slice(at, _BLOCK))
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], schema=arrow)

    out = np.zeros(width)
    for row in df.mapInArrow(run, schema).groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():
        out[row["i"]] = row["v"]
    return out


def _sums(df: DataFrame, dim: int) -> np.ndarray:
    """Exact sums per entry, as Python integers."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.DecimalType(38, 0))])
    partial = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.LongType())])
    arrow = to_arrow_schema(partial)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch, 0, dim).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], schema=arrow)

    rows = df.select("x").mapInArrow(run, partial).groupBy("i").agg(F.sum(F.col("v").cast(schema["v"].dataType)).alias("v"))
    out = [0] * dim
    for row in rows.toLocalIterator():
        out[row["i"]] = int(row["v"])
    return np.array(out, dtype=object)


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``n`` vectors with ``sums``, eigenvalues and unit eigenvectors (columns)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return (self.sums / self.n).astype(np.float64) if self.n else np.zeros(len(self.sums))


def fit(x: DataFrame, dim: int, components: int = 4) -> Whitening:
    """Fit on all rows of ``x``, a stored table with the array column ``x`` of ``dim`` longs.

    Two passes: the exact sums, then the covariance of centred vectors, divided by their number; a
    third one measures how far the whitened vectors' covariance is from the identity.
    """
    n = x.count()
    sums = _sums(x, dim) if n else np.array([0] * dim, dtype=object)
    if not n:
        return Whitening(0, sums, np.empty(0), np.empty((dim, 0)), 0.0, 0.0)
    mean = (sums / n).astype(np.float64)

    def gram(batch: pa.RecordBatch) -> np.ndarray:
        y = _matrix(batch, 0, dim) - mean
        return (y.T @ y).ravel()

    covariance = _total(x.select("x"), dim * dim, gram).reshape(dim, dim) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading_pairs(covariance, min(components, dim))
    k = len(values)
    project = vectors / np.sqrt(values) if k else vectors
    error = 0.0
    if k:

        def first(batch: pa.RecordBatch) -> np.ndarray:
            return ((_matrix(batch, 0, dim) - mean) @ project).sum(axis=0)

        center = _total(x.select("x"), k, first) / n

        def second(batch: pa.RecordBatch) -> np.ndarray:
            w = (_matrix(batch, 0, dim) - mean) @ project - center
            return (w.T @ w).ravel()

        error = float(np.abs(_total(x.select("x"), k * k, second).reshape(k, k) / n - np.eye(k)).max())
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)), error)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Exact sums of ``(n * x - sums) ** 2``: in 64 bits where they must fit, else in Python's integers."""
    most = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max((abs(s) for s in sums), default=0)
    if x.shape[1] * most * most < 1 << 63:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    return ((n * x.astype(object) - sums) ** 2).sum(axis=1).tolist()


def whiten(df: DataFrame, vector: str = "embedding", components: int = 4, scale: int = 256) -> tuple[DataFrame, Whitening]:
    """``df``'s usable rows without the vector, plus ``whitened`` (array of doubles) and ``deviation``; and the fit.

    A vector of numbers is scaled and floored to integers; the fit counts each distinct one once,
    however many rows hold it.  Rows whose vector is null or holds a null, NaN or infinite entry are
    dropped, and so are those whose length is not the most frequent one (of several, the greatest).
    ``deviation`` (decimal) is the exact sum of ``(n * x - sum) ** 2``.  Components whose variance
    vanishes are left out, so constant vectors have none; an empty table gives an empty table.  Rows
    with a null key and repeated rows are rows like others; columns of ``df`` named like a new or an
    inner one are replaced.
    """
    own = without(df, [c for c in ("x", "whitened", "deviation") if c.lower() != vector.lower()])
    kept = [c for c in own.columns if c != vector]
    rows = own.withColumn("x", integral(F.col(f"`{vector}`"), scale)).drop(vector).filter(F.col("x").isNotNull())
    sizes = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 0
    rows = rows.filter(F.size("x") == dim)
    distinct = settle(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "vectors")
    fitted = fit(distinct, dim, components)
    n, sums, mean = fitted.n, fitted.sums, fitted.mean
    project = fitted.vectors / np.sqrt(fitted.values) if len(fitted.values) else fitted.vectors
    kinds = [f for f in rows.schema.fields if f.name != "x"]
    schema = T.StructType(
        [*kinds, T.StructField("whitened", T.ArrayType(T.DoubleType(), False)), T.StructField("deviation", T.DecimalType(38, 0))]
    )
    arrow = to_arrow_schema(schema)
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], "x")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(at, _BLOCK)
                x = _matrix(batch, len(kinds), dim) if dim else np.zeros((batch.num_rows, 0), np.int64)
                # A product of vectors and matrix would depend on the batch; sums by row do not.
                w = np.stack([((x - mean) * project[:, j]).sum(axis=1) for j in range(project.shape[1])], axis=1) if project.shape[1] else np.empty((len(x), 0))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
                values = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
                exact = pa.array([Decimal(d) for d in _deviation(x, n, sums)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).cast(arrow.field(i).type) for i in range(len(kinds))], values.cast(arrow.field(len(kinds)).type), exact],
                    schema=arrow,
                )

    return rows.mapInArrow(apply, schema), fitted
