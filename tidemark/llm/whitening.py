"""Whitening of vectors: their projections on the principal components, each with variance one.

Entries c become integers floor(64 c) + 1000000, and the mean and covariance are those of the distinct integer vectors.
Their number and sums are exact. Tasks centre their vectors and add up the products; a second stage adds up the tasks' matrices
row by row, so that the driver gets one matrix of dimensions x dimensions, whatever the number of vectors. It is factored
there by Cholesky with pivoting, and the columns of the triangular factor are turned in pairs until all are orthogonal
(one-sided Jacobi, all disjoint pairs of a round at once): A = L L', L Q = U s, so the columns' squared norms
are the eigenvalues of A and the columns themselves, made units, the components. The small ones come out as exact as the large ones,
as A is never multiplied again. Whitened vectors' covariance is measured on the vectors, not derived.

Memory: a task holds a batch of vectors and one matrix. Tasks depend on their rows alone, and the factorisation is worked
out once and sent to all, so that a task that runs again projects on the same components.

Defined results: vectors that are null, empty, or hold null or non-finite entries have no rows, nor have those of
another length than most (the shorter, where two are as frequent); entries whose 64-fold is beyond 2^52 are held at that;
components without variance (as many as the Cholesky factor lacks) have no rows, so that vectors all alike give an empty table;
repeated rows and rows that share an id each get theirs; null ids are ids; a deviation of over 38 digits is null;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import need, written

#: Integers of a unit, what is added to them, and components that are given out.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LARGEST = float(1 << 52)
#: A pivot below this share of the largest one, times the dimensions, is taken for rounding.
ROUNDING = 4 * np.finfo(float).eps


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the vectors that count."""
    rows = need(df, id_col, vector_col).toDF("id", "v").withColumn("v", F.col("v").cast("array<double>")).where("v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c * SCALE))).cast("long") + SHIFT
    rows = rows.select("id", F.transform("v", whole).alias("x"))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (length.d if length else 0))


def matrix_of(column: pa.Array) -> np.ndarray:
    """A batch's vectors, all of one length, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the sum in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column(0))
                # 2^10 entries of 2^53 at most fit a long.
                own = sum(x[k : k + 1024].sum(axis=0).astype(object) for k in range(0, len(x), 1024))
                n, total = n + len(x), own if total is None else total + own
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([Decimal(int(v)) for v in (n, *total)], pa.decimal128(38, 0))], ["i", "s"])

    found = fit.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()  # a row a dimension
    values = [int(r.s) for r in found]
    return (values[0], values[1:]) if values else (0, [])


@dataclass(frozen=True)
class Centre:
    """Number of vectors and their exact sums, as whole means and what is left of them."""

    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole numbers first, so that nothing is lost to their size."""
        whole, rest = self.parts()
        return (x - whole) - np.array([r / self.n for r in rest])

    def parts(self) -> tuple[np.ndarray, list[int]]:
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(whole, np.int64), [s - self.n * m for s, m in zip(self.sums, whole)]

    def deviation(self, x: np.ndarray) -> list[int]:
        """sum of (n x - S)^2 over the dimensions of each row, exactly: n^2 sum y^2 - 2 n sum y r + sum r^2."""
        whole, rest = self.parts()
        y = x - whole
        most = max(int(np.abs(y).max(initial=0)), max(map(abs, rest)))
        fits = most < 1 << 31 and most * most * x.shape[1] < 1 << 62
        y, r = (y, np.array(rest, np.int64)) if fits else (y.astype(object), np.array(rest, object))
        squares, mixed, fixed = (y * y).sum(axis=1), (y * r).sum(axis=1), sum(v * v for v in rest)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + fixed for a, b in zip(squares, mixed)]


def scatter(fit: DataFrame, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of v v' over the rows, where v are the values of a row."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                v = values(matrix_of(b.column(0)))
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), matrix_of(b.column(1)) if b.num_rows else []):
                total[i] = total[i] + row if i in total else row
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "row"])

    kind = "i int, row array<double>"
    found = fit.mapInArrow(products, kind).repartition("i").mapInArrow(added, kind).orderBy("i").collect()  # a row a dimension
    return np.array([r.row for r in found])


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L L' = a, of as many columns as a has rank; row i of L belongs to row i of a."""
    rest, columns = a.astype(float).copy(), []
    least = ROUNDING * len(a) * max(rest.diagonal().max(initial=0.0), 0.0)
    for _ in range(len(a)):
        k = int(rest.diagonal().argmax())
        if rest[k, k] <= least:
            break
        c = rest[:, k] / np.sqrt(rest[k, k])
        columns.append(c)
        rest -= np.outer(c, c)
        rest[k, :] = rest[:, k] = 0.0
    return np.array(columns).T.reshape(len(a), len(columns))


def orthogonal_columns(m: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """m times a rotation, with orthogonal columns, largest first. In each round all columns stand in disjoint pairs; a
    sweep's rounds bring every two together once."""
    m = m[:, np.argsort(-(m * m).sum(axis=0), kind="stable")].copy()
    n = m.shape[1]
    if n < 2:
        return m
    ring = list(range(n)) + [-1] * (n % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if a >= 0 and b >= 0]
            i, j = np.array(pairs).T
            x, y = m[:, i], m[:, j]
            p, q, r = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            open_ = np.abs(r) > 1e-15 * np.sqrt(p * q)
            if open_.any():
                turned = True
                r = np.where(open_, r, 1.0)
                z = (q - p) / (2 * r)
                t = np.where(open_, np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.sqrt(1 + z * z)), 0.0)
                c = 1 / np.sqrt(1 + t * t)
                m[:, i], m[:, j] = c * x - c * t * y, c * t * x + c * y
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if not turned:
            break
    return m[:, np.argsort(-(m * m).sum(axis=0), kind="stable")]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling, above zero) and unit eigenvectors (columns) of a positive semidefinite matrix."""
    m = orthogonal_columns(pivoted_cholesky(a))
    norms = np.sqrt((m * m).sum(axis=0))
    return norms**2, m / norms


@dataclass(frozen=True)
class Whitening:
    """centre, variances and components (columns), all by falling variance; trace: of the covariance."""

    centre: Centre
    variances: np.ndarray
    components: np.ndarray
    trace: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.components / np.sqrt(self.variances))


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """fit: (x) of distinct vectors; None if they have no variance at all."""
    n, sums = exact_sums(fit)
    if not n:
        return None
    centre = Centre(n, tuple(sums))
    total = scatter(fit, centre.centred)
    values, vectors = eigen(total)
    if not len(values):
        return None
    return Whitening(centre, values[:components] / n, vectors[:, :components], float(total.trace()) / n)


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """How far the covariance of the whitened vectors is from the identity at most."""
    found = scatter(fit, w) / w.centre.n
    return float(np.abs(found - np.eye(len(found))).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component."""
    rows = integer_vectors(df, id_col, vector_col)
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    w = fitted(fit, components)
    kind = dict(rows.dtypes)["id"]
    if w is None:
        return df.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)
    error = identity_error(fit, w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column(1))
                deviation = [Decimal(v) if v < 10**38 else None for v in w.centre.deviation(x)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.decimal128(38, 0)), pa.array(list(w(x)), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    found = rows.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")
    explained = F.array(*[F.lit(float(v / w.trace)) for v in w.variances])
    each = found.select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(F.col("id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(w.centre.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
