"""Whitening of embeddings by spectrum slicing of their covariance.

Vectors are laid on an integer grid, and each distinct grid vector counts once.
Counts, sums and products of centred coordinates are integers that Spark adds up
exactly (numpy multiplies inside the tasks, one partial matrix for each task), so the
covariance is the correctly rounded one whatever the order of the rows.

The d x d covariance (d is the vectors' length, not their number) is then sliced on the driver: an
LDL^T factorisation of ``V - s I`` has as many negative pivots as there are
eigenvalues below ``s``, so bisecting with these counts isolates the i-th largest
eigenvalue; Rayleigh quotient iteration converges inside its interval, and counts on
both sides of the result certify that it is the i-th.  Eigenvalues that
double precision cannot tell apart are taken as one cluster with an orthonormal basis.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import staged

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
EPS = float(np.finfo(np.float64).eps)
_LIMB = 60                       # exact sums travel as two decimals: value = high * 2 ** 60 + low
_ALPHA = (1 + math.sqrt(17)) / 8


# ------------------------------------------------------------ spectrum slicing

def pivots(matrix: np.ndarray) -> list[np.ndarray]:
    """Diagonal blocks (1 x 1 and 2 x 2) of LDL^T with symmetric Bunch-Kaufman pivoting."""
    a = np.array(matrix, np.float64)
    out, k, n = [], 0, len(a)
    while k < n:
        step, swap = 1, k
        column = np.abs(a[k + 1:, k])
        if len(column) and column.max() > 0:
            r = k + 1 + int(column.argmax())
            largest = column.max()
            if abs(a[k, k]) < _ALPHA * largest:
                row = np.abs(a[k:, r])
                row[r - k] = 0
                across = row.max()
                if abs(a[k, k]) * across >= _ALPHA * largest * largest:
                    pass
                elif abs(a[r, r]) >= _ALPHA * across:
                    swap = r
                else:
                    step, swap = 2, r
        place = k + step - 1
        if swap != place:
            a[[place, swap]] = a[[swap, place]]
            a[:, [place, swap]] = a[:, [swap, place]]
        block = a[k:k + step, k:k + step].copy()
        out.append(block)
        rest = a[k + step:, k:k + step]
        if rest.size and np.abs(rest).max() > 0:
            a[k + step:, k + step:] -= rest @ np.linalg.solve(block, rest.T)
        k += step
    return out


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of the shifted matrix (Sylvester)."""
    n = 0
    for block in pivots(matrix - shift * np.eye(len(matrix))):
        if len(block) == 1:
            n += block[0, 0] > 0
        elif block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0] < 0:
            n += 1
        else:
            n += 2 * (block[0, 0] + block[1, 1] > 0)
    return int(n)


class Spectrum:
    """Leading eigenpairs of a symmetric matrix, each isolated and numbered by inertia counts."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = (matrix + matrix.T) / 2
        self.size = len(matrix)
        self.reach = float(np.abs(self.matrix).sum(axis=1).max()) if self.size else 0.0     # bounds all eigenvalues
        self.close = 16 * self.size * EPS * self.reach      # eigenvalues this near count as equal
        self.known = {-2 * self.reach - 1: self.size, 2 * self.reach + 1: 0}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = count_above(self.matrix, shift)
        return self.known[shift]

    def isolate(self, i: int) -> tuple[float, float]:
        """(low, high) around the i-th largest eigenvalue (from 1), with no other one in it unless it is that near."""
        low = max(s for s, c in self.known.items() if c >= i)
        high = min(s for s, c in self.known.items() if c < i and s > low)
        while self.known[low] - self.known[high] > 1 and high - low > self.close:
            middle = (low + high) / 2
            if self.above(middle) >= i:
                low = middle
            else:
                high = middle
        return low, high

    def narrowed(self, i: int, low: float, high: float) -> tuple[float, float]:
        middle = (low + high) / 2
        return (middle, high) if self.above(middle) >= i else (low, middle)

    def _solve(self, shift: float, rhs: np.ndarray) -> np.ndarray:
        for _ in range(8):
            try:
                x = np.linalg.solve(self.matrix - shift * np.eye(self.size), rhs)
                if np.isfinite(x).all():
                    return x
            except np.linalg.LinAlgError:
                pass
            shift += max(EPS * self.reach, np.finfo(np.float64).tiny)
        return rhs

    def _pair(self, i: int, low: float, high: float, found: np.ndarray, rng) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration that stays in the interval of the i-th eigenvalue."""
        while True:
            v = rng.normal(size=self.size)
            shift = (low + high) / 2
            value, residual = shift, math.inf
            for step in range(12):
                v = self._solve(shift, v)
                v -= found.T @ (found @ v)
                v /= np.linalg.norm(v)
                value = float(v @ self.matrix @ v)
                before, residual = residual, float(np.linalg.norm(self.matrix @ v - value * v))
                if not low <= value <= high:
                    break
                if residual <= 2 * EPS * self.reach or (step > 2 and residual >= before / 2):
                    if residual <= self.close:
                        return value, v
                    break
                if step > 0:
                    shift = value               # from here on the quotient itself: cubic
            if high - low <= self.close:
                return value, v
            low, high = self.narrowed(i, low, high)

    def _cluster(self, shift: float, m: int, found: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
        """An orthonormal basis for ``m`` eigenvalues that cannot be told apart."""
        block = rng.normal(size=(self.size, m))
        for _ in range(4):
            block = self._solve(shift + self.close, block)
            block -= found.T @ (found @ block)
            block, _ = np.linalg.qr(block)
        values = np.einsum("ij,ij->j", block, self.matrix @ block)
        order = np.argsort(-values, kind="stable")
        return values[order], block[:, order]

    def leading(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(values falling, unit vectors as rows) of the ``k`` largest; ArithmeticError if a count disagrees."""
        if self.reach == 0:
            return np.zeros(min(k, self.size)), np.eye(self.size)[:k]
        rng = np.random.default_rng(12)
        values, found = [], np.zeros((0, self.size))
        while len(values) < min(k, self.size):
            i = len(values) + 1
            low, high = self.isolate(i)
            m = self.known[low] - len(values)
            if m == 1:
                value, v = self._pair(i, low, high, found, rng)
                new = [(value, v)]
            else:
                got, block = self._cluster((low + high) / 2, m, found, rng)
                new = list(zip(got.tolist(), block.T))
            for value, v in new:
                v = v - found.T @ (found @ v)
                v /= np.linalg.norm(v)
                top = int(np.abs(v).argmax())
                found = np.vstack([found, v if v[top] > 0 else -v])
                values.append(value)
        for i, value in enumerate(values, 1):
            if not self.above(value - self.close) >= i > self.above(value + self.close):
                raise ArithmeticError(f"eigenvalue {i} is not certified by the counts around it")
        k = min(k, self.size)
        return np.array(values[:k]), found[:k]


# ------------------------------------------------------------ vectors on the grid

def grid_vector(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """``floor(scale * c) + shift`` of each entry as long; it stops at 2 ** 61 in either direction."""
    edge = F.lit(1 << 61)
    return F.transform(vector, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), edge), -edge) + shift)


def usable(vector: Column) -> Column:
    """False for a vector that is null or empty or holds a null or non-finite entry."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def grid_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """``id, x`` of the usable vectors."""
    return vectors.where(usable(F.col(vector_col))) \
        .select(F.col(id_col).alias("id"), grid_vector(F.col(vector_col), scale, shift).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _exact_sums(rows: DataFrame, dim: int, centre: list[int], products: bool) -> tuple[int, list[int]]:
    """(rows, sums) of the centred coordinates, or of their products (upper triangle by rows), as exact integers."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, n, total = np.array(centre, np.int64), 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                z = _matrix(batch.column(0).slice(start, 1024), dim) - middle
                n += len(z)
                if int(np.abs(z).max(initial=0)) < 1 << 21:                 # sums of 1024 products are exact in doubles
                    part = (z.T.astype(np.float64) @ z)[upper].astype(np.int64) if products else z.sum(axis=0)
                    total = total + part.astype(object)
                else:
                    z = z.astype(object)
                    total = total + ((z.T @ z)[upper] if products else z.sum(axis=0))
        if n:
            values = [n, *total.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(values)), pa.int32()),
                 pa.array([Decimal(int(v) >> _LIMB) for v in values], pa.decimal128(38, 0)),
                 pa.array([Decimal(int(v) & ((1 << _LIMB) - 1)) for v in values], pa.decimal128(38, 0))],
                names=["place", "high", "low"])

    parts = rows.select("x").mapInArrow(run, "place int, high decimal(38,0), low decimal(38,0)") \
        .groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    got = {r["place"]: (int(r["high"]) << _LIMB) + int(r["low"]) for r in parts.collect()}      # d (d + 1) / 2 + 1 rows
    width = dim * (dim + 1) // 2 if products else dim
    return got.get(0, 0), [got.get(i + 1, 0) for i in range(width)]


@dataclass
class Whitening:
    """A fitted whitening: ``n`` distinct vectors, exact ``sums``, eigenpairs and what they reach."""
    dim: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None
    scale: int
    shift: int

    @property
    def explained(self) -> list[float | None]:
        """Share of the total variance by component; null without any variance."""
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values]

    def positive(self) -> np.ndarray:
        """Components whose eigenvalue double precision tells from zero."""
        return self.values > 16 * self.dim * EPS * max(self.trace, 0.0)

    def centre(self) -> tuple[np.ndarray, list[int]]:
        """(integers next to the means, remainders): sum = n * integer + remainder."""
        middle = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(middle, np.int64), [s - self.n * m for s, m in zip(self.sums, middle)]

    def project(self, z: np.ndarray, rest: list[int]) -> np.ndarray:
        """Whitened coordinates of the components with variance, others NaN."""
        out = np.full((len(z), len(self.values)), np.nan)
        fine = self.positive()
        basis = self.vectors[fine] / np.sqrt(self.values[fine])[:, None]
        out[:, fine] = (z - np.array([r / self.n for r in rest])) @ basis.T
        return out


def covariance(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance) of the rows ``x``: centred at integers next to the means, the rest corrected exactly."""
    n, sums = _exact_sums(fit, dim, [0] * dim, False)
    if not n:
        return 0, sums, np.zeros((dim, dim))
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle)]
    _, products = _exact_sums(fit, dim, middle, True)
    v = np.zeros((dim, dim))
    for at, (i, j) in enumerate(zip(*np.triu_indices(dim))):
        v[i, j] = v[j, i] = (n * products[at] - rest[i] * rest[j]) / (n * n)    # one rounding
    return n, sums, v


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, summed over the rows."""
    fine = model.positive()
    k = int(fine.sum())
    if not k:
        return None
    middle, rest = model.centre()
    dim = model.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            w = model.project(_matrix(batch.column(0), dim) - middle, rest)[:, fine]
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)],
                                         names=["place", "value"])

    rows = fit.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("v")).collect()
    got = np.zeros(k + k * k)
    for r in rows:                                                                  # at most k + k * k rows
        got[r["place"]] = r["v"] / model.n
    mean = got[:k]
    return float(np.abs(got[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                  components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of the usable vectors, each distinct grid vector counted once; None if there is none.

    Vectors of several lengths: those of the most frequent length are used (the
    longer one on a tie), the others count as unusable.  Repeated rows and null ids make no
    difference.  A component without variance keeps its place and eigenvalue, but has no
    whitened coordinate.
    """
    rows = grid_rows(vectors, id_col, vector_col, scale, shift)
    length = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if length is None:
        return None
    dim = int(length["dim"])
    fit = staged(rows.where(F.size("x") == dim).select("x").distinct(), "grid-vectors")
    n, sums, v = covariance(fit, dim)
    values, basis = Spectrum(v).leading(components)
    model = Whitening(dim, n, sums, float(np.trace(v)), values, basis, None, scale, shift)
    model.identity_error = _identity_error(fit, model)
    return model


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``id_col, deviation, whitened`` for each usable vector of the model's length.

    ``whitened`` has one double for each component (null without variance);
    ``deviation`` is the exact sum over dimensions of ``(n x - sum) ** 2`` as decimal, null beyond
    38 digits.  Every row is kept, repeated and null ids too; no model, no rows.
    """
    id_type = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("deviation", T.DecimalType(38, 0)),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if model is None:
        return vectors.select(F.col(id_col).alias("id")).where(F.lit(False)) \
            .select("id", F.lit(None).cast("decimal(38,0)").alias("deviation"),
                    F.lit(None).cast("array<double>").alias("whitened")).withColumnRenamed("id", id_col)
    rows = grid_rows(vectors, id_col, vector_col, model.scale, model.shift).where(F.size("x") == model.dim)
    middle, rest = model.centre()
    most = max(map(abs, rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column(1), model.dim) - middle
            w = model.project(z, rest)
            reach = model.n * int(np.abs(z).max(initial=0)) + most
            d = z * model.n - np.array(rest, np.int64) if model.dim * reach * reach < 1 << 63 else \
                z.astype(object) * model.n - np.array(rest, object)
            total = (d * d).sum(axis=1).tolist()
            offsets = np.arange(len(z) + 1, dtype=np.int32) * w.shape[1]
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([Decimal(t) if t < 10 ** 38 else None for t in total], pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["id", "deviation", "whitened"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
