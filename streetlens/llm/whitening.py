"""Whitening of vectors by spectrum slicing: eigenvalues are isolated and numbered by inertia counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streetlens.llm.vectors import exact_sums, integer_vectors, integers

EPS = float(np.finfo(float).eps)
#: Share of the largest entry off the diagonal from which a diagonal entry is a stable pivot, (1 + sqrt(17)) / 8.
PIVOT = (1 + 17 ** 0.5) / 8


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: the positive pivots of the shifted matrix.

    L D Lᵀ with symmetric interchanges and pivots of one or two rows; by Sylvester's law D has as many
    positive eigenvalues as the shifted matrix, and a pivot of two rows has one of each sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        size = np.abs(a)
        diagonal = np.diagonal(size).copy()
        best = int(diagonal.argmax())
        np.fill_diagonal(size, 0)
        r, s = divmod(int(size.argmax()), len(a))
        if max(diagonal[best], size[r, s]) == 0:
            break
        if diagonal[best] >= PIVOT * size[r, s]:
            positive += bool(a[best, best] > 0)
            rest = np.delete(np.arange(len(a)), best)
            column = a[rest, best]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[best, best])
        else:
            positive += 1
            rest = np.delete(np.arange(len(a)), [r, s])
            pair = a[np.ix_(rest, [r, s])]
            a = a[np.ix_(rest, rest)] - pair @ np.linalg.solve(a[np.ix_([r, s], [r, s])], pair.T)
    return positive


def solved(matrix: np.ndarray, shift: float, vector: np.ndarray, norm: float) -> np.ndarray:
    """A step of inverse iteration; a shift that is an eigenvalue to the last digit is moved by one digit."""
    for step in range(4):
        try:
            out = np.linalg.solve(matrix - (shift + step * 2 * EPS * norm) * np.eye(len(matrix)), vector)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all() and out.any():
            return out
    return vector


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Counts are kept for all shifts tried. For number i the shifts are halved until exactly the i-th eigenvalue lies
    between two of them (or nothing lies between their digits). Rayleigh quotient iteration starts from inverse
    iteration at the middle; where it ends at an eigenvalue outside, the interval is halved again. The counts just
    above and just below the result certify that it is the i-th. Eigenvalues that are rounding noise of the largest
    are left out. The largest entry of each vector is positive.
    """
    d = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0))
    if not norm:
        return np.zeros(0), np.zeros((d, 0))
    counts: dict[float, int] = {-norm * (1 + d * EPS) - norm: d, norm * (1 + d * EPS): 0}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = eigenvalues_above(matrix, shift)
        return counts[shift]

    def between(i: int) -> tuple[float, float]:
        return max(s for s, c in counts.items() if c >= i), min(s for s, c in counts.items() if c < i)

    values, found = [], np.zeros((d, 0))
    noise = 8 * d * EPS * norm
    start = np.random.default_rng(0).standard_normal(d)
    for i in range(1, min(k, d) + 1):
        low, high = between(i)
        while True:
            while high - low > noise and not (counts[low] == i and counts[high] == i - 1):
                count((low + high) / 2)
                low, high = between(i)
            value, vector = (low + high) / 2, start
            for _ in range(3):
                vector = solved(matrix, value, vector - found @ (found.T @ vector), norm)
                vector /= np.linalg.norm(vector)
            residual = np.inf
            for _ in range(20):
                vector = vector - found @ (found.T @ vector)
                vector /= np.linalg.norm(vector)
                value = float(vector @ matrix @ vector)
                now = float(np.linalg.norm(matrix @ vector - value * vector))
                if now >= residual / 2 and now <= noise:
                    break
                residual = min(now, residual)
                vector = solved(matrix, value, vector, norm)
                vector /= np.linalg.norm(vector)
            if now <= noise and count(value - noise) >= i and count(value + noise) < i:
                break
            if high - low <= noise:
                raise ArithmeticError(f"eigenvalue {i} could not be certified")
            count((low + high) / 2)
            low, high = between(i)
        if value <= noise:
            break
        values.append(value)
        vector = vector * (1 if vector[np.abs(vector).argmax()] > 0 else -1)
        found = np.column_stack((found, vector))
    return np.array(values), found


@dataclass(frozen=True)
class Whitening:
    """What the tasks need: numbers of the fit list and the scaled eigenvectors; d * (k + 2) numbers in all."""

    n: int
    centre: np.ndarray
    #: Sum over the fit list of x - centre, as Python integers.
    rest: np.ndarray
    values: np.ndarray
    projection: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they fit, else Python integers."""
        z = x - self.centre
        widest = self.n * int(np.abs(z).max(initial=0)) + max((abs(int(r)) for r in self.rest), default=0)
        if widest < 1 << 62:
            return self.n * z - self.rest.astype(np.int64)
        return self.n * z.astype(object) - self.rest

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(float) @ self.projection


def square_sums(values: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; null where it does not fit in a long."""
    widest = int(np.abs(values).max(initial=0))
    if values.dtype != object and widest * widest * values.shape[1] < 1 << 63:
        return (values * values).sum(axis=1).tolist()
    exact = values.astype(object)
    return [s if s < 1 << 63 else None for s in map(int, (exact * exact).sum(axis=1))]


def products(z: np.ndarray) -> np.ndarray:
    """zᵀ z as Python integers, exact: in floats over so many rows that every sum stays below 2**53."""
    widest = int(np.abs(z).max(initial=0))
    step = (1 << 53) // max(1, widest * widest)
    if not step:
        wide = z.astype(object)
        return wide.T @ wide
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for start in range(0, len(z), step):
        part = z[start:start + step].astype(float)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def fit_whitening(kept: DataFrame, length: int, components: int) -> Whitening | None:
    """Two passes over the integers: sums, then products about the rounded mean; both exact in any order of tasks.

    The covariance is the exact quotient (n * P - R Rᵀ) / n², each entry rounded once. Only d * d numbers reach the
    driver, where the eigenvectors are found.
    """
    def sums(batch: pa.RecordBatch) -> np.ndarray:
        x = integers(batch.column(0), length)
        return np.append(x.sum(axis=0).astype(object), len(x))

    total = exact_sums(kept.select("x"), sums)
    if not total:
        return None
    n = total[length]
    centre = np.array([round(total[i] / n) for i in range(length)], np.int64)
    rest = np.array([total[i] - n * int(centre[i]) for i in range(length)], object)
    upper = np.triu_indices(length)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        return products(integers(batch.column(0), length) - centre)[upper]

    gram = exact_sums(kept.select("x"), moments)
    matrix = np.zeros((length, length))
    trace = 0
    for place, (i, j) in enumerate(zip(*upper)):
        exact = n * gram[place] - int(rest[i]) * int(rest[j])
        matrix[i, j] = matrix[j, i] = exact / (n * n)
        trace += exact if i == j else 0
    values, vectors = leading_pairs(matrix, components)
    return Whitening(n, centre, rest, values, vectors / np.sqrt(values), trace / (n * n))


def identity_error(kept: DataFrame, length: int, fit: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, measured over all of them."""
    k = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            w = fit.whitened(fit.deviations(integers(batch.column(0), length)))
            total += np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))
        yield pa.RecordBatch.from_pydict({"place": np.arange(len(total), dtype=np.int32), "value": total})

    sums = kept.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(k + k * k)
    for row in sums.collect():
        total[row.place] = row.value
    mean = total[:k] / fit.n
    return float(np.abs(total[k:].reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k)).max())


RESULT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(
    vectors: DataFrame, components: int = 8, vector_column: str = "embedding", scale: int = 1024,
    carry: Sequence[str] = ("vec_id",),
) -> DataFrame:
    """Each usable vector projected on the leading eigenvectors of the covariance and scaled to variance 1.

    Result, for each vector and component: ``row`` (struct of the ``carry`` columns), ``component`` (from 1, by falling
    eigenvalue), ``n`` (vectors of the fit), ``deviation`` (sum of (n * x - S)², exact; null where a long cannot hold
    it), ``whitened``, ``explained`` (share of the trace), ``identity_error`` (measured, one value). x is
    ``floor(scale * c)``; a constant added to all x changes no result, as all of them are centred.

    Left out: null and empty vectors, those with a null or non-finite component or one of 2**48 or more after scaling,
    and those of another than the most common length. Components without variance (one vector, equal vectors, fewer
    vectors than components) have no rows; an empty table gives none. Repeated rows count each time and appear each
    time; of equal eigenvalues any orthonormal vectors are right. Other columns are ignored.

    Four passes over the vectors (lengths, sums, products, check) and the projection; no vector is shuffled. The driver
    works on the covariance alone, d * d numbers, about d³ steps for each count.
    """
    kept, length = integer_vectors(vectors, vector_column, scale, carry)
    schema = T.StructType([kept.schema["row"], *T.StructType.fromDDL(RESULT).fields])
    fit = fit_whitening(kept, length, components) if length else None
    if fit is None or not len(fit.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(kept, length, fit)
    explained = fit.values / fit.trace
    k = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviations = fit.deviations(integers(batch.column(1), length))
            rows = batch.num_rows
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_pydict({
                "row": batch.column(0).take(pa.array(each)), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
                "n": np.full(rows * k, fit.n), "deviation": pa.array(square_sums(deviations), pa.int64()).take(pa.array(each)),
                "whitened": fit.whitened(deviations).ravel(), "explained": np.tile(explained, rows),
                "identity_error": np.full(rows * k, error)})

    return kept.mapInArrow(run, schema)
