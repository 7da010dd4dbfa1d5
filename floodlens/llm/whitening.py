"""Operator 11, embedding whitening by spectral divide and conquer.

Vectors become whole numbers x = floor(SCALE c) + SHIFT.  Spark finds the distinct
ones (the fit list), sums them exactly, and adds up the products of their centred
components; the covariance, one small square matrix whose size is that of a
vector, is taken apart on the driver:

* ``polar`` iterates towards the orthogonal polar factor of a symmetric matrix by
  dynamically weighted Halley steps (QDWH), by QR where the weights are large and
  by Cholesky where they are small;
* the polar factor U of the covariance shifted by sigma gives the projector
  (U + I) / 2 onto the invariant subspace of the eigenvalues above sigma;
* orthonormal bases of that subspace and its complement split the matrix into two
  smaller ones, which are split in turn until single components are left.

The components are broadcast, and one narrow pass whitens all rows.

Defined cases: rows whose vector is null or holds null or non-finite entries are
dropped, and empty vectors have no components.  Vectors of different length are
fitted apart, each length by itself, all in the same jobs.  SCALE c is held
within 2^40.  Components whose eigenvalue is not above ``FLOOR`` times the
largest are noise of rounding and are not returned, so that fit lists of fewer
than two vectors give no rows.  ``deviation`` is null where it exceeds 63 bits.
Rows that repeat, or have a null id, are returned each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SCALE, SHIFT, LIMIT = 64, 1_000_000, float(1 << 40)
#: components returned, and the least eigenvalue of one as a share of the largest
COMPONENTS, FLOOR = 16, 1e-9
#: rows that a task turns into numbers at once
ROWS = 4_096
_EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH iteration."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    try:
        least = 1 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(n))
    except np.linalg.LinAlgError:
        least = 0.0
    low = min(1.0, max(least, _EPS)) if np.isfinite(least) else _EPS
    for _ in range(30):
        squared = low * low
        d = (4 * (1 - squared) / squared ** 2) ** (1 / 3)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - squared) / (squared * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            chol = np.linalg.cholesky(np.eye(n) + wc * (x.T @ x))
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(chol.T, np.linalg.solve(chol, x.T)).T
        low = min(1.0, low * (wa + wb * squared) / (1 + wc * squared))
        step = np.linalg.norm(new - x)
        x = (new + new.T) / 2
        if step < (5 * _EPS) ** (1 / 3) and abs(1 - low) < 10 * _EPS:
            break
    return x


def _halves(a: np.ndarray, sigma: float, rng) -> tuple[float, np.ndarray, int] | None:
    """(what is left outside the two blocks, basis, size of the first block) of a split at ``sigma``."""
    n = len(a)
    projector = (polar(a - sigma * np.eye(n)) + np.eye(n)) / 2
    k = round(float(np.trace(projector)))
    if not 0 < k < n:
        return None
    basis = rng.standard_normal((n, k))
    for _ in range(3):  # a projector needs one step; the others clear rounding
        basis = np.linalg.qr(projector @ basis[:, :k], mode="complete")[0]
    return float(np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])), basis, k


def eigenpairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix."""
    rng = np.random.default_rng(7)
    size = np.linalg.norm(a)

    def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(a)
        a = (a + a.T) / 2
        diagonal = np.diag(a)
        if n == 1 or np.linalg.norm(a - np.diag(diagonal)) <= _EPS * size:
            return diagonal, np.eye(n)
        tries = []
        spread = np.quantile(diagonal, [0.5, 0.25, 0.75, 0.1, 0.9])
        for sigma in [spread[0], diagonal.mean(), *spread[1:], (diagonal.min() + diagonal.max()) / 2, *rng.uniform(diagonal.min(), diagonal.max(), 4)]:
            half = _halves(a, sigma, rng)
            if half:
                tries.append(half)
                if half[0] <= 4 * n * _EPS * size:
                    break
        if not tries:  # eigenvalues that are equal but for rounding
            return diagonal, np.eye(n)
        _, basis, k = min(tries, key=lambda t: t[0])
        inner = basis.T @ a @ basis
        (high, left), (low, right) = split(inner[:k, :k]), split(inner[k:, k:])
        return np.concatenate([high, low]), np.hstack([basis[:, :k] @ left, basis[:, k:] @ right])

    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    values, vectors = split(a)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _by_length(batches, column: str):
    """(rows of the batch, int64 matrix) for each length of the vectors of each batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            lists = part.column(column)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            for d in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == d)
                yield part, rows, flat[first[rows][:, None] + np.arange(d)]


class Fit:
    """Sums of a fit list, and its components once they are known."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)  # S / n = whole + rest / n
        self.rest = np.array([s % n for s in sums], np.int64)
        self.values = self.matrix = self.explained = None
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2, None beyond 63 bits."""
        off = x - self.whole
        if off.size and (float(np.abs(off).max()) + 1) ** 2 * float(self.n) ** 2 * off.shape[1] < 2.0 ** 62:
            return ((self.n * off - self.rest) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(o) - int(r)) ** 2 for o, r in zip(row, self.rest)) for row in off]
        return [s if s < 1 << 63 else None for s in exact]

    def learn(self, covariance: np.ndarray, components: int) -> None:
        values, vectors = eigenpairs(covariance)
        total = float(np.trace(covariance))
        k = int((values[:components] > FLOOR * max(float(values[0]), 0.0)).sum()) if len(values) else 0
        self.values, self.explained = values[:k], values[:k] / total if k else values[:0]
        self.matrix = vectors[:, :k] / np.sqrt(values[:k])


def _products(fitted: DataFrame, fits: dict[int, Fit], whitened: bool) -> dict[int, np.ndarray]:
    """For each length, the mean product of all pairs of centred (or whitened)
    components; a task adds up its rows, Spark the tasks."""
    shared = fitted.sparkSession.sparkContext.broadcast(fits)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for _, _, x in _by_length(batches, "x"):
            fit = shared.value[x.shape[1]]
            c = fit.centred(x)
            c = c @ fit.matrix if whitened else c
            sums[x.shape[1]] = sums.get(x.shape[1], 0.0) + c.T @ c
        for d, g in sums.items():
            if g.size:
                yield pa.RecordBatch.from_pydict({"length": np.full(g.size, d, np.int32), "place": np.arange(g.size, dtype=np.int64), "value": g.ravel()})
    added = fitted.mapInArrow(add, "length int, place bigint, value double").groupBy("length", "place").agg(F.sum("value").alias("value")).toArrow()
    length, place, value = (added.column(k).to_numpy() for k in range(3))
    out = {}
    for d, fit in fits.items():
        side = fit.matrix.shape[1] if whitened else d
        g = np.zeros(side * side)
        g[place[length == d]] = value[length == d]
        out[d] = g.reshape(side, side) / fit.n
    return out


def fit_whitening(x_vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """By vector length: the fit over the distinct ``x`` vectors (arrays of whole
    numbers).  Copies meet in the map-side half of the distinct, so a vector that
    a third of all rows share is one row of each task."""
    fitted = materialize(x_vectors.select("x").distinct(), "whitening-fit")

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for _, _, x in _by_length(batches, "x"):  # in two halves, whose sums fit 64 bits
            sums[x.shape[1]] = sums.get(x.shape[1], 0) + np.stack([(x >> 20).sum(0), (x & 0xFFFFF).sum(0), np.full(x.shape[1], len(x))])
        for d, s in sums.items():
            yield pa.RecordBatch.from_pydict({"length": np.full(d, d, np.int32), "place": np.arange(d, dtype=np.int32), "high": s[0], "low": s[1], "n": s[2]})
    added = fitted.mapInArrow(add, "length int, place int, high bigint, low bigint, n bigint").groupBy("length", "place").agg(
        F.sum("high"), F.sum("low"), F.sum("n")).orderBy("length", "place").collect()
    sums: dict[int, list] = {}
    for length, _, high, low, n in added:
        sums.setdefault(length, []).append((n, (high << 20) + low))
    fits = {d: Fit(s[0][0], [total for _, total in s]) for d, s in sums.items()}
    for d, covariance in _products(fitted, fits, False).items():
        fits[d].learn(covariance, components)
    for d, identity in _products(fitted, fits, True).items():
        fits[d].identity_error = float(np.abs(identity - np.eye(len(identity))).max(initial=0.0))
    return fits


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a
    row for each usable vector and component.  Other columns take no part,
    whatever their names."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    good = rows.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("vector")).where(
        F.col("vector").isNotNull() & ~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = good.select("vec_id", F.transform("vector", lambda c: F.floor(F.greatest(F.least(SCALE * c, F.lit(LIMIT)), F.lit(-LIMIT))) + F.lit(SHIFT).cast("long")).alias("x"))
    shared = rows.sparkSession.sparkContext.broadcast(fit_whitening(whole, components))

    def run(batches):
        for part, at, x in _by_length(batches, "x"):
            fit = shared.value[x.shape[1]]
            white = fit.centred(x) @ fit.matrix
            k = white.shape[1]
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                pa.array(np.full(k * len(at), fit.n)), pa.array(fit.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                pa.array(white.ravel()), pa.array(np.tile(fit.explained, len(at))), pa.array(np.full(k * len(at), fit.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    kind = whole.schema["vec_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
