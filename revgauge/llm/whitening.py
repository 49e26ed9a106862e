"""Embedding whitening: leading components by spectrum slicing of the covariance, and every row's whitened coordinates.

Entries become whole numbers, and the covariance is taken over the distinct vectors, centred at whole numbers next to
the means: products and sums of whole numbers are exact in doubles up to 2**53, so the covariance does not depend on how
rows are split over tasks. What reaches the driver is one matrix of the vectors' dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge.llm.base import stored

EPS = float(np.finfo(float).eps)
#: A vector's entries are multiplied by this before they are rounded down.
GRID = 256
#: From this share of its rows a pivot of one row is large enough against one of two.
PIVOT = (1 + 17**0.5) / 8


class Factor:
    """P A P' = L D L' of a symmetric matrix with pivots of one or two rows, the largest entry first."""

    def __init__(self, a: np.ndarray) -> None:
        a = np.array(a, float)
        n = len(a)
        self.order, self.lower, self.blocks = np.arange(n), np.eye(n), []
        self.least = EPS * max(float(np.abs(a).max(initial=0.0)), np.finfo(float).tiny)
        k = 0
        while k < n:
            rest = np.abs(a[k:, k:])
            one = int(rest.diagonal().argmax())
            largest = rest[one, one]
            np.fill_diagonal(rest, 0.0)
            r, s = divmod(int(rest.argmax()), n - k)
            size = 1 if largest >= PIVOT * rest[r, s] else 2
            for at, i in enumerate([one] if size == 1 else sorted((r, s))):
                i, j = k + i, k + at
                a[[i, j]] = a[[j, i]]
                a[:, [i, j]] = a[:, [j, i]]
                self.lower[[i, j], :k] = self.lower[[j, i], :k]
                self.order[[i, j]] = self.order[[j, i]]
            end = k + size
            block = a[k:end, k:end].copy()
            if size == 1 and abs(block[0, 0]) < self.least:
                block[0, 0] = 0.0
            self.blocks.append((k, end, block))
            if end < n and block.any():
                part = np.linalg.solve(block, a[k:end, end:]).T
                self.lower[end:, k:end] = part
                a[end:, end:] -= part @ a[k:end, end:]
            k = end

    def positive(self) -> int:
        """The number of positive eigenvalues: a pivot of two rows has one of each sign."""
        return sum(int(d[0, 0] > 0) if len(d) == 1 else 1 for _, _, d in self.blocks)

    def solve(self, b: np.ndarray) -> np.ndarray:
        """A solution of A x = b; a pivot of zero counts as the least number beside the matrix."""
        x = b[self.order].astype(float)
        for k in range(len(x)):
            x[k] -= self.lower[k, :k] @ x[:k]
        for k, end, block in self.blocks:
            x[k:end] = np.linalg.solve(block if block.any() else np.array([[self.least]]), x[k:end])
        for k in range(len(x) - 1, -1, -1):
            x[k] -= self.lower[k + 1:, k] @ x[k + 1:]
        out = np.empty_like(x)
        out[self.order] = x
        return out


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above ``shift``, by the inertia of the shifted matrix."""
    return Factor(a - shift * np.eye(len(a))).positive()


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    Counts halve an interval until it holds the j-th eigenvalue alone, or until it is as narrow as rounding allows (then
    its eigenvalues count as equal). Rayleigh quotient iteration goes on from there. Counts on both sides of the result
    prove its number; where it ran to another one, the interval is halved once more.
    """
    n = len(a)
    k = min(k, n)
    size = float(np.abs(a).sum(axis=1).max(initial=0.0))
    values, vectors = np.zeros(k), np.zeros((n, k))
    if not size:
        return values, np.eye(n, k)
    fine = 8 * EPS * size * max(1.0, n**0.5)
    rng = np.random.default_rng(0)
    for j in range(k):
        low, high = -size - fine, size + fine
        n_low, n_high = n, 0

        def halve() -> None:
            nonlocal low, high, n_low, n_high
            mid = (low + high) / 2
            count = above(a, mid)
            if count > j:
                low, n_low = mid, count
            else:
                high, n_high = mid, count

        while True:
            while (n_low > j + 1 or n_high < j) and high - low > fine:
                halve()
            found = _quotients(a, (low + high) / 2, vectors[:, :j], rng.standard_normal(n), fine)
            if found and above(a, found[0] + 2 * fine) <= j < above(a, found[0] - 2 * fine):
                break
            if high - low <= fine:
                raise ArithmeticError(f"eigenvalue {j + 1} between {low} and {high} was not reached")
            halve()
        values[j], vectors[:, j] = found
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _quotients(a: np.ndarray, shift: float, known: np.ndarray, x: np.ndarray, fine: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the vector that the first shift picks out, at right angles to ``known``."""
    def unit(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - known @ (known.T @ x)
        return x / max(float(np.linalg.norm(x)), np.finfo(float).tiny)

    x, best = unit(x), None
    eye = np.eye(len(a))
    for step in range(24):
        x = unit(Factor(a - shift * eye).solve(x))
        value = float(x @ a @ x)
        rest = float(np.linalg.norm(a @ x - value * x))
        if best is None or rest < best[0]:
            best = (rest, value, x)
        elif best[0] <= fine:
            break
        if step:   # the interval's middle twice, then the quotients
            shift = value
    return (best[1], best[2]) if best[0] <= fine else None


class Model(NamedTuple):
    """What the whitening of rows needs: the number of distinct vectors, their sums, and the scaled components."""

    n: int
    centre: np.ndarray      # whole numbers next to the means
    rest: np.ndarray        # sums - n * centre, exact
    values: np.ndarray      # leading eigenvalues
    explained: np.ndarray   # their shares of the trace (nan where the trace is 0)
    axes: np.ndarray        # unit eigenvectors over the roots of the eigenvalues; nan where an eigenvalue is 0


def grid_vectors(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", dim: int | None = None) -> DataFrame:
    """(vec_id, x array<long>): rows whose vector is not null and holds finite numbers only, entries floor(256 * c).

    All vectors have ``dim`` entries; where it is not given, as many as most of the rows have (ties: the larger number).
    Rows with another number of entries are left out. Entries beyond 2**55 stand at the ends of the whole numbers.
    """
    slim = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("c"))
    whole = slim.where(F.col("c").isNotNull() & F.forall(
        "c", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    if dim is None:
        sizes = whole.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("n"))
        most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
        dim = most.d if most else 0
    return whole.where(F.size("c") == dim).select("vec_id", F.transform("c", lambda c: F.floor(c * GRID)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, value): a task's sums of each dimension, and its number of vectors at -1."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            # halves of 32 bits: their sums fit, whatever the entries
            part = ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            n, total = n + len(x), part if total is None else total + part
    if n:
        yield pa.record_batch([pa.array(range(-1, len(total)), pa.int32()), pa.array([n, *total], pa.decimal128(38, 0))],
                              ["at", "value"])


def _products(batches: Iterator[pa.RecordBatch], centre: np.ndarray, axes: np.ndarray | None = None,
              shift: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(at, value): a task's sums of products of centred vectors, or of their whitened coordinates with a 1 in front."""
    total = None
    for batch in batches:
        if batch.num_rows:
            y = (_matrix(batch.column(0)) - centre).astype(float)
            if axes is not None:
                y = np.concatenate((np.ones((len(y), 1)), (y - shift) @ axes), axis=1)
            part = y.T @ y
            total = part if total is None else total + part
    if total is not None:
        at = np.arange(total.size, dtype=np.int32)
        yield pa.record_batch([pa.array(at), pa.array(total.ravel())], ["at", "value"])


def _gathered(parts: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():   # a square of the dimension
        out[r["at"]] = r.value
    return out


def fit(distinct: DataFrame, k: int = 4) -> Model | None:
    """Components of the covariance of the vectors in ``distinct`` (x array<long>), each counted once; None without any."""
    sums = {r["at"]: int(r.value) for r in distinct.select("x").mapInArrow(_sums, "at int, value decimal(38,0)")
            .groupBy("at").agg(F.sum("value").alias("value")).collect()}
    n, d = sums.pop(-1, 0), len(sums)
    if not n or not d:
        return None
    total = [sums[i] for i in range(d)]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    rest = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    shift = np.array([r / n for r in rest])
    inner = _gathered(distinct.select("x").mapInArrow(lambda b: _products(b, centre), "at int, value double"), d * d)
    cov = inner.reshape(d, d) / n - np.outer(shift, shift)
    cov = (cov + cov.T) / 2
    values, vectors = leading(cov, k)
    trace = float(np.trace(cov))
    real = values > 16 * EPS * d * max(trace, 0.0)
    axes = np.divide(vectors, np.sqrt(np.where(real, values, 1.0)), where=real, out=np.full(vectors.shape, np.nan))
    explained = np.maximum(values, 0.0) / trace if trace > 0 else np.full(len(values), np.nan)
    return Model(n, centre, np.array(rest, object), values, explained, axes)


def identity_error(distinct: DataFrame, model: Model) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity; None without a component."""
    real = ~np.isnan(model.axes[0])
    k = int(real.sum())
    if not k:
        return None
    shift = np.array([r / model.n for r in model.rest])
    parts = distinct.select("x").mapInArrow(lambda b: _products(b, model.centre, model.axes[:, real], shift), "at int, value double")
    s = _gathered(parts, (k + 1) ** 2).reshape(k + 1, k + 1) / model.n
    return float(np.abs(s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]) - np.eye(k)).max())


def _deviation(y: np.ndarray, model: Model) -> list[int | None]:
    """Sums of (n * x - S) ** 2; None beyond 2**63."""
    n, rest = model.n, model.rest
    rough = ((n * y.astype(float) - rest.astype(float)) ** 2).sum(axis=1)
    if (rough < 2.0**62).all():
        return ((n * y - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(rows: DataFrame, k: int = 4, vector: str = "embedding", vec_id: str = "vec_id", dim: int | None = None) -> DataFrame:
    """One row per kept row of ``rows`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Kept rows are those of ``grid_vectors``; repeated ids and rows without an id are rows as any other, and each distinct
    vector counts once in the covariance. Components are min(k, dimension). Where an eigenvalue is 0 (fewer distinct
    vectors than components, or equal ones) ``whitened`` is null; where all are, so are ``explained`` and
    ``identity_error``. A ``deviation`` beyond 64 bits is null. Nothing kept gives no rows.
    """
    kept = grid_vectors(rows, vector, vec_id, dim)
    distinct = stored(kept.select("x").distinct(), "vectors")
    model = fit(distinct, k)
    schema = (f"vec_id {dict(kept.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, model)
    shift = np.array([r / model.n for r in model.rest])
    width = model.axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            y = _matrix(batch.column(1)) - model.centre
            z = (y - shift) @ model.axes
            each = np.repeat(np.arange(m), width)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * width, model.n)), pa.array(_deviation(y, model), pa.int64()).take(pa.array(each)),
                 pa.array(z.ravel(), from_pandas=True), pa.array(np.tile(model.explained, m), from_pandas=True),
                 pa.array([error] * (m * width), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(run, schema)
