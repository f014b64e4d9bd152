"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Three passes over the distinct vectors: exact sums, scatter about the mean, and the covariance of the whitened vectors.
Every task sends sums of a size given by the number of dimensions alone, Spark adds them up, and the driver holds the scatter
of d x d numbers. Its pivoted Cholesky factor L (scatter = L L' with the rows put back in order) is rotated from the right
until its columns are orthogonal: their squared norms are the eigenvalues of the scatter, the normalised columns its
eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesheaf.llm.common import stored

# Vectors are put on a grid: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
# Largest |SCALE * c| that is taken; grid values then have an exact double and their sums fit 128 bits.
LARGEST = float(2**52)
# A pivot below this part of the largest one ends the factorisation: what is left is rounding.
NO_RANK = 1e-13
_BATCH = 4096


def grid(vector: Column) -> Column:
    """A vector of numbers on the grid as ``array<bigint>``; null if it is null or empty or has an entry that is null, not
    finite or beyond ``LARGEST / SCALE``."""
    scaled = F.transform(vector, lambda c: c.cast("double") * SCALE)
    # NaN is larger than every number here, so the one comparison finds it as well.
    whole = F.forall(scaled, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST)) & (F.size(vector) > 0)
    return F.when(whole, F.transform(scaled, lambda c: F.floor(c) + F.lit(SHIFT).cast("bigint")))


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """L with scatter = L L', one column for each pivot; the rows are in the order of the scatter."""
    d = len(scatter)
    rest, order = np.diag(scatter).astype(float).copy(), np.arange(d)
    factor = np.zeros((d, d))
    floor = NO_RANK * max(rest.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(rest[order[k:]]))
        order[[k, p]] = order[[p, k]]
        pivot = order[k]
        if rest[pivot] <= floor:
            return factor[:, :k]
        below = order[k + 1:]
        factor[pivot, k] = np.sqrt(rest[pivot])
        factor[below, k] = (scatter[below, pivot] - factor[below, :k] @ factor[pivot, :k]) / factor[pivot, k]
        rest[below] -= factor[below, k] ** 2
        rest[pivot] = 0.0
    return factor


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A round-robin tournament: every pair of ``n`` columns once, in rounds of pairs that have no column in common."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:])) if a < n and b < n]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60, tolerance: float = 1e-15) -> np.ndarray:
    """``factor`` times a rotation that makes its columns orthogonal, longest column first."""
    a = factor.copy()
    rounds = [r for r in _rounds(a.shape[1]) if len(r[0])]
    for _ in range(sweeps):
        worst = 0.0
        for p, q in rounds:
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            turn = np.abs(xy) > tolerance * size
            worst = max(worst, float((np.abs(xy[turn]) / size[turn]).max(initial=0.0)))
            zeta = np.where(turn, (yy - xx) / np.where(turn, 2 * xy, 1), 0)
            t = np.where(turn, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if worst <= 4 * tolerance:
            break
    return a[:, np.argsort(-(a * a).sum(0), kind="stable")]


class Whitening:
    """What the fit list gives: its size, exact sums, components (columns, by falling variance), variances and their sum."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray) -> None:
        self.n, self.sums = n, sums
        rotated = one_sided_jacobi(pivoted_cholesky(scatter))
        norms = np.sqrt((rotated * rotated).sum(0))
        self.components, self.variances = rotated / norms, norms**2 / n if n else norms
        self.total = float(np.trace(scatter)) / n if n else 0.0


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: whole numbers of 64 bits where they fit, Python's where not. Both are taken about the shift."""
    about = [s - n * SHIFT for s in sums]
    largest = max(int(np.abs(x - SHIFT).max(initial=0)) * n, max(map(abs, about), default=0))
    kind = np.int64 if largest < 2**61 else object
    return (x - SHIFT).astype(kind) * n - np.array(about, dtype=kind)


def _added(partial: DataFrame) -> list[tuple[int, int, float]]:
    return [tuple(r) for r in partial.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()]


def _products(rows: DataFrame, d: int, of) -> np.ndarray:
    """Sum of z z' over the rows z that ``of`` makes of a batch of vectors: one upper triangle for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for k in range(0, b.num_rows, _BATCH):
                z = of(_matrix(b.column(0)[k:k + _BATCH], d))
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    cells = _added(rows.select("x").mapInArrow(run, "i bigint, j bigint, v double"))
    m = max((j for _, j, _ in cells), default=-1) + 1
    out = np.zeros((m, m))
    for i, j, v in cells:
        out[i, j] = out[j, i] = v
    return out


def fit(points: DataFrame, d: int) -> tuple[Whitening, DataFrame]:
    """(model, fit list) of vectors ``x`` of length ``d``.

    The fit list is every distinct vector once, in a table in the shared folder. Copies are reduced in the tasks before
    they are exchanged, so a vector that a third of all rows hold costs one row of each task.
    """
    once = stored(points.select("x").distinct(), "distinct-vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for b in batches:
            for k in range(0, b.num_rows, _BATCH):
                # 4,096 numbers of at most 53 bits are added without loss.
                x = _matrix(b.column(0)[k:k + _BATCH], d) - SHIFT
                low, high = (x & 0xFFFFFFFF).sum(0).tolist(), (x >> 32).sum(0).tolist()
                sums, n = [s + a + (c << 32) for s, a, c in zip(sums, low, high)], n + len(x)
        values = [Decimal(n), *(Decimal(s + n * SHIFT) for s in sums)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d)), pa.array([0] * (d + 1)), pa.array(values, pa.decimal128(38, 0))], ["i", "j", "v"])

    counted = {i: int(v) for i, _, v in _added(once.mapInArrow(run, "i bigint, j bigint, v decimal(38,0)"))}
    n, sums = counted.get(-1, 0), [counted.get(i, 0) for i in range(d)]
    scatter = _products(once, d, lambda x: _centred(x, n, sums).astype(float) / n)
    return Whitening(n, sums, scatter), once


def identity_error(model: Whitening, once: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    n, sums, turn = model.n, model.sums, model.components[:, :k] / np.sqrt(model.variances[:k])
    if not turn.size:
        return 0.0
    found = _products(once, len(turn), lambda x: (_centred(x, n, sums).astype(float) / n) @ turn) / n
    return float(np.abs(found - np.eye(len(found))).max())


def whiten(embeddings: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error) for each vector and component.

    A vector takes part if it is not null or empty, all its entries are finite numbers (and smaller than 2^46), and its
    length is that of most such rows (ties: the greater length). Repeated rows stay repeated in the result and count once in
    the fit; a null key is kept. Components are those with a variance above rounding, at most ``components``, so fewer where
    the fit list spans fewer dimensions and none (no rows) for an empty table or a single distinct vector. Components of equal
    variance may be any orthogonal ones. ``deviation`` is null if the exact sum of squares does not fit 64 bits. The driver
    holds d x d numbers; other columns are not read.
    """
    points = embeddings.select(F.col(key).alias("key"), grid(F.col(vector)).alias("x")).where("x is not null")
    schema = embeddings.select(
        key, F.lit(0).alias("component"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("deviation"),
        F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error")).schema
    commonest = points.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if commonest is None:
        return points.select("key").mapInArrow(lambda batches: iter(()), schema)
    d = commonest["d"]
    points = points.where(F.size("x") == d)
    model, once = fit(points, d)
    k = min(components, model.components.shape[1])
    n, sums, error = model.n, model.sums, identity_error(model, once, k)
    turn, explained = model.components[:, :k] / np.sqrt(model.variances[:k]), model.variances[:k] / (model.total or 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, _BATCH):
                x = _matrix(b.column(1)[i:i + _BATCH], d)
                rows = np.repeat(np.arange(len(x)), k)
                exact = _centred(x, n, sums)
                if exact.dtype != object and float(np.abs(exact).max(initial=0)) ** 2 * d >= 2**62:
                    exact = exact.astype(object)
                squares = [s if s < 2**63 else None for s in (exact * exact).sum(1).tolist()]
                z = (exact.astype(float) / n) @ turn
                yield pa.RecordBatch.from_arrays([
                    b.column(0)[i:i + _BATCH].take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), n, np.int64)), pa.array(squares, pa.int64()).take(pa.array(rows)), pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error))], schema.names)

    return points.mapInArrow(run, schema)
