"""Whitening of embeddings along the principal components of their exact covariance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.llm import spectrum
from fleetscope.llm.frames import saved

#: Vectors are counted in steps of 1/256.
SCALE = 256
#: The covariance is as wide as a vector and the driver holds it a few times: up to 34 MB each.
MOST_DIMENSIONS = 2048
#: Different lengths of vectors in one table; each has a covariance of its own.
MOST_LENGTHS = 16
_ROWS = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Moments:
    """Number, sums and covariance of the fit list, from exact integers. ``centre`` is the mean rounded to an integer, ``rest`` what n times the
    centre lacks to the sums."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: list[int]
    covariance: np.ndarray


def steps(vector: Column) -> Column:
    """The vector as whole steps: floor(256 * c) of each component as a double."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * SCALE))


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, none whose steps leave the range of a long."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float(1 << 62)))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_products(rows: np.ndarray) -> np.ndarray:
    """rows.T @ rows in exact integers: doubles are exact below 2**53, so rows are taken in runs whose sums stay below; wide entries go digit by digit."""
    most = int(np.abs(rows).max(initial=0))
    if most < 1 << 22:
        run, total = max(1, (1 << 53) // max(most * most, 1)), None
        for at in range(0, len(rows), min(run, 1 << 16)):
            part = rows[at:at + min(run, 1 << 16)].astype(float)
            block = (part.T @ part).astype(np.int64).astype(object)
            total = block if total is None else total + block
        return total if total is not None else np.zeros((rows.shape[1],) * 2, object)
    high, low = rows >> 20, rows & ((1 << 20) - 1)
    if int(np.abs(high).max()) >= 1 << 22:
        wide = rows.astype(object)
        return wide.T @ wide
    both = exact_products(np.hstack([high, low]))
    d = rows.shape[1]
    cross = both[:d, d:]
    return both[:d, :d] * (1 << 40) + (cross + cross.T) * (1 << 20) + both[d:, d:]


def _totals(fit: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], cells: int) -> list[int]:
    """Sums over all vectors of the ``cells`` integers that ``of`` makes of a batch. A task sends one row a cell; sums are exact, so their order is nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, object)
        for batch in batches:
            if len(batch):
                total = total + of(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells), pa.int32()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["cell", "value"])

    found = fit.where(F.size("x") == width).mapInArrow(run, "cell int, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value"))
    result = [0] * cells
    for cell, value in found.toLocalIterator():
        result[cell] = int(value)
    return result


def moments(fit: DataFrame, width: int) -> Moments:
    """Two passes over the distinct vectors of one length: sums, then products of the centred vectors."""
    found = _totals(fit, width, lambda x: np.array([len(x), *x.astype(object).sum(axis=0)], object), width + 1)
    n, sums = found[0], found[1:]
    whole = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(whole, np.int64)
    rest = [s - n * m for s, m in zip(sums, whole)]
    upper = np.triu_indices(width)
    products = _totals(fit, width, lambda x: exact_products(x - centre)[upper], len(upper[0]))
    covariance = np.zeros((width, width))
    for i, j, p in zip(*upper, products):
        # Vectors less their centre add up to ``rest``; whole numbers divide once, so an entry is the exact covariance rounded to a double.
        covariance[i, j] = covariance[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    return Moments(n, sums, centre, rest, covariance)


def _whitened(x: np.ndarray, m: Moments, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return ((x - m.centre) - np.array([r / m.n for r in m.rest])) @ vectors / np.sqrt(values)


def _identity_error(fit: DataFrame, width: int, m: Moments, values: np.ndarray, vectors: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity. Vectors are centred before anything is multiplied."""
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if len(batch):
                white = _whitened(_matrix(batch.column(0)), m, values, vectors)
                total, sums = total + white.T @ white, sums + white.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k), pa.int32()), pa.array([*total.ravel(), *sums], pa.float64())], ["cell", "value"])

    parts = fit.where(F.size("x") == width).mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    found = np.zeros(k * k + k)
    for cell, value in parts.toLocalIterator():
        found[cell] = value
    mean = found[k * k:] / m.n
    return float(np.abs(found[:k * k].reshape(k, k) / m.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(x: np.ndarray, m: Moments) -> list[int | None]:
    """Sum over the dimensions of (n * x - sum)^2, exact; None beyond a long."""
    away = x - m.centre
    bound = m.n * int(np.abs(away).max(initial=0)) + max(map(abs, m.rest), default=0)
    if bound * bound * max(x.shape[1], 1) < 1 << 63:
        return ((m.n * away - np.array(m.rest, np.int64)) ** 2).sum(axis=1).tolist()
    found = ((m.n * away.astype(object) - np.array(m.rest, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in found]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """Return (vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    The fit list is each distinct vector once, in whole steps of 1/256. Tasks add up exact integers - number and sums, then products of centred
    vectors - so the covariance doesn't depend on the order of tasks or on a retry, and no digits cancel. The driver solves the covariance, as wide
    as a vector (at most ``MOST_DIMENSIONS``): inertia counts locate the largest eigenvalues, contour integrals project on their intervals and
    Rayleigh-Ritz extracts the components (``spectrum``); a missed or inexact one stops the job. One more pass over the fit list measures the
    whitened covariance, and the vectors are projected where they lie. Equal vectors are reduced before they shuffle, so copies of one do no harm.

    Rows whose vector is null, holds null or non-finite components, or components beyond 2**54, are left out. Vectors of another length have a fit list of
    their own (at most ``MOST_LENGTHS`` lengths). Components with an eigenvalue of zero, to rounding, have no rows: none at all where
    all vectors are equal, or for vectors of length 0. Equal eigenvalues have any unit vectors of their plane, the same for all rows and runs. Repeated
    rows each get theirs, null ids too. A deviation beyond a long is null.
    """
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("bigint").alias("vec_id"), steps(F.col(vector_col)).alias("x"))
    fit = saved(rows.select("x").distinct(), "whitening-fit")
    widths = sorted(r.width for r in fit.groupBy(F.size("x").alias("width")).count().limit(MOST_LENGTHS + 1).collect())
    if len(widths) > MOST_LENGTHS or max(widths, default=0) > MOST_DIMENSIONS:
        raise ValueError(f"vectors of at most {MOST_LENGTHS} lengths up to {MOST_DIMENSIONS} can be whitened")
    result = vectors.sparkSession.createDataFrame([], _ROWS)
    for width in widths:
        m = moments(fit, width)
        values, axes = spectrum.largest(m.covariance, components)
        if len(values):
            explained, error = values / np.trace(m.covariance), _identity_error(fit, width, m, values, axes)
            result = result.unionByName(rows.where(F.size("x") == width).mapInArrow(_projection(m, values, axes, explained, error), _ROWS))
    return result


def _projection(m: Moments, values: np.ndarray, axes: np.ndarray, explained: np.ndarray, error: float):
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, each = _matrix(batch.column(1)), np.repeat(np.arange(len(batch)), k)
            deviation = pa.array(_deviation(x, m), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(batch)), pa.int32()), pa.array(np.full(len(each), m.n), pa.int64()),
                 deviation.take(pa.array(each)), pa.array(_whitened(x, m, values, axes).ravel(), pa.float64()), pa.array(np.tile(explained, len(batch)), pa.float64()),
                 pa.array(np.full(len(each), error), pa.float64())], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run
