"""Whitening and its eigensolver against plain numpy."""

import math

import numpy as np
import pytest

from fleetscope.llm import spectrum, whitening
from fleetscope.llm.queries import QUERIES

VECTOR = "vec_id bigint, embedding array<double>, n int, x string, component int"


def plain(rows, k=4):
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    found = {}
    for i, x in good:
        away = [n * c - s for c, s in zip(x, sums)]
        found[i] = (n, sum(a * a for a in away), np.array(away) / n @ vectors / np.sqrt(values))
    return found, values / np.trace(covariance)


def compare(df, rows, tolerance=1e-9):
    want, explained = plain(rows)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(want)
    signs = np.sign([sum(got[i][c + 1].whitened * want[i][2][c] for i in want) for c in range(len(explained))])
    for i, (n, deviation, white) in want.items():
        assert sorted(got[i]) == list(range(1, len(explained) + 1))
        for c, r in got[i].items():
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(r.whitened * signs[c - 1] - white[c - 1]) < tolerance * max(1, abs(white[c - 1]))
            assert abs(r.explained - explained[c - 1]) < 1e-12 and 0 <= r.identity_error < 1e-9


def test_whitening_of_the_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(QUERIES["op13_whitening"](spark, small), rows)


def test_whitening_far_from_zero_with_odd_rows(frame):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((80, 6)) * [5, 3, 2, 1, 0.5, 0.2] + 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100, None), (101, [None] + [0.0] * 5), (102, [float("nan")] + [0.0] * 5), (103, [float("inf")] + [0.0] * 5)] + [(200 + i, rows[0][1]) for i in range(50)]
    df = frame(VECTOR, [(*r, 1, "x", 2) for r in rows])
    compare(whitening.whiten(df), rows)
    again = whitening.whiten(df.repartition(5)).collect()
    assert sorted(again, key=repr) != [] and {(r.vec_id, r.component, r.whitened) for r in again} == {(r.vec_id, r.component, r.whitened) for r in whitening.whiten(df).collect()}


def test_edge_cases(frame):
    make = lambda rows: whitening.whiten(frame(VECTOR, [(*r, 1, "x", 2) for r in rows]))
    assert make([]).count() == 0 and make([(1, [1.0, 2.0])]).count() == 0 and make([(1, [])]).count() == 0
    assert make([(1, None), (2, [1e300])]).count() == 0
    flat = make([(1, [0.0, 5.0]), (2, [2.0, 5.0]), (2, [2.0, 5.0]), (None, [-0.001, 5.0])]).collect()
    assert len(flat) == 4 and {r.component for r in flat} == {1} and {r.explained for r in flat} == {1.0} and {r.n for r in flat} == {3}
    lengths = make([(1, [0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 3.0])]).collect()
    assert sorted((r.vec_id, r.component) for r in lengths) == [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (5, 1), (5, 2)]
    wide = make([(1, [2.0**40]), (2, [-(2.0**40)])]).collect()
    assert {r.deviation for r in wide} == {None} and sorted(r.whitened for r in wide) == [-1.0, 1.0]
    with pytest.raises(ValueError):
        make([(1, [0.0] * (whitening.MOST_DIMENSIONS + 1))])


@pytest.mark.parametrize("size", [5, 1 << 21, 1 << 30, 1 << 45])
def test_products_are_exact(size):
    rows = np.random.default_rng(1).integers(-size, size, (300, 7))
    want = [[sum(int(a) * int(b) for a, b in zip(rows[:, i], rows[:, j])) for j in range(7)] for i in range(7)]
    assert whitening.exact_products(rows).tolist() == want


@pytest.mark.parametrize("values", [
    [9, 7, 5, 3, 2, 1, 0.5], [1e12, 1e6, 1, 0, 0, 0, 0], [4, 4, 4, 4, 4, 1, 1], [1, 1, 1, 1, 1, 1, 1], [3, 2, 0, 0, 0, 0, 0], [5, 4.9999, 4.9998, 4.9997, 4.9996, 1, 1],
    [2, 1, 1 - 1e-9, 1 - 2e-9, 1 - 3e-9, 0.5, 0.1],
])
def test_contours_find_all_eigenpairs(values):
    q = np.linalg.qr(np.random.default_rng(4).standard_normal((7, 7)))[0]
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = spectrum.largest(matrix, 4)
    want = [v for v in sorted(values, reverse=True)[:4] if v > 1e-14 * max(values)]
    assert len(found) == len(want) and np.allclose(found, want, rtol=1e-12, atol=1e-13 * max(values))
    assert np.allclose(matrix @ vectors, vectors * found, atol=1e-13 * max(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-9)


def test_inertia_counts():
    rng = np.random.default_rng(9)
    matrix = rng.standard_normal((40, 40))
    matrix += matrix.T
    diagonal, squares = spectrum.tridiagonal(matrix)
    values = np.linalg.eigvalsh(matrix)
    for shift in rng.standard_normal(50) * 5:
        assert spectrum.count_above(diagonal, squares, shift) == (values > shift).sum()
