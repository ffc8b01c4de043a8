"""Whitening against the eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest
from framesift.llm import whitening


def plain(rows, k=16):
    """Fit of the distinct whole vectors, by numpy: n, sums, eigenvalues and components, trace."""
    x = np.unique(np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in rows], np.int64), axis=0)
    sums = x.sum(axis=0)
    c = (x * len(x) - sums) / len(x)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    return len(x), sums, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def check(found, rows, k, rtol=1e-7):
    """``found`` are the rows of the query for ``rows`` of (vec_id, vector), ids unique."""
    n, sums, values, vectors, trace = plain([v for _, v in rows], k)
    by_key = {(r["vec_id"], r["component"]): r for r in found}
    assert len(by_key) == len(found) == len(rows) * k
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], np.int64)
    expected = ((x * n - sums) / n) @ vectors / np.sqrt(values)
    got = np.array([[by_key[i, j + 1]["whitened"] for j in range(k)] for i, _ in rows])
    got *= np.sign((got * expected).sum(axis=0))
    assert np.abs(got - expected).max() < rtol
    for i, (vec_id, _) in enumerate(rows):
        assert by_key[vec_id, 1]["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
    assert all(r["n"] == n and r["identity_error"] <= 1e-4 for r in found)
    assert np.allclose([by_key[rows[0][0], j + 1]["explained"] for j in range(k)], values / trace, rtol=1e-9)


def made(n, d, seed, decay):
    rng = np.random.default_rng(seed)
    return [(i, (10 * rng.standard_normal(d) * decay ** np.arange(d)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("d", "decay"), [(40, 0.97), (40, 0.4), (20, 1.0)])
def test_against_the_whole_covariance(spark, d, decay):
    """A slow fall of eigenvalues, a steep one, and fewer dimensions than the basis would have."""
    rows = made(400, d, 3, decay)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    k = 16 if decay > 0.5 else 6
    check(whitening.query(frame, k).collect(), rows, k)


def test_passes_or_expansion(spark):
    """A steep fall needs no expansion; with equal eigenvalues the basis is expanded."""
    steep, flat = (spark.createDataFrame(made(500, 48, 1, decay), "vec_id long, embedding array<double>") for decay in (0.25, 1.0))
    fits = [whitening.fitted(whitening.quantised(f).select("x").distinct(), 3, residual=1e-10) for f in (steep, flat)]
    assert [f.expanded for f in fits] == [False, True]
    for fit in fits:
        assert np.allclose(fit.vectors.T @ fit.vectors, np.eye(3), atol=1e-12)


def test_rows_that_go_and_rows_that_repeat(spark):
    rows = made(60, 5, 9, 0.8)
    inf, nan = float("inf"), float("nan")
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [1.0, inf, 0.0, 0.0, 0.0]), (903, [nan] * 5), (904, []), (905, [1.0]), (906, [1e300] * 5)]
    schema = "vec_id long, embedding array<double>, x string, id string"
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows + bad], schema)
    once = whitening.query(frame, 4).collect()
    check(once, rows, 4)
    hot = spark.createDataFrame([(*r, "a", "b") for r in rows + bad + [(None, rows[3][1])] * 200], schema).repartition(5)
    again = whitening.query(hot, 4).collect()
    assert len(again) == len(once) + 200 * 4
    by_key = {(r["vec_id"], r["component"]): r for r in again}
    for r in once:
        assert by_key[r["vec_id"], r["component"]]["whitened"] == pytest.approx(r["whitened"], abs=1e-9)
        if r["vec_id"] == 3:
            assert by_key[None, r["component"]]["whitened"] == pytest.approx(r["whitened"], abs=1e-9)


def test_degenerate(spark):
    """No rows, one row, rows that are all alike: no component. Rows on a line: one."""
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.query(make([])).count() == whitening.query(make([(1, [1.0, 2.0])])).count() == whitening.query(make([(1, [1.0, 2.0])] * 9)).count() == 0
    line = [(i, [float(i), 2.0 * i]) for i in range(10)]
    found = whitening.query(make(line)).collect()
    assert {r["component"] for r in found} == {1} and found[0]["explained"] == pytest.approx(1.0)


def test_large_deviations():
    fit = whitening.Fit(3, (30, 3 << 40), 0.0, np.empty(0), np.empty((2, 0)), False)
    x = np.array([[10, 1 << 40], [12, (1 << 40) + 5], [10, 1 << 50], [10, (1 << 40) + (1 << 30)]], np.int64)
    exact = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, fit.sums)) for row in x]
    assert whitening.deviations(x, fit) == [v if v < 1 << 63 else None for v in exact]
    assert whitening.deviations(x[:2], fit) == exact[:2]
