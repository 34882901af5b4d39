"""Whitening against a plain eigendecomposition, the solver against known spectra."""

import numpy as np
import pytest

from campuspulse.llm import whitening
from campuspulse.llm.bidiagonal import bidiagonalise, right_singular

CLASH = "label int, component int, n long, part long, payload string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, None, 7, 3, "x") for i, v in rows], f"vec_id long, embedding array<float>, {CLASH}")


def integers(vectors):
    return [[int(np.floor(1024.0 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]


def check(spark, rows, good, k=8):
    """Result of the operator next to a brute-force version over the vectors ``good``."""
    x = integers([v for _, v in good])
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array(x, float) - np.array(sums, float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(k, d, int((values > 1e-9 * values[0]).sum()))
    got = whitening.components(frame(spark, rows), k).collect()
    assert len(got) == n * rank
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    deviation = sorted((i, sum((n * a - s) ** 2 for a, s in zip(r, sums))) for (i, _), r in zip(good, x))
    for c in range(rank):
        want = centred @ vectors[:, c] / np.sqrt(values[c])
        rows_c = [r for (i, _) in dict(good).items() for r in by[c + 1][i]]
        assert sorted((r.vec_id, r.deviation) for r in rows_c) == deviation
        have = {r.vec_id: r.whitened for r in rows_c}
        pairs = np.array([(have[i], w) for (i, _), w in zip(good, want)])
        sign = np.sign(pairs[0, 0] * pairs[0, 1])
        assert np.allclose(pairs[:, 0], sign * pairs[:, 1], atol=1e-8)
        assert all(r.n == n and r.identity_error < 1e-9 and abs(r.explained - values[c] / values.sum()) < 1e-12 for r in rows_c)


def test_equals_eigenvectors_and_drops_unusable_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.5, 12)) + 1
    good = [(i, v.tolist()) for i, v in enumerate(base)]
    good += [(i + 300, good[7][1]) for i in range(200)]  # one vector many times
    inf, nan = float("inf"), float("nan")
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [1.0] * 11 + [inf]), (904, [nan] + [0.0] * 11), (905, [1.0, 2.0]), (906, [1e30] * 12)]
    check(spark, good + bad, good)
    check(spark, good + bad, good, 3)


def test_fewer_dimensions_or_rank_than_components(spark):
    rng = np.random.default_rng(6)
    narrow = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 3)))]
    check(spark, narrow, narrow)
    flat = [(i, [float(a), 0.0, float(b), 2.0]) for i, (a, b) in enumerate(rng.normal(size=(40, 2)) * [5, 1])]
    check(spark, flat, flat)
    large = [(i, [float(v) * 2**30, float(v % 3)]) for i, v in enumerate(range(20))]
    got = whitening.components(frame(spark, large)).where("component = 1").collect()
    assert all(r.deviation is None for r in got) and got[0].identity_error < 1e-6


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])]):
        out = whitening.components(frame(spark, rows))
        assert out.count() == 0
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_null_ids_and_partitions_do_not_matter(spark):
    rng = np.random.default_rng(7)
    rows = [(None if i % 3 else i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 5)))]
    one = frame(spark, rows).coalesce(1)
    many = frame(spark, rows).repartition(40)
    a = sorted(r.whitened for r in whitening.components(one).collect())
    b = sorted(r.whitened for r in whitening.components(many).collect())
    assert len(a) == 2000 and np.allclose(a, b, atol=1e-10)


def _orthogonal(rng, n):
    return np.linalg.qr(rng.normal(size=(n, n)))[0]


@pytest.mark.parametrize("name", ["random", "clusters", "rank", "tight", "graded", "zero", "wilkinson", "one"])
def test_solver(name):
    rng = np.random.default_rng(8)
    q, p = _orthogonal(rng, 30), _orthogonal(rng, 30)
    w = np.diag(np.abs(np.arange(21) - 10.0) + 2) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    r = {
        "random": np.triu(rng.normal(size=(30, 30))), "clusters": q @ np.diag([4.0] * 10 + [2.0] * 10 + [1.0] * 10) @ p,
        "rank": q @ np.diag([4.0] * 3 + [0.0] * 27) @ p, "tight": q @ np.diag(1 + 1e-10 * np.arange(30)) @ p,
        "graded": np.diag(10.0 ** -np.arange(12)), "zero": np.zeros((4, 4)), "wilkinson": np.linalg.cholesky(w).T, "one": np.array([[2.0]]),
    }[name]
    values, rows = right_singular(r, len(r))
    exact = np.linalg.svd(r, compute_uv=False) ** 2
    scale = max(exact[0], 1e-300)
    assert np.abs(values - exact).max() < 1e-13 * scale
    assert np.abs(rows @ rows.T - np.eye(len(r))).max() < 1e-11
    assert max(np.linalg.norm(r.T @ (r @ x) - v * x) for v, x in zip(values, rows)) < 1e-11 * scale
    if name == "graded":
        assert np.abs(values / exact - 1).max() < 1e-12


def test_bidiagonal_form():
    r = np.triu(np.random.default_rng(9).normal(size=(9, 9)))
    diagonal, above, v = bidiagonalise(r)
    b = np.diag(diagonal) + np.diag(above, 1)
    assert np.allclose(v @ (b.T @ b) @ v.T, r.T @ r) and np.allclose(v.T @ v, np.eye(9))
