"""Frequencies, bounds and identifiability against grids."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions.stats import chi2_ppf1, simplex_projection
from spanloom.operators import quant


def grid(n, step):
    k = round(1 / step)
    if n == 2:
        return np.array([(i / k, 1 - i / k) for i in range(k + 1)])
    return np.array([(i / k, j / k, (k - i - j) / k) for i in range(k + 1) for j in range(k + 1 - i)])


def ll(e, o, f):
    return np.where(o > 0, o * np.log(np.maximum(f @ e.T, 1e-300)), 0).sum(1)


def matrices(n, seed, many=12):
    rng = np.random.default_rng(seed)
    for _ in range(many):
        e = rng.random((rng.integers(n + 1, 7), n)) ** 3 + 1e-3
        e /= e.sum(0)
        yield e, rng.poisson(e @ rng.dirichlet(np.full(n, 0.7)) * rng.choice([20, 200, 2000])).astype(float)


def test_projection():
    rng = np.random.default_rng(0)
    x, live = rng.normal(size=(50, 6)), rng.random((50, 6)) < 0.7
    live[:, 0] = True
    got = quant.project(x, live, np.ones(50))
    for a, m, g in zip(x, live, got):
        assert np.allclose(g[m], simplex_projection(a[m])) and not g[~m].any()


@pytest.mark.parametrize("n, step", [(2, 0.0005), (3, 0.01)])
def test_mle_and_bounds_equal_a_grid(n, step):
    points = grid(n, step)
    for e, o in matrices(n, 4 + n):
        best = quant.mle(e, o)
        at = ll(e, o, points)
        assert best.sum() == pytest.approx(1) and ll(e, o, best[None])[0] >= at.max() - 1e-7
        if n == 2:
            assert np.abs(points[at.argmax()] - best).max() < 0.002
        inside = points[at >= ll(e, o, best[None])[0] - chi2_ppf1(0.975) / 2]
        for i in range(n):
            lo, hi = quant.profile_bounds(e, o, i)
            assert lo <= inside[:, i].min() + 1e-6 and hi >= inside[:, i].max() - 1e-6
            assert inside[:, i].min() - lo < 2.5 * step + 0.02 * (n == 3) and hi - inside[:, i].max() < 2.5 * step + 0.02 * (n == 3)


def test_optimality_conditions_of_wide_genes():
    rng = np.random.default_rng(7)
    e = rng.random((40, 25)) ** 4
    e /= e.sum(0)
    o = rng.poisson(e @ rng.dirichlet(np.full(25, 0.3)) * 5000).astype(float)
    f = quant.mle(e, o)
    g = e.T @ (o / (e @ f)) / o.sum()  # 1 where a frequency is positive, at most 1 elsewhere
    assert g.max() < 1 + 1e-4 and np.abs(g[f > 1e-5] - 1).max() < 1e-3


def test_ties_go_to_equal_shares():
    e = np.array([[0.5, 0.5, 0.1], [0.5, 0.5, 0.9]])
    f = quant.mle(e, e @ np.array([0.6, 0.0, 0.4]) * 1000)
    assert f[0] == pytest.approx(f[1], abs=1e-6) and f[2] == pytest.approx(0.4, abs=1e-4)
    assert quant.identifiable(e).tolist() == [False, False, True] and quant.identifiable(e[:, :1]).tolist() == [True]


def test_estimate_solves_each_gene_by_itself(spark, monkeypatch):
    rows, want = [], {}
    for g, (e, o) in enumerate(itertools.chain(matrices(2, 1), matrices(3, 2), matrices(1, 3, 2))):
        rows += [(g, k, f"t{j}", float(e[k, j]), float(o[k])) for k, j in np.ndindex(*e.shape) if e[k, j] > 0]
        want[g] = quant.mle(e / e.sum(0), o)
    rows += [(100, 0, "a", 1.0, 0.0), (100, 0, "b", 1.0, 0.0), (None, 0, "a", 1.0, 3.0)]
    bins = spark.createDataFrame(rows, "gene int, bin int, transcript string, expected double, observed double")
    got = quant.estimate(bins, with_bounds=True).collect()
    for r in got:
        if r.gene is not None and r.gene < 100:
            assert r.freq == pytest.approx(want[r.gene][int(r.transcript[1:])], abs=1e-6) and r.lower - 1e-9 <= r.freq <= r.upper + 1e-9
        elif r.gene == 100:
            assert r.freq is None and r.lower is None and r.identifiable is False
    assert len(got) == sum(map(len, want.values())) + 2
    monkeypatch.setattr(quant, "MOST_CELLS", 5)
    large = quant.estimate(bins.where("gene = 0"), with_bounds=True).collect()
    assert len(large) == 2 and all(r.freq is None for r in large)
    assert quant.estimate(bins.where(F.lit(False))).collect() == []
