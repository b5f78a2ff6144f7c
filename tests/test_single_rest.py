"""Where one transcript is left beside the held one, nothing is solved for it."""

import numpy as np

from spanloom.functions.stats import nnls
from spanloom.operators import quant


def test_bounds_of_two_transcripts_solve_nothing(monkeypatch):
    r = np.random.default_rng(2)
    e, o, live = r.random((40, 6, 2)), r.integers(0, 50, (40, 6)).astype(float), np.ones((40, 2), bool)
    live[3, 1] = False
    e[3, :, 1] = 0
    e[7, :, 1] = e[7, :, 0]
    e /= np.maximum(e.sum(1, keepdims=True), 1e-12)
    best = quant.solve(e, o, live)
    plain = quant.ascend
    calls = []
    monkeypatch.setattr(quant, "ascend", lambda *a: calls.append(1) or plain(*a))
    low, high = quant.bounds(e, o, live, best)
    assert not calls
    floor = quant._value(e, o, best, live, 0.0)[0] - quant.chi2_ppf1(0.975) / 2 / o.sum(1)
    grid = np.linspace(0, 1, 4001)
    for k in range(40):
        if live[k].all():
            inside = grid[[quant.log_likelihood(e[k], o[k], np.array([g, 1 - g])) / o[k].sum() >= floor[k] - 1e-9 for g in grid]]
            assert abs(inside.min() - low[k, 0]) < 1e-3 and abs(inside.max() - high[k, 0]) < 1e-3


def test_identifiable_equals_least_squares():
    r = np.random.default_rng(3)
    for k in range(200):
        m = r.random((5, 2)) * (r.random((5, 2)) > 0.4)
        if k % 5 == 0:
            m[:, 1] = 2 * m[:, 0]
        assert quant.identifiable(m).tolist() == [nnls(m[:, [1 - i]], m[:, i])[1] > 1e-6 for i in (0, 1)]
