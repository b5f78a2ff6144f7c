"""Distribution functions without scipy: incomplete beta and gamma, quantiles, simplex projection, NNLS."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
        f = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
                f = f * d * c
            if np.all(np.abs(d * c - 1) < 1e-14):
                break
    out = np.where(z <= 0, 0.0, front * f)
    return np.where(swap, 1 - out, out)


def _bisect(cdf, target: float, lo: np.ndarray, hi: np.ndarray, rounds: int = 100) -> np.ndarray:
    for _ in range(rounds):
        mid = (lo + hi) / 2
        under = cdf(mid) < target
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return (lo + hi) / 2


def beta_ppf(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantile by bisection, over distinct (a, b) only."""
    pairs = np.stack(np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float)), -1).reshape(-1, 2)
    if not len(pairs):
        return np.zeros(0)
    one, back = np.unique(pairs, axis=0, return_inverse=True)
    x = _bisect(lambda m: betainc(one[:, 0], one[:, 1], m), q, np.zeros(len(one)), np.ones(len(one)), 60)
    return x[np.ravel(back)]


def gammainc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma: series under a + 1, else continued fraction."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(a * np.log(x) - x - _lgamma(a))
        term = 1 / a
        total = term.copy()
        for n in range(1, 2000):
            term = term * x / (a + n)
            total = total + term
            if np.all(np.abs(term) <= 1e-15 * np.abs(total) + 1e-300):
                break
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for n in range(1, 2000):
            an = -n * (n - a)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-14):
                break
    return np.where(x <= 0, 0.0, np.where(x < a + 1, front * total, 1 - front * h))


def gamma_isf(p: float, shape: float, scale: float) -> float:
    """Upper quantile: Wilson and Hilferty's cube for large shapes, else bisection."""
    if shape > 100:
        from statistics import NormalDist

        z = NormalDist().inv_cdf(1 - p)
        return scale * shape * (1 - 1 / (9 * shape) + z / (3 * shape**0.5)) ** 3
    hi = max(shape, 1.0)
    while 1 - float(gammainc(shape, hi)) > p:
        hi *= 2
    return scale * float(_bisect(lambda m: gammainc(shape, m), 1 - p, np.array(0.0), np.array(hi)))


def chi2_ppf1(p: float) -> float:
    """Quantile of chi squared with one degree of freedom."""
    from statistics import NormalDist

    return NormalDist().inv_cdf((1 + p) / 2) ** 2


def chi2_sf1(x: float) -> float:
    return math.erfc(math.sqrt(x / 2))


def simplex_projection(v: np.ndarray) -> np.ndarray:
    """Nearest point (Euclidean) whose coordinates are non-negative and sum to 1."""
    v = np.asarray(v, float)
    u = np.sort(v)[::-1]
    over = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - over[np.flatnonzero(u > over)[-1]], 0)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Lawson-Hanson: least squares under x >= 0; solution and norm of the residual."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        if free.all() or np.max(np.where(free, -np.inf, w)) <= 1e-10:
            break
        free[int(np.argmax(np.where(free, -np.inf, w)))] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min(initial=1) > 0:
                break
            bad = free & (s <= 0)
            step = np.min(x[bad] / (x[bad] - s[bad]))
            x = x + step * (s - x)
            free &= x > 1e-14
        x = s
    return x, float(np.linalg.norm(b - a @ x))
