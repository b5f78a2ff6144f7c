import random

import numpy as np
import pytest

from spanloom.operators import fragments

HIST = "grp string, fl long, cnt long"


def _fit(values):
    """The robust fit by a plain list of lengths."""
    x = np.sort(np.array(values))
    lo, hi = x[0], x[-1]
    if len(x) > 40:
        k = int(len(x) * 0.15)
        guess = x[k : len(x) - k]
        lo, hi = max(0, guess.mean() - 4 * guess.std()), guess.mean() + 4 * guess.std()
    left = x[(x > lo) & (x < hi)]
    left = left if len(left) else x
    n, d = len(left), left - left.mean()
    sd = left.std()
    skew = (d**3).mean() / sd**3 if sd else None
    se_sd = np.sqrt(2 / (n * n - n) * (d**4).mean()) if n > 1 else None
    se_skew = np.sqrt(6 * n * (n - 1) / ((n - 2) * (n + 1) * (n - 3))) if n > 3 else None
    return n, int(left[0]), int(left[-1]), left.mean(), sd, skew, sd / np.sqrt(n), se_sd, se_skew


def _groups():
    rng = random.Random(8)
    out = {f"g{i}": [max(1, round(rng.gauss(150 + 40 * (i % 3), 10 + 5 * (i % 2)))) for _ in range(400)] + [rng.randrange(1, 3000) for _ in range(20)] for i in range(6)}
    return out | {"few": [7, 9, 9, 12, 40], "one": [33], "same": [50] * 90, "two": [3, 8], None: [10, 20, 30, 40, 50]}


def _rows(spark, groups):
    return spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "grp string, fl long")


def test_robust_fit_equals_loop(spark):
    groups = _groups()
    got = {r.grp: tuple(r)[1:] for r in fragments.robust(fragments.histogram(_rows(spark, groups), ["grp"]), ["grp"]).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        for a, b in zip(got[g], _fit(values)):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-9, abs=1e-9), g


def test_normal_fit_and_densities(spark):
    groups = _groups()
    h = fragments.histogram(_rows(spark, groups), ["grp"]).cache()
    for r in fragments.normal(h, ["grp"]).collect():
        x = np.sort(groups[r.grp])
        k = int(len(x) * 0.15)
        x = x[k : len(x) - k]
        assert (r.n, r.fl_min, r.fl_max) == (len(x), x[0], x[-1]) and r.mean == pytest.approx(x.mean()) and r.sd == pytest.approx(x.std())
    sums, fits = {}, {r.grp: r for r in fragments.robust(h, ["grp"]).collect()}
    for r in fragments.densities(h, ["grp"]).collect():
        sums[r.grp] = sums.get(r.grp, 0) + r.density
        assert fits[r.grp].fl_min <= r.fl <= fits[r.grp].fl_max
    assert sums.keys() == groups.keys() and all(s == pytest.approx(1) for s in sums.values())


def test_merged_moments_are_those_of_the_pool(spark):
    groups = {k: v for k, v in _groups().items() if k}
    h = fragments.histogram(_rows(spark, groups), ["grp"])
    parts = fragments.moments(h, ["grp"]).withColumnRenamed("grp", "part").selectExpr("substring(part, 1, 1) as grp", "n", "mean", "m2", "m3", "m4")
    got = {r.grp: r for r in fragments.merge_moments(parts, ["grp"]).collect()}
    for k in {g[0] for g in groups}:
        x = np.concatenate([v for g, v in groups.items() if g[0] == k]).astype(float)
        d = x - x.mean()
        assert got[k].n == len(x) and got[k].mean == pytest.approx(x.mean())
        for p, m in ((2, got[k].m2), (3, got[k].m3), (4, got[k].m4)):
            assert m == pytest.approx((d**p).sum(), rel=1e-9, abs=1e-6)


def test_clusters_need_all_three_and_pool_exactly(spark):
    rng = random.Random(2)
    near, wide, far = ([max(1, round(rng.gauss(m, s))) for _ in range(900)] for m, s in ((200, 10), (200, 40), (400, 10)))
    groups = {"a": near[:450], "b": near[450:], "c": wide, "d": far}
    h = fragments.histogram(_rows(spark, groups), ["grp"]).cache()
    c = fragments.clusters(fragments.robust(h, ["grp"]), ["grp"]).cache()
    got = {r.grp: r.cluster for r in c.collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 3
    pooled = {r.cluster: tuple(r)[1:] for r in fragments.pooled(h, c, ["grp"]).collect()}
    for k in set(got.values()):
        want = _fit([v for g, vs in groups.items() if got[g] == k for v in vs])
        assert pooled[k] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_pairs_in_exons_of_single_transcripts(spark):
    exons = spark.createDataFrame([("g", "t", "c", "+", 10, 50), ("h", "t", "c", "+", 100, 180), ("h", "u", "c", "+", 100, 180)], "gene string, transcript string, contig string, strand string, start long, stop long")
    rows = [("c", "+", 10, 50, 41, False, "q1"), ("c", "+", 9, 50, 42, False, "q2"), ("c", "-", 20, 30, 11, False, "q3"), ("c", "+", 20, 30, 11, True, "q4"), ("c", "+", 20, 30, 11, None, "q5"), ("c", "+", 110, 130, 21, False, "q6"), ("c", "+", 20, 30, None, False, "q7")]
    pairs = spark.createDataFrame([(*r, "x") for r in rows], "contig string, strand string, start long, stop long, fl long, spliced boolean, qname string, grp string")
    count = lambda **k: {(r.grp, r.fl): r.cnt for r in fragments.in_exons(pairs, exons, ["grp"], **k).collect()}
    assert count() == {("x", 41): 1, ("x", 11): 1}
    assert count(most=1) == {("x", 41): 1}


def test_density_builders():
    assert fragments.uniform_density(3, 6) == {3: 0.25, 4: 0.25, 5: 0.25, 6: 0.25}
    n = fragments.normal_density(100, 300, 200, 20)
    assert sum(n.values()) == pytest.approx(1) and n[180] == pytest.approx(n[220]) and n[200] / n[220] == pytest.approx(np.exp(0.5), rel=1e-5)
    assert fragments.normal_density(5, 9, 7, 0) == pytest.approx({5: 0, 6: 0, 7: 1, 8: 0, 9: 0})
    m = fragments.mixture_density([(100, 5, 3), (300, 10, 1)])
    assert sum(m.values()) == pytest.approx(1) and sum(p for k, p in m.items() if k < 200) == pytest.approx(0.75) and (min(m), max(m)) == (80, 340)


def test_no_fragments(spark):
    h = fragments.histogram(spark.createDataFrame([], "grp string, fl long"), ["grp"])
    assert fragments.robust(h, ["grp"]).count() == 0 and fragments.normal(h, ["grp"]).count() == 0
    assert fragments.clusters(fragments.robust(h, ["grp"]), ["grp"]).count() == 0
