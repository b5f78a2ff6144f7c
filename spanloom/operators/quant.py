"""Abundance: penalised maximum likelihood on the simplex, profile bounds, identifiability, FPKM.

Spark makes one row of each gene's matrix; a task solves the genes of a batch at once,
stacked by size, so numpy's loops run over genes and not the other way round.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.stats import chi2_ppf1, nnls
from spanloom.session import written

#: weights of the entropy penalty: the first one, the divisor between stages, and the last one
PENALTY, SHRINK, LAST = 100.0, 5.0, 1e-6
#: cells (bins x transcripts) of a matrix beyond which a gene isn't estimated
MOST_CELLS = 4_000_000
#: cells of all matrices that are solved together
TOGETHER = 1 << 21
_TINY = 1e-300


def fpkm(freq: Column, effective: Column) -> Column:
    return F.when(freq < 0, F.lit(None).cast("double")).when(effective <= 0, F.lit(0.0)).otherwise(freq * 1e9 / effective)


def log_likelihood(expected: np.ndarray, observed: np.ndarray, freq: np.ndarray) -> float:
    return float((observed * np.log(expected @ freq + 1e-16)).sum())


def project(x: np.ndarray, live: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """The nearest points of the simplices: rows of x, coordinates that are ``live``, sums ``mass``; others are 0."""
    u = -np.sort(-np.where(live, x, -np.inf), axis=1)
    total = np.cumsum(np.where(np.isfinite(u), u, 0.0), axis=1)
    k = np.arange(1, x.shape[1] + 1)
    n = np.maximum((u - (total - mass[:, None]) / k > 0).sum(1), 1)
    theta = (np.take_along_axis(total, n[:, None] - 1, 1)[:, 0] - mass) / n
    return np.where(live, np.maximum(x - theta[:, None], 0.0), 0.0)


def _value(e: np.ndarray, o: np.ndarray, f: np.ndarray, live: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Objective of each problem (a mean by count), and the expected shares of its bins."""
    r = np.matmul(e, f[:, :, None])[:, :, 0]
    n = np.maximum(o.sum(1), 1.0)
    value = np.where(o > 0, o * np.log(np.maximum(r, _TINY)), 0.0).sum(1)
    if penalty:
        value = value - penalty * np.where(live & (f > 0), f * np.log(np.maximum(f, _TINY)), 0.0).sum(1)
    return value / n, r


def ascend(e: np.ndarray, o: np.ndarray, f: np.ndarray, live: np.ndarray, mass: np.ndarray, penalty: float, rounds: int, tol: float) -> np.ndarray:
    """Projected gradient with steps from the last change (Barzilai and Borwein), halved until the objective rises.

    e: (problems, bins, transcripts), o: (problems, bins), f: start.  Coordinates that aren't
    live keep their value.  Problems that have settled leave the loop.
    """
    out, at = f.copy(), np.arange(len(f))
    n = np.maximum(o.sum(1), 1.0)

    def slope(e, o, r, f, n, live):
        g = np.matmul(np.where(o > 0, o / np.maximum(r, _TINY), 0.0)[:, None, :], e)[:, 0]
        if penalty:
            g = g - penalty * (1 + np.log(np.maximum(f, 1e-12)))
        return np.where(live, g / n[:, None], 0.0)

    held = np.where(live, 0.0, f)
    value, r = _value(e, o, f, live, penalty)
    g, step, still = slope(e, o, r, f, n, live), np.ones(len(f)), np.zeros(len(f), int)
    for _ in range(rounds):
        new = project(f + step[:, None] * g, live, mass) + held
        d = new - f
        next_value, next_r = _value(e, o, new, live, penalty)
        good = next_value >= value + 1e-4 * (g * d).sum(1) - 1e-15
        moved = np.abs(d).max(1)
        next_g = slope(e, o, next_r, new, n, live)
        curved = -(d * (next_g - g)).sum(1)
        bold = np.where(curved > 1e-300, (d * d).sum(1) / np.maximum(curved, 1e-300), step * 4)
        step = np.where(good, np.clip(bold, 1e-12, 1e6), step / 4)
        f = np.where(good[:, None], new, f)
        value, g = np.where(good, next_value, value), np.where(good[:, None], next_g, g)
        # settled: a good step of a fair size that moves nothing, twice, or no step at all
        still = np.where(good & (moved < tol), still + 1, np.where(good, 0, still))
        done = (still >= 2) | (step < 1e-11)
        if done.any():
            out[at[done]] = f[done]
            go = ~done
            e, o, f, live, mass, n, held, value, g, step, still, at = (x[go] for x in (e, o, f, live, mass, n, held, value, g, step, still, at))
            if not len(at):
                break
    out[at] = f
    return out


def solve(e: np.ndarray, o: np.ndarray, live: np.ndarray, rounds: int = 3000, tol: float = 1e-9) -> np.ndarray:
    """Frequencies of greatest likelihood of each problem; the entropy penalty shrinks stage by stage and breaks ties at its end."""
    mass = np.ones(len(e))
    f = live / np.maximum(live.sum(1, keepdims=True), 1)
    penalty = PENALTY
    while penalty > LAST:
        f = ascend(e, o, f, live, mass, penalty, 60, 1e-4)
        penalty /= SHRINK
    # without the penalty from here on; where the likelihood is flat it doesn't move
    return ascend(e, o, f, live, mass, 0.0, rounds, tol)


def bounds(e: np.ndarray, o: np.ndarray, live: np.ndarray, best: np.ndarray, alpha: float = 0.025) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each frequency whose profiled likelihood stays within the chi squared bound.

    All transcripts' ends are problems of one stack: the frequency is held, the others
    are solved anew from where they were, and the held value is bisected.
    """
    n, m = best.shape
    which, column = np.nonzero(live)
    floor = _value(e, o, best, live, 0.0)[0] - chi2_ppf1(1 - alpha) / 2 / np.maximum(o.sum(1), 1.0)
    ends = []
    for edge in (0.0, 1.0):
        out = np.full((n, m), np.nan)
        for lo in range(0, len(which), max(1, TOGETHER // max(1, e.shape[1] * m))):
            p, c = (x[lo : lo + max(1, TOGETHER // max(1, e.shape[1] * m))] for x in (which, column))
            one, rows = np.arange(m) == c[:, None], np.arange(len(p))
            rest, alone = live[p] & ~one, live[p].sum(1) == 1

            def profiled(v: np.ndarray, f: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                scaled = np.where(rest[k], f, 0.0)
                left = scaled.sum(1, keepdims=True)
                even = rest[k] / np.maximum(rest[k].sum(1, keepdims=True), 1)
                start = np.where(left > 1e-9, scaled / np.maximum(left, 1e-300), even) * (1 - v[:, None]) + one[k] * v[:, None]
                # a little of each, so that a zero can grow again
                start = np.where(rest[k], 0.99 * start + 0.01 * even * (1 - v[:, None]), start)
                # what is left to a single transcript is no choice
                f, free = start, np.flatnonzero(rest[k].sum(1) > 1)
                if len(free):
                    f[free] = ascend(e[p[k[free]]], o[p[k[free]]], start[free], rest[k[free]], 1 - v[free], 0.0, 300, 1e-8)
                return f, _value(e[p[k]], o[p[k]], f, rest[k], 0.0)[0] >= floor[p[k]] - 1e-13

            good, bad, f = best[p, c].copy(), np.full(len(p), edge), best[p].copy()
            _, inside = profiled(bad, f, rows)
            good[inside | alone] = np.where(alone, 1.0, edge)[inside | alone]
            open_ = np.flatnonzero(~(inside | alone))
            for _ in range(34):
                if not len(open_):
                    break
                mid = (good[open_] + bad[open_]) / 2
                f[open_], inside = profiled(mid, f[open_], open_)
                good[open_] = np.where(inside, mid, good[open_])
                bad[open_] = np.where(inside, bad[open_], mid)
            out[p, c] = good
        ends.append(out)
    return ends[0], ends[1]


def _single(expected: np.ndarray, observed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.asarray(expected, float)[None], np.asarray(observed, float)[None], np.ones((1, np.shape(expected)[1]), bool)


def mle(expected: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """Frequencies of one matrix."""
    return solve(*_single(expected, observed))[0]


def profile_bounds(expected: np.ndarray, observed: np.ndarray, i: int, alpha: float = 0.025) -> tuple[float, float]:
    """Bounds of column i of one matrix."""
    e, o, live = _single(expected, observed)
    low, high = bounds(e, o, live, solve(e, o, live), alpha)
    return float(low[0, i]), float(high[0, i])


def identifiable(expected: np.ndarray) -> np.ndarray:
    """Whether each column lies outside the cone of the others: the residual of non-negative least squares is over 1e-6."""
    out = np.ones(expected.shape[1], bool)
    for i in range(expected.shape[1]):
        rest = np.delete(expected, i, 1)
        if rest.shape[1] == 1:  # the cone of one column is a ray
            one, own = rest[:, 0], expected[:, i]
            out[i] = np.linalg.norm(own - one * (max(one @ own, 0.0) / max(one @ one, _TINY))) > 1e-6
        elif rest.shape[1]:
            out[i] = nnls(rest, expected[:, i])[1] > 1e-6
    return out


def estimate(bins: DataFrame, gene: str = "gene", with_bounds: bool = False, alpha: float = 0.025) -> DataFrame:
    """(gene, bin, transcript, expected, observed) -> gene, transcript, freq, and where asked lower, upper and identifiable.

    Columns are scaled to sum to 1.  A gene of more than ``MOST_CELLS`` cells, or without
    observations, has null frequencies.
    """
    kinds = dict(bins.dtypes)
    cell = F.struct("transcript", "bin", F.col("expected").cast("double").alias("expected"), F.col("observed").cast("double").alias("observed"))
    # a matrix has at most the square of its rows' number of cells, so only genes of many rows are counted
    many = bins.groupBy(gene).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * F.col("_n") > MOST_CELLS).select(gene)
    size = bins.join(many, gene, "left_semi").groupBy(gene).agg(F.count_distinct("bin").alias("_b"), F.count_distinct("transcript").alias("_t"))
    large = written(size.where(F.col("_b") * F.col("_t") > MOST_CELLS).select(gene), "large")
    rows = bins.where(F.col(gene).isNotNull()).join(large, gene, "left_anti").groupBy(gene).agg(F.collect_list(cell).alias("cells"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cells, ends = b.column(1).values, b.column(1).offsets.to_numpy()
            t, k = cells.field("transcript"), cells.field("bin")
            x, o = cells.field("expected").to_numpy(), cells.field("observed").to_numpy()
            stacks, genes = defaultdict(list), []
            for g, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                ts, ks = t.slice(lo, hi - lo).dictionary_encode(), k.slice(lo, hi - lo).dictionary_encode()
                ti, ki = ts.indices.to_numpy(), ks.indices.to_numpy()
                e, seen = np.zeros((len(ks.dictionary), len(ts.dictionary))), np.zeros(len(ks.dictionary))
                np.add.at(e, (ki, ti), x[lo:hi])
                seen[ki] = o[lo:hi]
                e = e / np.maximum(e.sum(0), 1e-12)
                genes.append((ts.dictionary, e, seen))
                stacks[tuple(1 << max(n - 1, 0).bit_length() for n in e.shape)].append(g)
            found: dict[int, list[np.ndarray]] = {}
            for (rows_, cols), members in stacks.items():
                every = max(1, TOGETHER // (rows_ * cols))
                for at in range(0, len(members), every):
                    some = members[at : at + every]
                    e, seen, live = np.zeros((len(some), rows_, cols)), np.zeros((len(some), rows_)), np.zeros((len(some), cols), bool)
                    for i, g in enumerate(some):
                        _, m, s = genes[g]
                        e[i, : m.shape[0], : m.shape[1]], seen[i, : len(s)], live[i, : m.shape[1]] = m, s, True
                    best = solve(e, seen, live)
                    low, high = bounds(e, seen, live, best, alpha) if with_bounds else (best, best)
                    for i, g in enumerate(some):
                        n = genes[g][1].shape[1]
                        found[g] = [a[i, :n] if genes[g][2].sum() > 0 else np.full(n, np.nan) for a in (best, low, high)]
            if genes:
                names = pa.chunked_array([d for d, _, _ in genes]).combine_chunks()
                which = np.repeat(np.arange(len(genes)), [len(d) for d, _, _ in genes])
                cols = [b.column(0).take(pa.array(which)), names, *[pa.array(np.concatenate([found[g][j] for g in range(len(genes))]), from_pandas=True) for j in range(3 if with_bounds else 1)]]
                heads = [gene, "transcript", "freq", "lower", "upper"][: len(cols)]
                if with_bounds:
                    cols.append(pa.array(np.concatenate([identifiable(m) for _, m, _ in genes])))
                    heads.append("identifiable")
                yield pa.RecordBatch.from_arrays(cols, names=heads)

    more = ", lower double, upper double, identifiable boolean" if with_bounds else ""
    out = rows.mapInArrow(run, f"`{gene}` {kinds[gene]}, transcript {kinds['transcript']}, freq double{more}")
    none = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns[2:]]
    return out.unionByName(bins.join(large, gene, "left_semi").select(gene, "transcript").distinct().select(gene, "transcript", *none))
