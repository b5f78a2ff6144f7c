"""Fragment length models: histograms, mergeable moments, robust and normal fits, clusters of read groups.

All fits read histograms (keys, fl, cnt): one row for each length of a group, which
partial aggregation makes, so that windows hold a group's distinct lengths, never its
reads.  Histograms add up, so a pooled fit is the fit of the pooled histogram, exactly.
Nulls in keys are a group of their own; null lengths are left out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.intervals import contains_join

#: share cut from both ends for the first guess, and how many deviations around it are kept
TRIM, DEVIATIONS = 0.15, 4
#: groups up to this size take their extremes as bounds
FEW = 40
STATS = ("mean", "sd", "skew")


def histogram(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each length of a group."""
    return fragments.where("fl is not null").groupBy(*keys, "fl").agg(F.count(F.lit(1)).alias("cnt"))


def add(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram of coarser groups."""
    return hist.groupBy(*keys, "fl").agg(F.sum("cnt").alias("cnt"))


def moments(hist: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean and the sums m2, m3, m4 of powers of the distance to the mean."""
    w = Window.partitionBy(*keys)
    mean = F.sum(F.col("fl") * F.col("cnt")).over(w) / F.sum("cnt").over(w)
    d = F.col("fl") - F.col("_mean")
    sums = [F.sum(F.pow(d, k) * F.col("cnt")).alias(f"m{k}") for k in (2, 3, 4)]
    return hist.withColumn("_mean", mean).groupBy(*keys).agg(F.sum("cnt").alias("n"), F.max("_mean").alias("mean"), *sums)


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the pooled groups from the groups' own: binomial sums around the pooled mean."""
    w = Window.partitionBy(*keys)
    mean = F.sum(F.col("mean") * F.col("n")).over(w) / F.sum("n").over(w)
    d, n, m2, m3, m4 = (F.col(c) for c in ("_d", "n", "m2", "m3", "m4"))
    at = parts.withColumn("_all", mean).withColumn("_d", F.col("mean") - F.col("_all"))
    return at.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("_all").alias("mean"), F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * F.pow(d, 3)).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * F.pow(d, 4)).alias("m4"),
    )


def stats(mom: DataFrame) -> DataFrame:
    """Moments -> mean, sd, skew and their standard errors; null where a group is too small or has one length."""
    n = F.col("n").cast("double")
    sd = F.sqrt(F.col("m2") / n)
    skew = F.when(F.col("m2") > 0, F.col("m3") / n / F.pow(sd, 3))
    se_sd = F.when(n > 1, F.sqrt(2 / (n * n - n) * F.col("m4") / n))
    se_skew = F.when(n > 3, F.sqrt(6 * n * (n - 1) / ((n - 2) * (n + 1) * (n - 3))))
    return mom.withColumns({"sd": sd, "skew": skew, "se_mean": sd / F.sqrt(n), "se_sd": se_sd, "se_skew": se_skew}).drop("m2", "m3", "m4")


def _trimmed(hist: DataFrame, keys: list[str]) -> DataFrame:
    """With the number of each length that stays (``_in``) when ``TRIM`` of the group goes at either end."""
    w = Window.partitionBy(*keys)
    upto = F.sum("cnt").over(w.orderBy("fl").rowsBetween(Window.unboundedPreceding, 0))
    h = hist.withColumn("_n", F.sum("cnt").over(w)).withColumn("_upto", upto).withColumn("_cut", F.floor(F.col("_n") * F.lit(TRIM)))
    inside = F.least(F.col("_upto"), F.col("_n") - F.col("_cut")) - F.greatest(F.col("_upto") - F.col("cnt"), F.col("_cut"))
    return h.withColumn("_in", F.greatest(F.lit(0), inside))


def kept(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram without outliers: what lies strictly within ``DEVIATIONS`` of the trimmed guess.

    A group of at most ``FEW`` fragments loses its least and greatest length; a group that would lose all keeps all.
    """
    w = Window.partitionBy(*keys)
    h = _trimmed(hist, keys).withColumn("_at", F.sum(F.col("fl") * F.col("_in")).over(w) / F.sum("_in").over(w))
    h = h.withColumn("_sd", F.sqrt(F.sum(F.pow(F.col("fl") - F.col("_at"), 2) * F.col("_in")).over(w) / F.sum("_in").over(w)))
    many = F.col("_n") > FEW
    lo = F.when(many, F.greatest(F.lit(0.0), F.col("_at") - DEVIATIONS * F.col("_sd"))).otherwise(F.min("fl").over(w))
    hi = F.when(many, F.col("_at") + DEVIATIONS * F.col("_sd")).otherwise(F.max("fl").over(w))
    h = h.withColumn("_ok", (F.col("fl") > lo) & (F.col("fl") < hi))
    return h.withColumn("_any", F.max("_ok").over(w)).where("_ok or not _any").select(*keys, "fl", "cnt")


def robust(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, fl_min, fl_max, mean, sd, skew and standard errors of each group without outliers."""
    h = kept(hist, keys)
    ends = h.groupBy(*keys).agg(F.min("fl").alias("fl_min"), F.max("fl").alias("fl_max"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))
    s = stats(moments(h, keys))
    return s.join(ends, same(s, ends)).select(*[s[k] for k in keys], "n", "fl_min", "fl_max", "mean", "sd", "skew", "se_mean", "se_sd", "se_skew")


def densities(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fl, density of the kept lengths."""
    share = F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*keys))
    return kept(hist, keys).select(*keys, "fl", share.alias("density"))


def normal(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, fl_min, fl_max, mean, sd of what is left when ``TRIM`` goes at either end."""
    h = _trimmed(hist, keys).where("_in > 0").select(*keys, "fl", F.col("_in").alias("cnt"))
    w = Window.partitionBy(*keys)
    h = h.withColumn("_at", F.sum(F.col("fl") * F.col("cnt")).over(w) / F.sum("cnt").over(w))
    sd = F.sqrt(F.sum(F.pow(F.col("fl") - F.col("_at"), 2) * F.col("cnt")) / F.sum("cnt"))
    return h.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.min("fl").alias("fl_min"), F.max("fl").alias("fl_max"), F.max("_at").alias("mean"), sd.alias("sd"))


def clusters(fits: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``cluster`` of read groups alike in mean, sd and skew.

    Along each of the three, a group begins a new level where it lies further from the one
    before than three standard errors or a tenth of its value, whichever is more; groups
    equal in all three levels are one cluster, numbered from 0 by levels.  The input has a
    row for each read group; ties are in the keys' order, nulls a level of their own.
    """
    out = fits
    for s in STATS:
        w = Window.orderBy(F.col(s).asc_nulls_first(), *keys)
        wide = F.greatest(3 * F.coalesce(F.col(f"se_{s}"), F.lit(0.0)), 0.1 * F.abs(F.col(s)))
        apart = F.coalesce(F.col(s) - F.lag(s).over(w) >= wide, F.col(s).isNotNull())
        new = F.when((F.row_number().over(w) > 1) & apart & ~F.coalesce((F.col(s) == F.lag(s).over(w)), F.lit(False)), 1).otherwise(0)
        out = out.withColumn(f"_new_{s}", new).withColumn(f"_{s}", F.sum(f"_new_{s}").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    number = F.dense_rank().over(Window.orderBy(*[f"_{s}" for s in STATS])) - 1
    return out.select(*keys, number.cast("long").alias("cluster"))


def pooled(hist: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Robust fit of each cluster on the added histograms of its read groups."""
    on = reduce(lambda x, y: x & y, [hist[k].eqNullSafe(groups[k]) for k in keys])
    return robust(add(hist.join(groups, on).select("cluster", "fl", "cnt"), ["cluster"]), ["cluster"])


def in_exons(pairs: DataFrame, exons: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Histogram of unspliced pairs (contig, strand, start, stop, fl, spliced, qname, keys) inside exons (gene, transcript, contig, strand, start, stop).

    Only genes of one transcript count.  ``most`` keeps that many pairs an exon, in the
    order of names; it stands for a sampling user, all pairs count without it.  A pair
    inside two exons counts in both.
    """
    single = exons.groupBy("gene").agg(F.count_distinct("transcript").alias("_t")).where("_t = 1").select("gene")
    sites = exons.join(single, "gene").select("contig", "strand", "start", "stop").distinct()
    hit = contains_join(pairs.where("not coalesce(spliced, false) and fl is not null"), sites)
    if most is not None:  # a row number under a limit is cut before the shuffle
        w = Window.partitionBy("contig", "strand", "r_start", "r_stop").orderBy("qname", "start", "stop", *keys)
        hit = hit.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most)
    return histogram(hit.select(*keys, "fl"), keys)


def uniform_density(low: int, high: int) -> dict[int, float]:
    """Each length from low to high alike; for ``design``."""
    return {n: 1 / (high - low + 1) for n in range(low, high + 1)}


def normal_density(low: int, high: int, mean: float, sd: float) -> dict[int, float]:
    """Normal density on whole lengths, scaled to 1; an sd of 0 puts all on the nearest length."""
    return mixture_density([(mean, sd, 1.0)], low, high)


def mixture_density(parts: list[tuple[float, float, float]], low: int | None = None, high: int | None = None) -> dict[int, float]:
    """Mixture of normals (mean, sd, share); bounds are four deviations around the outermost where none are given."""
    low = max(0, math.floor(min(m - DEVIATIONS * s for m, s, _ in parts))) if low is None else low
    high = math.ceil(max(m + DEVIATIONS * s for m, s, _ in parts)) if high is None else high
    out = dict.fromkeys(range(low, high + 1), 0.0)
    for mean, sd, share in parts:
        s = sd + 1e-6
        nearest = min(((n - mean) / s) ** 2 for n in out)  # exponents count from the nearest length, so none is lost
        mass = {n: math.exp((nearest - ((n - mean) / s) ** 2) / 2) for n in out}
        whole = sum(mass.values())
        for n in out:
            out[n] += share * mass[n] / whole
    total = sum(share for _, _, share in parts)
    return {n: p / total for n, p in out.items()}

