"""From transcripts and read pairs to a design matrix, frequencies and FPKM.

A gene's exon bounds cut it into segments.  A read's bin is the list of segments
that it touches, a pair's bin those of its left and right mate.  A transcript's
expected count in a bin sums the fragment length density over all placements
that fall in it.  Reads whose segments touch form runs of starts, so a bin is a
rectangle of (left start, right start) and its sum has a closed form in the
twice cumulated density.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import quant
from spanloom.operators.intervals import overlap_join


def start_runs(sizes: list[int], read: int) -> tuple[np.ndarray, ...]:
    """Runs of starts whose reads touch the same segments: least start, greatest start, first segment, last segment."""
    ends = np.cumsum(sizes)
    last = int(ends[-1]) - read if len(ends) else -1
    if last < 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    cuts = np.unique(np.concatenate([[0], ends, ends - read + 1]))
    lo = cuts[(cuts >= 0) & (cuts <= last)]
    return lo, np.append(lo[1:] - 1, last), np.searchsorted(ends, lo, "right"), np.searchsorted(ends, lo + read - 1, "right")


def _cumulated(density: dict[int, float], read: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    mass = np.zeros(total + 1)
    for n, p in density.items():
        if read <= n <= total:
            mass[n] += p
    once = np.cumsum(mass)
    return once, np.cumsum(once)


def expected_pairs(sizes: list[int], read: int, density: dict[int, float]) -> list[tuple[tuple[int, int, int, int], float]]:
    """((left first, left last, right first, right last segment), expected count) of all bins with some mass."""
    lo, hi, first, last = start_runs(sizes, read)
    if not len(lo):
        return []
    _, twice = _cumulated(density, read, int(sum(sizes)))
    area = lambda x: np.where(x < 0, 0.0, twice[np.clip(x, 0, None)])
    # sum over left starts s and right starts x of density(x + read - s)
    a0, a1, b0, b1 = lo[:, None], hi[:, None], lo[None] + read, hi[None] + read
    mass = area(b1 - a0) - area(b1 - a1 - 1) - area(b0 - 1 - a0) + area(b0 - 2 - a1)
    i, j = np.nonzero(mass > 1e-12)
    return [((int(first[p]), int(last[p]), int(first[q]), int(last[q])), float(mass[p, q])) for p, q in zip(i, j)]


def expected_single(sizes: list[int], read: int, density: dict[int, float] | None = None) -> list[tuple[tuple[int, int], float]]:
    """((first, last segment), count) for single reads: starts of the run, or starts weighted by the fragments that fit behind them."""
    lo, hi, first, last = start_runs(sizes, read)
    n = (hi - lo + 1).astype(float)
    if density is not None and len(lo):
        total = int(sum(sizes))
        _, twice = _cumulated(density, read, total)
        n = twice[total - lo] - np.where(total - hi - 1 < 0, 0.0, twice[np.clip(total - hi - 1, 0, None)])
    return [((int(a), int(b)), float(x)) for a, b, x in zip(first, last, n) if x > 1e-12]


def segments(exons: DataFrame) -> DataFrame:
    """(gene, contig, strand, transcript, start, stop) exons -> the segments of each transcript, numbered within the gene."""
    places = ["gene", "contig", "strand"]
    exons = exons.repartition("gene")  # all that follows is by gene
    bounds = exons.select(*places, F.explode(F.array("start", F.col("stop") + 1)).alias("start")).distinct()
    w = Window.partitionBy(*places).orderBy("start")
    tiles = bounds.withColumn("stop", F.lead("start").over(w) - 1).withColumn("seg", F.row_number().over(w)).where("stop is not null")
    e = exons.select("gene", "transcript", F.col("start").alias("_a"), F.col("stop").alias("_b"))
    inside = tiles.join(e, "gene").where((F.col("start") >= F.col("_a")) & (F.col("stop") <= F.col("_b")))
    return inside.select(*places, "transcript", "seg", "start", "stop").distinct()


def design(segs: DataFrame, density: dict[int, float], read: int, paired: bool = True) -> DataFrame:
    """gene, transcript, bin, expected; one group for each transcript, no larger than its own segments."""
    kinds = dict(segs.dtypes)

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("start")
        seg, sizes = pdf["seg"].tolist(), (pdf["stop"] - pdf["start"] + 1).tolist()
        name = lambda a, b: ",".join(map(str, seg[a : b + 1]))
        if paired:
            rows = [(f"{name(a, b)}|{name(c, d)}", x) for (a, b, c, d), x in expected_pairs(sizes, read, density)]
        else:
            rows = [(name(a, b), x) for (a, b), x in expected_single(sizes, read, density)]
        return pd.DataFrame({"gene": key[0], "transcript": key[1], "bin": [r[0] for r in rows], "expected": np.array([r[1] for r in rows], float)})

    return segs.groupBy("gene", "transcript").applyInPandas(run, f"gene {kinds['gene']}, transcript {kinds['transcript']}, bin string, expected double")


def observed(blocks: DataFrame, segs: DataFrame, paired: bool = True, width: int = 1024) -> DataFrame:
    """(contig, strand, qname, mate, start, stop) blocks -> gene, bin, count; mates are ordered by their least start."""
    tiles = segs.select("gene", "contig", "strand", "seg", "start", "stop").distinct()
    hit = overlap_join(blocks.select("contig", "strand", "qname", "mate", "start", "stop"), tiles, width)
    reads = hit.groupBy(F.col("r_gene").alias("gene"), "qname", "mate").agg(F.array_sort(F.collect_set("r_seg")).alias("_segs"), F.min("start").alias("_at"))
    reads = reads.withColumn("_key", F.array_join(F.col("_segs").cast("array<string>"), ","))
    if paired:
        mates = reads.groupBy("gene", "qname").agg(F.array_sort(F.collect_list(F.struct("_at", "mate", "_key"))).alias("_m")).where(F.size("_m") == 2)
        reads = mates.withColumn("_key", F.concat_ws("|", F.col("_m")[0]["_key"], F.col("_m")[1]["_key"]))
    return reads.groupBy("gene", F.col("_key").alias("bin")).agg(F.count(F.lit(1)).alias("observed"))


def quantify(blocks: DataFrame, exons: DataFrame, density: dict[int, float], read: int, paired: bool = True, with_bounds: bool = False, alpha: float = 0.025) -> DataFrame:
    """gene, transcript, share of the gene's fragments, effective length, FPKM; where asked its bounds, and whether the transcript is identifiable.

    FPKM takes the share of all fragments in bins of the design: a gene's share
    times the transcript's within it.  Fragments in bins that no transcript of
    the gene can give are out of the gene and not counted.  Transcripts too short
    for any fragment get no row.  A gene without fragments has null shares and an FPKM of 0.
    """
    segs = segments(exons)
    m = design(segs, density, read, paired)
    seen = observed(blocks, segs, paired)
    seen = seen.join(m.select("gene", "bin").distinct(), ["gene", "bin"])
    matrix = m.join(seen, ["gene", "bin"], "left").fillna(0, ["observed"])
    return abundance(quant.estimate(matrix, "gene", with_bounds, alpha), m, seen, with_bounds)


def abundance(freq: DataFrame, m: DataFrame, seen: DataFrame, with_bounds: bool) -> DataFrame:
    """Frequencies within genes, design and observed counts -> the rows of ``quantify``."""
    size = m.groupBy("gene", "transcript").agg(F.sum("expected").alias("effective"))
    gene = seen.groupBy("gene").agg(F.sum("observed").alias("fragments"))
    total = seen.agg(F.sum("observed").alias("_all"))  # one row
    out = freq.join(size, ["gene", "transcript"]).join(gene, "gene", "left").fillna(0, ["fragments"]).crossJoin(F.broadcast(total))

    def scaled(share: str, name: str) -> Column:
        part = F.when(F.col("fragments") > 0, F.col("fragments") / F.col("_all") * F.col(share)).otherwise(0.0)
        return quant.fpkm(part, F.col("effective")).alias(name)

    more = [scaled("lower", "fpkm_lo"), scaled("upper", "fpkm_hi"), F.col("identifiable")] if with_bounds else []
    return out.select("gene", "transcript", "freq", "effective", "fragments", scaled("freq", "fpkm"), *more)
