import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import assays, ends

READS = "flag int, contig string, pos long, aend long, mapq int, nh int, xp double"


def _reads():
    rng = random.Random(9)
    out = []
    for _ in range(600):
        paired, mate, pos = rng.random() < 0.6, rng.choice([0x40, 0x80]), rng.randrange(0, 200)
        flag = (0x1 | mate if paired else 0) | (0x10 if rng.random() < 0.5 else 0)
        out.append((flag, rng.choice("ab"), pos, pos + rng.randrange(1, 40), rng.randrange(0, 5), rng.choice([None, 1, 2, 4]), rng.choice([None, None, 0.25])))
    return out + [(None, "a", 5, 9, 9, 1, None), (0, "a", None, 9, 9, 1, None), (0, "a", 5, None, 9, 1, None), (0, "a", 5, 9, None, 1, None)]


def _weight(nh, xp):
    return xp if xp is not None else 1 / nh if nh else 1.0


def _pair_strand(flag, flip):
    forward = not flag & 0x10
    plus = forward if not flag & 0x1 else (bool(flag & 0x40) == forward)
    return "+" if plus != flip else "-"


@pytest.mark.parametrize("assay", ["cage", "rampage", "polya"])
@pytest.mark.parametrize("flip", [False, True])
def test_end_counts_equal_loop(spark, assay, flip):
    want = {}
    for flag, contig, pos, aend, mapq, nh, xp in _reads():
        if flag is None or pos is None or aend is None:
            continue
        if assay == "polya":
            if flag & 0x1 and flag & (0x80 if flip else 0x40):
                continue
            strand = _pair_strand(flag, flip)
            at = aend - 1 if strand == "+" else pos
        else:
            if mapq is None or mapq <= 1 or (assay == "rampage" and not flag & 0x40):
                continue
            strand = "+" if (not flag & 0x10) != flip else "-"
            at = pos if strand == "+" else aend - 1
        want[contig, strand, at] = want.get((contig, strand, at), 0) + _weight(nh, xp)
    got = {(r.contig, r.strand, r.pos): r["count"] for r in assays.end_counts(spark.createDataFrame(_reads(), READS), assay, flip).collect()}
    assert got == pytest.approx(want) and want


def _depths(spans):
    out = {}
    for contig, a, b in spans:
        for p in range(a, b):
            out[contig, p] = out.get((contig, p), 0) + 1
    return out


def _spread(runs):
    return {(r.contig, p): r.depth for r in runs.collect() for p in range(r.start, r.stop + 1) if r.depth}


def test_span_assays_equal_loop(spark):
    df, whole = spark.createDataFrame(_reads(), READS), [r for r in _reads() if None not in r[:4]]
    chip = _depths([(r[1], r[3] - 25 if r[0] & 0x10 else r[2], r[3] if r[0] & 0x10 else r[2] + 25) for r in whole])
    assert _spread(assays.chip_coverage(df, 25)) == pytest.approx({k: n / 26 for k, n in chip.items()})
    spans = [r for r in _reads() if None not in r[2:4]]
    assert _spread(assays.dnase_coverage(df)) == _depths([(r[1], r[2], r[3]) for r in spans])
    with pytest.raises(ValueError):
        assays.chip_coverage(df, 0)


def test_own_assay_and_no_reads(spark):
    df = spark.createDataFrame(_reads(), READS)
    sure = assays.EndAssay(lambda flip: F.col("mapq") > 3, five_prime=False)
    assert assays.end_counts(df, sure).agg(F.sum("count")).first()[0] == pytest.approx(sum(_weight(*r[5:]) for r in _reads() if None not in r[:5] and r[4] > 3))
    none = df.limit(0)
    assert assays.end_counts(none, "cage").count() == assays.chip_coverage(none, 5).count() == assays.dnase_coverage(none).count() == 0


def test_end_counts_feed_the_end_block(spark):
    reads = spark.createDataFrame([(0, "c", 3, 20, 30, 1, None)] * 3 + [(0, "c", 8, 20, 30, 1, None), (0x10, "c", 3, 9, 30, 1, None)], READS)
    sites = spark.createDataFrame([("g", "c", "+", "t", 0, 9), ("g", "c", "+", "u", 5, 9)], "gene string, contig string, strand string, transcript string, start long, stop long")
    got = {(r.transcript, r.bin): (round(r.expected, 5), r.observed) for r in ends.end_block(sites, assays.end_counts(reads, "cage")).collect()}
    assert got == {("t", "0-4"): (0.75, 3), ("t", "5-9"): (0.25, 1), ("u", "5-9"): (1.0, 1)}
