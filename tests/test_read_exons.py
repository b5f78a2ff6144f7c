"""Typed exons of the segments that reads meet: gathered once, against a plain loop."""

import random

import numpy as np
import pytest

from spanloom.operators import splice
from spanloom.plans import structure  # noqa: F401
from spanloom.plans.catalog import QUERIES
from tests.test_splice import gene_case, plain_exons, plain_graph


def test_exons_of_reads(spark):
    rng = random.Random(5)
    genes = [gene_case(rng, k) for k in range(120)]
    reads = [(g["gene"], a, a + rng.randrange(1, 25), rng.randrange(1, 4)) for g in genes for a in (rng.randrange(0, 150) for _ in range(rng.randrange(0, 9)))]
    reads += [(g["gene"], 0, 400, 1) for g in genes]  # meets every segment
    make = lambda key, more="": spark.createDataFrame([(g["gene"], *x) for g in genes for x in g[key]], f"gene long, start long, stop long{more}")
    regions = spark.createDataFrame([(g["gene"], g["strand"], *x) for g in genes for x in g["regions"]], "gene long, strand string, start long, stop long")
    found = splice.read_exons(regions, make("introns", ", cnt long"), make("tss"), make("tes"), spark.createDataFrame(reads, "gene long, start long, stop long, n long"), 10.0, 0.4, 0.3, 2.0)
    value = {}
    for g in genes:
        for i, (a, b, *_) in plain_graph(g)[0].items():
            n = sum(m for k, s, e, m in reads if k == g["gene"] and s <= b and e >= a)
            if n:
                value[g["gene"], i] = n * 10.0 / (b - a + 1)
    want = sorted(x for g in genes for x in plain_exons(g, value, 0.3, 2.0))
    got = sorted(map(tuple, found.collect()))
    assert [x[:5] for x in got] == [x[:5] for x in want] and len(want) > 100
    assert [x[5] for x in got] == pytest.approx([x[5] for x in want])


def test_pairs_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    gene, nth = np.repeat(np.arange(4), 50), np.tile(np.arange(50), 4)
    ends = splice._bit(splice.START, splice.ACCEPTOR, splice.END, splice.DONOR)
    left, right = (rng.integers(0, 128, 200) & ends for _ in range(2))
    value = rng.random(200) + 0.5

    def pairs():
        rows = splice._exon_pairs(gene, nth, left, right, gene % 2 == 0, value, 0.4 * value, 0.6, 20.0)
        return sorted((int(a), int(b), kind, float(v)) for first, last, kind, least in rows for a, b, v in zip(first, last, least))

    whole = pairs()
    assert all(v == value[a : b + 1].min() for a, b, _, v in whole)
    monkeypatch.setattr(splice, "PAIRS", 1)
    assert pairs() == whole and len(whole) > 200


def test_no_segment_meets_its_reads_in_a_join(spark):
    plan = QUERIES["splice_exons"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
