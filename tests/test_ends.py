import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import ends, quant

SITES = "gene string, contig string, strand string, transcript string, start long, stop long"
CELLS = "gene string, transcript string, bin string, expected double, observed long"


def test_end_block_equals_loop(spark):
    rng = random.Random(3)
    sites = [(f"g{g}", f"c{g % 2}", "+-"[g % 2], f"t{k}", a, a + rng.randrange(0, 25)) for g in range(12) for k in range(rng.randrange(1, 5)) for a in [rng.randrange(0, 60)]]
    counts = [(f"c{c}", s, p, rng.randrange(1, 9)) for c in range(2) for s in "+-" for p in range(0, 90) if rng.random() < 0.4]
    counts += counts[:20]  # a position may come in parts
    got = ends.end_block(spark.createDataFrame(sites + [("g0", None, "+", "t9", 1, 2)], SITES), spark.createDataFrame(counts, "contig string, strand string, pos long, count long"))
    got = {(r.gene, r.transcript, r.bin): (r.expected, r.observed) for r in got.collect()}
    want = {}
    for g in {s[0] for s in sites}:
        mine = [s for s in sites if s[0] == g]
        cuts = sorted({s[4] for s in mine} | {s[5] + 1 for s in mine})
        tiles = list(zip(cuts, [c - 1 for c in cuts[1:]]))
        seen = {t: sum(n for c, s, p, n in counts if (c, s) == mine[0][1:3] and t[0] <= p <= t[1]) for t in tiles}
        for s in mine:
            own = [t for t in tiles if s[4] <= t[0] and t[1] <= s[5]]
            whole = sum(seen[t] + 1e-6 for t in own)
            want.update({(g, s[3], f"{t[0]}-{t[1]}"): ((seen[t] + 1e-6) / whole, seen[t]) for t in own})
    assert got.keys() == want.keys()
    for k, (e, o) in want.items():
        assert got[k][1] == o and got[k][0] == pytest.approx(e, abs=1e-12)


def test_end_block_without_rows(spark):
    none = spark.createDataFrame([], "contig string, strand string, pos long, count long")
    sites = spark.createDataFrame([("g", "c", "+", "t", 1, 4), ("g", "c", "+", "u", 3, 6)], SITES)
    got = {(r.transcript, r.bin): (round(r.expected, 9), r.observed) for r in ends.end_block(sites, none).collect()}
    assert got == {("t", "1-2"): (0.5, 0), ("t", "3-4"): (0.5, 0), ("u", "3-4"): (0.5, 0), ("u", "5-6"): (0.5, 0)}
    assert ends.end_block(sites.limit(0), none).count() == 0


def _matrix(rng, bins, transcripts, kinds):
    profiles = rng.integers(0, 4, (kinds, transcripts)).astype(float)
    profiles[0] = 1
    profiles = profiles[profiles.sum(1) > 0]
    e = profiles[rng.integers(0, len(profiles), bins)] * rng.integers(1, 5, bins)[:, None]
    return e, rng.integers(0, 40, bins)


def _cells(gene, e, o):
    return [(gene, f"t{j}", f"b{i:03d}", float(e[i, j]), int(o[i])) for i in range(len(e)) for j in range(e.shape[1])]


def test_cluster_rows_equals_loop_and_keeps_the_maximum(spark):
    rng = np.random.default_rng(5)
    made = {f"g{g}": _matrix(rng, 30, 3, 6) for g in range(4)}
    block = spark.createDataFrame([c for g, (e, o) in made.items() for c in _cells(g, e, o)], CELLS)
    clustered = ends.cluster_rows(block).cache()
    for g, (e, o) in made.items():
        rows = {}
        x = e[:, e.sum(0) > 0] / e.sum(0)[e.sum(0) > 0]
        for i in range(len(x)):
            rows.setdefault(tuple(np.floor(x[i] / x[i].sum() * 100_000 + 0.5 + 1e-6)), []).append(i)
        got = {}
        for r in clustered.where(F.col("gene") == g).collect():
            got.setdefault(r.bin, {})[r.transcript] = (r.expected, r.observed, r.rows)
        names = [f"t{j}" for j in range(3) if e.sum(0)[j] > 0]
        assert got.keys() == {f"b{min(m):03d}" for m in rows.values()}
        for members in rows.values():
            mine = got[f"b{min(members):03d}"]
            assert {v[1:] for v in mine.values()} == {(int(o[members].sum()), len(members))}
            assert [mine.get(n, (0,))[0] for n in names] == pytest.approx(x[members].sum(0).tolist(), abs=1e-9)
    both = [{(r.gene, r.transcript): r.freq for r in quant.estimate(m).collect()} for m in (block.where("expected > 0"), clustered)]
    log = lambda g, f: float((made[g][1] * np.log(made[g][0] / np.maximum(made[g][0].sum(0), 1e-12) @ f + 1e-300)).sum())
    for g in made:
        a, b = (np.array([f.get((g, f"t{j}"), 0.0) for j in range(3)]) for f in both)
        assert log(g, a) == pytest.approx(log(g, b), abs=1e-3)


def test_cluster_rows_of_one_profile(spark):
    hot = [("g", "t", f"b{i:05d}", 1.0, 2) for i in range(5000)]
    (row,) = ends.cluster_rows(spark.createDataFrame(hot, CELLS)).collect()
    assert (row.bin, row.observed, row.rows) == ("b00000", 10000, 5000) and row.expected == pytest.approx(1)
    assert ends.cluster_rows(spark.createDataFrame([("g", "t", "b", 0.0, 2)], CELLS)).count() == 0


def test_stack_leaves_unseen_transcripts_out_and_adds_the_outside(spark):
    rna = spark.createDataFrame([("g", "a", "1", 2.0, 5), ("g", "b", "1", 2.0, 5), ("g", "b", "2", 6.0, 3), ("g", "c", "3", 1.0, 1), ("h", "a", "1", 1.0, 4)], CELLS)
    tss = spark.createDataFrame([("g", "a", "x", 1.0, 7), ("g", "b", "y", 1.0, 2)], CELLS)
    totals = spark.createDataFrame([("rna", 100), ("tss", 20)], "block string, total long")
    got = {(r.gene, r.bin, r.transcript): (r.expected, r.observed) for r in ends.stack({"rna": rna, "tss": tss}, totals).collect()}
    assert got == {
        ("g", "rna:1", "a"): (1.0, 5), ("g", "rna:1", "b"): (0.25, 5), ("g", "rna:2", "b"): (0.75, 3), ("g", "tss:x", "a"): (1.0, 7), ("g", "tss:y", "b"): (1.0, 2),
        ("h", "rna:1", "a"): (1.0, 4), ("g", "rna:out", None): (1.0, 91), ("g", "tss:out", None): (1.0, 11), ("h", "rna:out", None): (1.0, 96),
    }  # c has no start site; h has no start block at all


def test_out_of_gene_column_parts_from_the_likelihood(spark):
    cells = spark.createDataFrame([("g", "a", "1", 1.0, 30), ("g", "b", "1", 1.0, 30), ("g", "b", "2", 1.0, 20)], CELLS)
    totals = spark.createDataFrame([("rna", 80)], "block string, total long")
    full = ends.stack({"rna": cells}, totals).withColumn("transcript", F.coalesce("transcript", F.lit("out")))
    f = {r.transcript: r.freq for r in quant.estimate(full).collect()}
    g = {r.transcript: r.freq for r in quant.estimate(ends.stack({"rna": cells})).collect()}
    assert f["out"] == pytest.approx(30 / 80, abs=2e-3)
    for t in "ab":
        assert f[t] == pytest.approx(g[t] * 50 / 80, abs=2e-3)


def test_start_reads_tell_transcripts_of_equal_exons(spark):
    exons = spark.createDataFrame([("g", "c", "+", t, 0, 299) for t in ("t", "u")], "gene string, contig string, strand string, transcript string, start long, stop long")
    reads = [("c", "+", f"q{i}", m, i + 60 * m, i + 60 * m + 19) for i in range(100) for m in (0, 1)]
    blocks = spark.createDataFrame(reads, "contig string, strand string, qname string, mate int, start long, stop long")
    sites = spark.createDataFrame([("g", "c", "+", "t", 0, 9), ("g", "c", "+", "u", 40, 49)], SITES)
    at = spark.createDataFrame([("c", "+", 3, 75), ("c", "+", 44, 25), ("c", "-", 44, 900)], "contig string, strand string, pos long, count long")
    got = {r.transcript: r for r in ends.quantify(blocks, exons, {80: 1.0}, 20, tss=(sites, at), with_bounds=True).collect()}
    assert got["t"].freq == pytest.approx(0.75, abs=0.01) and got["u"].freq == pytest.approx(0.25, abs=0.01)
    assert got["t"].identifiable and got["t"].fpkm_lo < got["t"].fpkm < got["t"].fpkm_hi
    alone = ends.quantify(blocks, exons, {80: 1.0}, 20, with_bounds=True).collect()
    assert not any(r.identifiable for r in alone)
