import numpy as np
import pytest

from spanloom.functions import seq, stats
from spanloom.operators import graph, intervals, peaks, quant, reads
from spanloom.sources import text


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def iv(spark, data):
    return spark.createDataFrame([("c", "+", a, b) for a, b in data], "contig string, strand string, start long, stop long")


def test_merge_takes_the_running_maximum(spark):
    assert rows(intervals.merge_gaps(iv(spark, [(0, 100), (10, 20), (290, 300)]), 200), "start", "stop") == [(0, 300)]
    assert rows(intervals.merge_gaps(iv(spark, [(0, 9), (50, 59), (300, 310)]), 200), "start", "stop") == [(0, 59), (300, 310)]
    assert rows(intervals.flatten(iv(spark, [(1, 5), (6, 9)])), "start", "stop") == [(1, 9)]
    assert rows(intervals.flatten(iv(spark, [(1, 5), (7, 9)])), "start", "stop") == [(1, 5), (7, 9)]


def test_overlap_join_is_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = ([(int(s), int(s + n)) for s, n in zip(rng.integers(0, 500, 60), rng.integers(0, 150, 60))] for _ in range(2))
    got = rows(intervals.overlap_join(iv(spark, a), iv(spark, b), 32), "start", "stop", "r_start", "r_stop")
    assert got == sorted((*x, *y) for x in a for y in b if x[0] <= y[1] and x[1] >= y[0])


def test_coverage(spark):
    got = rows(intervals.coverage(iv(spark, [(0, 4), (2, 6)])), "start", "stop", "depth")
    assert got == [(0, 1, 1), (2, 4, 2), (5, 6, 1)]


def test_exon_runs_have_no_longest_span(spark):
    rng = np.random.default_rng(6)
    value = [int(x) for x in rng.integers(10, 100, 60)]
    value[25] = value[41] = 5
    segments = [("c", k, value[k], k % 3 == 0, k % 4 == 1) for k in range(60) if k != 50]
    got = rows(graph.exon_runs(spark.createDataFrame(segments, "contig string, nth long, value long, opens boolean, closes boolean"), 10, ["contig"]), "first", "last", "least")
    want = [(i, j, min(value[i : j + 1])) for i in range(0, 60, 3) for j in range(i, 60) if j % 4 == 1 and min(value[i : j + 1]) >= 10 and not i <= 50 <= j]
    assert got == want and max(b - a for a, b, _ in got) > 20


def test_cigar_blocks_and_junctions(spark):
    op = {"M": 0, "I": 1, "D": 2, "N": 3}
    cases = {"12M50N12M": [(12, "M"), (50, "N"), (12, "M")], "11M50N12M": [(11, "M"), (50, "N"), (12, "M")], "12M39N12M": [(12, "M"), (39, "N"), (12, "M")]}
    df = spark.createDataFrame([(k, 100, [(op[o], n) for n, o in v]) for k, v in cases.items()], "qname string, pos long, cigar array<struct<op:int,len:int>>")
    assert rows(reads.cigar_blocks(df).where("qname = '12M50N12M'"), "start", "stop") == [(100, 111), (162, 173)]
    assert rows(reads.junctions(df), "qname", "start", "stop") == [("12M50N12M", 112, 161)]


def test_strand_and_entropy(spark):
    df = spark.createDataFrame([(0x1 | 0x40,), (0x1 | 0x40 | 0x10,), (0x1 | 0x80,), (0x1 | 0x80 | 0x10,), (0,), (0x10,)], "flag int")
    assert [r[0] for r in df.select(reads.read_strand(df.flag)).collect()] == ["+", "-", "-", "+", "+", "-"]
    e = reads.entropy(spark.createDataFrame([("a", 100), ("a", 101), ("b", 100), ("b", 100)], "k string, s long"), ["k"], "s")
    assert rows(e, "k", "cnt", "entropy") == [("a", 2, 1.0), ("b", 2, 0.0)]


def test_statistics():
    assert stats.beta_ppf(0.5, 2, 2)[0] == pytest.approx(0.5)
    assert stats.beta_ppf(0.01, 1, 1001)[0] == pytest.approx(1 - 0.99 ** (1 / 1001), rel=1e-6)
    assert stats.gamma_isf(0.05, 1, 2) == pytest.approx(-2 * np.log(0.05), rel=1e-6)
    assert stats.gamma_isf(0.05, 101, 1) == pytest.approx(118.3, rel=5e-3)
    assert stats.chi2_ppf1(0.95) == pytest.approx(3.8414588)
    assert stats.simplex_projection(np.array([0.5, 0.8])) == pytest.approx([0.35, 0.65])
    x, r = stats.nnls(np.array([[1.0, 0], [0, 1]]), np.array([2.0, -1]))
    assert x == pytest.approx([2, 0]) and r == pytest.approx(1)


def test_mle_and_bounds():
    e = np.array([[0.7, 0.2], [0.3, 0.8]])
    f = quant.mle(e, e @ np.array([0.25, 0.75]) * 1000)
    assert f == pytest.approx([0.25, 0.75], abs=1e-3)
    lo, hi = quant.profile_bounds(e, e @ np.array([0.25, 0.75]) * 1000, 0)
    assert 0 < lo < 0.25 < hi < 1


def test_peak_stands_out():
    signal = np.zeros(200)
    signal[90:100] = 30
    found = peaks.call_peaks(signal, np.ones(200))
    assert [(a, b) for a, b, _ in found] == [(90, 99)]


def test_components_and_sequences(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8)], "src long, dst long")
    assert rows(graph.components(e), "node", "root") == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)]
    s = spark.createDataFrame([("ATGAAATAANNNA",)], "s string")
    assert s.select(seq.translate(s.s), seq.reverse_complement(s.s)).first()[:] == ("MK_X", "TNNNTTATTTCAT")
    assert seq.orfs("ATG" + "AAA" * 99 + "TAA") == [(0, 0, 300)] and seq.orfs("ATG" + "AAA" * 98 + "TAA") == []


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#x\nchr1\ts\texon\t1\t10\t.\t+\t.\tgene_id "g 1"; transcript_id "t";\nchr1\ts\texon\t21\t30\t.\t+\t.\tgene_id "g 1"; transcript_id "t";\nbad line\n')
    t = text.transcripts(text.read_gtf(spark, str(tmp_path / "a.gtf"))).first()
    assert (t.gene_id, t.start, t.stop) == ("g 1", 0, 29) and [tuple(x) for x in t.introns] == [(10, 19)]
    (tmp_path / "a.sam").write_text("@HD\tx\nq\t16\tchr1\t101\t60\t5S12M50N12M\t*\t0\t0\tACGT\t*\tNH:i:2\n")
    r = text.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert (r.pos, r.aend, r.nh, r.cigar[2].op) == (100, 174, 2, 3)
    (tmp_path / "a.bed").write_text("track name=x\nchr1\t0\t10\tn\t5\t+\n")
    assert rows(text.read_bed(spark, str(tmp_path / "a.bed")), "contig", "start", "stop") == [("1", 0, 9)]


def test_entry_runs(spark):
    import __spark_entry__

    assert not __spark_entry__.entry(spark).isEmpty()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_components_of_a_long_path(spark):
    e = spark.range(20_000).selectExpr("id as src", "id + 1 as dst").unionByName(spark.sql("select 30000L src, 30000L dst"))
    got = graph.components(e)
    assert got.count() == 20_002 and {r.root for r in got.select("root").distinct().collect()} == {0, 30000}


def test_semi_join_keeps_repeated_rows(spark):
    a = spark.createDataFrame([("c", "+", 1, 500), ("c", "+", 1, 500), ("c", "+", 900, 950)], "contig string, strand string, start long, stop long")
    b = spark.createDataFrame([("c", "+", 100, 400), ("c", "+", 450, 460)], "contig string, strand string, start long, stop long")
    assert [tuple(r) for r in intervals.overlap_join(a, b, how="left_semi").collect()] == [("c", "+", 1, 500)] * 2
    assert [tuple(r) for r in intervals.overlap_join(a, b, how="left_anti").collect()] == [("c", "+", 900, 950)]
