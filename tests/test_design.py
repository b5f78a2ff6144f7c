import gzip
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import design, quant, reads, simulate
from spanloom.sources import bam, text


@pytest.mark.parametrize("sizes, read, lengths", [([100, 1, 100], 50, [100]), ([80, 30, 60, 120], 40, range(90, 141)), ([200, 15, 90], 50, range(60, 181)), ([30], 40, [50]), ([60], 40, [50])])
def test_expected_counts_are_those_of_all_placements(sizes, read, lengths):
    density = {n: 1 / len(lengths) for n in lengths}
    seg = np.repeat(np.arange(len(sizes)), sizes)
    pairs, single = Counter(), Counter()
    for n, p in density.items():
        for s in range(len(seg) - n + 1):
            a, b = seg[s : s + read], seg[s + n - read : s + n]
            pairs[int(a[0]), int(a[-1]), int(b[0]), int(b[-1])] += p
            single[int(a[0]), int(a[-1])] += p
    assert dict(design.expected_pairs(sizes, read, density)) == pytest.approx(dict(pairs))
    assert dict(design.expected_single(sizes, read, density)) == pytest.approx(dict(single))


def test_fixed_fragment_has_one_placement():
    assert dict(design.expected_pairs([100, 1, 100], 50, {100: 1.0}))[0, 0, 0, 0] == pytest.approx(1.0)
    assert dict(design.expected_single([60, 40], 20)) == {(0, 0): 41, (0, 1): 19, (1, 1): 21}


EXONS = [("t1", 0, 299), ("t1", 400, 599), ("t1", 900, 1199), ("t2", 0, 299), ("t2", 900, 1199)]


def _transcripts(spark):
    e = spark.createDataFrame([("g", "c", "-", *x) for x in EXONS], "gene string, contig string, strand string, transcript string, start long, stop long")
    t = e.groupBy("contig", "strand", "transcript").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("exons"))
    return e, t.withColumn("weight", F.when(F.col("transcript") == "t1", 0.7).otherwise(0.3))


def test_simulated_reads_give_their_frequencies_back(spark, tmp_path):
    exons, t = _transcripts(spark)
    density = {n: 1 / 41 for n in range(180, 221)}
    frags = simulate.fragments(spark, t, 5000, density, seed=5)
    got = simulate.pairs(frags, 60)
    assert got.count() == 10000
    simulate.sam_lines(got).write.text(str(tmp_path / "sam"))
    again = text.read_sam(spark, str(tmp_path / "sam"))
    assert again.where("read_len = 60 and nh = 1").count() == 10000
    assert again.select("qname", "flag", "pos", "aend").exceptAll(got.select("qname", "flag", "pos", "aend")).isEmpty()
    blocks = reads.cigar_blocks(again.withColumn("strand", reads.read_strand(F.col("flag")))).withColumn("mate", F.when(reads.has(F.col("flag"), 0x40), 1).otherwise(2))
    assert [r.strand for r in blocks.select("strand").distinct().collect()] == ["-"]
    out = {r.transcript: r for r in design.quantify(blocks, exons, density, 60).collect()}
    assert out["t1"].freq == pytest.approx(0.7, abs=0.03) and out["t2"].freq == pytest.approx(0.3, abs=0.03)
    assert out["t1"].fragments == 5000
    assert out["t1"].effective == pytest.approx(sum((800 - n + 1) / 41 for n in density))
    assert out["t1"].fpkm == pytest.approx(out["t1"].freq * 1e9 / out["t1"].effective)


def test_fragments_depend_on_seed_only_and_skip_short_transcripts(spark):
    t = spark.createDataFrame([("a", "c", "+", [(0, 99)], 1.0), ("b", "c", "+", [(0, 9)], 5.0), ("z", "c", "+", [(0, 99)], 0.0)], "transcript string, contig string, strand string, exons array<struct<start:long,stop:long>>, weight double")
    one, two = (simulate.fragments(spark, t.repartition(k), 300, {50: 0.5, 120: 0.5}, seed=1).drop("exons").toPandas().sort_values("fragment").values.tolist() for k in (1, 5))
    assert one == two and len(one) == 300 and {r[1] for r in one} == {"a"} and {r[4] for r in one} == {50}
    assert simulate.fragments(spark, t.limit(0), 10, {50: 1.0}).count() == 0


def _record(name, flag, ref, pos, cigar, tags=b"", seq=0):
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 30, 0, len(cigar), flag, seq, -1, -1, 0) + name + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | op) for op, n in cigar) + b"\0" * ((seq + 1) // 2) + b"\0" * seq + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    head = b"BAM\x01" + struct.pack("<i", 3) + b"@CO" + struct.pack("<i", 2)
    for name, n in ((b"chr1\0", 1000), (b"chr2\0", 2000)):
        head += struct.pack("<i", len(name)) + name + struct.pack("<i", n)
    tags = b"RGZone\0" + b"NHC\x02" + b"XPf" + struct.pack("<f", 0.5) + b"ZBBs" + struct.pack("<ihh", 2, 1, 2)
    raw = head + _record(b"r1", 99, 0, 100, [(0, 12), (3, 50), (7, 6), (8, 6)], tags, 24) + _record(b"r2", 4, -1, -1, []) + b"".join(_record(b"x%d" % i, 0, 1, i, [(4, 2), (0, 5), (1, 1)]) for i in range(3000))
    members = b"".join(gzip.compress(raw[i : i + 1000]) for i in range(0, len(raw), 1000)) + gzip.compress(b"")
    (tmp_path / "a.bam").write_bytes(members)
    (tmp_path / "b.bam").write_bytes(gzip.compress(head))
    df = bam.read_bam(spark, str(tmp_path / "*.bam"))
    got = {r.qname: r for r in df.collect()}
    assert len(got) == 3002
    r = got["r1"]
    assert (r.flag, r.contig, r.pos, r.aend, r.mapq, r.rg, r.nh, r.xp, r.read_len) == (99, "chr1", 100, 174, 30, "one", 2, 0.5, 24)
    assert [(c.op, c.len) for c in r.cigar] == [(0, 12), (3, 50), (0, 12)]
    assert got["r2"].contig is None and got["x7"].read_len == 8 and got["x7"].aend == 12
    assert [(j.start, j.stop) for j in reads.junctions(df.where("qname = 'r1'")).collect()] == [(112, 161)]
    c = bam.read_contigs(spark, str(tmp_path / "*.bam"))
    assert sorted(tuple(x) for x in bam.shared_contigs(c, 2).collect()) == [("chr1", 1000), ("chr2", 2000)]


def test_estimate_reads_the_design(spark):
    m = spark.createDataFrame([("g", "1", "a", 10.0, 30), ("g", "2", "b", 10.0, 10)], "gene string, bin string, transcript string, expected double, observed long")
    assert {r.transcript: round(r.freq, 6) for r in quant.estimate(m).collect()} == {"a": 0.75, "b": 0.25}
