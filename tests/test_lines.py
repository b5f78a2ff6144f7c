"""Output lines: exact text, and round trips through the readers."""

from spanloom.sources import lines, text

T = "contig string, strand string, gene_id string, transcript_id string, exons array<struct<start:long,stop:long>>, cds_start long, cds_stop long"


def values(df):
    return [r.value for r in df.collect()]


def test_bed12_and_elements(spark):
    df = spark.createDataFrame([("2L", "+", 10, 29, True, [(10, 14), (20, 29)]), ("2L", "-", 5, 9, False, []), ("2L", "-", 5, 9, True, None)], "contig string, strand string, start long, stop long, thick boolean, blocks array<struct<start:long,stop:long>>")
    assert values(lines.bed12_lines(df, ucsc=True)) == [
        "chr2L\t10\t30\t.\t1000\t+\t10\t30\t00,00,00\t2\t5,10\t0,10", "chr2L\t5\t10\t.\t1000\t-\t5\t10\t00,00,00\t2\t1,1\t0,4", "chr2L\t5\t10\t.\t1000\t-\t5\t10\t00,00,00\t1\t5\t0"]
    regions = spark.createDataFrame([("g", "c", "+", 0, 9), ("g", "c", "+", 20, 29)], "gene string, contig string, strand string, start long, stop long")
    elements = spark.createDataFrame([("c", "+", 3, 5, "EXON"), ("c", "+", 6, 8, "INTRON"), ("c", "+", 6, 8, "OTHER")], "contig string, strand string, start long, stop long, type string")
    assert sorted(values(lines.element_lines(regions, elements))) == [
        "c\t0\t30\tgene\t1000\t+\t0\t30\t200,200,200\t2\t10,10\t0,20", "c\t3\t6\tinternal_exon\t1000\t+\t3\t6\t000,000,000\t1\t3\t0", "c\t6\t9\tintron\t1000\t+\t6\t9\t100,100,100\t2\t1,1\t0,2"]


def test_gtf_round_trip(spark, tmp_path):
    rows = [("2L", "+", "g1", "t1", [(10, 19), (30, 49)], 15, 40), ("2L", "-", "g1", "t2", [(5, 9)], None, None), ("X", "-", "g2", "t3", [(0, 99), (200, 299), (400, 410)], 50, 405)]
    df = spark.createDataFrame(rows, T)
    lines.transcript_lines(df, source="made").write.text(str(tmp_path / "out.gtf"))
    back = text.read_gtf(spark, str(tmp_path / "out.gtf"))
    got = {r.transcript_id: (r.contig, r.strand, r.gene_id, [tuple(x) for x in r.exons], r.cds_start, r.cds_stop) for r in text.transcripts(back).collect()}
    assert got == {r[3]: (r[0], r[1], r[2], [tuple(x) for x in r[4]], r[5], r[6]) for r in rows}
    features = [(r.feature, r.start, r.stop, r.frame) for r in back.where("transcript_id = 't1'").collect()]
    assert features == [("five_prime_UTR", 10, 14, None), ("exon", 30, 49, None), ("exon", 10, 19, None), ("CDS", 30, 40, 2), ("CDS", 15, 19, 0), ("three_prime_UTR", 41, 49, None)]


def test_gff(spark, tmp_path):
    df = spark.createDataFrame([("chr2L", "+", 0, 9, "exon", "e1", "n1", ["t1", "t2"], 2), ("3R", "-", 4, 4, "gene", "g1", "n2", [], None)], "contig string, strand string, start long, stop long, feature string, id string, name string, parents array<string>, frame int")
    made = lines.gff3_lines(df)
    assert values(made) == ["chr2L\t.\texon\t1\t10\t.\t+\t2\tID=e1;Parent=t1,t2;Name=n1;", "chr3R\t.\tgene\t5\t5\t.\t-\t.\tID=g1;Name=n2;"]
    made.write.text(str(tmp_path / "x.gff"))
    assert sorted((r.contig, r.feature, r.start, r.stop, r.strand, r.frame) for r in text.read_gff(spark, str(tmp_path / "x.gff")).collect()) == [("2L", "exon", 0, 9, "+", 2), ("3R", "gene", 4, 4, "-", None)]


def test_tracking_files(spark, tmp_path):
    rows = [("t1", "g1", 1234.5, None, 0.00012), ("a_very_long_name", "g2", 0.0, 1.0, 2.0)]
    made = lines.expression_lines(spark.createDataFrame(rows, "transcript string, gene string, fpkm double, fpkm_lo double, fpkm_hi double"))
    assert values(made)[0] == "t1         \tg1         \t-       \t1.23e+03\t-       \t1.20e-04\tOK"
    lines.headed(made, lines.header(lines.EXPRESSION)).write.text(str(tmp_path / "e"))
    got = sorted((r.tracking_id, r.gene_id, r.coverage, r.FPKM, r.FPKM_lo, r.FPKM_hi, r.status) for r in text.read_tracking(spark, str(tmp_path / "e")).collect())
    assert got == [("a_very_long_name", "g2", None, 0.0, 1.0, 2.0, "OK"), ("t1", "g1", None, 1230.0, None, 0.00012, "OK")]
    t = spark.createDataFrame([("c", "+", "g", "t", [(10, 19), (30, 49)], None, None)], T)
    assert values(lines.tracking_lines(t))[0].split() == ["t", "-", "-", "g", "-", "-", "c:+:10-49", "30"]
    assert values(lines.headed(made, "first"))[0] == "first"


def test_peaks_maps_and_tables(spark):
    p = spark.createDataFrame([("c", "+", 5, 9, 12.0, 0, 99, [3.0, 0.0, 9.0]), ("c", "+", 50, 50, 7.0, 0, 99, [7.0])], "contig string, strand string, start long, stop long, count double, gene_start long, gene_stop long, coverage array<double>")
    assert values(lines.narrow_peak_lines(p))[0] == "c\t5\t10\t.\t1000\t+\t1.200000e+01\t-1\t-1\t-1"
    assert sorted(values(lines.peak_bed_lines(p))) == ["c\t5\t10\tTSS_c_plus_0_99_pk1\t1000\t+", "c\t50\t51\tTSS_c_plus_0_99_pk2\t1000\t+"]
    assert values(lines.peak_bed_lines(p.limit(1), extra=True)) == ["c\t5\t10\tTSS_c_plus_0_99_pk1\t1000\t+\t12.0\tc_plus_0_99\tc_plus_0_99\tTSS_c_plus_0_99_pk1\t3.0,0.0,9.0"]
    assert values(lines.peak_gff_lines(p.limit(1))) == ["c\t.\tTSS\t5\t10\t12\t+\t.\tgene_id 'c_plus_0_99'; gene_name 'c_plus_0_99'; tss_id 'TSS_c_plus_0_99_pk1'; peak_cov '3,0,9';"]
    assert values(lines.value_lines(p.withColumnRenamed("count", "value")))[1] == "chrc\t50\t51\t7.00"
    m = spark.createDataFrame([("g", "t", "u", None, None), ("g", "v", "=", "h", "w")], "gene string, transcript string, class string, other_gene string, other string")
    assert values(lines.map_lines(m)) == ["g\tt\tu\t-\t-", "g\tv\t=\th\tw"]
    assert values(lines.source_lines(spark.createDataFrame([("old", "a.gtf", "new")], "source string, file string, transcript string"))) == ["old\ta.gtf\tnew"]
    s = spark.createDataFrame([("Intron", 4, 8, 2, 0.5, 0.25)], "class string, n_ref long, n_new long, matched long, recall double, precision double")
    assert values(lines.stats_lines(s))[0].split() == ["Intron", "50.00%", "(2/4)", "25.00%", "(2/8)"]
