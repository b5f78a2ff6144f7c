"""Lines of the text formats that results are written in: one column ``value``.

Coordinates are closed and from 0 everywhere else; each function says what its format has.
``df.write.text(path)`` writes what it returns; ``headed`` puts a header line before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.coordinates import feature_rows, spliced_length
from spanloom.operators.reads import ucsc_contig
from spanloom.sources.text import gtf_lines

#: fixed values of the element format: type, name, colour
ELEMENTS = (
    ("GENE", "gene", "200,200,200"),
    ("CAGE_PEAK", "promoter", "153,255,000"),
    ("SE_GENE", "single_exon_gene", "000,000,200"),
    ("TSS_EXON", "tss_exon", "140,195,59"),
    ("EXON", "internal_exon", "000,000,000"),
    ("TES_EXON", "tes_exon", "255,51,255"),
    ("INTRON", "intron", "100,100,100"),
    ("POLYA", "polya", "255,0,0"),
    ("INTERGENIC_SPACE", "intergenic", "254,254,34"),
    ("RETAINED_INTRON", "retained_intron", "255,255,153"),
)
TRANSCRIPT_TRACKING = (("tracking_id", 20), ("class_code", 10), ("nearest_ref_id", 20), ("gene_id", 20), ("gene_short_name", 20), ("tss_id", 10), ("locus", 30), ("length", 0))
EXPRESSION = (("tracking_id", 11), ("gene_id", 8), ("coverage", 8), ("FPKM", 8), ("FPKM_lo", 8), ("FPKM_hi", 8), ("status", 0))


def _line(*fields: Column | str) -> Column:
    """Tab-separated; a null field is a dot."""
    return F.concat_ws("\t", *[F.coalesce((F.col(f) if isinstance(f, str) else f).cast("string"), F.lit(".")) for f in fields]).alias("value")


def _padded(c: Column, n: int) -> Column:
    """At least n characters; longer values stay whole."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), n - F.length(c))))


def _contig(ucsc: bool) -> Column:
    return ucsc_contig(F.col("contig")) if ucsc else F.col("contig")


def _if_any(df: DataFrame, name: str, other: Column) -> Column:
    return F.coalesce(F.col(name), other) if name in df.columns else other


def header(columns: tuple[tuple[str, int], ...]) -> str:
    return "\t".join(name.ljust(n) for name, n in columns)


def headed(lines: DataFrame, line: str) -> DataFrame:
    """The line before all others: it is the first partition's."""
    return lines.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).union(lines)


def bed12_lines(df: DataFrame, ucsc: bool = False) -> DataFrame:
    """Half-open BED of twelve columns: contig, strand, start, stop, and where there are any name, score, color,
    blocks (array of (start, stop)) and thick.  Without blocks there is one, or, where thick is false, one base at either end."""
    n = F.col("stop") - F.col("start") + 1
    thick = _if_any(df, "thick", F.lit(True))
    plain = F.when(thick, F.array(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))).otherwise(
        F.array(*[F.struct(F.col(c).cast("long").alias("start"), F.col(c).cast("long").alias("stop")) for c in ("start", "stop")]))
    blocks = F.when(F.size("blocks") > 0, F.col("blocks").cast(plain_type())).otherwise(plain) if "blocks" in df.columns else plain
    sizes = F.array_join(F.transform(blocks, lambda b: b["stop"] - b["start"] + 1), ",")
    places = F.array_join(F.transform(blocks, lambda b: b["start"] - F.col("start")), ",")
    end = F.col("start") + n
    return df.select(_line(_contig(ucsc), "start", end, _if_any(df, "name", F.lit(".")), _if_any(df, "score", F.lit(1000)), "strand", "start", end, _if_any(df, "color", F.lit("00,00,00")), F.size(blocks), sizes, places))


def plain_type() -> str:
    return "array<struct<start:bigint,stop:bigint>>"


def element_lines(regions: DataFrame, elements: DataFrame, ucsc: bool = False) -> DataFrame:
    """A gene's line, with its regions as blocks, and one for each element of a known type; colours and names say the type.

    regions: gene, contig, strand, start, stop; elements: contig, strand, start, stop, type.
    """
    block = F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    genes = regions.groupBy("gene", "contig", "strand").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_list(block)).alias("blocks"))
    rows = genes.withColumn("type", F.lit("GENE")).drop("gene").unionByName(elements.select("contig", "strand", "start", "stop", "type").withColumn("blocks", F.array().cast(plain_type())))
    named, coloured = (F.create_map(*[F.lit(x) for row in ELEMENTS for x in (row[0], row[k])]) for k in (1, 2))
    rows = rows.withColumn("name", F.try_element_at(named, F.col("type"))).where("name is not null").withColumn("color", F.try_element_at(coloured, F.col("type")))
    return bed12_lines(rows.withColumn("thick", F.col("type") != "INTRON"), ucsc)


def gff_lines(df: DataFrame) -> DataFrame:
    """GFF, from 1: contig, strand, start, stop, group, and where there are any source, feature, score, frame."""
    any_ = lambda c: _if_any(df, c, F.lit(".")) if c not in df.columns else F.col(c)
    return df.select(_line(F.concat(F.lit("chr"), F.regexp_replace("contig", "^chr", "")), any_("source"), any_("feature"), F.col("start") + 1, F.col("stop") + 1, any_("score"), "strand", any_("frame"), "group"))


def gff3_lines(df: DataFrame) -> DataFrame:
    """GFF3, from 1, nine columns: contig, strand, start, stop, feature, id, name and parents (array)."""
    parents = F.when(F.size("parents") > 0, F.concat(F.lit("Parent="), F.array_join("parents", ","), F.lit(";"))).otherwise("")
    attributes = F.concat(F.lit("ID="), "id", F.lit(";"), parents, F.lit("Name="), "name", F.lit(";"))
    return gff_lines(df.withColumn("group", attributes))


def transcript_lines(transcripts: DataFrame, source: str = ".") -> DataFrame:
    """GTF of whole transcripts, each one's lines in the order promoter, UTR, exon, CDS, UTR, polya along the transcript.

    transcripts: contig, strand, gene_id, transcript_id, exons, cds_start, cds_stop, and where
    there are any promoter, polya, score.
    """
    kept = ["contig", "strand", "gene_id", "transcript_id", "exons", "cds_start", "cds_stop", *[c for c in ("promoter", "polya") if c in transcripts.columns]]
    rows = feature_rows(transcripts.select(*kept, (F.col("score").cast("double") if "score" in transcripts.columns else F.lit(None).cast("double")).alias("score")))
    ordered = rows.repartition("gene_id", "transcript_id").sortWithinPartitions("gene_id", "transcript_id", "nth")
    return gtf_lines(ordered.withColumn("source", F.lit(source)))


def tracking_lines(transcripts: DataFrame, ucsc: bool = False) -> DataFrame:
    """Transcript tracking: transcript_id, class_code, nearest_ref, gene_id, gene_name (or null), contig, strand, exons."""
    known = lambda c: F.coalesce(F.col(c), F.lit("-")) if c in transcripts.columns else F.lit("-")
    locus = F.format_string("%s:%s:%d-%d", _contig(ucsc), F.col("strand"), F.element_at("exons", 1)["start"].cast("long"), F.element_at("exons", -1)["stop"].cast("long"))
    cells = [F.col("transcript_id"), known("class_code"), known("nearest_ref"), F.col("gene_id"), known("gene_name"), F.lit("-"), locus, spliced_length().cast("string")]
    return transcripts.select(F.concat_ws("\t", *[_padded(c, n) for c, (_, n) in zip(cells, TRANSCRIPT_TRACKING)]).alias("value"))


def expression_lines(rows: DataFrame) -> DataFrame:
    """Expression tracking: transcript, gene, fpkm, fpkm_lo, fpkm_hi; null is '-'."""
    number = lambda c: _padded(F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.2e", F.col(c).cast("double"))), F.lit("-")), 8)
    cells = [_padded(F.col("transcript").cast("string"), 11), _padded(F.col("gene").cast("string"), 11), _padded(F.lit("-"), 8), *map(number, ("fpkm", "fpkm_lo", "fpkm_hi")), F.lit("OK")]
    return rows.select(F.concat_ws("\t", *cells).alias("value"))


def narrow_peak_lines(peaks: DataFrame, ucsc: bool = False) -> DataFrame:
    """Half-open narrowPeak: contig, strand, start, stop, count."""
    return peaks.select(_line(_contig(ucsc), "start", F.col("stop") + 1, F.lit("."), F.lit(1000), "strand", F.format_string("%e", F.col("count").cast("double")), F.lit(-1), F.lit(-1), F.lit(-1)))


def _peak_names(peaks: DataFrame, ucsc: bool) -> DataFrame:
    """Peaks (gene_start and gene_stop of their region too) with gene and site names, numbered along the region."""
    side = F.when(F.col("strand") == "+", "plus").when(F.col("strand") == "-", "minus").otherwise("either")
    made = F.concat_ws("_", _contig(ucsc), side, F.col("gene_start"), F.col("gene_stop"))
    nth = F.row_number().over(Window.partitionBy("contig", "strand", "gene_start", "gene_stop").orderBy("start", "stop"))
    out = peaks.withColumn("_gene", _if_any(peaks, "gene_id", made)).withColumn("_site", F.concat(F.lit("TSS_"), "_gene", F.lit("_pk"), nth.cast("string")))
    return out.withColumn("_name", _if_any(peaks, "gene_name", F.col("_gene")))


def peak_bed_lines(peaks: DataFrame, extra: bool = False, ucsc: bool = False) -> DataFrame:
    """Half-open BED of peaks: contig, strand, start, stop, gene_start, gene_stop; with ``extra`` count, names and coverage (array) too."""
    cells = [_contig(ucsc), "start", F.col("stop") + 1, "_site", F.lit(1000), "strand"]
    return _peak_names(peaks, ucsc).select(_line(*cells, *(["count", "_gene", "_name", "_site", F.array_join("coverage", ",")] if extra else [])))


def peak_gff_lines(peaks: DataFrame, source: str = ".", ucsc: bool = False) -> DataFrame:
    """TSS lines of peaks with their coverage; start from 0 and an exclusive stop, as this format's readers have it."""
    cov = F.array_join(F.transform("coverage", lambda x: x.cast("long")), ",")
    group = F.format_string("gene_id '%s'; gene_name '%s'; tss_id '%s'; peak_cov '%s';", "_gene", "_name", "_site", cov)
    return _peak_names(peaks, ucsc).select(_line(_contig(ucsc), F.lit(source), F.lit("TSS"), "start", F.col("stop") + 1, F.col("count").cast("long"), "strand", F.lit("."), group))


def value_lines(runs: DataFrame) -> DataFrame:
    """Half-open bedGraph of runs as they are: contig, start, stop, value with two decimals."""
    return runs.select(_line(F.concat(F.lit("chr"), "contig"), "start", F.col("stop") + 1, F.format_string("%.2f", F.col("value").cast("double"))))


def map_lines(classes: DataFrame) -> DataFrame:
    """Which transcript maps to which: gene, transcript, class, other_gene, other; '-' where there is none."""
    return classes.select(_line("gene", "transcript", "class", F.coalesce(F.col("other_gene").cast("string"), F.lit("-")), F.coalesce(F.col("other").cast("string"), F.lit("-"))))


def source_lines(sources: DataFrame) -> DataFrame:
    """Where a merged transcript comes from: source (old id), file, transcript (new id)."""
    return sources.select(_line("source", "file", "transcript"))


def stats_lines(stats: DataFrame) -> DataFrame:
    """A table of class, recall and precision with their counts, by class."""
    share = lambda c, n: F.format_string("%6.2f%% (%d/%d)", 100 * F.col(c), F.col("matched").cast("long"), F.col(n).cast("long"))
    return stats.orderBy("class").select(F.concat(_padded(F.col("class"), 26), _padded(share("recall", "n_ref"), 28), share("precision", "n_new")).alias("value"))
