"""Text formats: GTF and GFF, BED, SAM, expression tracking, sample sheet, FASTA, bedGraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str | list[str], pattern: str, least: int) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.split("value", pattern).alias("f"), "value").where(F.size("f") >= least)


def read_gff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Fields of valid lines; coordinates become 0-based and closed; invalid scores and frames are null."""
    f = lambda k: F.get("f", F.lit(k))
    out = _fields(spark, path, "\t", 9).select(
        F.regexp_replace(f(0), "^chr", "").alias("contig"), f(1).alias("source"), f(2).alias("feature"),
        (f(3).try_cast("long") - 1).alias("start"), (f(4).try_cast("long") - 1).alias("stop"), f(5).try_cast("double").alias("score"),
        f(6).alias("strand"), f(7).try_cast("int").alias("frame"), f(8).alias("attributes"),
    )
    return out.where("start is not null and stop is not null and strand in ('+', '-', '.')").withColumn("frame", F.when(F.col("frame").between(0, 2), F.col("frame")))


def read_gtf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """GFF lines with an attribute map that has gene_id and transcript_id."""
    keys = F.regexp_extract_all("attributes", F.lit(r'(\w+) +"[^"]*"'), 1)
    values = F.regexp_extract_all("attributes", F.lit(r'\w+ +"([^"]*)"'), 1)
    attrs = F.map_from_entries(F.array_distinct(F.arrays_zip(keys.alias("k"), values.alias("v"))))
    out = read_gff(spark, path).withColumn("attrs", attrs).drop("attributes")
    return out.withColumn("gene_id", F.col("attrs")["gene_id"]).withColumn("transcript_id", F.col("attrs")["transcript_id"]).where("gene_id is not null and transcript_id is not null")


def transcripts(gtf: DataFrame) -> DataFrame:
    """One row for each transcript: sorted exons, introns between them, bounds, coding bounds."""
    exon = F.col("feature").isin("exon", "CDS")
    part = F.struct("start", "stop")
    out = gtf.groupBy("contig", "strand", "gene_id", "transcript_id").agg(
        F.array_sort(F.collect_set(F.when(exon & (F.col("feature") == "exon"), part))).alias("exons"),
        F.min(F.when(exon, F.col("start"))).alias("start"), F.max(F.when(exon, F.col("stop"))).alias("stop"),
        F.min(F.when(F.col("feature") == "CDS", F.col("start"))).alias("cds_start"), F.max(F.when(F.col("feature") == "CDS", F.col("stop"))).alias("cds_stop"),
    )
    n = F.size("exons")
    gap = F.zip_with(F.slice("exons", 1, F.greatest(n - 1, F.lit(0))), F.slice("exons", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct((a["stop"] + 1).alias("start"), (b["start"] - 1).alias("stop")))
    return out.withColumn("introns", F.when(n > 1, gap).otherwise(F.slice(gap, 1, 0)))


def gtf_lines(df: DataFrame) -> DataFrame:
    return df.select(F.format_string('%s\t%s\t%s\t%d\t%d\t%s\t%s\t%s\tgene_id "%s"; transcript_id "%s";', "contig", F.coalesce("source", F.lit(".")), "feature", F.col("start") + 1, F.col("stop") + 1, F.coalesce(F.col("score").cast("string"), F.lit(".")), "strand", F.coalesce(F.col("frame").cast("string"), F.lit(".")), "gene_id", "transcript_id").alias("value"))


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Half-open lines of six columns or more become closed intervals; track lines are skipped."""
    f = lambda k: F.get("f", F.lit(k))
    rows = _fields(spark, path, "\t", 6).where(~F.col("value").startswith("track"))
    return rows.select(F.regexp_replace(f(0), "^chr", "").alias("contig"), f(1).cast("long").alias("start"), (f(2).cast("long") - 1).alias("stop"), f(3).alias("name"), f(4).try_cast("double").alias("score"), f(5).alias("strand")).distinct()


def bed_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", F.concat(F.lit("chr"), "contig"), "start", F.col("stop") + 1, "name", F.coalesce(F.col("score").cast("string"), F.lit("0")), "strand").alias("value"))


def bedgraph_lines(runs: DataFrame) -> DataFrame:
    """Runs of depth; the minus strand is negated, depths next to zero are dropped."""
    depth = F.when(F.col("strand") == "-", -F.col("depth")).otherwise(F.col("depth"))
    return runs.where(F.abs("depth") > 1e-12).select(F.concat_ws("\t", "contig", "start", F.col("stop") + 1, depth).alias("value"))


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignment lines: canonical read columns, 0-based start and exclusive end; duplicates stay flagged."""
    f = lambda k: F.get("f", F.lit(k))
    lines = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"))
    sizes, ops = F.regexp_extract_all(f(5), F.lit(r"(\d+)[MIDNSHP=X]"), 1), F.regexp_extract_all(f(5), F.lit(r"\d+([MIDNSHP=X])"), 1)
    code = lambda o: F.when(o.isin("=", "X"), 0).otherwise(F.instr(F.lit("MIDNSHP"), o) - 1)
    cigar = F.zip_with(sizes, ops, lambda n, o: F.struct(code(o).alias("op"), n.cast("int").alias("len")))
    tag = lambda name: F.regexp_extract(F.concat_ws("\t", F.slice("f", 12, 100)), rf"\b{name}:\w:([^\t]+)", 1)
    out = lines.select(f(0).alias("qname"), f(1).cast("int").alias("flag"), f(2).alias("contig"), (f(3).cast("long") - 1).alias("pos"), f(4).cast("int").alias("mapq"), cigar.alias("cigar"), F.nullif(tag("RG"), F.lit("")).alias("rg"), tag("NH").try_cast("int").alias("nh"), tag("XP").try_cast("double").alias("xp"), f(9).alias("seq"))
    inferred = F.aggregate("cigar", F.lit(0), lambda a, c: a + F.when(c["op"].isin(0, 1, 4), c["len"]).otherwise(0))
    out = out.withColumn("read_len", F.when(F.col("seq") == "*", inferred).otherwise(F.length("seq"))).drop("seq")
    moved = F.aggregate("cigar", F.lit(0).cast("long"), lambda a, c: a + F.when(c["op"].isin(0, 2, 3), c["len"]).otherwise(0))
    return out.withColumn("aend", F.col("pos") + moved)


def scan_region(reads: DataFrame, contig: str, start: int, stop: int) -> DataFrame:
    return reads.where((F.col("contig") == contig) & (F.col("pos") <= stop) & (F.col("aend") > start) & (F.col("flag").bitwiseAND(0x400) == 0))


TRACKING = ("tracking_id", "gene_id", "coverage", "FPKM", "FPKM_lo", "FPKM_hi", "status")


def read_tracking(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Expression tracking: '-' is null; the header line is skipped."""
    f = lambda k: F.get("f", F.lit(k))
    rows = _fields(spark, path, r"\s+", 7).where(f(0) != "tracking_id")
    return rows.select(*[(f(k).try_cast("double") if 2 <= k <= 5 else f(k)).alias(c) for k, c in enumerate(TRACKING)])


SHEET = ("sample_type", "rep_id", "assay", "paired", "stranded", "read_type", "filename")


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, r"\s+", 7).select(*[F.get("f", F.lit(k)).alias(c) for k, c in enumerate(SHEET)])


def select_samples(spark: SparkSession, sheet: DataFrame, assay: str, sample_type: str, rep_id: str) -> DataFrame:
    """Rows of an assay for a sample and replicate; '*' in the sheet stands for all."""
    return spark.sql("SELECT * FROM {sheet} WHERE assay = :a AND sample_type IN (:s, '*') AND rep_id IN (:r, '*')", args={"a": assay, "s": sample_type, "r": rep_id}, sheet=sheet)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """contig and sequence; records are split on '>' at line starts."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    clean = F.regexp_replace("value", "^>", "")
    return records.select(F.regexp_extract(clean, r"^(\S+)", 1).alias("contig"), F.regexp_replace(F.regexp_replace(clean, r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
