"""Transcript ends in the design matrix: end blocks, clustered rows, blocks stacked with the fragments outside a gene.

A block is a table (gene, transcript, bin, expected, observed) whose columns, the
transcripts, sum to 1.  A gene lies on one contig and strand.  The out-of-gene column
has one row of its own in each block, so it parts from the likelihood: its share is
the share of fragments outside, and the transcripts' shares are those without it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import design, quant
from spanloom.operators.intervals import overlap_join, point_sums
from spanloom.session import written

#: what each tile has beside its counts, so that no share is 0
SMOOTH = 1e-6
#: profiles are equal where their shares in 1 / PROFILE are; values this close under a half go up, so the order of sums doesn't decide
PROFILE, TIE = 100_000, 1e-6
#: rows that expect no more are left out of a stack
LEAST = 1e-6


def end_block(sites: DataFrame, ends: DataFrame) -> DataFrame:
    """(gene, contig, strand, transcript, start, stop) end regions and (contig, strand, pos, count) end counts -> a block.

    The regions of a gene are cut into tiles at all their bounds; a transcript expects
    a tile of its region by the tile's share of the region's counts.  Bins are ``start-stop``.
    Sites that hold a null are left out; without counts a region's tiles are equally likely.
    """
    pieces = written(design.segments(sites.select("gene", "contig", "strand", "transcript", "start", "stop").dropna()), "pieces")
    at = ends.groupBy("contig", "strand", "pos").agg(F.sum("count").alias("count"))
    if dict(at.dtypes)["count"] == "bigint":
        cells = point_sums(pieces, at, "count").withColumnRenamed("count", "observed")
    else:  # running sums of fractions aren't exact
        tiles = pieces.select("gene", "contig", "strand", "seg", "start", "stop").distinct()
        at = at.withColumnRenamed("pos", "start").withColumn("stop", F.col("start"))
        hit = overlap_join(at, tiles, 16).groupBy(F.col("r_gene").alias("gene"), F.col("r_seg").alias("seg")).agg(F.sum("count").alias("observed"))
        cells = pieces.join(hit, ["gene", "seg"], "left").fillna(0, ["observed"])
    whole = cells.groupBy("gene", "transcript").agg(F.sum(F.col("observed") + SMOOTH).alias("_whole"))
    name = F.concat_ws("-", F.col("start"), F.col("stop"))
    return cells.join(whole, ["gene", "transcript"]).select("gene", "transcript", name.alias("bin"), ((F.col("observed") + SMOOTH) / F.col("_whole")).alias("expected"), "observed")


def scaled(block: DataFrame) -> DataFrame:
    """Columns that sum to 1; transcripts without any expected count have no rows."""
    whole = block.groupBy("gene", "transcript").agg(F.sum("expected").alias("_whole")).where("_whole > 0")
    return block.join(whole, ["gene", "transcript"]).withColumn("expected", F.col("expected") / F.col("_whole")).drop("_whole")


def cluster_rows(block: DataFrame) -> DataFrame:
    """Rows of a gene whose profiles over the transcripts are proportional become one, so the likelihood keeps its maximum.

    Returns gene, transcript, bin (the least of the cluster), expected and observed (sums)
    and the number of rows in the cluster.  A row's key is an array of its transcripts only.
    """
    cells = scaled(block).where("expected > 0")
    row = cells.groupBy("gene", "bin").agg(F.array_sort(F.collect_list(F.struct("transcript", "expected"))).alias("_cells"), F.max("observed").alias("_seen"))
    whole = F.aggregate("_cells", F.lit(0.0), lambda a, x: a + x["expected"])
    row = row.withColumn("_row", whole)
    parts = F.transform("_cells", lambda x: F.struct(x["transcript"].alias("transcript"), F.floor(x["expected"] * PROFILE / F.col("_row") + 0.5 + TIE).alias("part")))
    row = row.withColumn("_profile", F.filter(parts, lambda x: x["part"] > 0))
    # a cluster's own sums are those of one more cell of each row, whose expected is null; all are summed before they are shuffled
    cell = "struct<transcript:{transcript},expected:double>".format(**dict(cells.dtypes))
    every = row.select("gene", "bin", "_profile", "_seen", F.explode(F.concat("_cells", F.array(F.lit(None).cast(cell)))).alias("_x"))
    own = F.col("_x").isNull()
    sums = every.groupBy("gene", "_profile", own.alias("_own"), F.col("_x.transcript").alias("transcript")).agg(
        F.sum("_x.expected").alias("expected"), F.min("bin").alias("_first"), F.sum("_seen").alias("_all"), F.count(F.lit(1)).alias("_n"))
    cluster = Window.partitionBy("gene", "_profile")
    of = lambda c: F.max(F.when(F.col("_own"), F.col(c))).over(cluster)
    out = sums.select("gene", "_own", "transcript", of("_first").alias("bin"), "expected", of("_all").alias("observed"), of("_n").alias("rows"))
    return out.where("not _own").drop("_own")


def stack(blocks: dict[str, DataFrame], totals: DataFrame | None = None) -> DataFrame:
    """Blocks under one another, bins named ``block:bin``; with (block, total) also the out-of-gene column.

    A transcript that a block of its gene can't see is left out of all blocks; a gene
    may lack a block as a whole.  Out-of-gene rows have a null transcript, expect 1 and
    observe what the block's total has beyond the gene's rows.
    """
    parts = [scaled(b).select(F.lit(k).alias("block"), "gene", "transcript", "bin", "expected", F.col("observed").cast("double").alias("observed")) for k, b in blocks.items()]
    cells = written(reduce(DataFrame.unionByName, parts), "blocks")  # read four times
    seen = cells.select("gene", "transcript", "block").distinct()
    needs = seen.select("gene", "block").distinct().groupBy("gene").agg(F.count(F.lit(1)).alias("_needs"))
    has = seen.groupBy("gene", "transcript").agg(F.count(F.lit(1)).alias("_has")).join(needs, "gene").where("_has = _needs").select("gene", "transcript")
    live = cells.join(has, ["gene", "transcript"])
    rows = live.groupBy("block", "gene", "bin").agg(F.sum("expected").alias("_row")).where(F.col("_row") > LEAST).drop("_row")
    columns = ["gene", F.concat_ws(":", "block", "bin").alias("bin"), "transcript", "expected", "observed"]
    out = live.join(rows, ["block", "gene", "bin"]).select(*columns)
    if totals is None:
        return out
    inside = cells.groupBy("block", "gene", "bin").agg(F.max("observed").alias("_in")).groupBy("block", "gene").agg(F.sum("_in").alias("_in"))
    outside = inside.join(F.broadcast(totals), "block").select(  # one row a block
        "block", "gene", F.lit("out").alias("bin"), F.lit(None).cast(out.schema["transcript"].dataType).alias("transcript"), F.lit(1.0).alias("expected"), (F.col("total") - F.col("_in")).alias("observed"),
    )
    return out.unionByName(outside.select(*columns))


def quantify(
    blocks: DataFrame, exons: DataFrame, density: dict[int, float], read: int, tss: tuple[DataFrame, DataFrame] | None = None, tes: tuple[DataFrame, DataFrame] | None = None,
    paired: bool = True, with_bounds: bool = False, alpha: float = 0.025,
) -> DataFrame:
    """As ``design.quantify``, with end reads in the likelihood: ``tss`` and ``tes`` are pairs of end regions and end counts.

    Fragments outside a gene count by the gene's share of all fragments of the design.
    """
    segs = design.segments(exons)
    m = design.design(segs, density, read, paired)
    seen = design.observed(blocks, segs, paired).join(m.select("gene", "bin").distinct(), ["gene", "bin"])
    rna = cluster_rows(m.join(seen, ["gene", "bin"], "left").fillna(0, ["observed"]))
    given = {k: end_block(*v) for k, v in (("tss", tss), ("tes", tes)) if v is not None}
    genes = m.select("gene").distinct()
    matrix = stack({"rna": rna, **{k: b.join(genes, "gene", "left_semi") for k, b in given.items()}})
    return design.abundance(quant.estimate(matrix, "gene", with_bounds, alpha), m, seen, with_bounds)
