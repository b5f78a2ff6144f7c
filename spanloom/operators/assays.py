"""Coverages of single assays out of aligned reads (``reads.READ_SCHEMA``; pos from 0, aend behind the last base).

End assays give (contig, strand, pos, count), the weighted number of read ends at a
position, aggregated before the shuffle; they are what ``ends.end_block`` and the peak
operators take.  Span assays give runs of constant depth without strands.  Reads whose
flag, place or, where it is tested, mapping quality is null don't count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import intervals
from spanloom.operators.reads import has, map_weight, read_strand

#: reads of this mapping quality or less don't show a start site
UNSURE = 1

PAIRED, FIRST, SECOND = 0x1, 0x40, 0x80


@dataclass(frozen=True)
class EndAssay:
    """Which reads show an end of a transcript, and which of their ends it is.

    ``keep`` takes the table's columns and whether strands are flipped; ``own_strand`` takes
    each read's own direction instead of its pair's.
    """

    keep: Callable[[bool], Column]
    five_prime: bool
    own_strand: bool = True


def _sure(flip: bool) -> Column:
    return F.col("mapq") > UNSURE


def _sure_first(flip: bool) -> Column:
    return _sure(flip) & has(F.col("flag"), FIRST)


def _with_tail(flip: bool) -> Column:
    """Of a pair only the mate that reads the tail: read 1 where strands are flipped, read 2 otherwise."""
    return ~(has(F.col("flag"), PAIRED) & has(F.col("flag"), SECOND if flip else FIRST))


#: what a user may add an assay to
END_ASSAYS: dict[str, EndAssay] = {
    "cage": EndAssay(_sure, five_prime=True),
    "rampage": EndAssay(_sure_first, five_prime=True),
    "polya": EndAssay(_with_tail, five_prime=False, own_strand=False),
}


def end_counts(reads: DataFrame, assay: str | EndAssay, flip: bool = False, opposite: bool = True) -> DataFrame:
    """contig, strand, pos, count of an end assay; ``flip`` where reads lie against their transcript, ``opposite`` where mates do against each other."""
    kind = END_ASSAYS[assay] if isinstance(assay, str) else assay
    strand = read_strand(F.col("flag"), not kind.own_strand and opposite, flip)
    used = reads.where(kind.keep(flip) & F.col("flag").isNotNull() & F.col("pos").isNotNull() & F.col("aend").isNotNull()).withColumn("_strand", strand)
    low, high = F.least(F.col("pos"), F.col("aend") - 1), F.greatest(F.col("pos"), F.col("aend") - 1)
    at = F.when(F.col("_strand") == ("+" if kind.five_prime else "-"), low).otherwise(high)
    return used.groupBy("contig", F.col("_strand").alias("strand"), at.alias("pos")).agg(F.sum(map_weight(F.col("xp"), F.col("nh"))).alias("count"))


def chip_coverage(reads: DataFrame, length: int, opposite: bool = False, flip: bool = False) -> DataFrame:
    """Unpaired reads stretched to fragments of ``length`` from their 5' ends, each of weight 1 / (length + 1): contig, start, stop, depth.

    Fragments are counted in whole numbers and weighed afterwards, so depth 0 is exact. Their starts may lie before 0.
    """
    if length < 1:
        raise ValueError("a fragment has at least one base")
    plus = read_strand(F.col("flag"), opposite, flip) == "+"
    used = reads.where(F.col("flag").isNotNull() & F.col("pos").isNotNull() & F.col("aend").isNotNull())
    start = F.when(plus, F.col("pos")).otherwise(F.col("aend") - length)
    runs = intervals.coverage(used.select("contig", start.alias("start"), (start + length - 1).alias("stop")), keys=["contig"])
    return runs.withColumn("depth", F.col("depth") / (length + 1))


def dnase_coverage(reads: DataFrame) -> DataFrame:
    """Spans of reads, gaps inside them included: contig, start, stop, depth."""
    low, high = F.least("pos", "aend"), F.greatest("pos", "aend")
    used = reads.where(F.col("pos").isNotNull() & F.col("aend").isNotNull()).select("contig", low.alias("start"), (high - 1).alias("stop"))
    return intervals.coverage(used.where("stop >= start"), keys=["contig"])
