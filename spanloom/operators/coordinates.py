"""Transcript and genome coordinates, coding parts, inferred ends, and reading frames placed on the genome.

Exons are an array of (start, stop), by start, closed; positions in a transcript count
from 0 at its lowest base, or, where a strand is given, at its 5' end.  Places are
expressions on the exon array, frames are found in the tasks that have the sequences,
so no sequence is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import seq
from spanloom.session import bound_batches

#: bases whose frames are found together
BASES = 1 << 22
_LETTERS = "TCAG"
_NUMBER = np.full(256, 4, np.uint8)
_NUMBER[[ord(x) for x in _LETTERS]] = range(4)
#: by 25 i + 5 j + k for the numbers of a codon's bases: 1 for ATG, 2 for a stop
_KINDS = np.zeros(125, np.uint8)
for _codon, _kind in (("ATG", 1), *[(x, 2) for x in seq.STOPS]):
    _KINDS[sum(_LETTERS.index(x) * 5 ** (2 - k) for k, x in enumerate(_codon))] = _kind


def _array(exons: str | Column) -> Column:
    return F.col(exons) if isinstance(exons, str) else exons


def _size(x: Column) -> Column:
    return x["stop"] - x["start"] + 1


def spliced_length(exons: str | Column = "exons") -> Column:
    return F.aggregate(F.transform(_array(exons), lambda x: _size(x).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


def placed_exons(exons: str | Column = "exons") -> Column:
    """Each exon with ``before``, the bases of all exons before it: the piecewise map between both coordinates."""
    e = _array(exons)
    sums = F.aggregate(F.transform(e, lambda x: _size(x).cast("long")), F.array(F.lit(0).cast("long")), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b)))
    return F.zip_with(e, F.slice(sums, 1, F.size(e)), lambda x, b: F.struct(x["start"].cast("long").alias("start"), x["stop"].cast("long").alias("stop"), b.alias("before")))


def _one(found: Column, value) -> Column:
    return F.when(F.size(found) > 0, value(F.get(found, F.lit(0))))


def genome_position(pos: Column, exons: str | Column = "exons", strand: Column | None = None) -> Column:
    """Genome position of a spliced position; null outside the transcript."""
    at = pos if strand is None else F.when(strand == "-", spliced_length(exons) - 1 - pos).otherwise(pos)
    found = F.filter(placed_exons(exons), lambda x: (at >= x["before"]) & (at < x["before"] + _size(x)))
    return _one(found, lambda x: x["start"] + at - x["before"])


def spliced_position(pos: Column, exons: str | Column = "exons", strand: Column | None = None) -> Column:
    """Spliced position of a genome position; null in introns and outside."""
    found = F.filter(placed_exons(exons), lambda x: (pos >= x["start"]) & (pos <= x["stop"]))
    at = _one(found, lambda x: x["before"] + pos - x["start"])
    return at if strand is None else F.when(strand == "-", spliced_length(exons) - 1 - at).otherwise(at)


def mirrored(start: Column, stop: Column, length: Column) -> tuple[Column, Column]:
    """The interval on the other strand of a contig of this length."""
    return length - 1 - stop, length - 1 - start


def _clipped(e: Column, lo: Column | None, hi: Column | None) -> Column:
    kept = F.filter(e, lambda x: (F.lit(True) if lo is None else x["stop"] >= lo) & (F.lit(True) if hi is None else x["start"] <= hi))
    return F.transform(kept, lambda x: F.struct((x["start"] if lo is None else F.greatest(x["start"], lo)).alias("start"), (x["stop"] if hi is None else F.least(x["stop"], hi)).alias("stop")))


def coding_parts(cds_start: Column, cds_stop: Column, strand: Column, exons: str | Column = "exons") -> tuple[Column, Column, Column]:
    """Arrays of the 5' untranslated, coding and 3' untranslated pieces of exons; all are null without a coding region."""
    e = _array(exons)
    below, inside, above = _clipped(e, None, cds_start - 1), _clipped(e, cds_start, cds_stop), _clipped(e, cds_stop + 1, None)
    known = cds_start.isNotNull() & cds_stop.isNotNull()
    minus = strand == "-"
    return F.when(known, F.when(minus, above).otherwise(below)), F.when(known, inside), F.when(known, F.when(minus, below).otherwise(above))


def _end_piece(low: Column, exons: str | Column, length: int) -> Column:
    first, last = F.element_at(_array(exons), 1), F.element_at(_array(exons), -1)
    return F.when(low, F.struct(first["start"].alias("start"), F.least(first["start"] + length - 1, first["stop"]).alias("stop"))).otherwise(
        F.struct(F.greatest(last["stop"] - length + 1, last["start"]).alias("start"), last["stop"].alias("stop")))


def inferred_promoter(strand: Column, exons: str | Column = "exons", length: int = 50) -> Column:
    """Up to ``length`` bases of the first exon, from the 5' end."""
    return _end_piece(strand == "+", exons, length)


def inferred_polya(strand: Column, exons: str | Column = "exons", length: int = 20) -> Column:
    """Up to ``length`` bases of the last exon, to the 3' end."""
    return _end_piece(strand == "-", exons, length)


def spliced_sequence(sequence: Column, begin: Column, strand: Column, exons: str | Column = "exons") -> Column:
    """A transcript's sequence from the plus strand's, which starts at genome position ``begin``."""
    joined = F.array_join(F.transform(_array(exons), lambda x: F.substring(sequence, (x["start"] - begin + 1).cast("int"), _size(x).cast("int"))), "")
    return F.when(strand == "-", seq.reverse_complement(joined)).otherwise(joined)


def feature_rows(transcripts: DataFrame) -> DataFrame:
    """The lines of an annotation, in their order: all columns but exons, with feature, start, stop, frame, nth.

    transcripts: strand, exons, cds_start, cds_stop, and, where there are any, promoter and
    polya (start, stop).  A coding piece's frame counts the coding bases before it, modulo 3.
    """
    strand = F.col("strand")
    up, cds, down = coding_parts(F.col("cds_start"), F.col("cds_stop"), strand)
    coded = placed_exons(cds)
    piece = lambda name, order, arr: F.transform(arr, lambda x: F.struct(F.lit(order).alias("_o"), F.lit(name).alias("feature"), x["start"].cast("long").alias("start"), x["stop"].cast("long").alias("stop"), F.lit(None).cast("int").alias("frame")))
    parts = [piece("five_prime_UTR", 2, up), piece("exon", 3, F.col("exons")), piece("three_prime_UTR", 5, down)]
    parts.append(F.transform(coded, lambda x: F.struct(F.lit(4).alias("_o"), F.lit("CDS").alias("feature"), x["start"], x["stop"], (x["before"] % 3).cast("int").alias("frame"))))
    parts += [piece(name, order, F.when(F.col(name).isNotNull(), F.array(name))) for name, order in (("promoter", 1), ("polya", 6)) if name in transcripts.columns]
    none = F.array().cast("array<struct<_o:int,feature:string,start:bigint,stop:bigint,frame:int>>")
    rows = F.concat(*[F.coalesce(p.cast("array<struct<_o:int,feature:string,start:bigint,stop:bigint,frame:int>>"), none) for p in parts])
    # by kind in the direction of transcription, then from high to low
    key = lambda x: F.struct(F.when(strand == "-", -x["_o"]).otherwise(x["_o"]).alias("k"), (-x["start"]).alias("s"), x.alias("x"))
    rest = [c for c in transcripts.columns if c not in ("exons", "cds_start", "cds_stop", "promoter", "polya")]
    out = transcripts.select(*rest, F.posexplode(F.array_sort(F.transform(rows, key))).alias("nth", "_r"))
    return out.select(*rest, "nth", "_r.x.feature", "_r.x.start", "_r.x.stop", "_r.x.frame")


def _open_frames(codes: np.ndarray, begins: np.ndarray, min_aa: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, frame, start, stop) of the open reading frames of base numbers (T, C, A, G, other: 0 to 4); sequence k is ``begins[k]`` to ``begins[k + 1]``."""
    codons = codes[:-2] * np.uint8(25) + codes[1:-1] * np.uint8(5) + codes[2:]
    kind = _KINDS[codons]
    at = np.flatnonzero(kind)
    of = np.searchsorted(begins, at, "right") - 1
    whole = at + 2 < begins[of + 1]
    at, of = at[whole], of[whole]
    place = at - begins[of]
    group = of * 3 + place % 3
    order = np.argsort(group, kind="stable")
    group, place, stop = group[order], place[order], kind[at][order] == 2
    new = np.append(True, group[1:] != group[:-1])
    # the first ATG of its frame, or behind a stop; later ones are inside
    keep = stop | new | np.append(True, stop[:-1])
    group, place, stop = group[keep], place[keep], stop[keep]
    k = np.flatnonzero(~stop[:-1] & stop[1:] & (group[:-1] == group[1:])) if len(group) else np.zeros(0, np.int64)
    k = k[place[k + 1] - place[k] >= 3 * min_aa]
    return group[k] // 3, group[k] % 3, place[k], place[k + 1]


def reading_frames(df: DataFrame, id_col: str, seq_col: str, min_aa: int = 100, keep: Sequence[str] = ()) -> DataFrame:
    """id, frame, start, stop: open reading frames from the first ATG behind a stop codon to the next stop, whose first base is ``stop``.

    Sequences go through numpy, ``BASES`` bases or one sequence at a time, in the task that has them, so nothing is shuffled.
    Sequences without a frame give no row; ``keep`` names columns that go with each row.
    """
    names = [id_col, *keep]
    src = df.select(*names, F.col(seq_col).alias("_s")).where("_s is not null")
    kinds = dict(src.dtypes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(len(names))
            sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), BASES, "right")) + lo)
                # one byte a letter; letters outside Latin-1 are others
                some = [x.encode("latin-1", "replace") for x in texts[lo:hi].to_pylist()]
                begins = np.append(0, np.cumsum([len(x) for x in some]))
                codes = _NUMBER[np.frombuffer(b"".join(some), np.uint8)]
                if len(codes) > 2:
                    of, frame, start, stop = _open_frames(codes, begins, min_aa)
                    taken = pa.array(of + lo)
                    yield pa.RecordBatch.from_arrays([*[b.column(k).take(taken) for k in range(len(names))], pa.array(frame, pa.int32()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=[*names, "frame", "start", "stop"])
                lo = hi

    bound_batches(df.sparkSession)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return src.mapInArrow(run, f"{schema}, frame int, start long, stop long")


def coding_regions(transcripts: DataFrame, min_aa: int = 100, only_longest: bool = False, with_stop: bool = True) -> DataFrame:
    """transcript, cds, frame, cds_start, cds_stop (genome), length (amino acids): reading frames of (transcript, strand, exons, sequence).

    ``sequence`` is spliced and reads from the 5' end.  Ends are of the stop codon where
    ``with_stop``.  Of several frames each gets a name with ``_CDS`` and its number by
    (frame, start); ``only_longest`` keeps all of the greatest length.
    """
    found = reading_frames(transcripts, "transcript", "sequence", min_aa, ["strand", "exons"]).withColumn("length", F.expr("(stop - start) div 3"))
    own = Window.partitionBy("transcript")
    if only_longest:
        found = found.withColumn("_top", F.max("length").over(own)).where("length = _top").drop("_top")
    t = found.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_k", F.row_number().over(own.orderBy("frame", "start")))
    a = genome_position(F.col("start"), "exons", F.col("strand"))
    b = genome_position(F.col("stop") - 1 + (3 if with_stop else 0), "exons", F.col("strand"))
    name = F.when(F.col("_n") > 1, F.concat(F.col("transcript").cast("string"), F.lit("_CDS"), F.col("_k"))).otherwise(F.col("transcript").cast("string"))
    return t.select("transcript", name.alias("cds"), "frame", F.least(a, b).alias("cds_start"), F.greatest(a, b).alias("cds_stop"), "length")
