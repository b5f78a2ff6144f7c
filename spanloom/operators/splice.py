"""From a gene's regions, introns and end sites to a splice graph, typed exons, path counts and candidate transcripts.

Every table has a column ``gene``; positions are closed at both ends.  What a gene is made
of is gathered in one row and cut by numpy for many genes at once, without a join or window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, StructField, StructType

from spanloom.operators.graph import exon_edges
from spanloom.session import written

#: fixed values: labels of boundaries
DONOR, ACCEPTOR, START, END, EMPTY_START, EMPTY_STOP, BOUNDARY = "D_JN", "R_JN", "TSS", "TES", "EMPTY_START", "EMPTY_STOP", "GENE_BNDRY"

#: all of them, in order; while they are gathered a label is a bit
LABELS = sorted([DONOR, ACCEPTOR, START, END, EMPTY_START, EMPTY_STOP, BOUNDARY])
#: rows of a batch that a walk over graphs hands on
BATCH = 2000
#: counts of paths stop growing here
MANY = 10**36


def _plus() -> Column:
    return F.col("strand") == "+"


def _many() -> Column:
    return F.lit(str(MANY)).cast("decimal(38,0)")


#: parts of a gene
REGION, INTRON, TSS_SITE, TES_SITE, READ = range(5)
#: names of the labels of each sum of bits
NAMES = [[x for k, x in enumerate(LABELS) if code >> k & 1] for code in range(1 << len(LABELS))]
#: exons that a batch holds, about
PAIRS = 1 << 20


def _bit(*labels: str) -> int:
    return sum(1 << LABELS.index(x) for x in labels)


def _gathered(regions: DataFrame, introns: DataFrame, tss: DataFrame, tes: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """gene, strand, parts: the kind, start, stop and number of all that a gene is made of, in one row; bounded by its distinct positions."""
    def parts(df: DataFrame, kind: int) -> DataFrame:
        strand = F.col("strand") if kind == REGION else F.lit(None).cast("string")
        n = F.col("n") if kind == READ else F.lit(1)
        whole = df if kind == REGION else df.where("start is not null and stop is not null")
        return whole.where("gene is not null").select("gene", strand.alias("strand"), F.struct(F.lit(kind).alias("kind"), *[c.cast("long").alias(x) for x, c in (("start", F.col("start")), ("stop", F.col("stop")), ("n", n))]).alias("part"))

    rows = parts(regions, REGION)
    for kind, df in ((INTRON, introns), (TSS_SITE, tss), (TES_SITE, tes), (READ, reads)):
        rows = rows if df is None else rows.unionByName(parts(df, kind))
    return rows.groupBy("gene").agg(F.max("strand").alias("strand"), F.collect_list("part").alias("parts"))


class _Parts:
    """The parts of a batch of genes as arrays; ``gene`` is the row of the batch."""

    def __init__(self, b: pa.RecordBatch):
        col = b.column("parts")
        cuts = col.offsets.to_numpy()
        inner = slice(int(cuts[0]), int(cuts[-1]))
        field = lambda name: col.values.field(name)[inner]
        self.gene = np.repeat(np.arange(b.num_rows), np.diff(cuts))
        self.kind, self.n = field("kind").to_numpy(zero_copy_only=False), field("n").to_numpy(zero_copy_only=False)
        self.known = [np.asarray(field(c).is_valid()) for c in ("start", "stop")]
        self.start, self.stop = (field(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
        self.plus = np.asarray(pc.fill_null(pc.equal(b.column("strand"), "+"), False))

    def of(self, kind: int) -> tuple[np.ndarray, ...]:
        at = self.kind == kind
        return self.gene[at], self.start[at], self.stop[at]


def _cut(x: _Parts) -> tuple[np.ndarray, ...]:
    """gene, nth, start, stop, and the labels of the left and the right end (bits) of the segments, by gene and start.

    Nothing is cut outside a gene's regions, and what lies between them is no segment, though it is counted.
    """
    at = x.kind == REGION
    gene, (has_start, has_stop) = x.gene[at], [k[at] for k in x.known]
    start, stop = x.start[at], x.stop[at]
    none = np.iinfo(np.int64)
    lo, hi = np.full(len(x.plus), none.max), np.full(len(x.plus), none.min)
    np.minimum.at(lo, gene[has_start], start[has_start])
    np.maximum.at(hi, gene[has_stop], stop[has_stop])
    real = np.flatnonzero((lo < none.max) & (hi > none.min))
    order = np.lexsort((np.where(has_start, start, none.min), gene))
    gene, start, stop, has_start, has_stop = (v[order] for v in (gene, start, stop, has_start, has_stop))
    apart = (gene[1:] == gene[:-1]) & has_stop[:-1] & has_start[1:] & (start[1:] > stop[:-1] + 1)
    gaps, begin, end = gene[1:][apart], stop[:-1][apart] + 1, start[1:][apart]
    jn, tss, tes = (x.of(k) for k in (INTRON, TSS_SITE, TES_SITE))
    sided = lambda g, left, right: np.where(x.plus[g], left, right)
    marks = [
        (real, lo[real], _bit(BOUNDARY)), (real, hi[real] + 1, _bit(BOUNDARY)), (gaps, begin, _bit(EMPTY_START)), (gaps, end, _bit(EMPTY_STOP)),
        (jn[0], jn[1], sided(jn[0], _bit(DONOR), _bit(ACCEPTOR))), (jn[0], jn[2] + 1, sided(jn[0], _bit(ACCEPTOR), _bit(DONOR))),
        (tss[0], sided(tss[0], tss[1], tss[2] + 1), _bit(START)), (tes[0], sided(tes[0], tes[2] + 1, tes[1]), _bit(END)),
    ]
    gene, pos = (np.concatenate([m[k] for m in marks]) for k in (0, 1))
    bits = np.concatenate([np.broadcast_to(m[2], m[0].shape) for m in marks]).astype(np.int64)
    order = np.lexsort((pos, gene))
    order = order[(pos[order] >= lo[gene[order]]) & (pos[order] <= np.where(hi > none.min, hi, none.min)[gene[order]] + 1)]
    gene, pos, bits = gene[order], pos[order], bits[order]
    if not len(gene):
        return (gene,) * 6
    new = np.flatnonzero(np.r_[True, (gene[1:] != gene[:-1]) | (pos[1:] != pos[:-1])])
    gene, pos, bits = gene[new], pos[new], np.bitwise_or.reduceat(bits, new)
    # empty regions that are open behind a cut, in its gene
    has = lambda label: (bits & _bit(label)) > 0
    step = has(EMPTY_START).astype(np.int64) - has(EMPTY_STOP)
    first = np.flatnonzero(np.r_[True, gene[1:] != gene[:-1]])
    run = np.cumsum(step)
    empty = run - np.repeat(run[first] - step[first], np.diff(np.r_[first, len(gene)])) > 0
    keep = ~empty | has(EMPTY_START)
    gene, pos, bits, empty = gene[keep], pos[keep], bits[keep], empty[keep]
    first = np.flatnonzero(np.r_[True, gene[1:] != gene[:-1]])
    nth = np.arange(len(gene)) - np.repeat(first, np.diff(np.r_[first, len(gene)]))
    at = np.flatnonzero((gene[1:] == gene[:-1]) & ~empty[:-1])
    return gene[at], nth[at], pos[at], pos[at + 1] - 1, bits[at], bits[at + 1]


def _meeting(x: _Parts, gene: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Number of the reads that meet each stretch: those that begin by its end, without those that end before it."""
    at = x.kind == READ
    mine, s, e, n = x.gene[at], x.start[at], x.stop[at], x.n[at]
    whole = s <= e
    mine, s, e, n = mine[whole], s[whole], e[whole], n[whole]
    if not len(s) or not len(gene):
        return np.zeros(len(gene), np.int64)
    low = min(s.min(), start.min())
    wide = max(e.max(), stop.max()) - low + 1  # genes lie one behind the other

    def upto(place: np.ndarray, asked: np.ndarray, side: str) -> np.ndarray:
        key = mine * wide + place - low
        order = np.argsort(key, kind="stable")
        return np.r_[0, np.cumsum(n[order])][np.searchsorted(key[order], gene * wide + asked - low, side)]

    return upto(s, stop, "right") - upto(e, start, "left")


def segments(regions: DataFrame, introns: DataFrame, tss: DataFrame, tes: DataFrame) -> DataFrame:
    """The pieces between a gene's cuts, without empty regions: gene, strand, nth (from 0, empty ones counted), start, stop, left_labels, right_labels.

    regions: gene, strand, start, stop, apart from each other; introns: gene, start, stop;
    tss, tes: gene, start, stop.  Cuts outside the gene's regions are left out.
    """
    each = _gathered(regions, introns, tss, tes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(NAMES, pa.list_(pa.string()))
        for b in it:
            gene, nth, start, stop, left, right = _cut(_Parts(b))
            own = pa.array(gene)
            yield pa.RecordBatch.from_arrays([b.column("gene").take(own), b.column("strand").take(own), pa.array(nth, pa.int32()), pa.array(start), pa.array(stop), names.take(pa.array(left)), names.take(pa.array(right))],
                                             names=["gene", "strand", "nth", "start", "stop", "left_labels", "right_labels"])

    return each.mapInArrow(run, f"gene {dict(each.dtypes)['gene']}, strand string, nth int, start long, stop long, left_labels array<string>, right_labels array<string>")


def splice_graph(regions: DataFrame, introns: DataFrame, tss: DataFrame, tes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each gene, edges in the direction of transcription.

    nodes: gene, strand, node, type (segment, TSS, TES), start, stop, and of segments nth
    and both labels.  edges: gene, src, dst, type (adjacent, splice, tss, tes), and of
    splices start, stop and cnt.  introns: gene, start, stop, cnt.  An intron or end site
    whose cut was left out has no edge; end sites without an edge stay as nodes.
    """
    segs = written(segments(regions, introns, tss, tes), "segments")
    name = F.concat(F.lit("S"), F.col("nth"))
    strands = regions.groupBy("gene").agg(F.any_value("strand").alias("strand"))

    def sites(df: DataFrame, kind: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("gene").orderBy("start", "stop")) - 1
        return df.select("gene", "start", "stop").distinct().join(strands, "gene").withColumn("node", F.concat(F.lit(f"{kind}_"), nth)).withColumn("type", F.lit(kind))

    starts, ends = sites(tss, "TSS"), sites(tes, "TES")
    nothing = [F.lit(None).cast("int").alias("nth"), *[F.lit(None).cast("array<string>").alias(c) for c in ("left_labels", "right_labels")]]
    head = ["gene", "strand", "node", "type", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")]
    nodes = segs.select("gene", "strand", name.alias("node"), F.lit("segment").alias("type"), "start", "stop", "nth", "left_labels", "right_labels")
    nodes = nodes.unionByName(starts.select(*head, *nothing)).unionByName(ends.select(*head, *nothing))

    kinds = segs.select("gene", "strand", "nth", "start", "stop").repartition("gene")
    w = Window.partitionBy("gene").orderBy("nth")
    following = kinds.withColumn("next", F.lead("nth").over(w)).where("next = nth + 1")
    named = lambda c: F.concat(F.lit("S"), F.col(c))
    plain = [F.lit(None).cast("long").alias(c) for c in ("start", "stop", "cnt")]
    directed = lambda a, b: [F.when(_plus(), a).otherwise(b).alias("src"), F.when(_plus(), b).otherwise(a).alias("dst")]
    adjacent = following.select("gene", *directed(named("nth"), named("next")), F.lit("adjacent").alias("type"), *plain)
    # what ends and begins at a cut; in the direction of transcription the first segment of a start site begins at it
    sides = kinds.select("gene", "strand", F.explode(F.array(
        F.struct(F.col("start").alias("pos"), F.lit(None).cast("int").alias("left"), F.col("nth").alias("right")), F.struct((F.col("stop") + 1).alias("pos"), F.col("nth").alias("left"), F.lit(None).cast("int").alias("right")))).alias("x")).select("gene", "strand", "x.*")
    at = lambda df, pos, kind, *more: df.select("gene", pos.cast("long").alias("pos"), F.lit(kind).alias("type"), *more)
    far, node = F.col("stop") + 1, F.col("node").alias("other")
    asked = at(introns, F.col("start"), "splice", *[F.col(c).cast("long").alias(c) for c in ("start", "stop", "cnt")])
    for df, kind, pos in ((starts, "tss", F.when(_plus(), F.col("start")).otherwise(far)), (ends, "tes", F.when(_plus(), far).otherwise(F.col("start")))):
        asked = asked.unionByName(at(df, pos, kind, node), allowMissingColumns=True)
    # one side of a splice, all of an end site; then the splices' other side, behind their last base
    at_right = (F.col("type") == "tss") == _plus()
    asked = _beside(asked, sides).withColumn("seg", F.when((F.col("type") == "splice") | ~at_right, F.col("left")).otherwise(F.col("right"))).where("seg is not null")
    splice = F.col("type") == "splice"
    asked = _beside(asked.drop("strand", "left", "right").withColumn("pos", F.when(splice, far)), sides)
    seg, right = named("seg"), named("right")
    src = F.when(splice, F.when(_plus(), seg).otherwise(right)).when(F.col("type") == "tss", F.col("other")).otherwise(seg)
    dst = F.when(splice, F.when(_plus(), right).otherwise(seg)).when(F.col("type") == "tss", seg).otherwise(F.col("other"))
    found = asked.where(~splice | F.col("right").isNotNull()).select("gene", src.alias("src"), dst.alias("dst"), "type", "start", "stop", "cnt")
    return nodes, adjacent.unionByName(found)


def _beside(asked: DataFrame, sides: DataFrame) -> DataFrame:
    """asked (gene, pos, ...) with strand, left and right: the gene's strand and the segments that end before pos and begin at it, null where there is none.

    A window over (gene, pos) instead of a join, so that tables dealt by gene stay where they are.
    """
    both = asked.withColumn("_asks", F.lit(True)).unionByName(sides, allowMissingColumns=True)
    w = Window.partitionBy("gene", "pos")
    return both.withColumns({c: F.max(c).over(w) for c in ("strand", "left", "right")}).where("_asks").drop("_asks")


def _exon_pairs(gene: np.ndarray, nth: np.ndarray, left: np.ndarray, right: np.ndarray, plus: np.ndarray, fpkm: np.ndarray, least: np.ndarray, floor: float, ratio: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(first, last, type, fpkm) of the exons of segments by gene and nth, in parts; ``plus`` is a segment's, first and last are rows, by position.

    Each pair of a segment that can begin an exon and one that can end it, with high segments alone between them; the least
    of a pair is that of two overlapping stretches of 2 ** k rows.
    """
    near = np.full(len(gene), floor)
    same = gene[1:] == gene[:-1]
    near[:-1] = np.where(same, np.fmax(near[:-1], least[1:] / ratio), near[:-1])
    near[1:] = np.where(same, np.fmax(near[1:], least[:-1] / ratio), near[1:])
    high = np.flatnonzero(fpkm >= near)
    if not len(high):
        return
    gene, nth, left, right, plus, fpkm = (x[high] for x in (gene, nth, left, right, plus, fpkm))
    begin = np.flatnonzero(np.r_[True, (gene[1:] != gene[:-1]) | (nth[1:] != nth[:-1] + 1)])
    size = np.diff(np.r_[begin, len(gene)])
    last = np.repeat(begin + size - 1, size)
    table = [fpkm]
    while 1 << len(table) <= size.max():
        half, below = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(below, np.r_[below[half:], np.full(half, np.inf)]))
    table = np.stack(table)
    opens, closes = _bit(START, ACCEPTOR), _bit(END, DONOR)
    low, up = left & np.where(plus, opens, closes), right & np.where(plus, closes, opens)
    lows, ups = np.flatnonzero(low), np.flatnonzero(up)
    since, until = np.searchsorted(ups, lows, "left"), np.searchsorted(ups, last[lows], "right")
    many, at = np.cumsum(until - since), 0
    while at < len(lows):
        done = many[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(many, done + PAIRS, "right")))
        n = until[at:end] - since[at:end]
        a = np.repeat(lows[at:end], n)
        b = ups[np.arange(len(a)) + np.repeat(since[at:end] - (np.cumsum(n) - n), n)]
        k = np.frexp(b - a + 1)[1] - 1
        value = np.minimum(table[k, a], table[k, b + 1 - (1 << k)])
        both = low[a] | up[b]
        for kind, labels in (("SE_GENE", (START, END)), ("TSS_EXON", (START, DONOR)), ("TES_EXON", (ACCEPTOR, END)), ("EXON", (ACCEPTOR, DONOR))):
            need = _bit(*labels)
            hit = (both & need) == need
            yield high[a[hit]], high[b[hit]], kind, value[hit]
        at = end


_EXON = "strand string, start long, stop long, type string, fpkm double"


def _exon_batches(b: pa.RecordBatch, row: np.ndarray, start: np.ndarray, stop: np.ndarray, *found: np.ndarray | float) -> Iterator[pa.RecordBatch]:
    for first, last, kind, value in _exon_pairs(row, *found):
        own = pa.array(row[first])
        yield pa.RecordBatch.from_arrays([b.column("gene").take(own), b.column("strand").take(own), pa.array(start[first]), pa.array(stop[last]), pa.array([kind]).take(pa.array(np.zeros(len(first), np.int64))), pa.array(value)],
                                         names=["gene", "strand", "start", "stop", "type", "fpkm"])


def typed_exons(segs: DataFrame, floor: float = 0.1, ratio: float = 20.0) -> DataFrame:
    """Exons of a gene: runs of segments from one that can begin an exon to one that can end it.

    segs: gene, strand, nth, start, stop, left_labels, right_labels, fpkm, fpkm_lb.  In the
    direction of transcription an exon begins at a start site or acceptor and ends at
    an end site or donor; its labels say its type.  A run stops at a gap, and at a segment
    whose fpkm is under ``floor`` or under a neighbour's lower bound / ``ratio``.
    Result: gene, strand, start, stop, type, fpkm (the least of the run).
    """
    code = lambda c: sum((F.when(F.array_contains(c, x), 1 << k).otherwise(0) for k, x in enumerate(LABELS)), F.lit(0)).alias(c)
    part = F.struct(*[F.col(c).cast("long").alias(c) for c in ("nth", "start", "stop")], code("left_labels"), code("right_labels"), *[F.col(c).cast("double").alias(c) for c in ("fpkm", "fpkm_lb")])
    each = segs.where("gene is not null").groupBy("gene").agg(F.max("strand").alias("strand"), F.array_sort(F.collect_list(part)).alias("parts"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            col = b.column("parts")
            cuts = col.offsets.to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(cuts))
            nth, start, stop, left, right, fpkm, least = (col.values.field(k)[int(cuts[0]) : int(cuts[-1])].to_numpy(zero_copy_only=False) for k in range(7))
            plus = np.asarray(pc.fill_null(pc.equal(b.column("strand"), "+"), False))[row]
            yield from _exon_batches(b, row, start, stop, nth, left, right, plus, fpkm, least, floor, ratio)

    return each.mapInArrow(run, f"gene {dict(each.dtypes)['gene']}, {_EXON}")


def read_exons(regions: DataFrame, introns: DataFrame, tss: DataFrame, tes: DataFrame, reads: DataFrame, scale: float, lower: float, floor: float = 0.1, ratio: float = 20.0) -> DataFrame:
    """``typed_exons`` of the segments that reads meet: a segment's fpkm is ``scale`` times the reads that meet it by its length, its lower bound ``lower`` times that.

    reads: gene, start, stop, n.  A gene is gathered once, cut, counted and paired in one task.
    """
    each = _gathered(regions, introns, tss, tes, reads)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = _Parts(b)
            row, nth, start, stop, left, right = _cut(x)
            n = _meeting(x, row, start, stop)
            row, nth, start, stop, left, right, n = (v[n > 0] for v in (row, nth, start, stop, left, right, n))
            fpkm = n * scale / (stop - start + 1)
            yield from _exon_batches(b, row, start, stop, nth, left, right, x.plus[row], fpkm, lower * fpkm, floor, ratio)

    return each.mapInArrow(run, f"gene {dict(each.dtypes)['gene']}, {_EXON}")


def merged_starts(exons: DataFrame, distance: int, keys: list[str]) -> DataFrame:
    """First exons that end together and begin within ``distance`` of the group's first one: keys, stop, start, score (summed), members."""
    step = """aggregate(slice(x, 2, size(x)), array(named_struct('start', x[0].start, 'score', x[0].score, 'members', 1)),
      (a, e) -> IF(e.start - a[size(a) - 1].start < {d},
        concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'score', a[size(a) - 1].score + e.score, 'members', a[size(a) - 1].members + 1))),
        concat(a, array(named_struct('start', e.start, 'score', e.score, 'members', 1)))))"""
    each = exons.groupBy(*keys, "stop").agg(F.array_sort(F.collect_list(F.struct("start", F.col("score").cast("double").alias("score")))).alias("x"))
    return each.select(*keys, "stop", F.explode(F.expr(step.format(d=int(distance)))).alias("g")).select(*keys, "stop", "g.start", "g.score", "g.members")


def merged_ends(exons: DataFrame, distance: int, keys: list[str]) -> DataFrame:
    """Last exons that begin together and end in a chain of steps under ``distance``: keys, start, stop (the last), score, members."""
    w = Window.partitionBy(*keys, "start").orderBy("stop")
    new = F.when(F.col("stop") - F.lag("stop").over(w) < distance, 0).otherwise(1)
    # rows of one stop are one step, however they are ordered
    each = exons.groupBy(*keys, "start", "stop").agg(F.sum(F.col("score").cast("double")).alias("score"), F.count(F.lit(1)).alias("members"))
    if distance <= 0:
        raise ValueError("a distance of 0 merges nothing, not even equal exons")
    g = each.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*keys, "start", "_g").agg(F.max("stop").alias("stop"), F.sum("score").alias("score"), F.sum("members").alias("members")).drop("_g")


def match_promoters(transcripts: DataFrame, promoters: DataFrame) -> DataFrame:
    """transcripts with promoter_start, promoter_stop: the promoter that begins at the first base, cut at the end of the first exon.

    transcripts: gene, transcript, strand, exons (array of (start, stop), by start);
    promoters: gene, start, stop.  Of several the last by (start, stop) counts; none: null.
    """
    return _matched(transcripts, promoters, "promoter", 1)


def match_polyas(transcripts: DataFrame, polyas: DataFrame) -> DataFrame:
    """The same at the other end: polya_start, polya_stop, the site that ends at the last base."""
    return _matched(transcripts, polyas, "polya", -1)


def _matched(transcripts: DataFrame, sites: DataFrame, name: str, end: int) -> DataFrame:
    at_start = _plus() if end > 0 else ~_plus()
    exon = F.when(at_start, F.element_at("exons", 1)).otherwise(F.element_at("exons", -1))
    t = transcripts.withColumn("_exon", exon).withColumn("_low", at_start)
    t = t.withColumn("_at", F.when(at_start, F.col("_exon.start")).otherwise(F.col("_exon.stop")))
    both = sites.select("gene", F.explode(F.array(F.struct(F.lit(True).alias("_low"), F.col("start").alias("_at")), F.struct(F.lit(False).alias("_low"), F.col("stop").alias("_at")))).alias("_k"), F.struct("start", "stop").alias("_site"))
    last = both.groupBy("gene", F.col("_k._low").alias("_low"), F.col("_k._at").alias("_at")).agg(F.max("_site").alias("_site"))
    out = t.join(last, ["gene", "_low", "_at"], "left")
    site, low = F.col("_site"), F.col("_low")
    start = F.when(low, site["start"]).otherwise(F.greatest(site["start"], F.col("_exon.start")))
    stop = F.when(low, F.least(site["stop"], F.col("_exon.stop"))).otherwise(site["stop"])
    return out.select(*transcripts.columns, F.when(site.isNotNull(), start).alias(f"{name}_start"), F.when(site.isNotNull(), stop).alias(f"{name}_stop"))


def _ways(edges: set, begin: set, rounds: int | None = None) -> dict | None:
    """How many ways lead from ``begin`` to each node that they reach; None where they reach a cycle or one has more than ``rounds`` edges."""
    on: dict = {}
    for a, b in edges:
        on.setdefault(a, []).append(b)
    waits, todo = dict.fromkeys(begin, 0), list(begin)
    while todo:
        for b in on.get(todo.pop(), ()):
            if b not in waits:
                waits[b] = 0
                todo.append(b)
            waits[b] += 1
    ways, ready = dict.fromkeys(waits, 0), [n for n, k in waits.items() if not k]
    for n in begin:
        ways[n] = 1
    done, hops = 0, dict.fromkeys(ready, 0)
    while ready:
        a = ready.pop()
        done += 1
        ways[a] = min(ways[a], MANY)
        for b in on.get(a, ()):
            ways[b] += ways[a]
            if rounds is not None:
                hops[b] = max(hops.get(b, 0), hops[a] + 1)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    return ways if done == len(waits) and (rounds is None or max(hops.values(), default=0) <= rounds) else None


def _counted(edges: set, starts: set, ends: set, rounds: int | None) -> dict | None:
    """node -> (before, after) of all nodes on a path from a start to a first end; None as in ``_ways``."""
    edges = {(a, b) for a, b in edges if a not in ends}  # edges out of an end are never walked
    before, after = _ways(edges, starts, rounds), _ways({(b, a) for a, b in edges}, ends, rounds)
    return None if before is None or after is None else {n: (k, after[n]) for n, k in before.items() if n in after}


def _listed(edges: set, starts: set, ends: set, live: dict) -> Iterator[list]:
    """All paths from a start to a first end, by nodes that lie on one only, so no step is in vain."""
    on: dict = {}
    for a, b in edges:
        if a in live and b in live and a not in ends:
            on.setdefault(a, []).append(b)
    todo = [[n] for n in starts if n in live]
    while todo:
        path = todo.pop()
        if path[-1] in ends:
            yield path
        else:
            todo += [[*path, n] for n in on.get(path[-1], ())]


def _by_gene(edges: DataFrame, starts: DataFrame, ends: DataFrame | None, each: Callable, columns: str, kinds: dict[str, str]) -> DataFrame:
    """Rows that ``each(edges, starts, ends)`` yields for the graph of a gene; a single row of nulls stands for a cycle and fails.

    The tables are dealt by gene once and sorted; a task holds the distinct edges of one gene at a time.
    """
    none = F.lit(None).cast(edges.schema["src"].dataType).alias("dst")
    rows = edges.where("src is not null and dst is not null").select("gene", F.lit(0).alias("kind"), "src", "dst")
    for kind, df in ((1, starts), (2, ends)):
        if df is not None:
            rows = rows.unionByName(df.where("node is not null").select("gene", F.lit(kind).alias("kind"), F.col("node").alias("src"), none))
    names = [c.split()[0] for c in columns.split(", ")]

    def genes(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, own = None, None
        for b in it:
            for g, kind, src, dst in zip(*(c.to_pylist() for c in b.columns)):
                if own is None or g != key:
                    if own is not None:
                        yield key, own
                    key, own = g, (set(), set(), set())
                own[kind].add(src if kind else (src, dst))
        if own is not None:
            yield key, own

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(it, None)
        if first is None:
            return
        node = first.schema.field("src").type
        types = [first.schema.field("gene").type, *[{"node": node, "nodes": pa.list_(node), "count": pa.decimal128(38, 0)}[kinds[c]] for c in names]]

        def batch(held: list) -> pa.RecordBatch:
            arrays = []
            for values, kind in zip(zip(*held), types):
                if pa.types.is_decimal(kind):
                    values = [None if x is None else Decimal(x) for x in values]
                arrays.append(pa.array(values, kind))
            return pa.RecordBatch.from_arrays(arrays, names=["gene", *names])

        held: list = []
        for key, own in genes(chain([first], it)):
            for row in each(*own):
                held.append((key, *row))
                if len(held) >= BATCH:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    schema = StructType([edges.schema["gene"], *[StructField(c, {"node": edges.schema["src"].dataType, "nodes": ArrayType(edges.schema["src"].dataType), "count": DecimalType(38, 0)}[kinds[c]]) for c in names]])
    out = written(rows.where("gene is not null").repartition("gene").sortWithinPartitions("gene").mapInArrow(run, schema), "graphs")
    if not out.where(" and ".join(f"{c} is null" for c in names)).isEmpty():
        raise RuntimeError("a cycle, or a path with too many edges")
    return out


def path_counts(edges: DataFrame, starts: DataFrame, ends: DataFrame, rounds: int | None = None) -> DataFrame:
    """gene, node, before, after: ways from the gene's starts to a node, and from it to a first end node.

    edges: gene, src, dst; starts, ends: gene, node.  A path stops at its first end.  Both
    are counted without making a path; a node lies on before x after of them.  Nodes on
    none are left out.  Counts stop growing at ``MANY``.  Fails on a cycle, and on a path of more than ``rounds`` edges.
    """
    def each(edges: set, starts: set, ends: set) -> Iterator[tuple]:
        found = _counted(edges, starts, ends, rounds)
        return iter([(None, None, None)]) if found is None else ((n, a, b) for n, (a, b) in found.items())

    return _by_gene(edges, starts, ends, each, "node, before, after", {"node": "node", "before": "count", "after": "count"})


def gene_paths(counts: DataFrame, starts: DataFrame) -> DataFrame:
    """gene, paths: all paths of a gene, from the counts of its start nodes."""
    return counts.join(starts.select("gene", "node").distinct(), ["gene", "node"], "left_semi").groupBy("gene").agg(F.least(F.sum("after"), _many()).alias("paths"))


def candidate_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, cap: int = 50_000, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, over): all paths of genes with at most ``cap`` of them, as gene and an array of nodes; genes with more, with their number.

    Paths are counted before any is made, and handed on as they are made.
    """
    def each(edges: set, starts: set, ends: set) -> Iterator[tuple]:
        found = _counted(edges, starts, ends, rounds)
        if found is None:
            return iter([(None, None)])
        n = min(sum(found[x][1] for x in starts if x in found), MANY)
        return iter([(None, n)]) if n > cap else ((p, n) for p in _listed(edges, starts, ends, found))

    out = _by_gene(edges, starts, ends, each, "path, paths", {"path": "nodes", "paths": "count"})
    return out.where("path is not null").select("gene", "path"), out.where("path is null").select("gene", "paths")


def paths_through(edges: DataFrame, lengths: DataFrame, chosen: DataFrame, longest: int) -> DataFrame:
    """All paths through a chosen node that reach as far as ``longest`` bases on both sides, or to where the graph ends.

    edges: gene, src, dst between segments; lengths: gene, node, length; chosen: gene, node.
    Each side is walked by itself and stops at the node that fills it; the paths are the
    product of both.  Result: gene, node, path (array of nodes).
    """
    size = lengths.select("gene", F.col("node").alias("dst"), "length")

    def side(e: DataFrame) -> DataFrame:
        steps = written(e.join(size, ["gene", "dst"]).select("gene", F.col("src").alias("at"), "dst", "length"), "edges")
        front = chosen.select("gene", "node").distinct().select("gene", "node", F.col("node").alias("at"), F.array().cast("array<string>").alias("way"), F.lit(0).cast("long").alias("reach"))
        done, turn = [], 0
        while True:
            turn += 1
            grown = front.join(steps, ["gene", "at"], "left")
            grown = written(grown.select("gene", "node", F.coalesce("dst", "at").alias("at"), F.when(F.col("dst").isNull(), F.col("way")).otherwise(F.concat("way", F.array("dst"))).alias("way"), (F.col("reach") + F.coalesce("length", F.lit(0))).alias("reach"), F.col("dst").isNull().alias("stuck")), "ways")
            full = (F.col("reach") >= longest) | F.col("stuck")
            done.append(grown.where(full).select("gene", "node", "way"))
            front = grown.where(~full).drop("stuck")
            if front.isEmpty():
                break
            if turn > longest + 1:
                raise RuntimeError("a cycle")
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out

    forward, backward = side(edges.select("gene", "src", "dst")), side(edges.select("gene", F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = backward.withColumnRenamed("way", "back").join(forward.withColumnRenamed("way", "on"), ["gene", "node"])
    return both.select("gene", "node", F.concat(F.reverse("back"), F.array("node"), "on").alias("path"))


def retained_intron_exons(lefts: DataFrame, rights: DataFrame, retained: DataFrame, rounds: int | None = None) -> DataFrame:
    """gene, start, stop, paths: exons made of a left and a right one joined over retained introns, with the number of ways.

    lefts, rights: gene, start, stop (exons); retained: gene, start, stop, where an exon
    ends at the intron's first base and the next begins at its last.  Ways are counted,
    not made; a way has one intron at least.
    """
    exons = lefts.select("gene", "start", "stop").unionByName(rights.select("gene", "start", "stop")).distinct()
    placed = exons.select(F.col("gene").alias("contig"), F.lit("+").alias("strand"), "start", "stop")
    jn = retained.select(F.col("gene").alias("contig"), F.lit("+").alias("strand"), (F.col("start") + 1).alias("start"), (F.col("stop") - 1).alias("stop"), F.lit(0).alias("cnt")).distinct()
    name = lambda a, b: F.concat_ws("-", F.col(a), F.col(b))
    links = exon_edges(placed, jn).select(F.col("contig").alias("gene"), name("l_start", "l_stop").alias("src"), name("r_start", "r_stop").alias("dst"))
    # one walk for each left exon: it is part of the gene's key
    begin = lefts.select("gene", name("start", "stop").alias("left"), F.col("start").alias("first")).distinct()
    keyed = links.join(begin.select("gene", "left"), "gene").select(F.struct("gene", "left").alias("gene"), "src", "dst")
    seeds = begin.select(F.struct("gene", "left").alias("gene"), F.col("left").alias("node"))

    def each(edges: set, starts: set, _: set) -> Iterator[tuple]:
        ways = _ways(edges, starts, rounds)
        return iter([(None, None)]) if ways is None else iter(ways.items())

    found = _by_gene(keyed, seeds, None, each, "node, paths", {"node": "node", "paths": "count"}).select("gene.gene", "gene.left", "node", "paths").where("left != node")
    found = found.join(begin, ["gene", "left"]).join(rights.select("gene", name("start", "stop").alias("node"), F.col("stop").alias("last")).distinct(), ["gene", "node"])
    return found.groupBy("gene", F.col("first").alias("start"), F.col("last").alias("stop")).agg(F.sum("paths").alias("paths"))
