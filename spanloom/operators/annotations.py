"""Annotations against each other: recovery of elements and transcripts, class codes, best references, merging.

A transcript is a row: transcript, contig, strand, exons (array of (start, stop), by
start, closed).  Sides are matched by keys and sorted neighbours, never by all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.graph import linkage_clusters
from spanloom.operators.intervals import overlap_join
from spanloom.session import written

PLACE = ["contig", "strand"]


def introns_of(exons: str | Column = "exons") -> Column:
    """The gaps between consecutive exons."""
    e = F.col(exons) if isinstance(exons, str) else exons
    n = F.greatest(F.size(e) - 1, F.lit(0))
    return F.zip_with(F.slice(e, 1, n), F.slice(e, 2, n), lambda a, b: F.struct((a["stop"] + 1).alias("start"), (b["start"] - 1).alias("stop")))


def elements(ref: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct elements of both sides: class, contig, strand, inner, outer, and whether ``ref`` and ``new`` have it.

    Internal exons, introns and single exons are (start, stop); a first or last exon is its
    inner bound, where its intron is, and its outer end.
    """
    e, n = F.col("exons"), F.size("exons")
    first, last = F.element_at(e, 1), F.element_at(e, -1)
    plain = lambda name, arr: F.transform(arr, lambda x: F.struct(F.lit(name).alias("class"), x["start"].alias("inner"), x["stop"].alias("outer")))
    plus = F.col("strand") == "+"
    low = lambda name: F.struct(F.lit(name).alias("class"), first["stop"].alias("inner"), first["start"].alias("outer"))
    high = lambda name: F.struct(F.lit(name).alias("class"), last["start"].alias("inner"), last["stop"].alias("outer"))
    ends = F.when(plus, F.array(low("TSS Exon"), high("TES Exon"))).otherwise(F.array(high("TSS Exon"), low("TES Exon")))
    several = F.concat(plain("Internal Exon", F.slice(e, 2, F.greatest(n - 2, F.lit(0)))), plain("Intron", introns_of()), ends)
    every = F.when(n == 1, plain("Single Exon", e)).when(n > 1, several)
    side = lambda df, k: df.select(F.lit(k).alias("_side"), *PLACE, F.explode(every).alias("x")).select("_side", *PLACE, "x.*")
    both = side(ref, 0).unionByName(side(new, 1)).groupBy("class", *PLACE, "inner", "outer")
    return both.agg((F.min("_side") == 0).alias("ref"), (F.max("_side") == 1).alias("new"))


def _recovered(both: DataFrame, distance: int) -> DataFrame:
    """class of each element of ``ref`` that ``new`` has: exactly, or with the outer end closer than ``distance``, or, of single exons, covered up to it."""
    ends, single = ["TSS Exon", "TES Exon"], "Single Exon"
    exact = both.where(~F.col("class").isin(*ends, single) & F.col("ref") & F.col("new"))
    # nearest neighbours on both sides of each end, within its key
    w = Window.partitionBy("class", *PLACE, "inner")
    theirs = F.when(F.col("new"), F.col("outer").cast("long"))
    near = both.where(F.col("class").isin(ends)).withColumn("_a", F.max(theirs).over(w.orderBy("outer"))).withColumn("_b", F.min(theirs).over(w.orderBy(F.desc("outer"))))
    near = near.where(F.col("ref") & ((F.col("outer") - F.col("_a") < distance) | (F.col("_b") - F.col("outer") < distance)))
    # of all new ones that begin before start + distance, the one that ends last
    one = both.where(F.col("class") == single)
    mark = lambda at, end: F.struct((F.col("inner") + at).cast("long").alias("at"), end.alias("end"))
    none = F.lit(None).cast("long")
    marks = F.array_compact(F.array(F.when(F.col("ref"), mark(distance - 1, none)), F.when(F.col("new"), mark(0, F.col("outer").cast("long")))))
    covered = one.select("class", *PLACE, "outer", F.explode(marks).alias("x")).withColumn("_far", F.max("x.end").over(Window.partitionBy(*PLACE).orderBy("x.at")))
    covered = covered.where(F.col("x.end").isNull() & (F.col("_far") + distance > F.col("outer")))
    return exact.select("class").unionByName(near.select("class")).unionByName(covered.select("class"))


def compare_elements(ref: DataFrame, new: DataFrame, distance: int = 50) -> DataFrame:
    """class, n_ref, n_new, matched (elements of ref that new has), recall, precision; "Exon" sums its three kinds."""
    both = written(elements(ref, new), "elements")  # read four times
    sums = both.groupBy("class").agg(F.count(F.when(F.col("ref"), 1)).alias("n_ref"), F.count(F.when(F.col("new"), 1)).alias("n_new"))
    each = sums.join(_recovered(both, distance).groupBy("class").agg(F.count(F.lit(1)).alias("matched")), "class", "left").fillna(0)
    exons = each.where(F.col("class").isin("Internal Exon", "TSS Exon", "TES Exon")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_ref", "n_new", "matched")])
    out = each.unionByName(exons.withColumn("class", F.lit("Exon")))
    share = lambda c: F.when(F.col(c) > 0, F.col("matched") / F.col(c)).otherwise(0.0)
    return out.select("class", "n_ref", "n_new", "matched", share("n_ref").alias("recall"), share("n_new").alias("precision"))


def _chains(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("transcript", *PLACE, introns_of().alias("introns"), F.element_at("exons", 1)["start"].alias("start"), F.element_at("exons", -1)["stop"].alias("stop"))


def match_classes(left: DataFrame, right: DataFrame, distance: int = 50, partial: bool = False) -> DataFrame:
    """transcript, class, match: of each left transcript the class of its best right one.

    ``=``: the same introns, and both ends closer than ``distance`` (the smallest id of those).
    With ``partial``: ``c``: its introns are a stretch of a longer chain (the shortest such
    chain, then smallest id); ``j``: it shares introns (most, then smallest id).  Else ``u``.
    Equal right transcripts are joined once; chains meet over an index by intron.
    """
    a, b = _chains(left), _chains(right).groupBy(*PLACE, "introns", "start", "stop").agg(F.min("transcript").alias("other"))
    cell = F.expr(f"start div {distance}")
    near = a.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1))).join(
        b.select(*PLACE, "introns", F.col("start").alias("_s"), F.col("stop").alias("_e"), "other", F.expr(f"start div {distance}").alias("_cell")), [*PLACE, "introns", "_cell"])
    near = near.where((F.abs(F.col("start") - F.col("_s")) < distance) & (F.abs(F.col("stop") - F.col("_e")) < distance))
    found = near.groupBy("transcript").agg(F.min("other").alias("match")).withColumn("class", F.lit("="))
    if partial:
        rest = written(a.join(found, "transcript", "left_anti"), "chains")
        chains = written(b.groupBy(*PLACE, "introns").agg(F.min("other").alias("other")).where(F.size("introns") > 0), "chains")
        mine = rest.groupBy(*PLACE, "introns").agg(F.min("transcript").alias("_one")).where(F.size("introns") > 0)
        index = lambda df, keep: df.select(*PLACE, keep, F.col("introns").alias(f"_{keep}_all"), F.posexplode("introns").alias(f"_{keep}_at", "intron"))
        pairs = index(mine, "_one").join(index(chains, "other"), [*PLACE, "intron"])
        # the first shared intron's places say where a contained chain would begin
        pairs = pairs.groupBy("_one", "other").agg(F.count(F.lit(1)).alias("shared"), F.min(F.struct("__one_at", "_other_at")).alias("at"), F.first("__one_all").alias("x"), F.first("_other_all").alias("y"))
        inside = (F.size("y") > F.size("x")) & (F.col("shared") == F.size("x")) & (F.col("at.__one_at") == 0) & (F.slice("y", F.col("at._other_at") + 1, F.size("x")) == F.col("x"))
        ranked = pairs.select("_one", F.struct(F.when(inside, 0).otherwise(1).alias("k"), F.when(inside, F.size("y")).otherwise(-F.col("shared")).alias("v"), F.col("other").alias("match")).alias("best"))
        ranked = ranked.groupBy("_one").agg(F.min("best").alias("best")).select("_one", F.when(F.col("best.k") == 0, "c").otherwise("j").alias("class"), F.col("best.match").alias("match"))
        # every transcript of the chain has its chain's class
        by_chain = mine.join(ranked, "_one").select(*PLACE, "introns", "class", "match")
        found = found.unionByName(rest.join(by_chain, [*PLACE, "introns"]).select("transcript", "match", "class"))
    out = left.select("transcript").join(found, "transcript", "left")
    return out.select("transcript", F.coalesce("class", F.lit("u")).alias("class"), "match")


def compare_transcripts(ref: DataFrame, new: DataFrame, distance: int = 50) -> DataFrame:
    """One row: n_ref, n_new, matched_ref and matched_new (transcripts of class ``=``), recall, precision."""
    side = lambda x, y, n, m: match_classes(x, y, distance).agg(F.count(F.lit(1)).alias(n), F.count(F.when(F.col("class") == "=", 1)).alias(m))
    both = side(ref, new, "n_ref", "matched_ref").crossJoin(side(new, ref, "n_new", "matched_new"))  # one row each
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return both.select("n_ref", "n_new", "matched_ref", "matched_new", share("matched_ref", "n_ref").alias("recall"), share("matched_new", "n_new").alias("precision"))


def best_references(transcripts: DataFrame, refs: DataFrame, width: int = 4096) -> DataFrame:
    """transcript, ref, code, shared, offset: of the references whose span meets the transcript's, the one that shares
    most introns, then the least offset of both ends, then the smallest id.

    Codes: ``=`` the same introns, ``c`` all of its introns and the reference has more, ``j`` some shared, ``o`` none.
    Transcripts without a reference get no row.  Offsets are under 2 ** 31.
    Pairs are sorted only where ids aren't whole numbers.
    """
    r = _chains(refs).withColumnRenamed("transcript", "ref")
    both = overlap_join(_chains(transcripts), r, width)
    shared, n, m = F.size(F.array_intersect("introns", "r_introns")), F.size("introns"), F.size("r_introns")
    offset = F.abs(F.col("start") - F.col("r_start")) + F.abs(F.col("stop") - F.col("r_stop"))
    code = F.when((n == m) & (n == shared), 0).when((n == shared) & (m > shared), 1).when(shared > 0, 2).otherwise(3)
    named = F.element_at(F.array(*map(F.lit, "=cjo")), F.col("_code") + 1)
    if dict(r.dtypes)["ref"] not in ("int", "bigint"):
        best = both.groupBy("transcript").agg(F.min(F.struct((-shared).alias("s"), offset.alias("offset"), F.col("r_ref").alias("ref"), code.alias("_code"))).alias("x"))
        return best.select("transcript", "x.*").select("transcript", "ref", named.alias("code"), (-F.col("s")).alias("shared"), "offset")
    # one number for shared, offset and id, as in intervals.best_overlaps: a task reduces its pairs by a hash aggregate and sorts none
    number = f"cast({1 << 64} as decimal(20,0))"
    rank = (shared.cast("long") * (1 << 31) + ((1 << 31) - 1 - offset)).alias("_rank")
    both = both.select("transcript", rank, F.expr(f"cast({(1 << 63) - 1} as decimal(19,0)) - cast(r_ref as decimal(19,0))").alias("_rest"), code.alias("_code"))
    whole = F.expr(f"cast(cast(_rank as decimal(19,0)) * {number} + _rest as decimal(38,0))")
    best = both.select("transcript", "_code", whole.alias("_best")).groupBy("transcript").agg(F.max("_best").alias("_best"), F.max_by("_code", "_best").alias("_code"))
    best = best.select("transcript", F.expr(f"cast(_best div {number} as long)").alias("_rank"), F.expr(f"cast({(1 << 63) - 1} - _best % {number} as long)").alias("ref"), "_code")
    return best.select("transcript", "ref", named.alias("code"), F.expr(f"cast(_rank div {1 << 31} as int)").alias("shared"), (F.lit((1 << 31) - 1).cast("long") - F.expr(f"_rank % {1 << 31}")).alias("offset"))


def internal_key(exons: str = "exons") -> Column:
    """All bounds of a transcript but its outer two, as text; single exons have the empty one."""
    return F.array_join(F.transform(introns_of(exons), lambda x: F.concat_ws("-", x["start"], x["stop"])), ",")


def merged_transcripts(transcripts: DataFrame, gap: int = 50) -> tuple[DataFrame, DataFrame]:
    """(merged, sources): one canonical transcript for each cluster, and which ones it stands for.

    Transcripts with the same inner bounds and coding region (cds_start, cds_stop, where
    the table has them) are linked when both ends are within ``gap``; linkage is single and goes on.
    merged: transcript (the cluster's smallest id), contig, strand, exons with the widest
    outer ends, members; sources: transcript, source.  Overlaps of the clusters don't matter.
    """
    coding = [c for c in ("cds_start", "cds_stop") if c in transcripts.columns]
    # null coding regions are equal
    keys = [*PLACE, "_key", *[f"_{c}" for c in coding]]
    t = transcripts.select("transcript", *PLACE, "exons", internal_key().alias("_key"), *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(f"_{c}") for c in coding])
    t = written(t.withColumn("start", F.element_at("exons", 1)["start"]).withColumn("stop", F.element_at("exons", -1)["stop"]), "transcripts")
    clusters = linkage_clusters(t.select(*keys, "transcript", "start", "stop"), gap, keys, "transcript")
    sources = clusters.select(F.col("cluster").alias("merged"), "transcript")
    bounds = t.join(clusters, "transcript").groupBy("cluster").agg(F.min("start").alias("lo"), F.max("stop").alias("hi"), F.count(F.lit(1)).alias("members"))
    whole = t.join(bounds, F.col("transcript") == F.col("cluster"))
    n = F.size("exons")
    wide = F.transform("exons", lambda x, i: F.struct(F.when(i == 0, F.col("lo")).otherwise(x["start"]).alias("start"), F.when(i == n - 1, F.col("hi")).otherwise(x["stop"]).alias("stop")))
    return whole.select("transcript", *PLACE, wide.alias("exons"), "members"), sources.select(F.col("merged").alias("transcript"), F.col("transcript").alias("source"))


def expressed(rows: DataFrame, least: float = 0.1, in_sample: float | None = None, over_samples: float | None = None) -> DataFrame:
    """Transcripts that some sample shows: (gene, sample, transcript, lo, hi) -> transcript.

    One stays unless all its lower bounds are under ``least``, where in some sample its upper bound
    reaches ``least``, the gene's greatest lower bound of the sample / ``in_sample``, and
    that of all samples / ``over_samples``.
    """
    top = lambda keys: rows.groupBy(*keys).agg(F.max("lo").alias("_top"))
    out, floor = rows, F.lit(least)
    for name, keys, ratio in (("_s", ["gene", "sample"], in_sample), ("_a", ["gene"], over_samples)):
        if ratio is not None:
            out = out.join(top(keys).withColumnRenamed("_top", name), keys, "left")
            floor = F.greatest(floor, F.col(name) / ratio)
    seen = out.groupBy("transcript").agg(F.max(F.coalesce(F.col("lo") >= least, F.lit(False))).alias("any"), F.max(F.coalesce(F.col("hi") >= floor, F.lit(False))).alias("some"))
    return seen.where("any and some").select("transcript")
