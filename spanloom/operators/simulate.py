"""Simulated paired reads of transcripts, a pure function of the seed and the fragment's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: int, salt: int, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *cols), F.lit(1 << 53)) / float(1 << 53)


def span_cigar(exons: Column, offset: Column, size: Column) -> Column:
    """struct(pos, cigar, stop) of ``size`` transcript bases from ``offset``: matches inside exons, skips between them."""

    def step(a, e):
        n = e["stop"] - e["start"] + 1
        lo, hi = F.greatest(offset - a["done"], F.lit(0).cast("long")), F.least(offset + size - a["done"], n)
        begin = e["start"] + lo
        skip = F.when(a["stop"].isNotNull() & (begin - a["stop"] > 1), F.array(F.struct(F.lit(3).alias("op"), (begin - a["stop"] - 1).cast("int").alias("len")))).otherwise(F.expr("cast(array() as array<struct<op:int,len:int>>)"))
        match = F.array(F.struct(F.lit(0).alias("op"), (hi - lo).cast("int").alias("len")))
        on = hi > lo
        return F.struct(
            (a["done"] + n).cast("long").alias("done"), F.when(on, F.coalesce(a["pos"], begin)).otherwise(a["pos"]).cast("long").alias("pos"),
            F.when(on, e["start"] + hi - 1).otherwise(a["stop"]).cast("long").alias("stop"), F.when(on, F.concat(a["cigar"], skip, match)).otherwise(a["cigar"]).alias("cigar"),
        )

    zero = F.expr("named_struct('done', 0L, 'pos', cast(null as bigint), 'stop', cast(null as bigint), 'cigar', cast(array() as array<struct<op:int,len:int>>))")
    return F.aggregate(exons, zero, step)


def fragments(spark: SparkSession, transcripts: DataFrame, n: int, density: dict[int, float], seed: int = 0) -> DataFrame:
    """``n`` numbered fragments: transcript by ``weight``, length by ``density`` up to the transcript's, uniform offset.

    transcripts: transcript, contig, strand, exons array<struct<start,stop>> (sorted), weight.
    The annotation's running weights are one window over its transcripts; the
    fragments find theirs by an equi-join on 4096 even cells of the running weights.
    """
    lengths = sorted(density)
    total, run, cdf = sum(density.values()), 0.0, []
    for k in lengths:
        run += density[k] / total
        cdf.append(run)
    size = F.aggregate("exons", F.lit(0).cast("long"), lambda a, e: a + e["stop"] - e["start"] + 1)
    t = transcripts.withColumn("_size", size).where((F.col("_size") >= lengths[0]) & (F.col("weight") > 0))
    w = Window.orderBy("transcript").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_hi", F.sum("weight").over(w)).withColumn("_all", F.sum("weight").over(Window.partitionBy()))
    t = t.withColumn("_lo", (F.col("_hi") - F.col("weight")) / F.col("_all")).withColumn("_hi", F.col("_hi") / F.col("_all"))
    cells = 1 << 12
    t = t.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * cells), F.least(F.floor(F.col("_hi") * cells), F.lit(cells)))))
    f = spark.range(n).select(F.col("id").alias("fragment"), uniform(seed, 1, "id").alias("_u")).withColumn("_cell", F.floor(F.col("_u") * cells))
    out = f.join(t, "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    known, steps = F.array(*[F.lit(k) for k in lengths]), F.array(*[F.lit(c) for c in cdf])
    out = out.withColumn("_k", F.size(F.filter(known, lambda k: k <= F.col("_size"))))
    pick = uniform(seed, 2, "fragment") * F.get(steps, F.col("_k") - 1)
    out = out.withColumn("_pick", pick).withColumn("length", F.get(known, F.least(F.size(F.filter(steps, lambda c: c <= F.col("_pick"))), F.col("_k") - 1)).cast("long"))
    out = out.withColumn("offset", F.floor(uniform(seed, 3, "fragment") * (F.col("_size") - F.col("length") + 1)).cast("long"))
    return out.select("fragment", "transcript", "contig", "strand", "exons", "length", "offset")


def pairs(frags: DataFrame, read: int) -> DataFrame:
    """Two canonical reads for each fragment, read 1 on the transcript's strand; reads no longer than the fragment."""
    n = F.least(F.lit(read).cast("long"), F.col("length"))
    plus = F.col("strand") == "+"
    # fixed values: flags of proper pairs, by strand and side
    left = F.struct(F.when(plus, 99).otherwise(163).alias("flag"), span_cigar(F.col("exons"), F.col("offset"), n).alias("s"))
    right = F.struct(F.when(plus, 147).otherwise(83).alias("flag"), span_cigar(F.col("exons"), F.col("offset") + F.col("length") - n, n).alias("s"))
    both = frags.select("*", n.cast("int").alias("read_len"), left.alias("_l"), right.alias("_r"))
    both = both.withColumn("_m", F.explode(F.array(F.struct(F.col("_l").alias("own"), F.col("_r.s.pos").alias("mate_pos")), F.struct(F.col("_r").alias("own"), F.col("_l.s.pos").alias("mate_pos")))))
    return both.select(
        F.concat_ws(":", "transcript", "fragment").alias("qname"), F.col("_m.own.flag").alias("flag"), "contig", F.col("_m.own.s.pos").alias("pos"), (F.col("_m.own.s.stop") + 1).alias("aend"),
        F.lit(60).alias("mapq"), F.col("_m.own.s.cigar").alias("cigar"), F.lit(None).cast("string").alias("rg"), F.lit(1).alias("nh"), F.lit(None).cast("double").alias("xp"), "read_len",
        F.col("_m.mate_pos").alias("mate_pos"), "strand", "transcript", "fragment",
    )


def sam_lines(reads: DataFrame) -> DataFrame:
    """Alignment lines without bases; the template length is left 0."""
    letters = F.lit("MIDNSHP")
    text = F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), F.substring(letters, c["op"] + 1, F.lit(1)))), "")
    return reads.select(F.concat_ws("\t", "qname", "flag", "contig", F.col("pos") + 1, "mapq", text, F.lit("="), F.col("mate_pos") + 1, F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("NH:i:"), "nh")).alias("value"))
