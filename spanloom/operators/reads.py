"""Aligned reads: flags, strands, CIGAR blocks, pairs, fragment lengths, junctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import spread

READ_SCHEMA = "qname string, flag int, contig string, pos long, aend long, mapq int, cigar array<struct<op:int,len:int>>, rg string, nh int, xp double, read_len int"
MIN_FLANK, MIN_INTRON, MAX_INTRON = 12, 40, 1_000_000


def clean_contig(name: Column) -> Column:
    return F.when(name.endswith("mitochondrion_genome"), F.lit("M")).otherwise(F.regexp_replace(name, "^chr", ""))


def ucsc_contig(name: Column) -> Column:
    return F.when(name.startswith("ERCC") | name.startswith("phiX"), name).otherwise(F.concat(F.lit("chr"), name))


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def read_strand(flag: Column, opposite: bool = True, flip: bool = False) -> Column:
    """+ or -: paired mates on opposite strands take the strand of read 1."""
    forward = ~has(flag, 0x10)
    plus = forward
    if opposite:
        mate = (has(flag, 0x40) & forward) | (has(flag, 0x80) & ~forward)
        plus = F.when(has(flag, 0x1), mate).otherwise(forward)
    return F.when(plus != F.lit(flip), "+").otherwise("-")


def map_weight(xp: Column, nh: Column) -> Column:
    return F.coalesce(F.when(xp.between(0, 1), xp), F.when(nh > 0, 1 / nh), F.lit(1.0))


def cigar_blocks(df: DataFrame) -> DataFrame:
    """One row for each aligned block; M covers, D and N advance, others don't."""
    step = lambda a, c: F.struct(
        F.when(c["op"].isin(0, 2, 3), a["at"] + c["len"]).otherwise(a["at"]).alias("at"),
        F.when(c["op"] == 0, F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + c["len"] - 1).alias("stop"))))).otherwise(a["out"]).alias("out"),
    )
    zero = F.struct(F.col("pos").cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("out"))
    blocks = F.aggregate("cigar", zero, step, lambda a: a["out"])
    return df.withColumn("_b", F.explode(blocks)).withColumn("start", F.col("_b.start")).withColumn("stop", F.col("_b.stop")).drop("_b")


def junctions(df: DataFrame, flank: int = MIN_FLANK, intron: int = MIN_INTRON) -> DataFrame:
    """Reads with exactly one intron inside long enough flanks, no insertion or deletion: start and stop of the intron."""
    op = lambda k: F.try_element_at("cigar", F.lit(k))["op"]
    size = lambda k: F.try_element_at("cigar", F.lit(k))["len"].cast("long")
    core = df.withColumn("cigar", F.filter("cigar", lambda c: ~c["op"].isin(4, 5)))
    ok = core.where(F.size("cigar") == 3).where((op(1) == 0) & (op(2) == 3) & (op(3) == 0) & (size(1) >= flank) & (size(3) >= flank) & (size(2) >= intron))
    begin = F.col("pos") + size(1)
    return ok.withColumn("start", begin).withColumn("stop", begin + size(2) - 1)


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shannon entropy (bits) of ``value`` within each group, and the group's count."""
    n = spread(df.select(*keys, value), *keys).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    p = n.withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy(*keys)))
    return p.groupBy(*keys).agg(F.sum("_n").alias("cnt"), F.greatest(F.lit(0.0), -F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))


def pair_posteriors(df: DataFrame) -> DataFrame:
    """All pairs of mates of a name on one strand, weighted by the product of weights over the name's sum."""
    a = df.where("mate % 2 = 1").select("qname", "strand", F.col("start").alias("start1"), F.col("stop").alias("stop1"), F.col("weight").alias("w1"))
    b = df.where("mate % 2 = 0").select("qname", "strand", F.col("start").alias("start2"), F.col("stop").alias("stop2"), F.col("weight").alias("w2"))
    both = a.join(b, ["qname", "strand"])
    both = both.withColumn("total", F.sum(F.col("w1") * F.col("w2")).over(Window.partitionBy("qname")))
    return both.withColumn("posterior", F.col("w1") * F.col("w2") / F.col("total"))


def fragment_length(s1: str = "start1", e1: str = "stop1", s2: str = "start2", e2: str = "stop2") -> Column:
    return F.greatest(s1, e1, s2, e2) - F.least(s1, e1, s2, e2) + 1


def noise_ratios(jn: DataFrame) -> DataFrame:
    """Largest counts that share a junction's start and stop, and the count on the other strand."""
    other = jn.select("contig", "start", "stop", F.when(F.col("strand") == "+", "-").otherwise("+").alias("strand"), F.col("cnt").alias("anti"))
    ends = lambda c: F.max("cnt").over(Window.partitionBy("contig", "strand", c))
    return jn.withColumn("max_start", ends("start")).withColumn("max_stop", ends("stop")).join(other, ["contig", "strand", "start", "stop"], "left")


def drop_noise(jn: DataFrame, fraction: float = 0.01, max_intron: int = MAX_INTRON) -> DataFrame:
    """Keep junctions whose share among those of a start (and of a stop) isn't clearly under ``fraction``, and above the other strand."""
    import pandas as pd
    from pyspark.sql.pandas.functions import PandasUDFType

    from spanloom.functions.stats import beta_ppf

    def quantile(c, m):
        return pd.Series(beta_ppf(0.01, c.to_numpy(float) + 1, m.to_numpy(float) + 1))

    low = F.pandas_udf(quantile, "double", PandasUDFType.SCALAR)
    r = noise_ratios(jn).where((F.coalesce("anti", F.lit(0)) < F.col("cnt")) & (F.col("stop") - F.col("start") + 1 <= max_intron))
    return r.where((low("cnt", "max_start") >= fraction) & (low("cnt", "max_stop") >= fraction))
