"""Graphs: connected components, DAG paths, exon graph edges, linkage clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import written


def components(edges: DataFrame, a: str = "src", b: str = "dst", rounds: int = 60) -> DataFrame:
    """node -> root, the smallest node of its component, for all nodes of edges.

    Large-star and small-star steps in turn on the edge table: every step links the
    neighbours of a node to the smallest of them, so paths shrink by half and more.
    Each round is written and read again, so that the planner knows its size; few
    edges go to few files.  Fails where ``rounds`` don't suffice.
    """
    def kept(df: DataFrame, n: int) -> DataFrame:
        return written(df.coalesce(max(1, n // 500_000)), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    ends = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    n = ends.count()
    e = kept(ends.where("u != v").distinct(), n)
    before = state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = kept(small.select("x.u", "x.v").where("u != v").distinct(), before[0])
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not merged in {rounds} rounds")
    alone = ends.where("u = v")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")))
    roots = roots.unionByName(alone.select(F.col("u").alias("node"), F.col("u").alias("root")))
    return kept(roots.groupBy("node").agg(F.min("root").alias("root")), max(n, before[0]))


def linkage_clusters(df: DataFrame, distance: int, keys: list[str], id_col: str = "id") -> DataFrame:
    """Single linkage under the larger of the start and stop differences: id -> cluster (smallest id).

    Points lie in square cells of side ``distance`` + 1, so all of one cell are linked: each
    gets one link, to the cell's smallest id.  Two cells that touch get at most one link
    too, if any two of their points are close enough.  Side by side only the outermost
    points matter; corner to corner a running least (or greatest) stop along starts finds
    a pair.  So links and work are in proportion to the points, however dense.
    """
    side = distance + 1
    points = written(df.select(*keys, F.col(id_col).alias("id"), "start", "stop", *[F.expr(f"({c} - pmod({c}, {side})) div {side}").alias(n) for c, n in (("start", "cx"), ("stop", "cy"))]), "points")
    cell = [*keys, "cx", "cy"]
    by = lambda f, c: f(F.struct(c, "id"))
    ends = written(points.groupBy(*cell).agg(F.min("id").alias("least"), *[by(f, c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("start", "stop")]), "cells")
    links = points.join(ends.select(*cell, "least"), cell).select(F.col("id").alias("src"), F.col("least").alias("dst"))
    for c, at in (("start", "cx"), ("stop", "cy")):
        there = ends.select(*[F.col(k) - 1 if k == at else F.col(k) for k in cell], F.col(f"lo_{c}").alias("_q")).toDF(*cell, "_q")
        pair = ends.select(*cell, F.col(f"hi_{c}").alias("_p")).join(there, cell).where(F.col("_q")[c] - F.col("_p")[c] <= distance)
        links = links.unionByName(pair.select(F.col("_p.id").alias("src"), F.col("_q.id").alias("dst")))
    for up, best in ((1, F.min), (-1, F.max)):
        # cells at the next corner, by the place of the cell that asks
        here = points.select(*cell, (F.col("start") + distance).alias("_at"), F.lit(1).alias("_asks"), "id", "stop", F.lit(None).cast(_struct(points)).alias("_q"))
        there = points.select(*keys, (F.col("cx") - 1).alias("cx"), (F.col("cy") - up).alias("cy"), F.col("start").alias("_at"), F.lit(0).alias("_asks"), "id", "stop", F.struct("stop", "id").alias("_q"))
        w = Window.partitionBy(*cell).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
        seen = here.unionByName(there).withColumn("_best", best("_q").over(w)).where("_asks = 1")
        close = seen.where((F.col("_best.stop") - F.col("stop")) * up <= distance)
        one = close.groupBy(*cell).agg(F.min(F.struct("id", F.col("_best.id").alias("other"))).alias("x"))
        links = links.unionByName(one.select(F.col("x.id").alias("src"), F.col("x.other").alias("dst")))
    return components(links).select(F.col("node").alias(id_col), F.col("root").alias("cluster"))


def _struct(points: DataFrame):
    return points.select(F.struct("stop", "id").alias("x")).schema["x"].dataType


def dag_paths(spark, edges: DataFrame, starts: DataFrame, ends: DataFrame, max_level: int = 100) -> DataFrame:
    """All paths from starts; a path ends at its first end node.  Acyclic graphs only."""
    return spark.sql(
        f"""
        WITH RECURSIVE step(node, path, hops) MAX RECURSION LEVEL {max_level} AS (
          SELECT node, cast(node AS string), 0 FROM {{starts}}
          UNION ALL
          SELECT e.dst, concat(s.path, '-', e.dst), s.hops + 1
          FROM step s JOIN {{edges}} e ON s.node = e.src
          WHERE s.node NOT IN (SELECT node FROM {{ends}})
        )
        SELECT path, hops FROM step WHERE node IN (SELECT node FROM {{ends}})
        """,
        edges=edges, starts=starts, ends=ends,
    )


def exon_edges(exons: DataFrame, introns: DataFrame) -> DataFrame:
    """Exons joined by an intron: one ends just before it, the other starts just behind."""
    left = exons.select("contig", "strand", F.col("start").alias("l_start"), F.col("stop").alias("l_stop"))
    right = exons.select("contig", "strand", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    jn = introns.select("contig", "strand", (F.col("start") - 1).alias("l_stop"), (F.col("stop") + 1).alias("r_start"), "cnt")
    return left.join(jn, ["contig", "strand", "l_stop"]).join(right, ["contig", "strand", "r_start"])


def running_least(rows: DataFrame, keys: list[str], opens: Column, closes: Column, of_first: list[str], of_last: list[str]) -> DataFrame:
    """Runs of consecutive ``nth`` from a row that opens to one that closes, with the least ``value`` of each.

    Rows of an island without a gap in nth get the least of their next 1, 2, 4, ...
    rows, each from the one before, so the least of a run is that of two overlapping
    stretches: the work is in proportion to rows x log(island) and runs.  Result: keys,
    first, last, least, and the named columns as first_... and last_...
    """
    w = Window.partitionBy(*keys).orderBy("nth")
    rows = written(rows.withColumn("island", F.col("nth") - F.row_number().over(w)), "islands")
    longest = rows.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    along = Window.partitionBy(*keys, "island").orderBy("nth")
    # _k holds the least of 2 ** k rows from here on; shorter ones at an island's end aren't asked for
    steps = rows.withColumn("_0", F.col("value"))
    levels = max(0, int(longest - 1).bit_length() - 1) + 1
    for k in range(1, levels):
        steps = steps.withColumn(f"_{k}", F.least(f"_{k - 1}", F.lead(f"_{k - 1}", 1 << (k - 1)).over(along)))
    steps = written(steps.select(*keys, "island", "nth", F.array(*[f"_{k}" for k in range(levels)]).alias("_least"), opens.alias("_opens"), closes.alias("_closes"), *sorted({*of_first, *of_last})), "least")
    first = steps.where("_opens").select(*keys, "island", F.col("nth").alias("first"), F.col("_least").alias("_from"), *[F.col(c).alias(f"first_{c}") for c in of_first])
    last = steps.where("_closes").select(*keys, "island", F.col("nth").alias("last"), *[F.col(c).alias(f"last_{c}") for c in of_last])
    runs = first.join(last, [*keys, "island"]).where("last >= first")
    runs = runs.withColumn("_k", F.floor(F.log2(F.col("last") - F.col("first") + 1) + 1e-9).cast("int"))
    # the second stretch begins 2 ** k rows before the end
    runs = runs.withColumn("_second", F.col("last") + 1 - F.expr("cast(shiftleft(1, _k) as long)"))
    second = steps.select(*keys, F.col("nth").alias("_second"), F.col("_least").alias("_to"))
    runs = runs.join(second, [*keys, "_second"])
    least = F.least(F.element_at("_from", F.col("_k") + 1), F.element_at("_to", F.col("_k") + 1))
    return runs.select(*keys, "first", "last", least.alias("least"), *[f"first_{c}" for c in of_first], *[f"last_{c}" for c in of_last])


def exon_runs(segments: DataFrame, floor: float, keys: list[str]) -> DataFrame:
    """From each segment that opens, the runs that stay at ``floor`` or more up to a segment that closes.

    segments: keys, nth, value, opens, closes; only a segment under the floor or a gap in nth ends a run.
    A null value ends no run and counts for nothing; a run of nulls alone isn't one.
    """
    high = segments.where(F.coalesce(F.col("value") >= floor, F.lit(True))).select(*keys, "nth", "value", "opens", "closes")
    return running_least(high, keys, F.col("opens"), F.col("closes"), [], []).where(F.col("least") >= floor)
