"""Exact top-k by inner product: columnar branch and bound.

Vectors are scaled to integers and dealt into candidate parts of about
``PART_ROWS`` rows and query parts of about ``QUERY_ROWS``.  The first candidate part
meets all queries and gives each one the score of its k-th best row: a bound for
the whole table.  Every query part, with its bounds, then meets every other
candidate part once, as a block.  Inside a block the candidates lie vertically
(one row of numbers for each dimension).  For a query the inner product is
accumulated dimension block by dimension block; after each block the remaining
mass of both sides bounds what is still to come (Cauchy-Schwarz), and candidates
that can't reach the bound are compacted away.  Ties at the bound always survive.
A part sends k rows at most for each query, which are merged.  Components travel
in the narrowest integers that hold them all.

Arithmetic is exact: 32-bit floats while all sums stay under 2**24, 64-bit under
2**53, else Python integers.

Defined cases: vectors that are null, or hold null or non-finite components, take
no part; only vectors of the same length are compared; a null id takes no part; a
component or a score of over 64 bits can't be a long and fails the query with a
message that names the vector, and never wraps;
rows that repeat an id are separate candidates, but a query never gets a row of
its own id; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, quoted

PART_ROWS = 16_384
QUERY_ROWS = 8192
BLOCK_DIMS = 8

_FOUND = "query_id long, vec_id long, score long"


def best_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, row ids and scores of each query's k best rows, ties to smaller ids.

    ``least``: scores that each query has k of already; rows under it may be missing.
    """
    dims = rows.shape[1]
    biggest = max(int(np.abs(rows).max(initial=0)), int(np.abs(queries).max(initial=0)))
    reach = biggest * biggest * max(dims, 1)
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else object
    # most mass first: where the first bound is taken from
    mass = (rows.astype(np.float64) ** 2).sum(1)
    order = np.lexsort((ids, -mass))
    rows, ids = rows[order], ids[order]
    columns = np.ascontiguousarray(rows.T).astype(kind)
    # dimensions of most energy first, so that little mass remains soon
    dim_order = np.argsort(-(rows.astype(np.float64) ** 2).sum(0), kind="stable")
    columns, q_all = columns[dim_order], queries[:, dim_order]
    cuts = [*range(0, dims, BLOCK_DIMS), dims]

    def rest(m: np.ndarray) -> list[np.ndarray]:
        """Norms of what follows each block, a little enlarged so that rounding never prunes."""
        sq = m.astype(np.float64) ** 2
        return [np.sqrt(sq[:, c:].sum(1)) * (1 + 1e-9) for c in cuts[1:]]

    row_rest, query_rest = rest(rows[:, dim_order]), rest(q_all)
    first, out = min(len(ids), 8 * k), ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    for n in range(len(q_all)):
        q = q_all[n].astype(kind)
        own = ids != query_ids[n]
        head = np.flatnonzero(own[:first])
        bound = -np.inf if least is None else float(least[n])
        if len(head) >= k:
            full = (q @ columns[:, head]).astype(np.float64)
            bound = max(bound, np.partition(full, len(full) - k)[len(full) - k])
        alive = np.flatnonzero(own)
        total = np.zeros(len(alive), kind)
        for b in range(len(cuts) - 1):
            part = columns[cuts[b] : cuts[b + 1]]
            total = total + q[cuts[b] : cuts[b + 1]] @ (part if len(alive) == part.shape[1] else part[:, alive])
            reachable = total.astype(np.float64) + row_rest[b][alive] * query_rest[b][n] + 1e-6 * (1 + abs(bound) if np.isfinite(bound) else 1)
            stay = reachable >= bound
            if not stay.all():
                alive, total = alive[stay], total[stay]
        score = np.array([int(x) for x in total], object) if kind is object else total.astype(np.int64)
        if len(score) > k:
            value = score.astype(np.float64) if kind is object else score
            keep = value >= np.partition(value, len(value) - k)[len(value) - k]
            alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score.astype(np.float64) if kind is object else -score))
        best = sorted(best.tolist(), key=lambda i: (-int(score[i]), int(ids[alive[i]]))) if kind is object else best
        best = best[:k]
        if kind is object:
            for i in best:
                if not -(1 << 63) <= int(score[i]) < 1 << 63:
                    raise ValueError(f"the score of query {int(query_ids[n])} and vector {int(ids[alive[i]])} is over 64 bits: {int(score[i])}")
        out[0].append(np.full(len(best), query_ids[n], np.int64))
        out[1].append(ids[alive[best]].astype(np.int64))
        out[2].append(np.array([int(score[i]) for i in best], np.int64) if kind is object else score[best])
    return tuple(np.concatenate(x) for x in out)


def top_k(vectors: DataFrame, k: int = 20, *, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", part_rows: int = PART_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each row whose id is divisible by ``every``: query_id, rank, vec_id, score of its k best other rows."""
    source, vec_id = quoted(vector_col), quoted(id_col).cast("long")
    wide = F.raise_error(F.concat(F.lit("vector "), vec_id.cast("string"), F.lit(": a scaled component is over 64 bits"))).cast("long")
    v = F.transform(source, lambda x: F.when(F.abs(x.cast("double") * scale) < float(1 << 63), F.floor(x.cast("double") * scale).cast("long")).otherwise(wide))
    finite = F.forall(source, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(vec_id.alias("_id"), F.when(finite, v).alias("_v")).where("_id is not null and _v is not null")
    n, n_query, high, low = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("_id") % every == 0, 1)), F.max(F.array_max("_v")), F.min(F.array_min("_v"))).first()
    kind = next(t for bits, t in ((15, "smallint"), (31, "int"), (63, "bigint")) if -(1 << bits) <= (low or 0) and (high or 0) < 1 << bits)
    rows = rows.withColumn("_v", F.col("_v").cast(f"array<{kind}>")).withColumn("_d", F.size("_v"))
    parts, query_parts = max(1, -(-n // part_rows)), max(1, -(-n_query // query_rows))
    spread = F.xxhash64(F.lit(3), "_id", "_v")
    every_query = F.sequence(F.lit(0), F.lit(query_parts - 1))
    key = ["_d", "_part", "_qpart"]
    candidates = rows.select("_d", F.pmod(spread, F.lit(parts)).cast("int").alias("_part"), F.explode(every_query).alias("_qpart"), "_id", "_v")
    queries = rows.where(F.col("_id") % every == 0).withColumn("_qpart", F.pmod(spread, F.lit(query_parts)).cast("int"))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("_id").to_numpy()
        flat = t.column("_v").combine_chunks().flatten().to_numpy() if len(t) else np.zeros(0, np.int64)
        return ids, flat.astype(np.int64).reshape(len(ids), -1)

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if len(q) and len(c):
            qi, qm = matrix(q)
            ci, cm = matrix(c)
            least = q.column("_least").to_pandas().to_numpy(float, na_value=-np.inf) if "_least" in q.column_names else None
            found = best_of(qm, qi, cm, ci, k, least)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    def met(q: DataFrame, c: DataFrame) -> DataFrame:
        q = q.select(*[F.col(c).alias(c) for c in q.columns])  # names of its own: both sides come from one table
        return q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(meet, _FOUND)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = met(queries.withColumn("_part", F.lit(0)), candidates.where("_part = 0"))
    if parts > 1:
        found = cut(found)
        # a double may be above its long: one less in 2**52 is surely under it
        kth = F.col("score").cast("double") - F.abs(F.col("score")).cast("double") * 2.0**-52 - 1
        bounds = found.withColumn("_r", rank).where(F.col("_r") == k).select("query_id", kth.alias("_least"))
        bound = queries.join(bounds, F.col("_id") == F.col("query_id"), "left").drop("query_id")
        bound = bound.withColumn("_part", F.explode(F.sequence(F.lit(1), F.lit(parts - 1))))
        found = found.unionByName(met(bound, candidates.where("_part > 0")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
