"""Best-fit packing of token sequences: bound-certified repacking.

A document is its ids and an end id.  A document longer than the capacity is cut
into full pieces behind a shorter first one; full pieces fill a sequence each.
The other pieces are dealt into partitions of about ``PARTITION_ROWS`` pieces and
packed there by best-fit decreasing.  Dual-feasible functions give a lower bound
of each partition's sequences; a partition that reaches it is certified optimal.
Partitions with a gap give the documents of their open sequences into a common
pool, which is dealt again and packed again, until no partition has a gap, the
pool fits one partition, or a round saves nothing.

Defined cases: null is the empty text (one sequence piece with the end id); ids
that repeat are separate documents; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import encoder
from ._common import bound_batches, cut, quoted

CAPACITY = 1024
PARTITION_ROWS = 65_536
ROUNDS = 6


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the fill of each bin.

    A bit for each residual size tells whether an open bin has it, so the
    tightest bin that fits is the lowest set bit from the length on.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            k, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = k, fill[k]
        fill[k] += n
        if room > n:
            by_room[room - n].append(k)
            mask |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound among two families of dual-feasible functions.

    Thresholds: lengths over capacity - t count as a whole bin, those under t as
    nothing, others as they are.  Steps: x counts floor((k + 1) x) / k unless
    (k + 1) x is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * sizes)
    t = np.arange(0, capacity // 2 + 1)
    middle = total[capacity - t] - np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    best = int(np.max(-(-((n[-1] - n[capacity - t]) * capacity + middle) // capacity)))
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # in units of 1 / (k capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """_uid, _id, _n (ids with the end id) and crc32 of each piece (and the ids)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(vocabulary), TaskContext.get().partitionId() << 40
        end = np.array([end_id], np.uint32)
        for b in it:
            n, crcs, raw = [], [], []
            for lo, hi, ids, offsets in enc.encode(b.column(1)):
                for k in range(hi - lo):
                    own = np.concatenate([ids[offsets[k] : offsets[k + 1]], end])
                    cuts = [0, *range((len(own) - 1) % capacity + 1, len(own) + 1, capacity)]
                    data = memoryview(own.astype("<u4")).cast("B")
                    n.append(len(own))
                    crcs.append([zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(cuts, cuts[1:])])
                    if with_ids:
                        raw.append(bytes(data))
            arrays = [pa.array(np.arange(uid, uid + len(n))), b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            uid += len(n)
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(raw, pa.binary())] if with_ids else []), names=["_uid", "_id", "_n", "_crcs"] + ["_ids"] * with_ids)

    bound_batches(docs.sparkSession)
    src = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    return src.mapInArrow(run, f"_uid long, _id {src.dtypes[0][1]}, _n long, _crcs array<long>" + ", _ids binary" * with_ids)


_PLACED = "_uid long, _len long, _part long, _bin long, _off long, _open boolean, _gap long"


def _packed(items: DataFrame, parts: int, capacity: int, seed: int) -> DataFrame:
    def pack(t: pa.Table) -> pa.Table:
        # by id, so that a task which runs again gives the same bins
        t = t.sort_by("_uid")
        lengths = t.column("_len").to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        return pa.table({
            "_uid": t.column("_uid"), "_len": t.column("_len"), "_part": t.column("_part"), "_bin": bins, "_off": offsets,
            "_open": (fill < capacity)[bins] & (gap > 0), "_gap": np.full(len(bins), gap, np.int64),
        })

    dealt = items.withColumn("_part", F.pmod(F.xxhash64("_uid", F.lit(seed)), F.lit(parts)))
    return cut(dealt.groupBy("_part").applyInArrow(pack, _PLACED))


def placements(items: DataFrame, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(_uid, _len) -> _uid, _seq, _off: see the module."""
    final, pool = None, items
    n_pool, before = pool.count(), None
    for turn in range(ROUNDS):
        parts = max(1, -(-n_pool // partition_rows))
        placed = _packed(pool, parts, capacity, turn)
        seq = (F.lit(turn) * F.lit(1 << 38) + F.col("_part")) * F.lit(1 << 20) + F.col("_bin")
        named = placed.withColumn("_seq", seq)
        n_open, open_bins = placed.where("_open").agg(F.count(F.lit(1)), F.count_distinct("_part", "_bin")).first()
        stop = parts == 1 or not n_open or turn == ROUNDS - 1 or (before is not None and open_bins >= before)
        done = named if stop else named.where("not _open")
        done = done.select("_uid", "_seq", "_off")
        final = done if final is None else final.unionByName(done)
        if stop:
            break
        pool, n_pool, before = placed.where("_open").select("_uid", "_len"), n_open, open_bins
    return final


def packed(docs: DataFrame, vocabulary: str, *, end_id: int = 2, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (and its ids)."""
    tokens = cut(tokenised(docs, vocabulary, end_id, capacity, id_col, text_col, with_ids))
    tokens = tokens.withColumn("_len", (F.col("_n") - 1) % capacity + 1)
    part = tokens.where(F.col("_len") < capacity).select("_uid", "_len")
    rows = tokens.join(placements(part, capacity, partition_rows), "_uid", "left")
    rows = rows.select("*", F.posexplode("_crcs").alias("_piece", "_crc"))
    first = F.col("_piece") == 0
    start = F.when(first, 0).otherwise(F.col("_len") + (F.col("_piece") - 1) * capacity).cast("long")
    length = F.when(first, F.col("_len")).otherwise(F.lit(capacity)).cast("long")
    whole = -F.monotonically_increasing_id() - 1
    out = [
        F.col("_id").alias(id_col), F.col("_piece").cast("int").alias("piece"), start.alias("start"), length.alias("length"), F.col("_crc").alias("ids_crc32"),
        F.when(first & F.col("_seq").isNotNull(), F.col("_seq")).otherwise(whole).alias("sequence_id"),
        F.when(first, F.coalesce("_off", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("offset"),
    ]
    if with_ids:
        out.append(F.substring(F.col("_ids"), (4 * start + 1).cast("int"), (4 * length).cast("int")).alias("ids"))
    return rows.select(*out)
