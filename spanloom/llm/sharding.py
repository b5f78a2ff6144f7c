"""Sharding: two-pass external shuffle with DataFrame functions only.

Pass 1 scatters every row into one of ``ceil(bytes / bucket_bytes)`` buckets by
a seeded hash of its place in the input, so buckets are uniform whatever keys or
copies the rows hold.  Pass 2 gathers a bucket (bounded by ``bucket_bytes`` on
average; there are as many tasks as buckets, so that none holds many), puts it in
the order of the input places, so that a second run gives the same, permutes it by
a seeded Fisher-Yates shuffle (Spark's ``shuffle``) and writes it.  Counts are read from the written buckets only, so a
task that runs again after a lost executor can't disagree with them.

A row's global place is its bucket's offset plus its place in the bucket; shard
= place modulo shards and slot = place div shards (law ``rows``: shard counts
differ by one at most and slots have no gaps).

Defined cases: a null text has no bytes (size 1) and the crc32 of nothing (0);
repeated rows and null ids are rows like others; an empty table gives an empty
result; extra columns are carried into the written buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh_path, quoted, running_offsets

BUCKET_BYTES = 16 << 20
BROADCAST_BUCKETS = 65_536


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shuffled_buckets(docs: DataFrame, text_col: str = "text", *, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Write the shuffled buckets; the written rows with _bucket and _pos, and the number of buckets."""
    spark = docs.sparkSession
    total = docs.select(F.sum(row_size(quoted(text_col)))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    path = fresh_path(spark, "shards")
    place = F.monotonically_increasing_id()
    scattered = docs.select(place.alias("_place"), F.struct(*[quoted(c) for c in docs.columns]).alias("_row"))
    scattered = scattered.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_place"), F.lit(buckets)))
    gathered = scattered.repartition(buckets, "_bucket").groupBy("_bucket").agg(F.collect_list(F.struct("_place", "_row")).alias("_rows"))
    ordered = F.array_sort("_rows", lambda a, b: F.when(a["_place"] < b["_place"], -1).otherwise(1))
    mixed = gathered.select("_bucket", F.posexplode(F.shuffle(ordered, F.lit(seed))).alias("_pos", "_one")).select("_bucket", "_pos", F.col("_one._row").alias("_row"))
    mixed.select("_bucket", F.col("_pos").cast("long").alias("_pos"), "_row").write.parquet(path)
    return spark.read.parquet(path), buckets


def sharded(docs: DataFrame, shards: int = 8, text_col: str = "text", **options) -> DataFrame:
    """Every row as ``_row`` with _shard and _slot, from the written buckets."""
    rows, buckets = shuffled_buckets(docs, text_col, **options)
    offsets = running_offsets(rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")), "_bucket", "_n", "_base")
    if buckets <= BROADCAST_BUCKETS:  # two longs each: a megabyte at most
        offsets = F.broadcast(offsets)
    place = F.col("_base") + F.col("_pos")
    return rows.join(offsets, "_bucket").select(
        "_row", (place % shards).cast("int").alias("_shard"), F.expr(f"(_base + _pos) div {int(shards)}").alias("_slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, text_col: str = "text", **options) -> None:
    """One folder ``shard=k`` for each shard, each row whole in ``_row``, with its slot."""
    out = sharded(docs, shards, text_col, **options).select("_row", F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))
    out.write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    text = F.col("_row").getField(text_col)
    return sharded(docs.select(quoted(id_col), quoted(text_col)), shards, text_col, **options).select(
        F.col("_row").getField(id_col).alias(id_col), row_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
