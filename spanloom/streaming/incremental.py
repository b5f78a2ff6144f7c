"""Incremental coverage and sessions over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_islands(events: DataFrame, keys: list[str], ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Gap merge in time: batch or streaming (watermarked) sessions."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.session_window(ts, gap)
    return src.groupBy(*keys, w).agg(F.count(F.lit(1)).alias("members"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("session_window")


def coverage_steps(reads: DataFrame) -> DataFrame:
    """Streaming part of coverage: sums of +1 and -1 for each place; a reader prefix-sums them."""
    step = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("stop") + 1).alias("pos"), F.lit(-1).alias("d"))))
    return reads.select("contig", "strand", step.alias("s")).groupBy("contig", "strand", F.col("s.pos").alias("pos")).agg(F.sum("s.d").alias("d"))
