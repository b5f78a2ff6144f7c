"""Session helpers of the library."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: rows that one task of an aggregate gets
ROWS = 250_000


def checkpoint_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only for a local session without it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if sc.applicationId not in _OWN:
        if sc.master.startswith("local"):
            path = tempfile.mkdtemp(prefix="spanloom-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        else:
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_spanloom"
        _OWN[sc.applicationId] = path
        sc.setCheckpointDir(path)
    return _OWN[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table in the shared folder and read it again: cuts the lineage, and its size is known to the planner."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to as many tasks as their number asks for, before an aggregate by these keys.

    A task then holds the groups of about ``ROWS`` rows, however large the table; otherwise the tasks that read hold
    all groups of a whole split, and the next ones those of as many rows as fit in 64 MB compressed.  Counts the rows first.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return df.repartition(tasks, *keys)


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` for the session, so that long sequences don't fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
