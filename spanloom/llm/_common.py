"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_GROUPS = 1000
_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is what ``spark.checkpoint.dir`` names.  Where that is unset, a local
    session gets a temporary folder and a cluster a folder in its warehouse.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    app = sc.applicationId
    if app not in _OWN_DIRS:
        if sc.master.startswith("local[") or sc.master == "local":
            path = tempfile.mkdtemp(prefix="spanloom-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        else:
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_spanloom"
        sc.setCheckpointDir(path)
        _OWN_DIRS[app] = path
    return _OWN_DIRS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; for light tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table in the shared folder and read it again.

    ``rows``, at most so many light rows, go to files of about 500,000; they are
    moved for it, so that an aggregate before them keeps all its tasks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df if rows is None else df.repartition(max(1, -(-rows // 500_000)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches, so that long texts don't fill a worker's memory; Spark bounds their bytes besides."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def rowed(docs: DataFrame) -> Column:
    """All columns in one struct ``_row``, so that their names clash with nothing."""
    return F.struct(*[quoted(c) for c in docs.columns]).alias("_row")


def unrowed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def attached(rows: DataFrame, key: str, light: DataFrame, light_key: str, n_light: int, most: int) -> DataFrame:
    """Left join with a light table of unique keys (strings or bytes).

    It is broadcast while it has at most ``most`` rows.  Beyond that only the rows
    of the ``HOT_GROUPS`` most frequent keys are broadcast; all others are joined by
    shuffle, so that no key with many rows meets in one task.
    """
    values = [c for c in light.columns if c != light_key]
    if n_light <= most:
        return rows.join(F.broadcast(light), F.col(key) == F.col(light_key), "left").drop(light_key)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_often")).orderBy(F.desc("_often"), key).limit(HOT_GROUPS).select(F.col(key).alias("_hk"))
    hot = light.join(F.broadcast(hot), F.col(light_key) == F.col("_hk"), "right").select("_hk", F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h{c}") for c in values])
    out = rows.join(F.broadcast(cut(hot)), F.col(key) == F.col("_hk"), "left")
    # rows that are served already get a key of their own: they spread, and what they match isn't read
    alone = F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string")).cast(dict(rows.dtypes)[key])
    out = out.withColumn("_jk", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(alone))
    out = out.join(light, F.col("_jk") == F.col(light_key), "left")
    return out.select(*[F.col(c) for c in rows.columns], *[F.when(F.col("_hot").isNull(), F.col(c)).otherwise(F.col(f"_h{c}")).alias(c) for c in values])


def once(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Leave ``flag`` true in one row only of those that agree in ``keys``; at most one row of each task meets the others."""
    one = F.row_number().over(Window.partitionBy(*keys, "_task").orderBy(F.lit(0)))
    out = rows.withColumn("_task", F.spark_partition_id()).withColumn("_nth", F.when(F.col(flag), one))
    out = out.withColumn("_apart", F.when(F.col("_nth") == 1, F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    two = F.row_number().over(Window.partitionBy(*keys, "_apart").orderBy("_task"))
    return out.withColumn(flag, F.col(flag) & (F.col("_nth") == 1) & (two == 1)).drop("_task", "_nth", "_apart")


def fold(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % n


def running_offsets(groups: DataFrame, key: str, size: str, out: str, width: int = 4096) -> DataFrame:
    """``key`` (long, unique, from 0) -> sum of ``size`` over all smaller keys.

    Two levels: sums of runs of ``width`` keys, then inside each run, so that no
    task sorts more than max(width, keys / width) rows.
    """
    run = F.expr(f"{key} div {width}")
    g = groups.select(key, size, run.alias("_run"))
    w = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = g.groupBy("_run").agg(F.sum(size).alias("_n"))
    runs = runs.select("_run", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return g.join(runs, "_run").select(key, (F.col("_base") + F.col("_in")).alias(out))
