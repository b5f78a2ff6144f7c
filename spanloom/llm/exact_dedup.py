"""Exact dedup: skew-safe combining with DataFrame functions only.

Texts are equal when identical after each run of ASCII white space became one
space; a null text counts as empty.  Three combining stages, each with the full
text beside its digest in the grouping key, so a digest collision never merges
two texts:

1. local: the partial aggregate of every input task keeps one row for each text;
2. salted: the task results of a digest meet in one of ``salts`` groups;
3. global: the winners of the salts meet, at most ``salts`` rows for each text.

What then goes back to the rows is a light table (digest, keep_id, group_size)
of the texts that occur more than once.  It is broadcast only while it has at
most ``broadcast_rows`` rows; beyond that the ``HOT_GROUPS`` largest groups are
broadcast (a fixed number of rows) and the others joined by shuffle, so that a
group that holds a third of all rows doesn't meet in one task.

Defined cases: null ids count as larger than any id; of rows that repeat both
the text and the smallest id exactly one is kept; an empty table gives an empty
result; extra columns are not read, or carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import attached, cut, once, quoted, rowed, unrowed

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def combine(rows: DataFrame, salts: int) -> DataFrame:
    """(_id, _norm, _digest) -> one row for each text."""
    salted = (
        rows.withColumn("_salt", F.spark_partition_id() % salts)
        .groupBy("_digest", "_salt", "_norm")
        .agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    )
    # one exchange by digest serves this grouping and the count of contents
    return salted.repartition("_digest").groupBy("_digest", "_norm").agg(
        F.min("_id").alias("_keep"), F.sum("_n").alias("_size")
    )


def marked(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    salts: int = 32,
    broadcast_rows: int = 100_000,
    digest: Callable[[Column], Column] = sha256_hex,
    carry: bool = False,
) -> DataFrame:
    """Every row with ``_id _digest _keep _size _kept``, and all its columns in ``_row`` where ``carry``."""
    rows = docs.select(quoted(id_col).alias("_id"), normalised(quoted(text_col)).alias("_norm"), *[rowed(docs)] * carry)
    rows = rows.withColumn("_digest", digest(F.col("_norm")))
    plain = rows.select("_id", "_norm", "_digest")
    light = combine(plain, salts).groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_texts"), F.min("_keep").alias("_keep"), F.max("_size").alias("_size")
    )
    many = cut(light.where("_size > 1 or _texts > 1"))
    n_many, n_clash = many.agg(F.count(F.lit(1)), F.count(F.when(F.col("_texts") > 1, 1))).first()
    repeated = not rows.groupBy("_id").count().where("count > 1").isEmpty()

    out, own = rows, None
    if n_clash:
        collided = many.where("_texts > 1").select("_digest")
        clash = combine(plain.join(collided, "_digest", "left_semi"), salts)
        own = rows.join(collided, "_digest", "left_semi").join(clash, ["_digest", "_norm"])
        out = rows.join(collided, "_digest", "left_anti")
    single = many.where("_texts = 1").select(F.col("_digest").alias("_d"), "_keep", "_size")
    out = attached(out.drop("_norm"), "_digest", single, "_d", n_many, broadcast_rows).withColumn("_norm", F.lit(""))
    out = out.withColumn("_keep", F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep")))
    out = out.withColumn("_size", F.coalesce("_size", F.lit(1)).cast("long"))
    if own is not None:
        out = out.unionByName(own.select(*out.columns))
    out = out.withColumn("_kept", F.col("_id").eqNullSafe(F.col("_keep")))
    if repeated:
        out = once(out, ["_digest", "_norm", "_id"], "_kept")
    return out.drop("_norm")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for every document: id, keep_id, group_size, kept, text_sha256."""
    return marked(docs, id_col, text_col, **options).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns."""
    return unrowed(marked(docs, id_col, text_col, carry=True, **options).where("_kept"), docs.columns)
