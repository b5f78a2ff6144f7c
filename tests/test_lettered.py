"""Texts become bases in one pass over their bytes."""

from pyspark.sql import functions as F

from spanloom.operators import motifs

TEXTS = ["", None, "Abc xyz", "ÀÉ日本 k", "Kelvin İstanbul", "0123", "z" * 5000, None, "q\nr\ts"]


def test_bases_equal_the_expression(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    want = df.select("id", F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))
    for parts in (1, 4):
        assert sorted(map(tuple, motifs.lettered(df.repartition(parts), "id").collect())) == sorted(map(tuple, want.collect()))
