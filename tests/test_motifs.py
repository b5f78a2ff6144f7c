import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import motifs

MATRIX = [[3, -1, 0, 1], [0, 2, -2, 1, -9], [1, 1, 4, -3]]


def _seqs():
    rng = random.Random(4)
    out = {i: "".join(rng.choice("ACGTacgtN") for _ in range(n)) for i, n in enumerate([1, 2, 3, 4, 15, 16, 17, 31, 32, 33, 200])}
    return out | {20: "", 21: None, 22: "ACG" * 40, 23: "ACé𝄞GACG"}


def _score(window, matrix):
    rows = [r if len(r) > 4 else [*r, min(r)] for r in matrix]
    return sum(r["ACGT".find(b.upper()) if b.upper() in "ACGT" else 4] for r, b in zip(rows, window))


def test_hits_across_chunk_borders_equal_brute_force(spark):
    seqs = _seqs()
    df = spark.createDataFrame(list(seqs.items()), "id long, seq string")
    flip = str.maketrans("ACGTacgt", "TGCAtgca")
    want = []
    for k, s in seqs.items():
        for i in range(len(s or "") - len(MATRIX) + 1):
            w = s[i : i + len(MATRIX)]
            want += [(k, i, sign, x) for sign, x in (("+", _score(w, MATRIX)), ("-", _score(w.translate(flip)[::-1], MATRIX))) if x >= 5]
    assert want
    for width in (3, 16, 1000):
        got = [tuple(r) for r in motifs.scan(df, "id", MATRIX, 5, both=True, width=width).collect()]
        assert sorted(got) == sorted(want), width
    plus = [tuple(r) for r in motifs.scan(df, "id", MATRIX, 5).collect()]
    assert sorted(plus) == sorted(w for w in want if w[2] == "+")


def test_a_very_long_sequence(spark):
    df = spark.range(1).select("id", F.expr("concat(repeat('T', 2999990), 'ACG', repeat('T', 7), repeat('ACG', 2))").alias("seq"))
    got = [(r.start, r.score) for r in motifs.scan(df, "id", MATRIX, 9).collect()]
    assert sorted(got) == [(2999990, 9.0), (3000000, 9.0), (3000003, 9.0)]


def test_region_fetch(spark):
    seqs = {k: s for k, s in _seqs().items() if k < 20}
    df = spark.createDataFrame(list(seqs.items()), "id long, seq string")
    rng = random.Random(6)
    regions = [(k, a, a + rng.randrange(0, 50)) for k in seqs for a in (-4, 0, 7, 16, 40, 190)] + [(0, 5, 4), (99, 1, 2), (10, 3, 9), (10, 3, 9)]
    asked = spark.createDataFrame(regions, "id long, start long, stop long")
    for width, halo in ((8, 3), (16, 16), (4096, 0)):
        got = sorted(tuple(r) for r in motifs.fetch(motifs.chunked(df, "id", halo, width), asked, "id", width).collect())
        assert got == sorted((k, a, b, seqs.get(k, "")[max(a, 0) : max(b + 1, 0)]) for k, a, b in regions)


def test_bounds_of_parameters(spark):
    df = spark.createDataFrame([], "id long, seq string")
    assert motifs.scan(df, "id", MATRIX, 0).count() == 0
    with pytest.raises(ValueError):
        motifs.chunked(df, "id", 5, 4)
    with pytest.raises(ValueError):
        motifs.scan(df, "id", [], 0)


def test_hits_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(motifs, "HITS", 5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        df = spark.createDataFrame([(1, "AC" * 40), (2, "GGGG"), (3, None), (4, "CA" * 7)], "id long, seq string").coalesce(1)
        got = motifs.scan(df, "id", [[1, 0, 0, 0], [0, 1, 0, 0]], 2, both=True, width=16)
        assert sorted((r.id, r.start, r.strand) for r in got.collect()) == sorted([(1, k, "+") for k in range(0, 80, 2)] + [(4, k, "+") for k in range(1, 13, 2)])
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000  # so few chunks are in a task at once
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
