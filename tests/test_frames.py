"""Reading frames are found where the sequences are: no sequence is shuffled, and no frame crosses into the next sequence."""

import random

from spanloom.functions import seq
from spanloom.operators import coordinates as C
from spanloom.plans import structure


def test_frames_of_many_sequences(spark, monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choices("ACGTNé日", [30, 30, 30, 30, 1, 1, 1], k=r.randint(0, 400))) for _ in range(60)] + [None, "", "AT", "G" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, dna string")
    want = sorted((k, *x) for k, t in enumerate(texts) for x in seq.orfs(t or "", 2))
    assert want
    for size in (1, 1000, 1 << 22):
        monkeypatch.setattr(C, "BASES", size)
        assert sorted(map(tuple, C.reading_frames(df, "id", "dna", 2).collect())) == want


def test_texts_are_read_once_and_not_joined(spark):
    plan = structure.orf_annotate(spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and text.count("Relation") == 1
