"""compare_elements makes the elements of both sides in one aggregate and reads them from there."""

import random

from spanloom.operators import annotations as A

SCHEMA = "transcript int, contig int, strand string, exons array<struct<start:long,stop:long>>"


def _transcripts(spark, seed):
    r, out = random.Random(seed), []
    for k in range(80):
        at, exons = r.choice([0, 5, 100]), []
        for _ in range(r.randint(1, 4)):
            exons.append((at, at + r.choice([9, 12, 30])))
            at = exons[-1][1] + r.choice([20, 25])
        out.append((k, r.randint(1, 2), r.choice("+-"), exons))
    return spark.createDataFrame(out, SCHEMA)


def test_elements_have_their_sides(spark):
    a, b = _transcripts(spark, 1), _transcripts(spark, 2)
    both = A.elements(a, b)
    keys = ["class", "contig", "strand", "inner", "outer"]
    alone = lambda df: {tuple(x) for x in A.elements(df, df.limit(0)).select(*keys).collect()}
    rows = both.collect()
    assert len(rows) == len({tuple(r[k] for k in keys) for r in rows})
    assert {tuple(r[k] for k in keys) for r in rows if r.ref} == alone(a) and {tuple(r[k] for k in keys) for r in rows if r.new} == alone(b)


def test_elements_are_compared_without_a_join_of_them(spark):
    plan = A.compare_elements(_transcripts(spark, 1), _transcripts(spark, 2), 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "exons" not in plan and "LeftSemi" not in plan
