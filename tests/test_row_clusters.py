"""Rows are clustered without joins beside the one that scales their columns."""

from spanloom.operators import ends


def test_clusters_make_no_joins(spark):
    cells = [("g", t, f"b{b}", float(1 + t * (b % 2)), 3) for b in range(6) for t in range(2)] + [("h", 0, "b9", 1.0, 4)]
    df = spark.createDataFrame(cells, "gene string, transcript int, bin string, expected double, observed long")
    out = ends.cluster_rows(df)
    joins = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(out) == joins(ends.scaled(df)) == 1
    got = sorted((r.gene, r.bin, r.transcript, round(r.expected, 6), r.observed, r.rows) for r in out.collect())
    assert got == [("g", "b0", 0, 0.5, 9, 3), ("g", "b0", 1, round(1 / 3, 6), 9, 3), ("g", "b1", 0, 0.5, 9, 3), ("g", "b1", 1, round(2 / 3, 6), 9, 3), ("h", "b9", 0, 1.0, 4, 1)]
