"""Walks over a gene's graph: one pass, however long its paths are."""

from spanloom.operators import splice


def tables(spark, edges, starts, ends):
    node = lambda xs: spark.createDataFrame([(1, x) for x in xs], "gene long, node string")
    return spark.createDataFrame([(1, a, b) for a, b in edges], "gene long, src string, dst string"), node(starts), node(ends)


def test_a_path_may_be_of_any_length(spark):
    n = 4000
    chain = tables(spark, [(str(k), str(k + 1)) for k in range(n)], ["0"], [str(n)])
    counts = splice.path_counts(*chain).collect()
    assert len(counts) == n + 1 and all(int(r.before) == int(r.after) == 1 for r in counts)
    paths, over = splice.candidate_paths(*chain)
    assert [r.path for r in paths.collect()] == [[str(k) for k in range(n + 1)]] and not over.count()
