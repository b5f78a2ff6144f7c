"""Comparison and merging of annotations against plain loops, and the four-contig fixture."""

import random
from collections import defaultdict

import pytest

from spanloom.operators import annotations as A
from spanloom.operators import graph

SCHEMA = "transcript string, contig string, strand string, exons array<struct<start:long,stop:long>>"


def make(spark, rows):
    return spark.createDataFrame([(t, c, s, [{"start": a, "stop": b} for a, b in e]) for t, c, s, e in rows], SCHEMA)


FIVE = [(1, 11), (21, 31), (41, 51), (61, 71), (81, 91)]


def test_four_contigs(spark):
    new = make(spark, [(f"n{k}", f"c{k}", "+", FIVE) for k in range(1, 5)])
    ref = make(spark, [("r1", "c1", "+", FIVE), ("r2", "c2", "+", FIVE[:4]), ("r3", "c3", "+", FIVE[1:]), ("r4", "c4", "+", FIVE[1:4])])
    got = {r["class"]: (r.n_ref, r.n_new, r.matched) for r in A.compare_elements(ref, new).collect()}
    # c2's last exon begins where a novel internal one does, so no end exon of it is found; the same on c3's other side
    assert got == {"Internal Exon": (8, 12, 8), "Intron": (12, 16, 12), "TSS Exon": (4, 4, 2), "TES Exon": (4, 4, 2), "Exon": (16, 20, 12)}
    (row,) = A.compare_transcripts(ref, new).collect()
    assert (row.n_ref, row.n_new, row.matched_ref, row.matched_new) == (4, 4, 1, 1) and row.recall == 0.25
    assert {r.transcript: (r["class"], r.match) for r in A.match_classes(ref, new, partial=True).collect()} == {"r1": ("=", "n1"), "r2": ("c", "n2"), "r3": ("c", "n3"), "r4": ("c", "n4")}
    empty = make(spark, [])
    assert A.match_classes(empty, new, partial=True).collect() == [] and {r["class"] for r in A.match_classes(new, empty, partial=True).collect()} == {"u"}
    assert {r.matched for r in A.compare_elements(ref, empty).collect()} == {0}


def random_transcripts(rng, n, name):
    out = []
    for k in range(n):
        exons, at = [], rng.choice([-15, 0, 3, 20])
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            size = rng.choice([5, 9])
            exons.append((at, at + size))
            at += size + rng.choice([4, 8])
        out.append((f"{name}{k:03}", rng.choice("xy"), rng.choice("+-"), exons))
    return out


def introns(e):
    return tuple((a[1] + 1, b[0] - 1) for a, b in zip(e, e[1:]))


def test_classes_elements_and_best_references(spark):
    rng = random.Random(12)
    ref, new = random_transcripts(rng, 60, "r"), random_transcripts(rng, 60, "n")
    r, n = make(spark, ref), make(spark, new)
    want, best = {}, {}
    for t, c, s, e in new:
        same = [(x, f) for x, cc, ss, f in ref if (cc, ss) == (c, s)]
        exact = [x for x, f in same if introns(f) == introns(e) and abs(f[0][0] - e[0][0]) < 4 and abs(f[-1][1] - e[-1][1]) < 4]
        ranked = []
        for x, f in same:
            i, j = introns(e), introns(f)
            shared = len(set(i) & set(j))
            if shared:
                inside = len(j) > len(i) and any(j[k : k + len(i)] == i for k in range(len(j)))
                ranked.append((0, len(j), x) if inside else (1, -shared, x))
        want[t] = ("=", min(exact)) if exact else ("cj"[min(ranked)[0]], min(ranked)[2]) if ranked else ("u", None)
        over = []
        for x, f in same:
            if f[0][0] <= e[-1][1] and f[-1][1] >= e[0][0]:
                shared = len(set(introns(e)) & set(introns(f)))
                code = "=" if introns(e) == introns(f) else "c" if shared == len(introns(e)) < len(introns(f)) else "j" if shared else "o"
                over.append((-shared, abs(f[0][0] - e[0][0]) + abs(f[-1][1] - e[-1][1]), x, code))
        if over:
            best[t] = min(over)
    assert {x.transcript: (x["class"], x.match) for x in A.match_classes(n, r, 4, partial=True).collect()} == want and {c for c, _ in want.values()} == set("=cju")
    assert {x.transcript: (-x.shared, x.offset, x.ref, x.code) for x in A.best_references(n, r, 8).collect()} == best

    def sets(rows):
        out = defaultdict(set)
        for _, c, s, e in rows:
            if len(e) == 1:
                out["Single Exon"].add((c, s, *e[0]))
                continue
            out["Internal Exon"] |= {(c, s, *x) for x in e[1:-1]}
            out["Intron"] |= {(c, s, *x) for x in introns(e)}
            low, high = (c, s, e[0][1], e[0][0]), (c, s, e[-1][0], e[-1][1])
            out["TSS Exon"].add(low if s == "+" else high)
            out["TES Exon"].add(high if s == "+" else low)
        return out

    a, b, expect = sets(ref), sets(new), {}
    for k in a:
        if k in ("TSS Exon", "TES Exon"):
            m = sum(any(y[:3] == x[:3] and abs(y[3] - x[3]) < 4 for y in b[k]) for x in a[k])
        elif k == "Single Exon":
            m = sum(any(y[:2] == x[:2] and y[2] - 4 < x[2] and y[3] + 4 > x[3] for y in b[k]) for x in a[k])
        else:
            m = len(a[k] & b[k])
        expect[k] = (len(a[k]), len(b[k]), m)
    assert {x["class"]: (x.n_ref, x.n_new, x.matched) for x in A.compare_elements(r, n, 4).collect() if x["class"] != "Exon"} == expect


def plain_clusters(points, distance):
    root = {p[0]: p[0] for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, k, a, b in points:
        for j, m, c, d in points:
            if k == m and abs(a - c) <= distance and abs(b - d) <= distance:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {p[0]: find(p[0]) for p in points}


@pytest.mark.parametrize("spread, distance", [(400, 9), (60, 4), (30, 0), (2000, 30)])
def test_linkage_goes_on_along_chains(spark, spread, distance):
    rng = random.Random(spread)
    points = [(i, rng.choice("ab"), rng.randrange(-spread, spread), rng.randrange(-spread // 8, spread // 8)) for i in range(350)]
    points += [(1000 + i, "chain", i * distance, -i * distance) for i in range(40)]
    got = graph.linkage_clusters(spark.createDataFrame(points, "id long, k string, start long, stop long"), distance, ["k"])
    assert {r.id: r.cluster for r in got.collect()} == plain_clusters(points, distance)


def test_merging(spark):
    rows = [("t1", "c", "+", [(10, 20), (40, 60)]), ("t2", "c", "+", [(5, 20), (40, 70)]), ("t3", "c", "+", [(0, 20), (40, 60)]), ("t4", "c", "+", [(10, 21), (40, 60)]), ("t5", "c", "+", [(100, 200)]), ("t6", "c", "+", [(103, 204)]), ("t7", "c", "-", [(10, 20), (40, 60)])]
    t = make(spark, rows)
    merged, sources = A.merged_transcripts(t, gap=10)
    got = {r.transcript: ([tuple(x) for x in r.exons], r.members) for r in merged.collect()}
    assert got == {"t1": ([(0, 20), (40, 70)], 3), "t4": ([(10, 21), (40, 60)], 1), "t5": ([(100, 204)], 2), "t7": ([(10, 20), (40, 60)], 1)}
    assert sorted(map(tuple, sources.collect())) == [("t1", "t1"), ("t1", "t2"), ("t1", "t3"), ("t4", "t4"), ("t5", "t5"), ("t5", "t6"), ("t7", "t7")]
    coded = t.selectExpr("*", "if(transcript = 't2', 41L, null) as cds_start", "if(transcript = 't2', 50L, null) as cds_stop")
    assert {r.transcript: r.members for r in A.merged_transcripts(coded, 10)[0].collect()} == {"t1": 2, "t2": 1, "t4": 1, "t5": 2, "t7": 1}


def test_expressed(spark):
    rows = [("g", 1, "a", 10.0, 20.0), ("g", 1, "b", 0.1, 0.4), ("g", 2, "a", 8.0, 16.0), ("g", 2, "b", 0.2, 5.0), ("g", 2, "c", None, 9.0)]
    df = spark.createDataFrame(rows, "gene string, sample int, transcript string, lo double, hi double")
    # thresholds 2.5 in both samples: b stays through sample 2 only
    assert sorted(r.transcript for r in A.expressed(df, 0.1, 4.0, 4.0).collect()) == ["a", "b"]
    assert sorted(r.transcript for r in A.expressed(df, 0.1, 1.5, 4.0).collect()) == ["a"]


def test_best_references_sort_no_pairs(spark):
    rows = [(k, 1, "+", [(10, 20 + k % 3), (30, 40), (50, 60 + k)]) for k in range(40)]
    df = spark.createDataFrame(rows, "transcript long, contig long, strand string, exons array<struct<start:long,stop:long>>")
    out = A.best_references(df.where("transcript % 2 = 0"), df.where("transcript % 2 = 1"))
    assert "SortAggregate" not in out._jdf.queryExecution().toString()
    # the nearest end among those with both introns
    want = {k: min((k % 3 != j % 3, abs(k - j), j) for j in range(1, 40, 2)) for k in range(0, 40, 2)}
    assert {r.transcript: (r.shared, r.offset, r.ref, r.code) for r in out.collect()} == {k: (2 - far, d, j, "j" if far else "=") for k, (far, d, j) in want.items()}
