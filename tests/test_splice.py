"""Splice graphs, typed exons, path counts and candidate transcripts against plain loops."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

from spanloom.operators import splice


def gene_case(rng, gene):
    regions, pos = [], rng.randrange(50)
    for _ in range(rng.randrange(1, 4)):
        size = rng.randrange(5, 60)
        regions.append((pos, pos + size - 1))
        pos += size + rng.randrange(1, 20)
    lo, hi = regions[0][0], regions[-1][1]
    some = lambda n: sorted({tuple(sorted(rng.sample(range(lo, hi + 1), 2))) for _ in range(rng.randrange(n))})
    return {"gene": gene, "strand": rng.choice("+-"), "regions": regions, "introns": [(a, b, rng.randrange(1, 9)) for a, b in some(5)], "tss": some(4), "tes": some(4)}


def plain_graph(g):
    plus, lo, hi = g["strand"] == "+", g["regions"][0][0], g["regions"][-1][1]
    labels = defaultdict(set)
    labels[lo].add("GENE_BNDRY")
    labels[hi + 1].add("GENE_BNDRY")
    gaps = [(a[1] + 1, b[0]) for a, b in itertools.pairwise(g["regions"])]
    for a, b in gaps:
        labels[a].add("EMPTY_START")
        labels[b].add("EMPTY_STOP")
    for a, b, _ in g["introns"]:
        labels[a].add("D_JN" if plus else "R_JN")
        labels[b + 1].add("R_JN" if plus else "D_JN")
    for a, b in g["tss"]:
        labels[a if plus else b + 1].add("TSS")
    for a, b in g["tes"]:
        labels[b + 1 if plus else a].add("TES")
    cuts = sorted(p for p in labels if not any(a < p < b for a, b in gaps))
    segs = {i: (a, b - 1, sorted(labels[a]), sorted(labels[b])) for i, (a, b) in enumerate(itertools.pairwise(cuts)) if "EMPTY_START" not in labels[a]}
    turn = lambda a, b: (a, b) if plus else (b, a)
    edges = [(*turn(f"S{i}", f"S{i + 1}"), "adjacent") for i in segs if i + 1 in segs]
    for a, b, _ in g["introns"]:
        left = [i for i, s in segs.items() if s[1] + 1 == a]
        right = [i for i, s in segs.items() if s[0] == b + 1]
        edges += [(*turn(f"S{i}", f"S{j}"), "splice") for i in left for j in right]
    for k, (a, b) in enumerate(g["tss"]):
        edges += [(f"TSS_{k}", f"S{i}", "tss") for i, s in segs.items() if (s[0] == a if plus else s[1] == b)]
    for k, (a, b) in enumerate(g["tes"]):
        edges += [(f"S{i}", f"TES_{k}", "tes") for i, s in segs.items() if (s[1] == b if plus else s[0] == a)]
    return segs, edges


@pytest.fixture(scope="module")
def genes():
    rng = random.Random(8)
    return [gene_case(rng, k) for k in range(150)]


@pytest.fixture(scope="module")
def tables(spark, genes):
    make = lambda key, more="": spark.createDataFrame([(g["gene"], *x) for g in genes for x in g[key]], f"gene long, start long, stop long{more}")
    regions = spark.createDataFrame([(g["gene"], g["strand"], *x) for g in genes for x in g["regions"]], "gene long, strand string, start long, stop long")
    return regions, make("introns", ", cnt long"), make("tss"), make("tes")


def test_splice_graph(genes, tables):
    nodes, edges = splice.splice_graph(*tables)
    got_edges, got_nodes = defaultdict(list), defaultdict(dict)
    for r in edges.collect():
        got_edges[r.gene].append((r.src, r.dst, r.type))
    for r in nodes.collect():
        got_nodes[r.gene][r.node] = r
    for g in genes:
        segs, want = plain_graph(g)
        assert sorted(got_edges[g["gene"]]) == sorted(want)
        found = {n: (r.start, r.stop, r.left_labels, r.right_labels) for n, r in got_nodes[g["gene"]].items() if r.type == "segment"}
        assert found == {f"S{i}": s for i, s in segs.items()}
        assert sum(r.type == "TSS" for r in got_nodes[g["gene"]].values()) == len(g["tss"])


def plain_exons(g, value, floor, ratio):
    segs, _ = plain_graph(g)
    plus = g["strand"] == "+"
    line = [(i, *(s if plus else (s[0], s[1], s[3], s[2]))) for i, s in sorted(segs.items(), reverse=not plus)]
    out = []
    for i in range(len(line)):
        for opens in set(line[i][3]) & {"TSS", "R_JN"}:
            for j in range(i, len(line)):
                if j > i and abs(line[j][0] - line[j - 1][0]) != 1:
                    break
                least = max([floor] + [0.4 * value[g["gene"], line[k][0]] / ratio for k in (j - 1, j + 1) if 0 <= k < len(line)])
                if value[g["gene"], line[j][0]] < least:
                    break
                for closes in set(line[j][4]) & {"TES", "D_JN"}:
                    kind = {("TSS", "TES"): "SE_GENE", ("TSS", "D_JN"): "TSS_EXON", ("R_JN", "TES"): "TES_EXON"}.get((opens, closes), "EXON")
                    fpkm = min(value[g["gene"], line[k][0]] for k in range(i, j + 1))
                    out.append((g["gene"], g["strand"], min(line[i][1], line[j][1]), max(line[i][2], line[j][2]), kind, fpkm))
    return out


def test_typed_exons(spark, genes, tables):
    rng, value = random.Random(3), {}
    for g in genes:
        for i in plain_graph(g)[0]:
            value[g["gene"], i] = rng.choice([0.05, 1.0, 2.0, 3.0, 30.0, 90.0])
    v = spark.createDataFrame([(*k, x, 0.4 * x) for k, x in value.items()], "gene long, nth int, fpkm double, fpkm_lb double")
    segs = splice.splice_graph(*tables)[0].where("type = 'segment'").drop("type", "node").join(v, ["gene", "nth"])
    got = sorted(map(tuple, splice.typed_exons(segs, 0.1, 20.0).collect()))
    assert got == sorted(x for g in genes for x in plain_exons(g, value, 0.1, 20.0)) and len({r[4] for r in got}) == 4


def random_dags(rng, n):
    out = {}
    for gene in range(n):
        size = rng.randrange(2, 9)
        edges = {(a, b) for a, b in itertools.combinations(range(size), 2) if rng.random() < 0.5}
        out[gene] = (edges, {0, rng.randrange(size)}, {size - 1, rng.randrange(size)})
    return out


def all_paths(edges, starts, ends):
    def go(path):
        if path[-1] in ends:
            yield path
        else:
            for a, b in sorted(edges):
                if a == path[-1]:
                    yield from go([*path, b])

    return [p for s in starts for p in go([s])]


def graph_tables(spark, dags):
    node = lambda k: spark.createDataFrame([(g, str(x)) for g, d in dags.items() for x in d[k]], "gene long, node string")
    edges = spark.createDataFrame([(g, str(a), str(b)) for g, d in dags.items() for a, b in d[0]], "gene long, src string, dst string")
    return edges, node(1), node(2)


def test_path_counts_and_candidates(spark):
    dags = random_dags(random.Random(6), 80)
    tables = graph_tables(spark, dags)
    counts = splice.path_counts(*tables)
    got = {(r.gene, r.node): (int(r.before), int(r.after)) for r in counts.collect()}
    want, totals, listed = {}, {}, []
    for g, d in dags.items():
        paths = all_paths(*d)
        heads, tails = defaultdict(set), defaultdict(set)
        for p in paths:
            for k, x in enumerate(p):
                heads[x].add(tuple(p[: k + 1]))
                tails[x].add(tuple(p[k:]))
        want |= {(g, str(x)): (len(heads[x]), len(tails[x])) for x in heads}
        if paths:
            totals[g] = len(paths)
        if len(paths) <= 5:
            listed += [(g, tuple(map(str, p))) for p in paths]
    assert got == want
    assert {r.gene: int(r.paths) for r in splice.gene_paths(counts, tables[1]).collect()} == totals
    paths, over = splice.candidate_paths(*tables, cap=5)
    assert sorted((r.gene, tuple(r.path)) for r in paths.collect()) == sorted(listed)
    assert {r.gene: int(r.paths) for r in over.collect()} == {g: n for g, n in totals.items() if n > 5} and over.count()


def test_many_paths_are_counted_not_made(spark):
    diamonds = {(f"{k}", f"{k}{s}") for k in range(40) for s in "ab"} | {(f"{k}{s}", f"{k + 1}") for k in range(40) for s in "ab"}
    dags = {1: (diamonds, {"0"}, {"40"}), 2: ({("x", "y")}, {"x"}, {"y"})}
    paths, over = splice.candidate_paths(*graph_tables(spark, dags))
    assert [(r.gene, r.path) for r in paths.collect()] == [(2, ["x", "y"])]
    assert [(r.gene, int(r.paths)) for r in over.collect()] == [(1, 2**40)]


def test_cycles_fail_and_empty_graphs_do_not(spark):
    cycle = graph_tables(spark, {1: ({("a", "b"), ("b", "a")}, {"a"}, {"z"})})
    with pytest.raises(RuntimeError):
        splice.path_counts(*cycle, rounds=12)
    edges, nodes = spark.createDataFrame([], "gene long, src string, dst string"), spark.createDataFrame([], "gene long, node string")
    paths, over = splice.candidate_paths(edges, nodes, nodes)
    assert paths.count() == 0 and over.count() == 0


def test_paths_through(spark):
    rng = random.Random(2)
    dags = random_dags(rng, 25)
    length = {(g, x): rng.randrange(1, 6) for g, d in dags.items() for x in range(9)}
    chosen = [(g, rng.choice(sorted({x for e in d[0] for x in e} or {0}))) for g, d in dags.items()]

    def grown(g, d, x, forward):
        out, open_ = [], [([], x, 0)]
        while open_:
            way, at, reach = open_.pop()
            nexts = [b if forward else a for a, b in d[0] if (a if forward else b) == at]
            if not nexts:
                out.append(way)
            for y in nexts:
                far = reach + length[g, y]
                (out.append([*way, y]) if far >= 6 else open_.append(([*way, y], y, far)))
        return out

    want = []
    for g, x in chosen:
        want += [(g, str(x), tuple(map(str, [*b[::-1], x, *f]))) for b in grown(g, dags[g], x, False) for f in grown(g, dags[g], x, True)]
    got = splice.paths_through(
        graph_tables(spark, dags)[0], spark.createDataFrame([(g, str(x), n) for (g, x), n in length.items()], "gene long, node string, length long"),
        spark.createDataFrame([(g, str(x)) for g, x in chosen], "gene long, node string"), 6,
    )
    assert sorted((r.gene, r.node, tuple(r.path)) for r in got.collect()) == sorted(want)


def test_merged_ends(spark):
    rng = random.Random(5)
    exons = sorted((rng.randrange(3), rng.randrange(40), 50 + rng.randrange(3) * 9, rng.randrange(5)) for _ in range(120))
    df = spark.createDataFrame(exons, "gene long, start long, stop long, score long")
    want = []
    for (g, stop), group in itertools.groupby(sorted(exons, key=lambda x: (x[0], x[2], x[1])), key=lambda x: (x[0], x[2])):
        groups = []
        for _, start, _, score in group:
            if groups and start - groups[-1][0] < 4:
                groups[-1] = (groups[-1][0], groups[-1][1] + score, groups[-1][2] + 1)
            else:
                groups.append((start, score, 1))
        want += [(g, stop, *x) for x in groups]
    assert sorted((r.gene, r.stop, r.start, r.score, r.members) for r in splice.merged_starts(df, 4, ["gene"]).collect()) == sorted(want)
    flipped = spark.createDataFrame([(g, 100 - stop, 100 - start, score) for g, start, stop, score in exons], "gene long, start long, stop long, score long")
    want = []
    rows = [(g, 100 - stop, 100 - start, score) for g, start, stop, score in exons]
    for (g, start), group in itertools.groupby(sorted(rows, key=lambda x: (x[0], x[1], x[2])), key=lambda x: (x[0], x[1])):
        groups = []
        for _, _, stop, score in group:
            if groups and stop - groups[-1][0] < 4:
                groups[-1] = (stop, groups[-1][1] + score, groups[-1][2] + 1)
            else:
                groups.append((stop, score, 1))
        want += [(g, start, *x) for x in groups]
    assert sorted((r.gene, r.start, r.stop, r.score, r.members) for r in splice.merged_ends(flipped, 4, ["gene"]).collect()) == sorted(want)


def test_matching_sites(spark):
    e = lambda *x: [{"start": a, "stop": b} for a, b in x]
    rows = [("g", "t1", "+", e((10, 20), (40, 60))), ("g", "t2", "-", e((10, 20), (40, 60))), ("g", "t3", "+", e((11, 20))), ("h", "t4", "+", e((10, 20)))]
    tr = spark.createDataFrame(rows, "gene string, transcript string, strand string, exons array<struct<start:long,stop:long>>")
    sites = spark.createDataFrame([("g", 10, 15), ("g", 10, 30), ("g", 35, 60), ("g", 1, 20)], "gene string, start long, stop long")
    got = {r.transcript: (r.promoter_start, r.promoter_stop, r.polya_start, r.polya_stop) for r in splice.match_polyas(splice.match_promoters(tr, sites), sites).collect()}
    assert got == {"t1": (10, 20, 40, 60), "t2": (40, 60, 10, 20), "t3": (None, None, 11, 20), "t4": (None,) * 4}


def test_retained_introns(spark):
    rng = random.Random(9)
    want, lefts, rights, jns = Counter(), [], [], []
    for g in range(30):
        exons = sorted({(a, a + rng.randrange(1, 4)) for a in (rng.randrange(0, 30) for _ in range(8))})
        left, right = rng.sample(exons, min(4, len(exons))), rng.sample(exons, min(4, len(exons)))
        introns = {(rng.randrange(0, 33), rng.randrange(0, 33)) for _ in range(60)}
        introns = {(a, b) for a, b in introns if a < b}
        known = set(left) | set(right)
        # an intron from an exon's last base to the next one's first
        links = {(x, y) for x in known for y in known for a, b in introns if x[1] == a and y[0] == b}
        lefts += [(g, *x) for x in left]
        rights += [(g, *x) for x in right]
        jns += [(g, *x) for x in introns]

        def ways(x, y, links=links):
            return sum((b == y) + ways(b, y) for a, b in links if a == x)

        for x in left:
            for y in right:
                if x != y and ways(x, y):
                    want[g, x[0], y[1]] += ways(x, y)
    make = lambda rows: spark.createDataFrame(rows, "gene long, start long, stop long")
    got = splice.retained_intron_exons(make(lefts), make(rights), make(jns))
    assert {(r.gene, r.start, r.stop): int(r.paths) for r in got.collect()} == dict(want) and want
