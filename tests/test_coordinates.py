"""Coordinate maps, coding parts and reading frames against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import seq
from spanloom.operators import coordinates as C

SCHEMA = "transcript string, strand string, exons array<struct<start:long,stop:long>>"


def cases(n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        exons, at = [], rng.randrange(20)
        for _ in range(rng.randrange(1, 5)):
            size = rng.randrange(1, 12)
            exons.append((at, at + size - 1))
            at += size + rng.randrange(1, 9)
        out.append((f"t{k}", rng.choice("+-"), exons))
    return out


@pytest.fixture(scope="module")
def rows():
    return cases(40, 1)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(t, s, [{"start": a, "stop": b} for a, b in e]) for t, s, e in rows], SCHEMA)


def test_every_base_there_and_back(rows, table):
    p = table.withColumn("p", F.explode(F.sequence(F.lit(-1).cast("long"), C.spliced_length())))
    got = p.select("transcript", "p", C.genome_position(F.col("p")).alias("g"), C.genome_position(F.col("p"), "exons", F.col("strand")).alias("gs"))
    got = {(r.transcript, r.p): (r.g, r.gs) for r in got.collect()}
    for t, s, e in rows:
        line = [x for a, b in e for x in range(a, b + 1)]
        for k in range(-1, len(line) + 1):
            inside = 0 <= k < len(line)
            assert got[t, k] == ((line[k], line[::-1][k] if s == "-" else line[k]) if inside else (None, None))
    g = table.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(90).cast("long"))))
    back = {(r.transcript, r.g): (r.a, r.b) for r in g.select("transcript", "g", C.spliced_position(F.col("g")).alias("a"), C.spliced_position(F.col("g"), "exons", F.col("strand")).alias("b")).collect()}
    for t, s, e in rows:
        line = [x for a, b in e for x in range(a, b + 1)]
        for x in range(91):
            want = (line.index(x), len(line) - 1 - line.index(x) if s == "-" else line.index(x)) if x in line else (None, None)
            assert back[t, x] == want


def test_parts_ends_and_sequences(rows, table):
    rng = random.Random(2)
    cds = {t: tuple(sorted(rng.sample([x for a, b in e for x in range(a, b + 1)], 2))) if sum(b - a + 1 for a, b in e) > 1 else None for t, _, e in rows}
    genome = "".join(rng.choice("ACGT") for _ in range(120))
    cut = F.create_map(*[F.lit(x) for t, c in cds.items() if c for x in (t, f"{c[0]}-{c[1]}")])
    df = table.withColumn("_c", F.split(F.try_element_at(cut, F.col("transcript")), "-")).withColumn("cds_start", F.col("_c")[0].cast("long")).withColumn("cds_stop", F.col("_c")[1].cast("long")).drop("_c")
    up, mid, down = C.coding_parts(F.col("cds_start"), F.col("cds_stop"), F.col("strand"))
    got = df.select("transcript", up.alias("u"), mid.alias("m"), down.alias("d"), C.inferred_promoter(F.col("strand"), "exons", 5).alias("p"), C.inferred_polya(F.col("strand"), "exons", 4).alias("q"), C.spliced_sequence(F.lit(genome), F.lit(0), F.col("strand")).alias("s"))
    spread = lambda e: [x for p in e for x in range(p.start, p.stop + 1)]
    for r in got.collect():
        _, s, e = next(x for x in rows if x[0] == r.transcript)
        line = [x for a, b in e for x in range(a, b + 1)]
        if cds[r.transcript]:
            lo, hi = cds[r.transcript]
            sides = [x for x in line if x < lo], [x for x in line if x > hi]
            assert (spread(r.u), spread(r.d)) == (sides if s == "+" else sides[::-1]) and spread(r.m) == [x for x in line if lo <= x <= hi]
        else:
            assert r.u is None and r.m is None
        first, last = (e[0], e[-1]) if s == "+" else (e[-1], e[0])
        head = (first[0], min(first[0] + 4, first[1])) if s == "+" else (max(first[1] - 4, first[0]), first[1])
        tail = (max(last[1] - 3, last[0]), last[1]) if s == "+" else (last[0], min(last[0] + 3, last[1]))
        assert tuple(r.p) == head and tuple(r.q) == tail
        plain = "".join(genome[x] for x in line)
        assert r.s == (plain if s == "+" else plain[::-1].translate(str.maketrans("ACGT", "TGCA")))


def test_lines_in_order(spark):
    df = spark.createDataFrame([("t", "-", [(0, 9), (20, 29)], 4, 24, (20, 29)), ("u", "+", [(5, 7)], None, None, None)], SCHEMA + ", cds_start long, cds_stop long, promoter struct<start:long,stop:long>")
    got = [(r.transcript, r.feature, r.start, r.stop, r.frame) for r in C.feature_rows(df).orderBy("transcript", "nth").collect()]
    assert got == [
        ("t", "three_prime_UTR", 0, 3, None), ("t", "CDS", 20, 24, 0), ("t", "CDS", 4, 9, 0), ("t", "exon", 20, 29, None), ("t", "exon", 0, 9, None),
        ("t", "five_prime_UTR", 25, 29, None), ("t", "promoter", 20, 29, None), ("u", "exon", 5, 7, None),
    ]


def test_frames_equal_the_scan(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT" if k % 3 else "ATGATG" + "N") for _ in range(rng.randrange(0, 500))) for k in range(60)] + ["ATG" + "AAA" * 99 + "TAA", "ATG" + "AAA" * 98 + "TAA", "", "AT", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, dna string")
    for least in (1, 4, 100):
        want = sorted((k, *o) for k, t in enumerate(texts) if t for o in seq.orfs(t, least))
        assert sorted(map(tuple, C.reading_frames(df, "id", "dna", least).collect())) == want
    assert any(k == 60 for k, *_ in want) and not any(k == 61 for k, *_ in want)


def test_frames_on_the_genome(spark):
    rng, line = random.Random(8), []
    for t, s, e in cases(30, 9):
        e = [(a * 20, b * 20 + 19) for a, b in e]
        n = sum(b - a + 1 for a, b in e)
        line.append((t, s, [{"start": a, "stop": b} for a, b in e], "".join(rng.choice(["ATG", "AAA", "TAG", "C"]) for _ in range(n))[:n]))
    df = spark.createDataFrame(line, SCHEMA + ", sequence string")
    for longest, stop in ((False, True), (True, False)):
        got = sorted((r.cds, r.cds_start, r.cds_stop, r.length) for r in C.coding_regions(df, 2, longest, stop).collect())
        want = []
        for t, s, e, text in line:
            flat = [x for p in e for x in range(p["start"], p["stop"] + 1)]
            flat = flat[::-1] if s == "-" else flat
            found = seq.orfs(text, 2)
            if longest:
                found = [o for o in found if o[2] - o[1] == max(b - a for _, a, b in found)]
            for k, (_, a, b) in enumerate(sorted(found), 1):
                ends = sorted((flat[a], flat[b + (2 if stop else -1)]))
                want.append((f"{t}_CDS{k}" if len(found) > 1 else t, *ends, (b - a) // 3))
        assert got == sorted(want) and got
