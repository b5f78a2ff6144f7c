"""Queries over fragment length models, end blocks of the design matrix, motif scans and single assays.

Mapping: fragments are mate pairs of orders, the first mate's stretch of 125 days is their read group; an order is a
gene on contig order % 25, its line numbers are transcripts whose start region is the first
ten days of a stretch and whose end region, where the line number isn't a multiple of 3, the
last ten; every lineitem row is a start read at its first and an end read at its last day.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import assays, ends, fragments, motifs
from spanloom.plans.catalog import DNA_SQL, FRAG, MATES, R_SQL, _mates, dna, query, t
from spanloom.plans.structure import DAY, X_SQL, rows
from spanloom.session import written

HIST = f"{R_SQL}, {MATES}, h AS (SELECT a.start // 125 AS grp, {FRAG} AS fl, count(*) AS cnt FROM a JOIN b ON a.qname = b.qname GROUP BY ALL)"


def fit_sql(h: str, key: str, p: str = "") -> str:
    """Robust fit of histogram ``h`` as table ``{p}fit``."""
    return f"""{p}t0 AS (SELECT *, sum(cnt) OVER w AS n, sum(cnt) OVER (PARTITION BY {key} ORDER BY fl ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {h} WINDOW w AS (PARTITION BY {key})),
  {p}t1 AS (SELECT *, floor(n * CAST(0.15 AS DOUBLE)) AS cut FROM {p}t0),
  {p}t2 AS (SELECT *, greatest(0, least(upto, n - cut) - greatest(upto - cnt, cut)) AS inn FROM {p}t1),
  {p}t3 AS (SELECT *, sum(fl * inn) OVER (PARTITION BY {key}) / sum(inn) OVER (PARTITION BY {key}) AS mu FROM {p}t2),
  {p}t4 AS (SELECT *, sqrt(sum((fl - mu) * (fl - mu) * inn) OVER (PARTITION BY {key}) / sum(inn) OVER (PARTITION BY {key})) AS s FROM {p}t3),
  {p}t5 AS (SELECT *, fl > CASE WHEN n > 40 THEN greatest(0, mu - 4 * s) ELSE min(fl) OVER (PARTITION BY {key}) END AND fl < CASE WHEN n > 40 THEN mu + 4 * s ELSE max(fl) OVER (PARTITION BY {key}) END AS ok FROM {p}t4),
  {p}t6 AS (SELECT {key}, fl, cnt FROM (SELECT *, bool_or(ok) OVER (PARTITION BY {key}) AS anyone FROM {p}t5) WHERE ok OR NOT anyone),
  {p}t7 AS (SELECT *, sum(fl * cnt) OVER (PARTITION BY {key}) / sum(cnt) OVER (PARTITION BY {key}) AS mean FROM {p}t6),
  {p}t8 AS (SELECT {key}, CAST(sum(cnt) AS DOUBLE) AS n, min(fl) AS fl_min, max(fl) AS fl_max, max(mean) AS mean, sum((fl - mean) ** 2 * cnt) / sum(cnt) AS v2, sum((fl - mean) ** 3 * cnt) / sum(cnt) AS v3, sum((fl - mean) ** 4 * cnt) / sum(cnt) AS v4 FROM {p}t7 GROUP BY {key}),
  {p}fit AS (SELECT {key}, CAST(n AS BIGINT) AS n, fl_min, fl_max, mean, sqrt(v2) AS sd, CASE WHEN v2 > 0 THEN v3 / sqrt(v2) ** 3 END AS skew, sqrt(v2) / sqrt(n) AS se_mean,
    CASE WHEN n > 1 THEN sqrt(2 / (n * n - n) * v4) END AS se_sd, CASE WHEN n > 3 THEN sqrt(6 * n * (n - 1) / ((n - 2) * (n + 1) * (n - 3))) END AS se_skew FROM {p}t8)"""


ROUNDED = ("mean", "sd", "skew", "se_mean", "se_sd", "se_skew")
FIT = "n, fl_min, fl_max, " + ", ".join(f"round({c}, 5) AS {c}" for c in ROUNDED)


def rounded(df):
    return df.withColumns({c: F.round(c, 5) for c in ROUNDED})


def group_histogram(spark, d):
    return fragments.histogram(_mates(spark, d).select(F.expr("start1 div 125").alias("grp"), "fl"), ["grp"])


@query(f"WITH {HIST}, {fit_sql('h', 'grp')} SELECT grp, {FIT} FROM fit")
def fragment_fit_robust(spark, d):
    return rounded(fragments.robust(group_histogram(spark, d), ["grp"]))


@query(f"WITH {HIST}, {fit_sql('h', 'grp')} SELECT grp, CAST(count(*) AS BIGINT) AS lengths, CAST(sum(inn) AS BIGINT) AS n, min(fl) AS fl_min, max(fl) AS fl_max, round(max(mu), 5) AS mean, round(max(s), 5) AS sd FROM t4 WHERE inn > 0 GROUP BY grp")
def fragment_fit_normal(spark, d):
    h = group_histogram(spark, d)
    lengths = fragments._trimmed(h, ["grp"]).where("_in > 0").groupBy("grp").agg(F.count(F.lit(1)).alias("lengths"))
    fit = fragments.normal(h, ["grp"]).join(lengths, "grp")
    return fit.select("grp", "lengths", "n", "fl_min", "fl_max", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"))


def _level(s: str) -> str:
    """Levels along one statistic; the first group has level 0."""
    return f"""new_{s} AS (SELECT grp, {s}, CASE WHEN row_number() OVER w > 1 AND coalesce({s} - lag({s}) OVER w >= greatest(3 * coalesce(se_{s}, 0), CAST(0.1 AS DOUBLE) * abs({s})), {s} IS NOT NULL) AND NOT coalesce({s} = lag({s}) OVER w, false) THEN 1 ELSE 0 END AS b FROM fit WINDOW w AS (ORDER BY {s} NULLS FIRST, grp)),
  lv_{s} AS (SELECT grp, sum(b) OVER (ORDER BY {s} NULLS FIRST, grp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l_{s} FROM new_{s})"""


CLUSTERS = f"{_level('mean')}, {_level('sd')}, {_level('skew')}, cl AS (SELECT grp, dense_rank() OVER (ORDER BY l_mean, l_sd, l_skew) - 1 AS cluster FROM lv_mean JOIN lv_sd USING (grp) JOIN lv_skew USING (grp))"


@query(f"WITH {HIST}, {fit_sql('h', 'grp')}, {CLUSTERS} SELECT grp, CAST(cluster AS BIGINT) AS cluster FROM cl")
def fragment_clusters(spark, d):
    return fragments.clusters(fragments.robust(group_histogram(spark, d), ["grp"]), ["grp"])


@query(f"WITH {HIST}, {fit_sql('h', 'grp')}, {CLUSTERS}, hc AS (SELECT cluster, fl, sum(cnt) AS cnt FROM h JOIN cl USING (grp) GROUP BY ALL), {fit_sql('hc', 'cluster', 'p')} SELECT CAST(cluster AS BIGINT) AS cluster, {FIT} FROM pfit")
def fragment_clusters_pooled(spark, d):
    h = group_histogram(spark, d)
    return rounded(fragments.pooled(h, fragments.clusters(fragments.robust(h, ["grp"]), ["grp"]), ["grp"]))


@query(f"WITH {HIST} SELECT CAST(grp % 10 AS BIGINT) AS lane, CAST(sum(cnt) AS BIGINT) AS n, round(sum(fl * cnt) / sum(cnt), 5) AS mean, round(sqrt(sum(cnt * (fl - mu) ** 2) / sum(cnt)), 5) AS sd, round(sum(cnt * (fl - mu) ** 3) / sum(cnt) / sqrt(sum(cnt * (fl - mu) ** 2) / sum(cnt)) ** 3, 5) AS skew FROM (SELECT *, sum(fl * cnt) OVER (PARTITION BY grp % 10) / sum(cnt) OVER (PARTITION BY grp % 10) AS mu FROM h) GROUP BY grp % 10")
def fragment_moments_merged(spark, d):
    """Moments of read groups, merged to lanes without their reads."""
    parts = fragments.moments(group_histogram(spark, d), ["grp"]).withColumn("lane", (F.col("grp") % 10).cast("long"))
    return fragments.stats(fragments.merge_moments(parts, ["lane"])).select("lane", "n", *[F.round(c, 5).alias(c) for c in ("mean", "sd", "skew")])


def _block_sql(p: str, site: str, where: str, at: str) -> str:
    return f"""{p}s AS (SELECT DISTINCT gene, strand, mate AS transcript, {site} FROM x WHERE {where}),
  {p}c AS (SELECT DISTINCT gene, strand, unnest([a, z + 1]) AS f FROM {p}s),
  {p}t AS (SELECT * FROM (SELECT gene, strand, f, lead(f) OVER (PARTITION BY gene ORDER BY f) - 1 AS u FROM {p}c) WHERE u IS NOT NULL),
  {p}e AS (SELECT gene % 25 AS contig, strand, {at} AS pos, count(*) AS cnt FROM x GROUP BY ALL),
  {p}o AS (SELECT gene, f, sum(cnt) AS obs FROM {p}t t JOIN {p}e e ON e.contig = t.gene % 25 AND e.strand = t.strand AND e.pos BETWEEN t.f AND t.u GROUP BY ALL),
  {p}p AS (SELECT s.gene, s.transcript, t.f, t.u, coalesce(o.obs, 0) AS obs FROM {p}s s JOIN {p}t t ON s.gene = t.gene AND t.f >= s.a AND t.u <= s.z LEFT JOIN {p}o o ON o.gene = t.gene AND o.f = t.f),
  {p}d AS (SELECT DISTINCT gene, transcript, f, u, obs FROM {p}p),
  {p}b AS (SELECT '{p}' AS block, gene, transcript, f || '-' || u AS bin, (obs + CAST(1e-6 AS DOUBLE)) / sum(obs + CAST(1e-6 AS DOUBLE)) OVER (PARTITION BY gene, transcript) AS expected, obs FROM {p}d)"""


SITE = {"tss": "CASE WHEN strand = '+' THEN s ELSE e - 9 END AS a, CASE WHEN strand = '+' THEN s + 9 ELSE e END AS z", "tes": "CASE WHEN strand = '+' THEN e - 9 ELSE s END AS a, CASE WHEN strand = '+' THEN e ELSE s + 9 END AS z"}
TES_WHERE = "mate % 3 <> 0"


def end_blocks(spark, d):
    """Start and end blocks of all orders, and the number of reads of each."""
    x = rows(spark, d).withColumn("contig", F.col("gene") % 25).withColumn("transcript", F.col("mate"))
    plus = F.col("strand") == "+"

    def block(first: bool):
        left = plus if first else ~plus
        site = x if first else x.where(TES_WHERE)
        sites = site.select("gene", "contig", "strand", "transcript", F.when(left, F.col("start")).otherwise(F.col("stop") - 9).alias("start"), F.when(left, F.col("start") + 9).otherwise(F.col("stop")).alias("stop"))
        at = x.select("contig", "strand", F.when(left, F.col("start")).otherwise(F.col("stop")).alias("pos")).groupBy("contig", "strand", "pos").agg(F.count(F.lit(1)).alias("count"))
        return ends.end_block(sites, at)

    totals = x.agg(F.count(F.lit(1)).alias("total")).select(F.explode(F.array(F.lit("tss"), F.lit("tes"))).alias("block"), "total")
    return {"tss": block(True), "tes": block(False)}, totals


@query(f"""WITH {X_SQL}, {_block_sql('tss', SITE['tss'], 'true', "CASE WHEN strand = '+' THEN s ELSE e END")}, {_block_sql('tes', SITE['tes'], TES_WHERE, "CASE WHEN strand = '+' THEN e ELSE s END")},
  al AS (SELECT * FROM tssb UNION ALL SELECT * FROM tesb),
  nd AS (SELECT gene, count(DISTINCT block) AS k FROM al GROUP BY gene),
  ok AS (SELECT gene, transcript FROM (SELECT gene, transcript, count(DISTINCT block) AS k FROM al GROUP BY gene, transcript) JOIN nd USING (gene, k)),
  dn AS (SELECT gene, block, sum(obs) AS obs FROM (SELECT DISTINCT block, gene, bin, obs FROM al) GROUP BY ALL),
  rw AS (SELECT al.*, sum(expected) OVER (PARTITION BY block, al.gene, bin) AS row_sum FROM al JOIN ok USING (gene, transcript))
  SELECT gene, block || ':' || bin AS bin, transcript, round(expected, 6) AS expected, CAST(obs AS BIGINT) AS observed FROM rw WHERE row_sum > 1e-6
  UNION ALL SELECT gene, block || ':out', NULL, 1.0, CAST((SELECT count(*) FROM x) - obs AS BIGINT) FROM dn""")
def design_end_blocks(spark, d):
    blocks, totals = end_blocks(spark, d)
    out = ends.stack(blocks, totals)
    return out.select("gene", "bin", "transcript", F.round("expected", 6).alias("expected"), F.col("observed").cast("long").alias("observed"))


@query("""WITH b AS (SELECT l_partkey AS gene, (l_suppkey + l_linenumber) % 30 AS bin, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS obs FROM lineitem GROUP BY ALL),
  c AS (SELECT gene, bin, obs, CAST((1 + bin % 5) AS DOUBLE) / sum(1 + bin % 5) OVER g AS x0, CAST((1 + bin * bin % 4) AS DOUBLE) / sum(1 + bin * bin % 4) OVER g AS x1 FROM b WINDOW g AS (PARTITION BY gene)),
  k AS (SELECT *, floor(x0 * 100000 / (x0 + x1) + CAST(0.5 AS DOUBLE) + CAST(1e-6 AS DOUBLE)) AS p0, floor(x1 * 100000 / (x0 + x1) + CAST(0.5 AS DOUBLE) + CAST(1e-6 AS DOUBLE)) AS p1 FROM c),
  m AS (SELECT gene, min(bin) AS bin, sum(x0) AS x0, sum(x1) AS x1, sum(obs) AS observed, count(*) AS n FROM k GROUP BY gene, p0, p1)
  SELECT gene, bin, 0 AS transcript, round(x0, 6) AS expected, CAST(observed AS BIGINT) AS observed, CAST(n AS BIGINT) AS n FROM m UNION ALL SELECT gene, bin, 1, round(x1, 6), CAST(observed AS BIGINT), CAST(n AS BIGINT) FROM m""")
def design_row_clusters(spark, d):
    """A part is a gene of two transcripts whose bins come from suppliers and line numbers."""
    n = F.col("bin")
    b = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 30).alias("bin")).agg(F.sum(F.col("l_quantity").cast("long")).alias("observed"))
    two = F.array(F.struct(F.lit(0).alias("transcript"), (1 + n % 5).alias("expected")), F.struct(F.lit(1).alias("transcript"), (1 + n * n % 4).alias("expected")))
    cells = b.select("gene", "bin", "observed", F.explode(two).alias("x")).select("gene", "bin", "observed", "x.transcript", F.col("x.expected").cast("double").alias("expected"))
    return ends.cluster_rows(cells).select("gene", "bin", "transcript", F.round("expected", 6).alias("expected"), "observed", F.col("rows").alias("n"))


#: fixed values: whole-numbered weights of A, C, G, T at the places of a polyadenylation signal
SIGNAL = [[6, -4, -4, -4], [5, -3, -4, 1], [-4, -4, -4, 6], [6, -4, -4, -4], [6, -4, -4, -4], [5, -2, 0, -4]]
LEAST = 18


def _score_sql() -> str:
    cases = [f"CASE c{j} WHEN 'A' THEN {r[0]} WHEN 'C' THEN {r[1]} WHEN 'G' THEN {r[2]} WHEN 'T' THEN {r[3]} ELSE {min(r)} END" for j, r in enumerate(SIGNAL)]
    flip = [f"CASE c{len(SIGNAL) - 1 - j} WHEN 'T' THEN {r[0]} WHEN 'G' THEN {r[1]} WHEN 'C' THEN {r[2]} WHEN 'A' THEN {r[3]} ELSE {min(r)} END" for j, r in enumerate(SIGNAL)]
    leads = ", ".join(f"lead(c, {j}) OVER w AS c{j}" for j in range(1, len(SIGNAL)))
    return f"""u AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(dna, '') AS l FROM s WHERE len(dna) > 0)),
  v AS (SELECT doc_id, i, c AS c0, {leads} FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  sc AS (SELECT doc_id, i, '+' AS strand, {' + '.join(cases)} AS score FROM v WHERE c{len(SIGNAL) - 1} IS NOT NULL UNION ALL SELECT doc_id, i, '-', {' + '.join(flip)} FROM v WHERE c{len(SIGNAL) - 1} IS NOT NULL)"""


@query(f"WITH {DNA_SQL}, {_score_sql()} SELECT doc_id, CAST(i AS BIGINT) AS start, strand, CAST(score AS DOUBLE) AS score FROM sc WHERE score >= {LEAST}")
def motif_scan(spark, d):
    return motifs.scan(dna(spark, d), "doc_id", SIGNAL, LEAST, both=True, seq="dna")


@query(f"WITH {DNA_SQL} SELECT doc_id, CAST(len(dna) // 3 AS BIGINT) AS start, CAST(2 * len(dna) // 3 AS BIGINT) AS stop, md5(dna[len(dna) // 3 + 1 : 2 * len(dna) // 3 + 1]) AS seq FROM s WHERE dna IS NOT NULL")
def reference_fetch(spark, d):
    """The middle third of each sequence out of chunks of 4096 bases."""
    s = written(dna(spark, d).where("dna is not null"), "bases")  # read three times
    regions = s.select("doc_id", F.expr("cast(length(dna) div 3 as bigint)").alias("start"), F.expr("cast(2 * length(dna) div 3 as bigint)").alias("stop"))
    out = motifs.fetch(motifs.chunked(s, "doc_id", 5, 4096, "dna"), regions, "doc_id", 4096)
    return out.select("doc_id", "start", "stop", F.md5("seq").alias("seq"))


#: lineitem rows as aligned reads: reversed where the line status is F, paired where the quantity is even, odd line numbers are read 1
READS_SQL = f"""x AS (SELECT l_suppkey AS contig, {DAY} AS pos, {DAY} + CAST(l_quantity AS BIGINT) AS aend, l_linestatus = 'F' AS rev, CAST(l_quantity AS BIGINT) % 2 = 0 AS paired, l_linenumber % 2 = 1 AS one,
  CAST(round(l_tax * 100) AS BIGINT) AS mapq, 1.0 / (1 + l_linenumber % 3) AS weight FROM lineitem)"""


def aligned(spark, d):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long")
    paired, one = F.col("l_quantity").cast("long") % 2 == 0, F.col("l_linenumber") % 2 == 1
    flag = F.when(paired, 0x1).otherwise(0) + F.when(F.col("l_linestatus") == "F", 0x10).otherwise(0) + F.when(one, 0x40).otherwise(0x80)
    return t(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("contig"), day.alias("pos"), (day + F.col("l_quantity").cast("long")).alias("aend"), flag.alias("flag"),
        F.round(F.col("l_tax") * 100).cast("int").alias("mapq"), F.lit(None).cast("double").alias("xp"), (1 + F.col("l_linenumber") % 3).alias("nh"),
    )


def _ends_sql(where: str, plus: str, at_plus: str, at_minus: str) -> str:
    return f"WITH {READS_SQL} SELECT contig, CASE WHEN {plus} THEN '+' ELSE '-' END AS strand, CASE WHEN {plus} THEN {at_plus} ELSE {at_minus} END AS pos, round(sum(weight), 4) AS count FROM x WHERE {where} GROUP BY ALL"


def _ends(df):
    return df.withColumn("count", F.round("count", 4))


@query(_ends_sql("mapq > 1", "NOT rev", "pos", "aend - 1"))
def assay_cage(spark, d):
    return _ends(assays.end_counts(aligned(spark, d), "cage"))


@query(_ends_sql("mapq > 1 AND one", "rev", "pos", "aend - 1"))
def assay_rampage(spark, d):
    """Against the transcripts' strand."""
    return _ends(assays.end_counts(aligned(spark, d), "rampage", flip=True))


@query(_ends_sql("NOT (paired AND one)", "CASE WHEN paired THEN one <> rev ELSE NOT rev END", "aend - 1", "pos"))
def assay_polya(spark, d):
    return _ends(assays.end_counts(aligned(spark, d), "polya"))


def _runs_sql(start: str, stop: str, depth: str) -> str:
    return f"""WITH {READS_SQL}, f AS (SELECT contig, pos, sum(d) AS d FROM (SELECT contig, {start} AS pos, 1 AS d FROM x UNION ALL SELECT contig, {stop}, -1 FROM x) GROUP BY contig, pos)
  SELECT contig, start, stop, {depth} AS depth FROM (SELECT contig, pos AS start, lead(pos) OVER w - 1 AS stop, sum(d) OVER w AS n FROM f WINDOW w AS (PARTITION BY contig ORDER BY pos)) WHERE stop IS NOT NULL"""


@query(_runs_sql("CASE WHEN rev THEN aend - 30 ELSE pos END", "CASE WHEN rev THEN aend ELSE pos + 30 END", "round(n / 31, 6)"))
def assay_chip(spark, d):
    return assays.chip_coverage(aligned(spark, d), 30).withColumn("depth", F.round("depth", 6))


@query(_runs_sql("pos", "aend", "CAST(n AS BIGINT)"))
def assay_dnase(spark, d):
    return assays.dnase_coverage(aligned(spark, d))
