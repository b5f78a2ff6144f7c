"""The queries of the training-data operators, one for each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, codec, exact_dedup, html_text, langid, minhash, packing, periodic, phrases, quality, sharding, topk, toxicity
from ._common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digest(table(spark, sf_dir, "documents"))


def op13_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text_of(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_sharding, op2_language_id, op3_best_fit_packing, op4_exact_top_k, op5_toxicity, op6_minhash_near_dedup, op7_exact_dedup, op8_token_files, op9_byte_bpe, op10_quality,
        op11_phrase_mining, op12_periodic_runs, op13_html_main_text,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_top_k": """
            WITH v AS (
              SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v
              FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
              SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                     CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
            ), r AS (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
            )
            SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
        """,
        "op7_exact_dedup": r"""
            WITH t AS (
              SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
            ), g AS (
              SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
            )
            SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
                   t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
            FROM t JOIN g ON t.norm = g.norm
        """,
        "op11_phrase_mining": r"""
            WITH d AS (
              SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
            ), p AS (
              SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
            ), w AS (
              SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
            ), g AS (
              SELECT lang, k.k AS k, array_to_string(ws[i.i : i.i + k.k - 1], ' ') AS phrase
              FROM w, LATERAL (SELECT unnest(range(1, 6)) AS k) k, LATERAL (SELECT unnest(range(1, len(ws) - k.k + 2)) AS i) i
            ), f AS (
              SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY lang, phrase, k
            ), n AS (
              SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
            ), c AS (
              SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 100
            ), inside AS (
              SELECT DISTINCT c.lang, array_to_string(c.ws[i.i : i.i + m.m - 1], ' ') AS phrase, c.a
              FROM c, LATERAL (SELECT unnest(range(2, c.k)) AS m) m, LATERAL (SELECT unnest(range(1, c.k - m.m + 2)) AS i) i
            ), kept AS (
              SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= 100 * c.a)
            ), cuts AS (
              SELECT x.lang, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, n.n,
                     CAST(CAST(1000 AS HUGEINT) * x.a * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
              FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) x
              JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[1 : x.cut], ' ')
              JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[x.cut + 1 :], ' ')
              JOIN n ON n.lang = x.lang
            ), best AS (
              SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS b FROM cuts
            ), ranked AS (
              SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE b = 1
            )
            SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
            FROM ranked WHERE rank <= 2000
        """,
    }
