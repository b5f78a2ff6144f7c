"""Toxicity: multiple-instance learning over sentences.

A document is a bag of sentences.  A sentence scores p = sigmoid(bias + sum of the
weights of its words and of their beginnings of ``BEGINNINGS`` bytes, so that
inflected and compound forms share weights).  The document's score is the noisy-or,
1 - prod(1 - p), in training and in scoring.  Weights are learned from document labels
only, by Adam with soft thresholding on the likelihood of that noisy-or, over a bounded
sample: at most ``SAMPLE`` labelled rows of each label with texts of at most
``SAMPLE_BYTES``, taken by a hash of the id.  A clean bag's likelihood is a product
over its sentences, so a clean text that counts ``CLEAN`` times stands for bags so many
times longer: that keeps the many sentences of long clean texts from adding up.
Only features in ``MIN_DOCS`` sample documents get a weight.  Scoring reads whole
texts, long ones in pieces; ``offending`` returns the sentences that carry a
document's score.

Defined cases: null and empty texts have no sentence and score 0; a text without
known words scores the noisy-or of the bias; without labels of both kinds every
score is 0; repeated label rows count once for each; extra columns are not read,
or carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import batches, rows_of, span_hashes, word_pieces, word_spans
from ._common import bound_batches, fold, quoted, rowed, unrowed

SAMPLE = 2000
SALTS = 8
SAMPLE_BYTES = 16_384
MIN_DOCS = 4
BEGINNINGS = (4, 5, 6)
CLEAN = 256

_ends = np.zeros(256, bool)
_ends[[ord("."), ord("!"), ord("?"), ord("\n")]] = True


@dataclass
class WordBag:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Index of each known word, -1 for others."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        low = (h & np.uint64(0xFFFF)).astype(np.int64)
        maybe = np.zeros(65536, bool)
        maybe[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        out = np.full(len(h), -1)
        some = np.flatnonzero(maybe[low])
        at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        out[some] = np.where(self.hashes[at] == h[some], at, -1)
        return out


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all sentences that aren't empty, and their rows."""
    first = np.zeros(len(data) + 1, bool)
    first[1:] = _ends[data]
    first[offsets] = True
    first[len(data)] = False
    starts = np.flatnonzero(first)
    return starts, rows_of(offsets, starts)


def _parse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, sentence) of each feature; (start, row) of each sentence."""
    at, row = sentences(data, offsets)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for base, piece, inner in word_pieces(data, offsets):
        low, starts, ends = word_spans(piece, inner)
        whole, begun = span_hashes(low, starts, ends, BEGINNINGS)
        place = np.searchsorted(at, starts + base, "right") - 1
        hashes.append(whole)
        places.append(place)
        for n, (longer, h) in zip(BEGINNINGS, begun):
            hashes.append(h ^ np.uint64(n))
            places.append(place[longer])
    return np.concatenate(hashes), np.concatenate(places), at, row


def _log_safe(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))"""
    return -np.logaddexp(0, z)


def train(texts: pa.Array, toxic: np.ndarray, steps: int = 200, rate: float = 0.1, sparse: float = 2e-4) -> WordBag:
    hs, ss, rows, once, n_sent = [], [], [], [np.zeros(0, np.uint64)], 0
    for lo, hi, data, offsets in batches(texts, 2 << 20):
        h, s, _, row = _parse(data, offsets)
        hs.append(h)
        ss.append((s + n_sent).astype(np.int32))
        rows.append(row + lo)
        doc = row[s]
        order = np.lexsort((h, doc))
        x, d = h[order], doc[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
        once.append(x[new])
        n_sent += len(row)
    row = np.concatenate(rows)
    vocab, docs_with = np.unique(np.concatenate(once), return_counts=True)
    bag = WordBag(vocab[docs_with >= MIN_DOCS], np.zeros(0), -3.0)
    del once, vocab, docs_with
    found = [bag.lookup(h).astype(np.int32) for h in hs]
    s = np.concatenate([x[f >= 0] for x, f in zip(ss, found)])
    w = np.concatenate([f[f >= 0] for f in found])
    del hs, ss, found
    weights, bias = np.zeros(len(bag.hashes)), -6.0
    m, v, mb, vb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    n_docs = len(toxic)
    share = np.where(toxic == 1, 0.5 / max((toxic == 1).sum(), 1), 0.5 / max((toxic == 0).sum(), 1)) * 0.5 + 0.5 / n_docs
    share = np.where(toxic == 1, share, CLEAN * share)
    for step in range(1, steps + 1):
        z = bias + np.bincount(s, weights[w], n_sent)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        clean = np.bincount(row, _log_safe(z), n_docs)  # log of the chance that no sentence offends
        hit = np.maximum(-np.expm1(clean), 1e-9)
        g_doc = np.where(toxic == 1, -np.exp(clean) / hit, 1.0) * share
        g_sent = p * g_doc[row]
        g, gb = np.bincount(w, g_sent[s], len(weights)), g_sent.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        weights = weights - scale * m / (1 - 0.9**step)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - scale * sparse, 0)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-4)
    some = np.abs(weights) > 1e-3
    return WordBag(bag.hashes[some], weights[some], float(bias))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> WordBag | None:
    """Learn from labels whose crc32 fold modulo 5 isn't 0."""
    seen = labels.select(F.col(id_col).alias("_lid"), F.col(label_col).cast("int").alias("_y")).where("_lid is not null and _y in (0, 1)").where(fold("_lid", 5) != 0)
    # a few salts each, so that tasks drop what can't be in the sample before the exchange
    seen = seen.withColumn("_o", F.xxhash64(F.lit(7), "_lid")).withColumn("_salt", F.pmod("_o", F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy("_y", "_salt").orderBy("_o"))
    few = seen.withColumn("_r", rank).where(F.col("_r") <= max(1, sample // SALTS)).select("_lid", "_y")  # at most two samples of two numbers
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text")).where(F.octet_length("_text") <= SAMPLE_BYTES)
    got = rows.join(F.broadcast(few), F.col("_id") == F.col("_lid")).select("_lid", "_text", "_y").toArrow().sort_by("_lid")
    y = got.column("_y").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    return train(got.column("_text").combine_chunks(), y)


def sentence_odds(bag: WordBag, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds, starts and rows of all sentences."""
    h, s, at, row = _parse(data, offsets)
    w = bag.lookup(h)
    known = w >= 0
    return bag.bias + np.bincount(s[known], bag.weights[w[known]], len(row)), at, row


def noisy_or(z: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Scores of n bags from their sentences' log odds."""
    return 0.0 - np.expm1(np.bincount(row, _log_safe(z), n))


def document_scores(bag: WordBag, text: pa.Array) -> np.ndarray:
    out = np.zeros(len(text))
    for lo, hi, data, offsets in batches(text, 1 << 20):
        z, _, row = sentence_odds(bag, data, offsets)
        out[lo:hi] = noisy_or(z, row, hi - lo)
    return out


def scored(docs: DataFrame, bag: WordBag | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """_id (or all columns in _row) and _score of every whole text."""
    src = docs.select(rowed(docs)) if carry else docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    place = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = pc.struct_field(b.column(0), [place]) if carry else b.column(1)
            score = document_scores(bag, text) if bag is not None else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=[b.schema.names[0], "_score"])

    bound_batches(docs.sparkSession)
    return src.mapInArrow(run, src.drop("_text").schema.add("_score", "double"))


def offending(docs: DataFrame, bag: WordBag, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences that score ``least`` or more: id, start, length (bytes of UTF-8), sentence, score."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[tuple] = []
            ids = b.column(0).to_pylist()
            for lo, _, data, offsets in batches(b.column(1), 1 << 20):
                z, at, row = sentence_odds(bag, data, offsets)
                ends, raw = np.append(at[1:], len(data)), data.tobytes()
                for k in np.flatnonzero(z >= np.log(least / (1 - least))).tolist():
                    a, e = int(at[k]), int(ends[k])
                    out.append((ids[lo + row[k]], a - int(offsets[row[k]]), e - a, raw[a:e].decode(errors="replace"), float(1 / (1 + np.exp(-z[k])))))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[id_col, "start", "length", "sentence", "score"])

    bound_batches(docs.sparkSession)
    src = docs.select(quoted(id_col), quoted(text_col))
    return src.mapInArrow(run, f"`{id_col}` {src.dtypes[0][1]}, start long, length long, sentence string, score double")


def toxicity_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = scored(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    held = F.coalesce(fold("_id", 5) == 0, F.lit(False))
    return out.select(F.col("_id").alias(id_col), held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows that score under ``least``."""
    return unrowed(scored(docs, fit(docs, labels, id_col, text_col), id_col, text_col, carry=True).where(F.col("_score") < least), docs.columns)
