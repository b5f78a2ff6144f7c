"""Quality classifier: positive-unlabelled learning.

Trusted positives are texts labelled 1; all other texts of the sample count as
unlabelled web text, whatever their labels say.  A small network over shape
features of the whole text minimises the non-negative unbiased risk (sigmoid
loss) for an estimated class prior.  The prior is the least ratio of unlabelled
to positive shares above a score, over all score thresholds, of a first
classifier that tells positives from unlabelled rows (out of fold).

The sample is bounded: at most ``POSITIVES`` labelled positives and
``UNLABELLED`` others, texts of at most ``SAMPLE_BYTES``, taken by a hash of the id.

Features are counts of neighbouring byte classes over the whole text (long ones in
pieces), the log of
its length, its share of distinct words and of distinct lines, and mean lengths.

Defined cases: null and empty texts have the features of no bytes and are scored
like others; without positives or unlabelled rows the score is the prior 1; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import batches, rows_of, span_hashes, word_pieces, words
from ._common import bound_batches, fold, quoted

POSITIVES = 4000
UNLABELLED = 8000
SAMPLE_BYTES = 16_384
HIDDEN = 24

#: byte classes: 0 other control, 1 space, 2 new line, 3 lower, 4 upper, 5 digit, 6 .,;: 7 !? 8 quotes and brackets, 9 | and slashes, 10 #$%&*@ and the like, 11 from 128
_class = np.zeros(256, np.int64)
_class[32] = _class[9] = 1
_class[[10, 13]] = 2
_class[97:123] = 3
_class[65:91] = 4
_class[48:58] = 5
_class[33:127] = np.where(_class[33:127] == 0, 10, _class[33:127])
_class[[ord(c) for c in ".,;:"]] = 6
_class[[ord(c) for c in "!?"]] = 7
_class[[ord(c) for c in "'\"()[]{}<>"]] = 8
_class[[ord(c) for c in "|/\\"]] = 9
_class[128:] = 11
CLASSES = 12


def _distinct(rows: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many hashes, how many different ones."""
    order = np.lexsort((h, rows))
    r, x = rows[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return np.bincount(rows, minlength=n), np.bincount(r[new], minlength=n)


def features(text: pa.Array) -> np.ndarray:
    out = np.zeros((len(text), CLASSES * CLASSES + CLASSES + 6), np.float32)
    for lo, hi, data, offsets in batches(text, 1 << 20):
        n = hi - lo
        size = np.diff(offsets)
        pair, single = np.zeros((n, CLASSES * CLASSES), np.int64), np.zeros((n, CLASSES), np.int64)
        hashes, rows, line = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        letters = np.zeros(n)
        for at, piece, inner in word_pieces(data, offsets):
            cls, own = _class[piece], rows_of(offsets, np.arange(at, at + len(piece))) if n > 1 else np.zeros(len(piece), np.int64)
            single += np.bincount(own * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES)
            before = own * CLASSES + (_class[data[at - 1 : at + len(piece) - 1]] if at else np.append(0, cls[:-1]))
            first = np.zeros(len(piece) + 1, bool)
            first[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + len(piece), "right")] - at] = True
            pair += np.bincount((before * CLASSES + cls)[~first[:-1]], minlength=n * CLASSES * CLASSES).reshape(n, -1)
            starts, ends, h = words(piece, inner)
            hashes.append(h)
            rows.append(rows_of(offsets, starts + at).astype(np.int32))
            letters += np.bincount(rows[-1], ends - starts, n)
            first[1:] |= piece == 10
            line.append(np.flatnonzero(first[:-1]) + at)
            if first[-1] and at + len(piece) < len(data) and piece[-1] == 10:
                line.append(np.array([at + len(piece)]))
        n_words, n_distinct = _distinct(np.concatenate(rows), np.concatenate(hashes), n)
        lines = np.unique(np.concatenate(line))
        n_lines, lines_distinct = _distinct(rows_of(offsets, lines), span_hashes(data, lines, np.append(lines[1:], len(data))), n)
        some = np.maximum(size, 1)[:, None]
        out[lo:hi, : CLASSES * CLASSES] = np.sqrt(pair / some)
        out[lo:hi, CLASSES * CLASSES : -6] = np.sqrt(single / some)
        out[lo:hi, -6:] = np.stack([
            np.log1p(size) / 10, n_distinct / np.maximum(n_words, 1), lines_distinct / np.maximum(n_lines, 1),
            letters / np.maximum(n_words, 1) / 10, np.log1p(size / np.maximum(n_lines, 1)) / 10, np.log1p(n_words) / 10,
        ], 1)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        w, b, o, c = self.params
        return np.tanh(np.clip((x - self.mean) * self.scale, -6, 6) @ w + b) @ o + c

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _descend(net: Network, x: np.ndarray, gradient, steps: int, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Adam; ``gradient(logits)`` gives the risk's derivative for each row."""
    x = np.clip((x - net.mean) * net.scale, -6, 6)
    m, v = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params]
    for step in range(1, steps + 1):
        w, b, o, c = net.params
        h = np.tanh(x @ w + b)
        g = gradient(h @ o + c)
        back = (g[:, None] * o) * (1 - h * h)
        grads = [x.T @ back + decay * w, back.sum(0), h.T @ g + decay * o, np.array(g.sum())]
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            net.params[i] = net.params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return net


def _fresh(x: np.ndarray, seed: int, prior: float) -> Network:
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), 1 / (x.std(0) + 1e-3)
    d = x.shape[1]
    return Network(mean, scale, [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(0.0)], prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> float:
    """Least ratio of shares above a threshold, smoothed by one row, over thresholds with enough positives."""
    x = np.concatenate([positive, unlabelled])
    y = np.r_[np.ones(len(positive)), np.zeros(len(unlabelled))]
    part = np.random.default_rng(seed).integers(0, 2, len(x))
    score = np.zeros(len(x))
    for k in (0, 1):
        fit, rest = part != k, part == k
        weight = np.where(y[fit] == 1, 0.5 / max(y[fit].sum(), 1), 0.5 / max((1 - y[fit]).sum(), 1))
        net = _descend(_fresh(x[fit], seed + k, 0.5), x[fit], lambda z, t=y[fit], q=weight: (1 / (1 + np.exp(-z)) - t) * q, 150, decay=1e-3)
        score[rest] = net.logit(x[rest])
    p, u = np.sort(score[y == 1]), np.sort(score[y == 0])
    # the unlabelled share in the low tail that positives leave empty
    cut = np.quantile(p, np.linspace(0.02, 0.5, 25))
    above_p = 1 - np.searchsorted(p, cut) / len(p)
    above_u = 1 - np.searchsorted(u, cut) / len(u)
    return float(np.clip(np.min((above_u + 1 / len(u)) / above_p), 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, seed: int = 1) -> Network:
    prior = class_prior(positive, unlabelled)
    x = np.concatenate([positive, unlabelled])
    n = len(positive)
    net = _fresh(x, seed, prior)

    def gradient(z: np.ndarray) -> np.ndarray:
        """Sigmoid loss l(z) = sigmoid(-z); where the negative part of the risk falls under 0, ascend it instead."""
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = s * (1 - s)
        negative = s[n:].mean() - prior * s[:n].mean()
        g = np.empty(len(z))
        if negative >= 0:
            g[:n] = -prior * slope[:n] / n - prior * slope[:n] / n
            g[n:] = slope[n:] / len(unlabelled)
        else:
            g[:n] = prior * slope[:n] / n
            g[n:] = -slope[n:] / len(unlabelled)
        return g

    return _descend(net, x, gradient, steps)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network | None:
    """Labels are read only where crc32 of the id modulo 5 isn't 0; other rows of the sample are unlabelled."""
    seen = labels.select(quoted(id_col).alias("_lid"), F.col(label_col).cast("int").alias("_y")).where("_lid is not null and _y = 1").where(fold("_lid", 5) != 0)
    order = F.xxhash64(F.lit(19), "_lid")
    good = seen.select("_lid").distinct().orderBy(order).limit(POSITIVES)  # at most POSITIVES numbers
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text")).where(F.octet_length("_text") <= SAMPLE_BYTES)
    fold_in = rows.where(F.coalesce(fold("_id", 5) != 0, F.lit(True)))
    positive = fold_in.join(F.broadcast(good), F.col("_id") == F.col("_lid")).select("_id", "_text").toArrow().sort_by("_id")
    ids = fold_in.select("_id").orderBy(F.xxhash64(F.lit(23), "_id")).limit(UNLABELLED).select(F.col("_id").alias("_lid"))
    web = fold_in.join(F.broadcast(ids.distinct()), F.col("_id") == F.col("_lid")).select("_id", "_text").toArrow().sort_by("_id")
    if not len(positive) or not len(web):
        return None
    return train(features(positive.column("_text").combine_chunks()), features(web.column("_text").combine_chunks()))


def scored(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            score = net.score(features(b.column(1))) if net is not None else np.ones(len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.asarray(score, np.float64))], names=["_id", "_score"])

    bound_batches(docs.sparkSession)
    src = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    return src.mapInArrow(run, f"_id {src.dtypes[0][1]}, _score double")


def quality_of(docs: DataFrame, labels: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = scored(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    held = F.coalesce(fold("_id", 5) == 0, F.lit(False))
    return out.select(F.col("_id").alias(id_col), held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= least).cast("int").alias("predicted"))
