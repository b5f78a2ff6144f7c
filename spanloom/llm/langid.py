"""Language identification: a byte convolutional network.

Bytes are embedded, convolved with filters of widths 2, 3 and 4, max-pooled over
fixed-length windows and classified by softmax.  Training is numpy code on the
driver, on windows of a bounded sample (``SAMPLE`` documents for each language,
one window of ``WINDOW`` bytes each).  Prediction runs over all windows of the
whole text; a document's class probabilities are the mean of its windows',
weighted by their bytes.

A convolution over embedded bytes is linear, so workers tabulate it: the two
bytes of a pair share one table row, and a filter's response is a sum of at most
two rows.

Defined cases: ``und`` with score 0 where the text is null, empty or has no
letter; ties go to the smaller language name; if no labelled row can be learned
from, every text is ``und``; extra columns are not read, or carried along whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import batches
from ._common import bound_batches, fold, quoted, rowed, unrowed

WINDOW = 256
SAMPLE = 1500
SALTS = 4
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8

#: ASCII letters in lower case, other ASCII as a space; bytes from 128 stay
_plain = np.full(256, 32, np.uint8)
for _c in range(256):
    if 97 <= _c < 123 or _c >= 128:
        _plain[_c] = _c
    elif 65 <= _c < 91:
        _plain[_c] = _c + 32


@dataclass
class ByteCnn:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # width * EMBED x FILTERS, for each width
    bias: list[np.ndarray]
    out: np.ndarray  # filters of all widths x languages
    out_bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width: responses of the first pair of bytes and of what follows it."""
        e, made = self.embed, []
        for width, f, b in zip(WIDTHS, self.filters, self.bias):
            taps = [e @ f[k * EMBED : (k + 1) * EMBED] for k in range(width)]
            first = (taps[0][:, None] + taps[1][None] + b).reshape(65536, FILTERS).astype(np.float32)
            rest = None if width == 2 else taps[2].astype(np.float32) if width == 3 else (taps[2][:, None] + taps[3][None]).reshape(65536, FILTERS).astype(np.float32)
            made.append((first, rest))
        return made


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows, padded by zeros: matrix of bytes, row and length of each window."""
    lengths = np.diff(offsets)
    count = -(-lengths // size)
    row = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + nth * size
    used = np.minimum(size, offsets[row + 1] - start)
    padded = np.concatenate([_plain[data], np.zeros(size, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(padded, size)[start].copy()
    short = np.flatnonzero(used < size)
    x[short] *= np.arange(size) < used[short, None]
    return x, row, used


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def pooled(x: np.ndarray, tables: list, step: int = 64) -> np.ndarray:
    out = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
    for at in range(0, len(x), step):
        w = x[at : at + step]
        pair = w[:, :-1].astype(np.int32) * 256 + w[:, 1:]
        for k, (first, rest) in enumerate(tables):
            if rest is None:
                r = first.take(pair, axis=0)
            elif WIDTHS[k] == 3:
                r = first.take(pair[:, :-1], axis=0)
                r += rest.take(w[:, 2:], axis=0)
            else:
                r = first.take(pair[:, :-2], axis=0)
                r += rest.take(pair[:, 2:], axis=0)
            out[at : at + step, k * FILTERS : (k + 1) * FILTERS] = r.max(1)
    return np.maximum(out, 0)


def train(texts: list[bytes], labels: np.ndarray, langs: list[str], steps: int = 500, batch: int = 64, seed: int = 5) -> ByteCnn:
    """Adam on the cross entropy of windows; max pooling sends gradients to one place for each filter."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.5, (256, EMBED))]
    params += [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)) for w in WIDTHS]
    params += [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), np.zeros(len(langs))]
    params[0][0] = 0
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n = len(WIDTHS)
    by_class = [np.flatnonzero(labels == k) for k in range(len(langs))]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(c, batch // len(langs) + 1) for c in by_class])
        x = np.zeros((len(pick), WINDOW), np.uint8)
        for k, i in enumerate(pick):
            t = texts[i][: int(rng.integers(24, WINDOW + 1)) if rng.random() < 0.4 else WINDOW]
            x[k, : len(t)] = _plain[np.frombuffer(t, np.uint8)]
        e = params[0][x]
        hidden, where, patches = [], [], []
        for k, w in enumerate(WIDTHS):
            p = np.concatenate([e[:, t : WINDOW - w + 1 + t] for t in range(w)], 2)
            r = p @ params[1 + k] + params[1 + n + k]
            arg = r.argmax(1)
            hidden.append(np.take_along_axis(r, arg[:, None], 1)[:, 0])
            where.append(arg)
            patches.append(p)
        h = np.concatenate(hidden, 1)
        a = np.maximum(h, 0)
        g = _softmax(a @ params[-2] + params[-1])
        g[np.arange(len(pick)), labels[pick]] -= 1
        g /= len(pick)
        grads = [np.zeros_like(p) for p in params]
        grads[-2], grads[-1] = a.T @ g + 1e-4 * params[-2], g.sum(0)
        back = (g @ params[-2].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            b, arg = back[:, k * FILTERS : (k + 1) * FILTERS], where[k]
            spot = np.take_along_axis(patches[k], arg[:, :, None], 1)  # sample x filter x taps
            grads[1 + k] = np.einsum("sft,sf->tf", spot, b)
            grads[1 + n + k] = b.sum(0)
            into = b[:, :, None] * params[1 + k].T[None]
            for t in range(w):
                byte = np.take_along_axis(x, arg + t, 1)
                np.add.at(grads[0], byte.ravel(), into[:, :, t * EMBED : (t + 1) * EMBED].reshape(-1, EMBED))
        grads[0][0] = 0
        for i, grad in enumerate(grads):
            m[i] += 0.1 * (grad - m[i])
            v[i] += 0.001 * (grad * grad - v[i])
            params[i] -= 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return ByteCnn(langs, params[0], params[1 : 1 + n], params[1 + n : 1 + 2 * n], params[-2], params[-1])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> ByteCnn | None:
    """Learn from rows with a language that aren't held out (crc32 of the id modulo 4 is 2)."""
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"), quoted(lang_col).alias("_lang"))
    seen = rows.where(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}") & F.coalesce(fold("_id", 4) != 2, F.lit(True)))
    order = F.xxhash64(F.lit(11), F.col("_id"))
    raw = F.col("_text")
    place = F.pmod(F.xxhash64(F.lit(13), F.col("_id")), F.greatest(F.length(raw) - WINDOW, F.lit(0)) + 1).cast("int") + 1
    cuts = seen.select(F.col("_lang").alias("lang"), raw.substr(place, F.lit(WINDOW)).alias("piece"), order.alias("order"))
    # a few salts each, so that tasks drop what can't be in the sample before the exchange
    cuts = cuts.withColumn("salt", F.pmod("order", F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("order"))
    rows = cuts.withColumn("rank", rank).where(F.col("rank") <= max(1, sample // SALTS)).select("lang", "piece").toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    if not langs:
        return None
    labels = np.array([langs.index(x) for x in rows.column("lang").to_pylist()])
    return train([t.encode()[:WINDOW] for t in rows.column("piece").to_pylist()], labels, langs)


_ready: dict[int, list] = {}


def tables_of(model: ByteCnn) -> list:
    """A worker's tables, made once for each model."""
    key = hash(model.out.tobytes())
    if key not in _ready:
        _ready.clear()
        _ready[key] = model.tables()
    return _ready[key]


def identify(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Whole documents -> _id (or all columns in _row), _lang, _score."""
    src = docs.select(rowed(docs)) if carry else docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    place = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None if model is None else tables_of(model)
        for b in it:
            text = pc.struct_field(b.column(0), [place]) if carry else b.column(1)
            lang, score = np.full(len(b), "und", object), np.zeros(len(b))
            if model is not None:
                lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                for lo, hi, data, offsets in batches(text, 1 << 20):
                    x, row, used = windows(data, offsets)
                    p = _softmax(pooled(x, tables) @ model.out + model.out_bias) * used[:, None]
                    total = np.stack([np.bincount(row, p[:, k], hi - lo).astype(float) for k in range(p.shape[1])], 1)
                    total /= np.maximum(np.diff(offsets), 1)[:, None]
                    best, ok = total.argmax(1), lettered[lo:hi]
                    lang[lo:hi][ok] = np.array(model.langs, object)[best][ok]
                    score[lo:hi][ok] = np.clip(total[np.arange(hi - lo), best][ok], 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=[b.schema.names[0], "_lang", "_score"])

    bound_batches(docs.sparkSession)
    schema = src.drop("_text").schema.add("_lang", "string").add("_score", "double")
    return src.mapInArrow(run, schema)


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    out = identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    held = F.coalesce(fold("_id", 4) == 2, F.lit(False))
    return out.select(F.col("_id").alias(id_col), held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows whose text has a learned language with a score of ``least`` at least."""
    out = identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col, carry=True)
    return unrowed(out.where((F.col("_lang") != "und") & (F.col("_score") >= least)), docs.columns)
