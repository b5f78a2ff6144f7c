"""Periodic run detection over words by multi-scale minimizers.

A run is a longest stretch of words whose smallest period q repeats at least
``REPEATS`` times and that has at least ``SHORTEST`` words.  Texts of a batch are one
line of word ids with a mark of its own behind each text.

* Periods under ``SHORT``: the line is compared with itself moved by each lag.
* Scale P (``SHORT``, then twice as much each time) serves periods from P to 2P - 1:
  every window of P places keeps its least hash of 2P words, the minimizers.  Inside
  a run windows repeat at the distance of the period, and so do their minimizers;
  2P words are more than a period, so they are found again at multiples of it only.
  So two neighbours among the equal minimizers of a run of at least four periods are
  one period apart.  Each such pair is a seed, extended to both sides by comparing
  words.  Hashes only choose seeds; what is returned was compared word by word.

A stretch whose smallest period is shorter is found at that period too, with the same
place, and goes.  Work is in proportion to the words at each scale, and a scale reads
only texts of at least four of its periods.

Defined cases: null and empty texts have no words and no runs; a text of one word
repeated has one run of period 1; repeated rows are rows of their own; extra columns
aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import bound_batches, quoted

REPEATS = 4
SHORTEST = 6
SHORT = 8
WORDS = 1 << 20  # words that are searched at once; a longer text is searched alone
PIECE = 4 << 20  # bytes of a text that are split at once
_SPACE = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


def _stretches(apart: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of at least ``least`` of n places, between the places in ``apart``."""
    edge = np.concatenate(([-1], apart, [n]))
    long = np.flatnonzero(np.diff(edge) > least)
    return edge[long] + 1, edge[long + 1]


def _sliding(f: Callable, a: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) of each ``width`` (a power of two) places."""
    step = 1
    while step < width:
        a = f(a[:-step], a[step:])
        step *= 2
    return a


def _seeds(x: np.ndarray, h: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """(period, place) where minimizers of hashes h (of 2 * scale words) are found again at a distance of this scale."""
    if len(h) < scale + 1:
        return []
    least = _sliding(np.minimum, h, scale)
    room = np.zeros(scale - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.maximum, np.concatenate((room, least, room)), scale) == h)
    value = h[chosen]
    order = np.argsort(value, kind="stable")
    value, place = value[order], chosen[order]
    gap = np.diff(place)
    some = np.flatnonzero((value[1:] == value[:-1]) & (gap >= scale) & (gap < 2 * scale))
    return sorted(zip(gap[some].tolist(), place[some].tolist()))


def _extended(x: np.ndarray, q: int, at: int) -> tuple[int, int]:
    """The stretch [first, end) around ``at`` in which each word equals the one q further on."""
    end, step = at, 64
    while end + q < len(x):
        a, b = x[end : end + step], x[end + q : end + q + step]
        differs = np.flatnonzero(a[: len(b)] != b)
        if len(differs):
            end += int(differs[0])
            break
        end, step = end + len(b), step * 2
    first, step = at, 64
    while first > 0:
        lo = max(0, first - step)
        differs = np.flatnonzero(x[lo:first] != x[lo + q : first + q])
        if len(differs):
            first = lo + int(differs[-1]) + 1
            break
        first, step = lo, step * 2
    return first, end


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text of word ids, by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))  # longest first: a scale reads a part of the line from its start
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    x = np.empty(begins[-1], np.int64)
    for k, i in enumerate(order):
        x[begins[k] : begins[k] + sizes[k]] = texts[i]
        x[begins[k] + sizes[k]] = -1 - k  # equals nothing
    found: dict[tuple[int, int], int] = {}

    def add(first: int, end: int, q: int) -> None:
        size = end - first + q
        if size >= max(SHORTEST, REPEATS * q):
            found[first, size] = min(q, found.get((first, size), q))

    def reach(q: int) -> int:
        """Where the texts end that can hold a run of this period."""
        return int(begins[np.searchsorted(-sizes, -max(SHORTEST, REPEATS * q), "right")])

    for q in range(1, SHORT):
        y = x[: reach(q)]
        if len(y) > q:
            apart = np.flatnonzero(y[q:] != y[:-q])
            for first, end in zip(*_stretches(apart, len(y) - q, max(SHORTEST - q, (REPEATS - 1) * q))):
                add(int(first), int(end), q)
    h, width, scale = x.astype(np.uint64), 1, SHORT
    while True:
        n = reach(scale)
        if n < REPEATS * scale:
            break
        h = h[: n - width + 1]
        while width < 2 * scale and len(h) > width:
            h = h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            width *= 2
        if width < 2 * scale:
            break
        known, end = 0, 0
        for q, at in _seeds(x, h, scale):
            if q != known or at >= end:  # not in the last stretch of this period
                first, end = _extended(x, q, at)
                known = q
                add(first, end, q)
        scale *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (first, size), q in found.items():
        k = int(np.searchsorted(begins, first, "right")) - 1
        out[order[k]].append((first - int(begins[k]), size, q))
    return [sorted(r, key=lambda r: (r[0], r[2])) for r in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run is cut to its first period."""
    kept = np.ones(n, bool)
    for start, size, q in runs:
        kept[start + q : start + size] = False
    return kept


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; ties to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


class Vocabulary(defaultdict):
    """Word -> number, new words get the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_numbers(raw: bytes, words: Vocabulary, size: int = PIECE) -> np.ndarray:
    """Numbers of a text's words; bytes.split() splits at just the six ASCII characters meant here."""
    found, at = [], 0
    while at < len(raw):
        cut = len(raw)
        if cut - at > size:
            cut = max(raw.rfind(c, at, at + size) for c in _SPACE)
            if cut <= at:  # a word of more than size bytes
                cut = min((c for c in (raw.find(c, at + size) for c in _SPACE) if c >= 0), default=len(raw))
        part = raw[at:cut].split()
        found.append(np.fromiter(map(words.__getitem__, part), np.int64, len(part)))
        at = cut if cut > at else cut + 1
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def joined(ids: np.ndarray, spelled: list[bytes], part: int = 1 << 20) -> Iterator[bytes]:
    """The words joined by one space, in parts."""
    for k in range(0, len(ids), part):
        yield (b" " if k else b"") + b" ".join(map(spelled.__getitem__, ids[k : k + part].tolist()))


def _batches(b: pa.RecordBatch) -> Iterator[tuple[list[int], list[np.ndarray], Vocabulary]]:
    """Rows, word numbers and words of texts that are searched together."""
    rows, texts, words, n = [], [], Vocabulary(), 0
    for k, text in enumerate(b.column(1)):
        texts.append(word_numbers((text.as_py() or "").encode(), words))
        rows.append(k)
        n += len(texts[-1])
        if n >= WORDS:
            yield rows, texts, words
            rows, texts, words, n = [], [], Vocabulary(), 0
    if rows:
        yield rows, texts, words


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each run: id, start, length, period (words) and the repeated words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for rows, texts, words in _batches(b):
                spelled, out = list(words), []
                for k, x, runs in zip(rows, texts, find_runs(texts)):
                    out += [(b.column(0)[k].as_py(), s, n, q, b"".join(joined(x[s : s + q], spelled)).decode()) for s, n, q in runs]
                cols = list(zip(*out)) if out else [[]] * 5
                kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[id_col, "start", "length", "period", "repeated"])

    bound_batches(docs.sparkSession)
    src = docs.select(quoted(id_col), quoted(text_col))
    return src.mapInArrow(run, f"`{id_col}` {src.dtypes[0][1]}, start long, length long, period long, repeated string")


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text with every run cut to its first period, words joined by one space."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for rows, texts, words in _batches(b):
                spelled = list(words)
                new = [b"".join(joined(x[kept_words(len(x), r)], spelled)).decode() for x, r in zip(texts, find_runs(texts))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(new, pa.string())], names=[id_col, text_col])

    bound_batches(docs.sparkSession)
    src = docs.select(quoted(id_col), quoted(text_col))
    return src.mapInArrow(run, f"`{id_col}` {src.dtypes[0][1]}, `{text_col}` string")


def with_repeats(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """A tenth of the documents, chosen by crc32 of the id, get a repeated end; for the digest query."""
    h, n = (zlib.crc32(str(doc_id).encode()), len(ids)) if doc_id is not None else (1, 0)
    if h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return ids[np.where(i < a, i, a + (i - a) % p)]


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document, with repeats planted by ``with_repeats``: n_runs, the strongest run, digests of all runs and of the collapsed text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for rows, texts, words in _batches(b):
                spelled, out = list(words), []
                texts = [with_repeats(x, b.column(0)[k].as_py()) for k, x in zip(rows, texts)]
                for k, x, runs in zip(rows, texts, find_runs(texts)):
                    top = strongest(runs)
                    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode())
                    text = hashlib.sha256()
                    for part in joined(x[kept_words(len(x), runs)] if runs else x, spelled):
                        text.update(part)
                    out.append((b.column(0)[k].as_py(), len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, listed.hexdigest(), text.hexdigest()))
                names = [id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
                kinds = [b.schema.field(0).type, *[pa.int64()] * 5, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)

    bound_batches(docs.sparkSession)
    src = docs.select(quoted(id_col), quoted(text_col))
    return src.mapInArrow(run, f"`{id_col}` {src.dtypes[0][1]}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
