"""Vectorised work on the UTF-8 bytes of a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ALL = (1 << 64) - 1
#: spans are hashed in windows of so many bytes, so that tables and sums stay small whatever a text's size
WINDOW = 1 << 18


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one behind the other, and the offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_utf8()), "")
    _, offs, data = a.buffers()
    o = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1]
    if not len(o):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def batches(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(column)
    for lo, hi in slices(offsets, limit):
        o = offsets[lo : hi + 1]
        yield lo, hi, data[o[0] : o[-1]], o - o[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _cumulated(base: int) -> np.ndarray:
    p = np.full(WINDOW + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


_forth, _back = _cumulated(_BASE), _cumulated(_INVERSE)


def _prefix(data: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _forth[: len(data)], out=prefix[1:])
    return prefix


def _finished(polynomial: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(polynomial + sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _long_span(data: np.ndarray) -> int:
    total, shift = 0, 1
    for at in range(0, len(data), WINDOW):
        total = total + int(_prefix(data[at : at + WINDOW])[-1]) * shift & _ALL
        shift = shift * pow(_BASE, WINDOW, 1 << 64) & _ALL
    return total


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, beginnings: tuple[int, ...] = ()):
    """64-bit hash of each span's bytes: a polynomial from prefix sums, then mixed with the length.

    Starts and ends ascend.  With ``beginnings``: also, for each number n of them,
    the places of the spans of over n bytes and the hashes of their first n bytes.
    """
    out, begun = np.empty(len(starts), np.uint64), [([], []) for _ in beginnings]
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + WINDOW, "right"))
        whole = to > at
        to = max(to, at + 1)
        s, e = starts[at:to] - base, ends[at:to] - base
        window = data[base : base + min(int(e[-1]), WINDOW)]
        prefix = _prefix(window)
        if whole:
            out[at:to] = _finished((prefix[e] - prefix[s]) * _back[s], e - s)
        else:
            out[at] = _finished(np.array([_long_span(data[base : base + int(e[0])])], np.uint64), e)[0]
        for n, (places, hashes) in zip(beginnings, begun):
            longer = np.flatnonzero(e - s > n)
            places.append(longer + at)
            hashes.append(_finished((prefix[s[longer] + n] - prefix[s[longer]]) * _back[s[longer]], np.full(len(longer), n)))
        at = to
    if not beginnings:
        return out
    none = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    return out, [(np.concatenate(none[0] + p), np.concatenate(none[1] + h)) for p, h in begun]


_word = np.zeros(256, np.uint8)
for _c in range(256):
    if 48 <= _c < 58 or 97 <= _c < 123 or _c >= 128:
        _word[_c] = _c
    elif 65 <= _c < 91:
        _word[_c] = _c + 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words: runs of ASCII letters, digits and bytes from 128."""
    low = _word[data]
    inside = low != 0
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    return low, np.flatnonzero(inside & ~before[:-1]), np.flatnonzero(inside & ~after[1:]) + 1


def word_pieces(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, offsets) of pieces of about ``size`` bytes that no word straddles; a long word stays whole."""
    if len(data) <= size:
        yield 0, data, offsets
        return
    at = 0
    while at < len(data):
        to = min(at + size, len(data))
        while to < len(data):
            gap = np.flatnonzero(_word[data[at:to][::-1][:65536]] == 0)
            if len(gap):
                to -= int(gap[0])
                break
            to = min(to + size, len(data))
        inner = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to, "left")]
        yield at, data[at:to], np.concatenate([[at], inner, [to]]) - at
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words."""
    low, starts, ends = word_spans(data, offsets)
    return starts, ends, span_hashes(low, starts, ends)


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and their rows; long data in pieces."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for at, piece, inner in word_pieces(data, offsets):
        starts, _, h = words(piece, inner)
        hashes.append(h)
        rows.append(rows_of(offsets, starts + at).astype(np.int32))
    return np.concatenate(hashes), np.concatenate(rows)


def rows_of(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, places, "right") - 1
