"""Token ids of whole texts with one library call for each distinct chunk.

A text is cut before ASCII white space that follows a visible ASCII or Latin-1
character.  Both vocabularies used here end a pre-token there whatever stands
around it, so the ids of a text are the ids of its chunks in order.  Each worker
keeps the bytes and ids of the chunks it has met, up to ``KEEP`` of them and
``KEEP_BYTES`` bytes, then afresh.  They are found by a hash, and every chunk's
bytes are compared with those found: where they differ, the library gets the
chunk itself.  Long texts are taken in pieces of about ``SLICE`` bytes.

New chunks go to the library ``JOINED`` at a time with a mark between them, as
each call has a fixed cost.  A mark stands between two such places too, so all
marks' ids are found behind the chunks they follow; where more are found, chunks
hold some themselves, and the library gets these chunks one by one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from ._bytes import batches, span_hashes

KEEP = 1_000_000
KEEP_BYTES = 16 << 20
JOINED = 64
_MARK = "\n~"
SLICE = 1 << 20

_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_visible = np.zeros(256, bool)
_visible[33:127] = True


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        last, lead = data[:-1], np.zeros(len(data) - 1, np.uint8)
        lead[1:] = data[:-2]
        cut[1:-1] = _white[data[1:]] & (_visible[last] | ((lead == 0xC3) & (last >= 0x80)))
    cut[offsets] = True
    cut[len(data)] = False
    return np.flatnonzero(cut)


def pieces(data: np.ndarray, size: int = SLICE) -> Iterator[np.ndarray]:
    """A long text in pieces of whole chunks, of about ``size`` bytes or one chunk."""
    at = 0
    while at < len(data):
        reach, cut = size, 0
        while at + reach < len(data) and not cut:
            cut = int(chunk_starts(data[at : at + reach], np.array([0, reach]))[-1])
            reach *= 2
        yield data[at : at + cut] if cut else data[at:]
        at = at + cut if cut else len(data)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, one behind the other."""
    behind = np.cumsum(count)
    return np.arange(behind[-1] if len(behind) else 0) + np.repeat(first - (behind - count), count)


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # chunks come once; its cache only costs
        self.mark = self._alone([_MARK])[0]
        self.clear()

    def clear(self) -> None:
        self.keys, self.pool, self.bytes = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.slot = self.first = self.count = self.begin = self.size = np.zeros(0, np.int32)

    def _alone(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one behind the other, and how many each has."""
        found: list[list[int]] = [[]] * len(texts)
        apart, joinable = [], []
        for k, t in enumerate(texts):
            (joinable if t[0] in " \t\n\v\f\r" and "!" <= t[-1] <= "~" else apart).append(k)
        groups = [joinable[at : at + JOINED] for at in range(0, len(joinable), JOINED)]
        for group, ids in zip(groups, self._alone([_MARK.join([texts[k] for k in g]) for g in groups])):
            flat = np.array(ids, np.uint32)
            hit = flat[: len(flat) - len(self.mark) + 1] == self.mark[0]
            for k in range(1, len(self.mark)):
                hit &= flat[k : k + len(hit)] == self.mark[k]
            at = np.flatnonzero(hit).tolist()
            if len(at) != len(group) - 1:
                apart += group
                continue
            for k, a, z in zip(group, [0, *(x + len(self.mark) for x in at)], [*at, len(flat)]):
                found[k] = ids[a:z]
        for k, ids in zip(apart, self._alone([texts[k] for k in apart])):
            found[k] = ids
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum())), count

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        """``keys``: ascending, none of them known; their chunks' places in ``data``."""
        own = data[_runs(starts, size)]
        behind, raw = np.cumsum(size), own.tobytes()
        ids, count = self._ids([raw[a:z].decode() for a, z in zip((behind - size).tolist(), behind.tolist())])
        slot = len(self.first) + np.arange(len(keys))
        new = {"first": len(self.pool) + np.cumsum(count) - count, "count": count, "begin": len(self.bytes) + behind - size, "size": size}
        for name, values in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), values.astype(np.int32)]))
        self.pool, self.bytes = np.concatenate([self.pool, ids]), np.concatenate([self.bytes, own])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slot)

    def _chunks(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks (they cover ``data``) one behind the other, and where each chunk's end."""
        size = np.diff(starts, append=len(data))
        distinct, one, back = np.unique(span_hashes(data, starts, starts + size), return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > KEEP or len(self.bytes) > KEEP_BYTES:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(distinct[new], data, starts[one[new]], size[one[new]])
        slot = self.slot[np.searchsorted(self.keys, distinct)][back]
        wrong = self.size[slot] != size
        differs = self.bytes.take(_runs(self.begin[slot], size), mode="clip") != data
        if differs.any():
            wrong |= np.logical_or.reduceat(differs, starts)
        first, count = self.first[slot], self.count[slot]
        pool = self.pool
        if wrong.any():  # another chunk has this hash
            places, raw = np.flatnonzero(wrong), data.tobytes()
            ids, n = self._ids([raw[a : a + k].decode() for a, k in zip(starts[places].tolist(), size[places].tolist())])
            first[places], count[places] = len(pool) + np.cumsum(n) - n, n
            pool = np.concatenate([pool, ids])
        return pool[_runs(first, count)], np.cumsum(count)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row behind the last, ids of these rows, offsets of the rows in them)."""
        for lo, hi, data, offsets in batches(column, SLICE):
            if len(data) > SLICE:  # one long text
                ids = np.concatenate([self._chunks(piece, chunk_starts(piece, np.array([0, len(piece)])))[0] for piece in pieces(data)])
                yield lo, hi, ids, np.array([0, len(ids)])
                continue
            starts = chunk_starts(data, offsets)
            if not len(starts):
                yield lo, hi, np.zeros(0, np.uint32), np.zeros(hi - lo + 1, np.int64)
                continue
            ids, behind = self._chunks(data, starts)
            yield lo, hi, ids, np.concatenate([[0], behind])[np.searchsorted(starts, offsets)]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """A worker's encoder; one at a time is kept, so that reused workers stay small."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
