"""Token-id files: an adaptive context-mixing range coder over independent blocks.

A block holds up to ``BLOCK`` ids of 16 bits.  Ids are named by their order of
appearance in the block.  Order 2 and order 1 each predict what last followed the
last two ids and the last id.  Whether such a candidate comes is a binary event:
orders 2, 1 and 0 each give a probability for it (by how often the prediction was
right in its context, and by the candidate's own frequency), and a logistic
mixer blends them with weights that it learns online.  A second candidate, where
orders 2 and 1 differ, gets an event of its own.  Other ids are coded by adaptive
order-0 frequencies of the ids seen so far, with an escape to ids not yet seen:
adaptive frequencies of their high six bits and even low bits.  All this narrows
one interval of a range coder with 16-bit output.  Every block starts from nothing and has a crc32
of its ids, so blocks decode alone and in any order.

Blocks are coded side by side: one numpy lane for each block, one step for each
id; all state is adapted after each id.  All arithmetic is on integers, so any
machine decodes what another wrote.

Segment format (little endian): magic ``SLT3``; u32 documents, u32 blocks, u64
ids; per document i64 count of ids; per block u32 ids, u32 bytes, u32 crc32;
then the blocks' bytes.  Document ids travel in a column beside the segment.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import encoder
from ._common import bound_batches, fresh_path, quoted, running_offsets

BLOCK = 2048
LANES = 2048
SEGMENT_IDS = BLOCK * LANES
MAGIC = b"SLT3"

_U = np.uint64
_SHIFT, _LEAST = _U(16), _U(1 << 48)
_HEAVY = 1 << 18  # of a weight, where 1 << 16 is one
_WIDE_BITS, _WIDE = 6, 64  # names of a group of order-0 frequencies, and classes of ids not yet seen
_GROUPS = BLOCK // _WIDE
#: what a name (rows 0 to 63) and a new one (the other rows) add to the sums behind it
_ABOVE = np.array([[more * (k > place) for k in range(_WIDE)] for more in (2, 1) for place in range(_WIDE)], np.int16)
_ABOVE_GROUP = _ABOVE[:, :_GROUPS].copy()
_ABOVE_CLASS = np.array([[4 * (high < k <= _WIDE) for k in range(_WIDE + 8)] for high in range(_WIDE)], np.int32)
#: log odds in units of 1 / 256 of probabilities in units of 1 / 4096, and back from log odds + 2048
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)])
_SQUASH = np.array([min(4080, max(16, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2048, 2048)])
#: log2 of a number, whole part
_LOG = np.array([max(n, 1).bit_length() - 1 for n in range(1 << 14)])

#: first probabilities, of 65536: by order 2 (none, then its run of right predictions), by order 1 (none, runs where it agrees, runs where it differs) and by order 0 (log2 of one over the share)
_FIRST = (
    np.array([20000, 24000, 40000, 52000, 60000]),
    np.array([12000, 26000, 42000, 54000, 61000, 16000, 14000, 12000, 10000]),
    np.clip(60000 - 5000 * np.arange(16), 2000, None),
)
#: for the second candidate: by order 1's run and order 2's, and by order 0
_SECOND = (np.repeat([7000, 14000, 22000, 30000], 4), np.clip(40000 - 4000 * np.arange(16), 1500, None))


def _true(rows: np.ndarray) -> np.ndarray:
    """How many of each row are true; the rows' length is a multiple of eight."""
    return np.bitwise_count(rows.view(_U)).sum(1, dtype=np.int64)


def _add_rows(to: np.ndarray, rows: np.ndarray, more: np.ndarray) -> None:
    """``to[rows] += more`` of whole rows, all different."""
    more += to.take(rows, 0, mode="clip")
    kind = f"V{to.dtype.itemsize * to.shape[1]}"
    to.view(kind).ravel()[rows] = more.view(kind).ravel()


class _Event:
    """Mixer of adaptive probabilities: for each order a table and a weight in every lane."""

    def __init__(self, lanes: int, first: tuple[np.ndarray, ...], weight: int):
        self.table = np.concatenate([np.tile(t, lanes) for t in first]).astype(np.int64)
        sizes = [len(t) for t in first]
        self.base = np.array([np.arange(lanes) * n + lanes * sum(sizes[:k]) for k, n in enumerate(sizes)])
        self.weights = np.full((len(first), lanes), weight, np.int64)

    def mixed(self, contexts: np.ndarray) -> np.ndarray:
        """Probabilities of 4096; contexts: (orders, lanes)."""
        contexts += self.base
        self.at = contexts
        self.old = self.table.take(contexts, mode="wrap")
        self.odds = _STRETCH.take(self.old >> 4, mode="wrap")
        dot = (self.odds * self.weights).sum(0)
        dot >>= 16
        dot += 2048
        self.p = _SQUASH.take(dot, mode="clip")
        return self.p

    def learn(self, right: np.ndarray, counts: np.ndarray) -> None:
        """Lanes whose ``counts`` is 0 didn't have the event."""
        target = (right * 65535 - self.old) * counts
        target >>= 4
        target += self.old
        self.table[self.at] = target
        error = ((right << 12) - self.p) * (counts * 6)
        step = self.odds * error
        step += 32768
        step >>= 16
        step += self.weights
        np.minimum(step, _HEAVY, out=step)
        self.weights = np.maximum(step, -_HEAVY, out=step)


class _Model:
    """State of all lanes: names ids, predicts names, and learns each name."""

    def __init__(self, lanes: int):
        self.lanes = np.arange(lanes)
        self.row, self.group_row = self.lanes * BLOCK, self.lanes * _GROUPS
        self.behind = lanes * BLOCK
        self.followers = np.zeros(2 * lanes * BLOCK, np.int16)  # by order 1, then by order 2: (name + 1) << 2 | run of right predictions
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.place = np.zeros((2, lanes), np.int64)
        self.count = np.zeros(lanes * BLOCK, np.int16)
        self.groups = np.full((lanes, _GROUPS), 1 << 14, np.int16)  # sums of all smaller groups, where a group is open
        self.inside = np.zeros((lanes * _GROUPS, _WIDE), np.int16)  # sums of all smaller names of the group
        self.total = np.zeros(lanes, np.int64)
        self.names = np.zeros(lanes, np.int64)
        self.classes = np.tile(np.append(np.arange(_WIDE + 1), [1 << 30] * 7).astype(np.int32), (lanes, 1))  # sums of all smaller classes, and of all
        self.first, self.second = _Event(lanes, _FIRST, 30000), _Event(lanes, _SECOND, 40000)

    def predict(self) -> None:
        """Both candidates and their probabilities of 4096 (0: none)."""
        np.add(self.row, self.last, out=self.place[0])
        np.add(((self.last * 40503 + self.before * 30011) >> 4) & (BLOCK - 1), self.row + self.behind, out=self.place[1])
        e = self.followers.take(self.place, mode="wrap").astype(np.int64)
        self.run, has = e & 3, (e > 0).astype(np.int64)
        e >>= 2
        e -= 1
        self.guess = e
        (one, two), (n1, n2), (has1, has2) = e, self.run, has
        self.one = one
        self.cand = np.where(has2, two, one)
        differ = (one != two) & has2
        self.has, self.both = has1 | has2, differ & has1
        near = self.count.take(np.array([self.cand, one]) + self.row, mode="wrap")
        share = _LOG.take(self.total, mode="wrap") - _LOG.take(near, mode="wrap")
        self.pa = self.first.mixed(np.array([(n2 + 1) * has2, (n1 + 1 + 4 * differ) * has1, share[0]])) * self.has
        self.pb = self.second.mixed(np.array([n1 * 4 + n2, share[1]])) * self.both

    def frequencies(self, lanes: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and share of names in order 0; of names not yet seen, the escape's."""
        new = name == self.names[lanes]
        at = np.minimum(name, BLOCK - 1)
        self.group, self.inner = self.group_row[lanes] + (at >> _WIDE_BITS), at & (_WIDE - 1)
        start = self.groups.ravel().take(self.group).astype(np.int64) + self.inside.ravel().take((self.group << _WIDE_BITS) + self.inner)
        share = self.count.take(self.row[lanes] + at)
        return np.where(new, self.total[lanes], start).view(_U), np.where(new, self.names[lanes] + 1, share).view(_U)

    def find(self, lanes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Names whose order-0 interval holds ``place``."""
        small = place.astype(np.int16)
        group = _true(self.groups.take(lanes, 0) <= small[:, None]) - 1
        at = self.group_row[lanes] + group
        small -= self.groups.ravel().take(at)
        inner = _true(self.inside.take(at, 0) <= small[:, None])
        return np.where(place >= self.total[lanes], self.names[lanes], group * _WIDE + inner - 1)

    def update(self, name: np.ndarray, right: np.ndarray, right_second: np.ndarray, rest: np.ndarray) -> None:
        self.first.learn(right.astype(np.int64), self.has)
        self.second.learn(right_second.astype(np.int64), self.both & ~right)
        entry = ((name + 1) << 2) + np.minimum(self.run + 1, 3) * (self.guess == name)
        self.followers[self.place] = entry.astype(np.int16)
        self.before, self.last = self.last, name
        # order 0 learns what reached it: 2 more for a name, 1 for a new one
        x, n = name[rest], self.names[rest]
        new = x == n
        if new.any():
            opens = rest[new & (self.inner == 0)]
            self.groups[opens, name[opens] >> _WIDE_BITS] = self.total[opens]
        more = np.subtract(2, new, dtype=np.int16)
        self.count[self.row[rest] + x] += more
        kind = new * _WIDE
        _add_rows(self.groups, rest, _ABOVE_GROUP.take((x >> _WIDE_BITS) + kind, 0, mode="clip"))
        _add_rows(self.inside, self.group, _ABOVE.take(self.inner + kind, 0, mode="clip"))
        self.total[rest] += more
        self.names[rest] = n + new

    def class_frequencies(self, lanes: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = lanes * (_WIDE + 8) + high
        start, behind = self.classes.ravel().take(np.array([at, at + 1])).astype(np.int64)
        return start.view(_U), (behind - start).view(_U)

    def class_total(self, lanes: np.ndarray) -> np.ndarray:
        return self.classes[lanes, _WIDE].astype(np.int64)

    def find_class(self, lanes: np.ndarray, place: np.ndarray) -> np.ndarray:
        return _true(self.classes.take(lanes, 0) <= place.astype(np.int32)[:, None]) - 1

    def update_class(self, lanes: np.ndarray, high: np.ndarray) -> None:
        _add_rows(self.classes, lanes, _ABOVE_CLASS.take(high, 0))


def _names(ids: np.ndarray) -> np.ndarray:
    """Each id's order of first appearance in its row."""
    lanes, steps = ids.shape
    key = (np.arange(lanes)[:, None] << 16 | ids).ravel()
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    new = np.zeros(lanes * steps, bool)
    new[first] = True
    nth = np.cumsum(new.reshape(lanes, steps), 1).ravel() - 1
    return nth[first][back].reshape(lanes, steps)


def encode_blocks(ids: np.ndarray, last: int) -> list[bytes]:
    """Blocks' bytes.  ids: (lanes, steps); the last block has ``last`` ids, the others ``steps``."""
    lanes, steps = ids.shape
    model, width = _Model(lanes), 2 * steps + 12
    out, used = np.zeros(lanes * width, np.uint16), np.arange(lanes) * width
    low, span = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
    ends = np.zeros(lanes, np.int64)

    def finish(lane: slice) -> None:
        """Write the rest of these lanes; what they code later starts anew behind it."""
        for _ in range(4):
            out[used[lane]] = low[lane] >> _U(48)
            used[lane] += 1
            low[lane] <<= _SHIFT
        span[lane] = ~_U(0)
        ends[lane] = used[lane]

    def move(where: np.ndarray, over: np.ndarray, left: np.ndarray) -> None:
        """Carry, for lanes whose low ends ran over, and write what is settled of lanes of small spans."""
        place = used[where[over]] - 1
        while len(place):
            out[place] += np.uint16(1)
            place = place[out[place] == 0] - 1
        shift = where[left < _LEAST]
        while len(shift):
            l, s, at = low[shift], span[shift] << _SHIFT, used[shift]
            out[at] = l >> _U(48)
            used[shift] = at + 1
            low[shift], span[shift] = l << _SHIFT, s
            shift = shift[s < _LEAST]

    tokens = np.ascontiguousarray(ids.T, np.int64)
    for step, name in enumerate(np.ascontiguousarray(_names(ids.astype(np.int64)).T)):
        if step == last:
            finish(slice(lanes - 1, lanes))
        model.predict()
        part = (span >> _U(12)) * model.pa.view(_U)
        right = (name == model.cand) & (model.has > 0)
        to, left = low + part * ~right, np.where(right, part, span - part)
        right_second = (name == model.one) & (model.both > 0)
        part = (left >> _U(12)) * (model.pb * ~right).view(_U)
        to += part * ~right_second
        left = np.where(right_second, part, left - part)
        rest = np.flatnonzero(~(right | right_second))
        own = name[rest]
        start, share = model.frequencies(rest, own)
        unit = left[rest] // (model.total[rest] + model.names[rest] + 1).view(_U)
        to[rest] += unit * start
        left[rest] = unit * share
        over, low, span = to < low, to, left
        move(model.lanes, over, left)
        new = rest[own == model.names[rest]]
        if len(new):
            token = tokens[step, new]
            start, share = model.class_frequencies(new, token >> 10)
            unit = span[new] // model.class_total(new).view(_U)
            fine = unit * share >> _U(10)
            before = low[new]
            to = before + unit * start + fine * (token & 1023).view(_U)
            low[new], span[new] = to, fine
            move(new, to < before, fine)
            model.update_class(new, token >> 10)
        model.update(name, right, right_second, rest)
    finish(slice(lanes - (last < steps)))
    return [out[k * width : ends[k]].astype("<u2").tobytes() for k in range(lanes)]


def decode_blocks(blocks: list[bytes], steps: int) -> np.ndarray:
    """The first ``steps`` ids of each block: (lanes, steps)."""
    lanes = len(blocks)
    model, width = _Model(lanes), max(map(len, blocks)) // 2 + 8
    words = np.zeros((lanes, width), np.uint16)
    for k, b in enumerate(blocks):
        words[k, : len(b) // 2] = np.frombuffer(b, "<u2", len(b) // 2)
    w = words[:, :4].astype(_U)
    code = w[:, 0] << _U(48) | w[:, 1] << _U(32) | w[:, 2] << _U(16) | w[:, 3]
    words, used, behind = words.ravel(), np.arange(lanes) * width + 4, lanes * width - 1
    span = np.full(lanes, ~_U(0))
    named = np.zeros(lanes * BLOCK, np.uint16)
    out = np.zeros((steps, lanes), np.uint32)

    def move(where: np.ndarray, left: np.ndarray) -> None:
        shift = where[left < _LEAST]
        while len(shift):
            s, at = span[shift] << _SHIFT, used[shift]
            code[shift] = code[shift] << _SHIFT | words[np.minimum(at, behind)]
            used[shift] = at + 1
            span[shift] = s
            shift = shift[s < _LEAST]

    for step in range(steps):
        model.predict()
        part = (span >> _U(12)) * model.pa.view(_U)
        right = code < part
        code, span = code - part * ~right, np.where(right, part, span - part)
        part = (span >> _U(12)) * (model.pb * ~right).view(_U)
        right_second = code < part
        code -= part * ~right_second
        span = np.where(right_second, part, span - part)
        name = np.where(right_second, model.one, model.cand)
        # where neither event was possible both parts are 0
        rest = np.flatnonzero(~(right | right_second))
        total = model.total[rest] + model.names[rest] + 1
        unit = span[rest] // total.view(_U)
        own = model.find(rest, np.minimum((code[rest] // unit).view(np.int64), total - 1))
        name[rest] = own
        start, share = model.frequencies(rest, own)
        code[rest] -= unit * start
        span[rest] = unit * share
        move(model.lanes, span)
        new = rest[own == model.names[rest]]
        if len(new):
            total = model.class_total(new)
            unit = span[new] // total.view(_U)
            high = model.find_class(new, np.minimum((code[new] // unit).view(np.int64), total - 1))
            start, share = model.class_frequencies(new, high)
            fine = unit * share >> _U(10)
            inner = code[new] - unit * start
            lower = np.minimum(inner // fine, _U(1023))
            code[new], span[new] = inner - fine * lower, fine
            move(new, fine)
            named[model.row[new] + np.minimum(name[new], BLOCK - 1)] = high << 10 | lower.view(np.int64)
            model.update_class(new, high)
        out[step] = named.take(model.row + name, mode="wrap")
        model.update(name, right, right_second, rest)
    return out.T


def pack_segment(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """One segment: the ids of whole documents and how many each has."""
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("ids of more than 16 bits")
    n_blocks = -(-len(ids) // BLOCK)
    lengths = np.full(n_blocks, BLOCK)
    if n_blocks:
        lengths[-1] = len(ids) - BLOCK * (n_blocks - 1)
    body, meta = [], []
    for at in range(0, n_blocks, LANES):
        own = lengths[at : at + LANES]
        flat = ids[at * BLOCK : at * BLOCK + int(own.sum())]
        matrix = np.zeros((len(own), int(own.max())), np.uint32)
        matrix.ravel()[: len(flat)] = flat  # only a segment's last block is shorter
        for k, b in enumerate(encode_blocks(matrix, int(own[-1]))):
            meta.append((int(own[k]), len(b), zlib.crc32(matrix[k, : own[k]].astype("<u4").tobytes())))
            body.append(b)
    head = MAGIC + struct.pack("<IIQ", len(counts), n_blocks, len(ids))
    return head + counts.astype("<i8").tobytes() + np.array(meta, "<u4").reshape(-1, 3).tobytes() + b"".join(body)


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts); raises ValueError where a checksum or the format doesn't hold."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, n_blocks, total = struct.unpack_from("<IIQ", data, 4)
    at = 20
    counts = np.frombuffer(data, "<i8", docs, at)
    at += 8 * docs
    meta = np.frombuffer(data, "<u4", 3 * n_blocks, at).reshape(-1, 3).astype(np.int64)
    at += 12 * n_blocks
    begins = at + np.cumsum(meta[:, 1]) - meta[:, 1]
    out = []
    for first in range(0, n_blocks, LANES):
        own = meta[first : first + LANES]
        blocks = [data[b : b + n] for b, n in zip(begins[first : first + LANES].tolist(), own[:, 1].tolist())]
        matrix = decode_blocks(blocks, int(own[:, 0].max()))
        for k, (n, _, crc) in enumerate(own.tolist()):
            ids = np.ascontiguousarray(matrix[k, :n], dtype="<u4")
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError(f"block {first + k} has a wrong checksum")
            out.append(ids)
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    if len(ids) != total or counts.sum() != total:
        raise ValueError("a segment's counts don't agree")
    return ids, counts


def write_token_files(docs: DataFrame, vocabulary: str, path: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text in ascending id order and write segments: _part, _seg, ids of the documents, payload."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seg = encoder(vocabulary), TaskContext.get().partitionId(), 0
        keys: list = []
        tokens: list[np.ndarray] = []
        counts: list[int] = []
        held, kind = 0, None

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(tokens)
            payload = pack_segment(ids, np.array(counts, np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int64()), pa.array([keys], pa.list_(kind)), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())],
                names=["_part", "_seg", "_ids", "_tokens", "_payload"],
            )

        end = np.array([end_id], np.uint32)
        for b in it:
            kind = b.schema.field(0).type
            names = b.column(0).to_pylist()
            for lo, hi, ids, offsets in enc.encode(b.column(1)):
                for k in range(hi - lo):
                    own = np.concatenate([ids[offsets[k] : offsets[k + 1]], end])
                    keys.append(names[lo + k])
                    tokens.append(own)
                    counts.append(len(own))
                    held += len(own)
                    if held >= SEGMENT_IDS:
                        yield flush()
                        keys, tokens, counts, held, seg = [], [], [], 0, seg + 1
        if counts:
            yield flush()

    bound_batches(docs.sparkSession)
    src = docs.select(quoted(id_col).alias("_id"), F.coalesce(quoted(text_col), F.lit("")).alias("_text"))
    # the other keys split an id, or a row, that repeats many times; the first alone orders
    src = src.withColumn("_tie", F.xxhash64("_text")).withColumn("_nth", F.monotonically_increasing_id())
    src = src.repartitionByRange("_id", "_tie", "_nth").sortWithinPartitions("_id", "_tie", "_nth").select("_id", "_text")
    kind = src.dtypes[0][1]
    src.mapInArrow(run, f"_part int, _seg long, _ids array<{kind}>, _tokens long, _payload binary").write.parquet(path)


def read_token_files(files: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Every document of the files: id, _part, _seg, _place (ids before it in its segment), n_tokens, ids_crc32 (and its ids)."""
    kind = dict(files.dtypes)["_ids"][len("array<") : -1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, seg, keys, payload in zip(*(b.column(k) for k in range(4))):
                ids, counts = unpack_segment(payload.as_py())
                behind = np.cumsum(counts)
                begins = behind - counts
                crcs = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(begins.tolist(), behind.tolist())]
                n = len(counts)
                columns = [keys.values, pa.array([part.as_py()] * n, pa.int32()), pa.array([seg.as_py()] * n, pa.int64()), pa.array(begins), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())]
                names = [id_col, "_part", "_seg", "_place", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:z].tolist() for a, z in zip(begins, behind)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    bound_batches(files.sparkSession)
    schema = f"`{id_col}` {kind}, _part int, _seg long, _place long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.select("_part", "_seg", "_ids", "_payload").mapInArrow(run, schema)


def token_file_digest(docs: DataFrame, vocabulary: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files, read them back: id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_token_files(docs, vocabulary, path, end_id=end_id, id_col=id_col, text_col=text_col)
    files = spark.read.parquet(path)
    # segments of a partition are far fewer than 2**20
    sizes = files.select((F.col("_part").cast("long") * (1 << 20) + F.col("_seg")).alias("_key"), "_tokens")
    offsets = running_offsets(sizes, "_key", "_tokens", "_base", width=1 << 32)
    rows = read_token_files(files, id_col, with_ids=False).withColumn("_key", F.col("_part").cast("long") * (1 << 20) + F.col("_seg"))
    return rows.join(offsets, "_key").select(id_col, (F.col("_base") + F.col("_place")).alias("start"), "n_tokens", "ids_crc32")
