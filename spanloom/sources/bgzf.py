"""Blocked alignments read by many tasks: one file is split like a text file.

The blocks of such a file all begin with the same sixteen bytes, so Spark's text reader
with those as its line separator gives one row for each block, splits a file between
tasks, and reads any store that Spark does.  A task inflates the blocks of its part,
one after the other.  Records may cross blocks and parts: where a part begins inside
one, the first place is sought from which on records are well formed, what is before it goes
to the end of the part before, and both pieces together must be whole records, else
reading fails.  So a wrong guess can't go unnoticed.

Region and duplicates are tested on the fixed fields before a record is decoded.
Files whose blocks begin otherwise fail; ``bam.read_bam`` reads them, a file to a task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.reads import READ_SCHEMA
from spanloom.sources import bam

#: fixed values: gzip with an extra field, no time, unknown system, six bytes of it, "BC" of two bytes: the block's size
BEGIN = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
#: records in a row that must be well formed where a part begins
CHAIN = 8
PIECE = 4 << 20  # bytes of records that are decoded at once
DUPLICATE = 0x400


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, part (where it begins in the file) and one block, without its first bytes, a row."""
    rows = spark.read.option("encoding", "ISO-8859-1").option("lineSep", BEGIN.decode("latin1")).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.col("value").cast("binary").alias("block"))


def inflated(block: bytes) -> bytes:
    """The bytes of a block that follows ``BEGIN``."""
    (size,) = struct.unpack_from("<H", block)
    if size + 1 != len(block) + len(BEGIN):
        raise ValueError("a block of another size than it says")
    out = zlib.decompress(block[2:-8], -15)
    if struct.unpack("<II", block[-8:]) != (zlib.crc32(out), len(out)):
        raise ValueError("a block with a wrong checksum")
    return out


def contigs_of(spark: SparkSession, path: str | list[str]) -> dict[str, list[tuple[str, int]]]:
    """file -> contigs and lengths, from its first blocks alone."""
    out = {}
    for (name,) in spark.read.format("binaryFile").load(path).select("path").collect():  # names of files
        many = 8
        while True:
            got = [bytes(r.block) for r in _pieces(spark, name).limit(many).collect()]
            if not got or got[0]:
                raise ValueError(f"{name}: blocks don't begin as expected")
            try:
                out[name] = bam.header(_Bytes(b"".join(map(inflated, got[1:]))))
                break
            except EOFError:
                if len(got) < many:
                    raise
                many *= 4
    return out


class _Bytes:
    """What ``bam.header`` reads from."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]


def _well_formed(b: bytes, at: int, lengths: list[int]) -> int:
    """Where the record at ``at`` ends, -1 if there can't be one, the buffer's length plus one if it isn't whole but may be one."""
    if at + 36 > len(b):
        return len(b) + 1
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", b, at)
    if size < 32 or not -1 <= ref < len(lengths) or not -1 <= mate < len(lengths) or n_name < 2 or n_seq < 0 or pos < -1 or mate_pos < -1:
        return -1
    if (ref >= 0 and pos >= lengths[ref]) or (mate >= 0 and mate_pos >= lengths[mate]) or 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq > size:
        return -1
    end = at + 36 + n_name
    if end <= len(b):
        name = b[at + 36 : end]
        if name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1]):
            return -1
    return min(at + 4 + size, len(b) + 1)


def first_record(b: bytes, lengths: list[int]) -> int:
    """The first place from which on ``CHAIN`` records, or all up to the end, are well formed; the length if there is none."""
    for at in range(len(b)):
        end, seen = at, 0
        while end < len(b) and seen < CHAIN:
            end, seen = _well_formed(b, end, lengths), seen + 1
            if end < 0:
                break
        if end >= 0 and (seen > 1 or end == len(b)):
            return at
    return len(b)


def _offsets(b: bytes, at: int) -> tuple[list[int], int]:
    """Begins of the whole records, and where the rest begins."""
    out = []
    while at + 4 <= len(b):
        end = at + 4 + struct.unpack_from("<i", b, at)[0]
        if end > len(b):
            break
        out.append(at)
        at = end
    return out, at


def _records(b: bytes, at: list[int], contigs: list[tuple[str, int]], region: tuple[str, int, int] | None, duplicates: bool) -> list[tuple]:
    if not at:
        return []
    data, place = np.frombuffer(b, np.uint8), np.array(at)
    field = lambda k, kind, n: np.ascontiguousarray(data[place[:, None] + np.arange(k, k + n)]).view(kind)[:, 0]
    keep = np.ones(len(place), bool)
    if not duplicates:
        keep &= field(18, "<u2", 2) & DUPLICATE == 0
    if region:
        ref = next((i for i, (name, _) in enumerate(contigs) if name == region[0]), -2)
        keep &= (field(4, "<i4", 4) == ref) & (field(8, "<i4", 4) <= region[2])
    sizes = field(0, "<i4", 4)
    out = [bam.record(b[p + 4 : p + 4 + n], contigs) for p, n in zip(place[keep].tolist(), sizes[keep].tolist())]
    return [r for r in out if r[4] > region[1]] if region else out


_OUT = pa.schema([*bam._ARROW, ("_path", pa.string()), ("_part", pa.int64()), ("_end", pa.int32()), ("_bytes", pa.binary())])


def _batches(rows: list[tuple], path: str, part: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), bam.BATCH):
        some = bam._batch(rows[k : k + bam.BATCH])
        n = len(some)
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array([path] * n), pa.array([part] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_OUT)


def _edge(path: str, part: int, end: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in bam._ARROW], pa.array([path]), pa.array([part], pa.int64()), pa.array([end], pa.int32()), pa.array([data], pa.binary())], schema=_OUT)


def _part(blocks: Iterator[bytes], path: str, part: int, contigs: list[tuple[str, int]], region, duplicates: bool) -> Iterator[pa.RecordBatch]:
    """Records of one part, then what is before its first and behind its last whole one."""
    lengths = [n for _, n in contigs]
    held, begun = b"", False
    for block in blocks:
        held += inflated(block)
        if not begun:
            if part == 0:
                src = _Bytes(held)
                try:
                    bam.header(src)
                except EOFError:
                    continue
                held, begun = held[src.at :], True
            elif len(held) >= PIECE:
                at = first_record(held, lengths)
                if at == len(held):
                    continue  # nothing but the inside of a record so far
                yield _edge(path, part, 0, held[:at])
                held, begun = held[at:], True
        if begun and len(held) >= PIECE:
            at, rest = _offsets(held, 0)
            yield from _batches(_records(held, at, contigs, region, duplicates), path, part)
            held = held[rest:]
    if not begun:
        at = first_record(held, lengths)
        yield _edge(path, part, 0, held[:at])
        held = held[at:]
        if not held:
            return
    at, rest = _offsets(held, 0)
    yield from _batches(_records(held, at, contigs, region, duplicates), path, part)
    yield _edge(path, part, 1, held[rest:])


def read(spark: SparkSession, path: str | list[str], region: tuple[str, int, int] | None = None, duplicates: bool = True) -> DataFrame:
    """The records of ``bam.read_bam``, read by as many tasks as the files have splits.

    region: contig, start, stop (closed): only records that touch it; ``duplicates`` false
    leaves flagged copies out.  The file is read twice, once for what crosses parts.
    """
    every = contigs_of(spark, path)
    sent = spark.sparkContext.broadcast(every)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p.as_py(), s.as_py(), b.as_py()) for batch in it for p, s, b in zip(*batch.columns))
        ahead = next(rows, None)
        while ahead is not None:
            path, part = ahead[:2]

            def own() -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and ahead[:2] == (path, part):
                    if ahead[2]:
                        yield ahead[2]
                    ahead = next(rows, None)

            contigs = next(c for name, c in sent.value.items() if _same(name, path))
            yield from _part(own(), path, part, contigs, region, duplicates)

    names = [f.name for f in bam._ARROW]
    found = _pieces(spark, path).mapInArrow(run, READ_SCHEMA + ", _path string, _part long, _end int, _bytes binary")
    edges = found.where("_end is not null").select("_path", "_part", "_end", "_bytes")

    def joined(t: pa.Table) -> pa.Table:
        """The ends of one file's parts, in order: each gap must hold whole records."""
        path = t.column("_path")[0].as_py()
        contigs, held, rows = next(c for name, c in sent.value.items() if _same(name, path)), b"", []
        for r in t.sort_by([("_part", "ascending"), ("_end", "ascending")]).to_pylist():
            if r["_end"] == 1:
                # a part that found records: what was open before it must have been closed by its beginning
                if held:
                    break
                held = r["_bytes"]
                continue
            held += r["_bytes"]
            at, rest = _offsets(held, 0)
            if rest == len(held):
                rows += _records(held, at, contigs, region, duplicates)
                held = b""
        if held:
            raise ValueError(f"{path}: records don't join between parts; read it with bam.read_bam")
        return pa.Table.from_batches([bam._batch(rows)] if rows else [], schema=bam._ARROW)

    return found.where("_end is null").select(*names).unionByName(edges.groupBy("_path").applyInArrow(joined, READ_SCHEMA))


def _same(a: str, b: str) -> bool:
    """Whether two ways to write a file's address name the same one."""
    plain = lambda x: x.removeprefix("file:").lstrip("/")
    return plain(a) == plain(b)
