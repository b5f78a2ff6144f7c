"""Binary alignments: BGZF blocks and BAM records to the canonical read columns.

A file is one task's, read through Spark and inflated block by block, so that
memory holds the compressed file (2 GB at most, Spark's bound for binary files)
and one batch of records; give larger sets as one file for each contig.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.reads import READ_SCHEMA

BATCH = 20_000

# fixed values of the format: sizes of tag values by type letter, and their codes in struct
TAG_SIZE = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_CODE = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

_CIGAR = pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())]))
_ARROW = pa.schema([
    ("qname", pa.string()), ("flag", pa.int32()), ("contig", pa.string()), ("pos", pa.int64()), ("aend", pa.int64()), ("mapq", pa.int32()),
    ("cigar", _CIGAR), ("rg", pa.string()), ("nh", pa.int32()), ("xp", pa.float64()), ("read_len", pa.int32()),
])


class _Inflated:
    """Reads exact numbers of bytes from concatenated gzip members."""

    def __init__(self, data: bytes, piece: int = 1 << 16):
        self.data, self.at, self.piece = memoryview(data), 0, piece
        self.have, self.member = bytearray(), zlib.decompressobj(31)

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                self.member = zlib.decompressobj(31)
            if self.at >= len(self.data):
                raise EOFError
            part = self.data[self.at : self.at + self.piece]
            self.at += len(part)
            self.have += self.member.decompress(part)
        out = bytes(self.have[:n])
        del self.have[:n]
        return out

    def ended(self) -> bool:
        try:
            self.have[:0] = self.take(1)
        except EOFError:
            return True
        return False


def _tags(b: bytes) -> dict[str, object]:
    out, at = {}, 0
    while at + 3 <= len(b):
        name, kind = b[at : at + 2].decode("latin1"), chr(b[at + 2])
        at += 3
        if kind in "ZH":
            end = b.index(0, at)
            out[name], at = b[at:end].decode("latin1"), end + 1
        elif kind == "B":
            (n,) = struct.unpack_from("<i", b, at + 1)
            at += 5 + n * TAG_SIZE[chr(b[at])]
        else:
            (out[name],) = struct.unpack_from("<" + TAG_CODE[kind], b, at)
            at += TAG_SIZE[kind]
    return out


def header(src: _Inflated) -> list[tuple[str, int]]:
    """Contigs and their lengths; the stream is left at the first record."""
    if src.take(4) != b"BAM\x01":
        raise ValueError("no BAM file")
    src.take(*struct.unpack("<i", src.take(4)))
    contigs = []
    for _ in range(*struct.unpack("<i", src.take(4))):
        name = src.take(*struct.unpack("<i", src.take(4)))[:-1].decode("latin1")
        contigs.append((name, *struct.unpack("<i", src.take(4))))
    return contigs


def record(b: bytes, contigs: list[tuple[str, int]]) -> tuple:
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHi", b, 0)
    at = 32 + n_name
    name = b[32 : at - 1].decode("latin1")
    cigar, aend, inferred = [], pos, 0
    for (x,) in struct.iter_unpack("<I", b[at : at + 4 * n_cigar]):
        op, n = x & 15, x >> 4
        op = 0 if op in (7, 8) else op
        if cigar and op == 0 == cigar[-1]["op"]:
            cigar[-1]["len"] += n
        else:
            cigar.append({"op": op, "len": n})
        aend += n if op in (0, 2, 3) else 0
        inferred += n if op in (0, 1, 4) else 0
    tags = _tags(b[at + 4 * n_cigar + (n_seq + 1) // 2 + n_seq :])
    return name, flag, contigs[ref][0] if ref >= 0 else None, pos, aend, mapq, cigar, tags.get("RG"), tags.get("NH"), tags.get("XP"), n_seq or inferred


def _decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i in range(len(batch)):
            src = _Inflated(batch.column(0)[i].as_py())
            contigs, rows = header(src), []
            while not src.ended():
                rows.append(record(src.take(*struct.unpack("<i", src.take(4))), contigs))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def read_bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All records, unmapped ones with a null contig; duplicates stay flagged."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_decode, READ_SCHEMA)


def read_contigs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, contig, length from the headers."""

    def run(it):
        for batch in it:
            for i in range(len(batch)):
                found = header(_Inflated(batch.column(1)[i].as_py()))
                where = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([where] * len(found), pa.string()), pa.array([c for c, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["path", "contig", "length"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, contig string, length long")


def shared_contigs(contigs: DataFrame, files: int) -> DataFrame:
    """Contigs that all files name with one length."""
    g = contigs.groupBy("contig").agg(F.countDistinct("path").alias("n"), F.min("length").alias("length"), F.max("length").alias("most"))
    return g.where((F.col("n") == files) & (F.col("length") == F.col("most"))).select("contig", "length")
