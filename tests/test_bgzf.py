"""One blocked alignment file read by many tasks, against the reader of whole files."""

import random
import struct
import zlib

import pytest

from spanloom.sources import bam, bgzf


def block(data):
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return bgzf.BEGIN + struct.pack("<H", len(bgzf.BEGIN) + 2 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(rng, k, contigs):
    ref = rng.randrange(-1, len(contigs))
    pos = rng.randrange(contigs[ref][1]) if ref >= 0 else -1
    name = f"read{k}".encode() + b"\0"
    seq = rng.choice([0, 5, 60, 60, 60]) if k != 700 else 9000
    cigar = [(0, 10), (3, 40), (0, 10)] if rng.random() < 0.3 else [(0, 20)]
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 30, 0, len(cigar), rng.choice([0, 16, 0x400]), seq, -1, -1, 0) + name
    body += b"".join(struct.pack("<I", n << 4 | op) for op, n in cigar) + rng.randbytes((seq + 1) // 2 + seq) + b"NHC\x02"
    return struct.pack("<i", len(body)) + body


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng, contigs = random.Random(3), [("chr1", 5000), ("chr2", 800)]
    head = b"BAM\x01" + struct.pack("<i", 4) + b"@CO\n" + struct.pack("<i", len(contigs))
    for name, n in contigs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    path = tmp_path_factory.mktemp("bgzf")
    for name, n, size in (("a", 1500, 700), ("b", 1, 50), ("c", 0, 64_000), ("d", 900, 23)):
        raw = head + b"".join(record(rng, k, contigs) for k in range(n))
        (path / f"{name}.bam").write_bytes(b"".join(block(raw[i : i + size]) for i in range(0, len(raw), size)) + block(b""))
    return path


@pytest.mark.parametrize("split", [1500, 9000, 1 << 27])
def test_parts_give_all_records(spark, files, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = bgzf.read(spark, str(files / "*.bam"))
        parts = bgzf._pieces(spark, str(files / "a.bam")).rdd.getNumPartitions()
        rows = sorted(map(str, got.collect()))
        near = sorted(map(str, bgzf.read(spark, str(files / "*.bam"), ("chr1", 1000, 1500), duplicates=False).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = bam.read_bam(spark, str(files / "*.bam"))
    assert rows == sorted(map(str, whole.collect())) and len(rows) == 2401
    assert near == sorted(map(str, whole.where("contig = 'chr1' and pos <= 1500 and aend > 1000 and flag & 1024 = 0").collect())) and near
    assert parts > 20 if split == 1500 else parts >= 1


def test_other_files_fail_with_a_message(spark, tmp_path, files):
    import gzip

    (tmp_path / "x.bam").write_bytes(gzip.compress(b"BAM\x01"))
    with pytest.raises(ValueError, match="don't begin"):
        bgzf.read(spark, str(tmp_path / "x.bam"))
    data = (files / "a.bam").read_bytes()
    (tmp_path / "cut.bam").write_bytes(data[: data.rindex(bgzf.BEGIN, 0, len(data) - 500)])
    with pytest.raises(Exception, match="don't join"):
        bgzf.read(spark, str(tmp_path / "cut.bam")).collect()


def test_headers_come_from_first_blocks(spark, files):
    found = bgzf.contigs_of(spark, str(files / "*.bam"))
    assert len(found) == 4 and all(c == [("chr1", 5000), ("chr2", 800)] for c in found.values())
