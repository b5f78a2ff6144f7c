"""Sequences in chunks: regions of a chunked reference, position weight matrices slid over it.

A chunk (key, at, piece) holds ``width`` bases from place ``at`` (from 0) and a halo of
the bases behind them, so that each window of at most halo + 1 bases lies whole in the
chunk where it starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import bound_batches

WIDTH = 65_536
#: hits that a task holds before it hands them on
HITS = 1 << 18
BASES = "ACGT"


#: base of each lower-case letter, in turn A, C, G, T; 0 of all other bytes
_BASE_OF = np.zeros(256, np.uint8)
_BASE_OF[97:123] = [ord(BASES[k % 4]) for k in range(26)]


def lettered(texts: DataFrame, key: str, text: str = "text", out: str = "seq") -> DataFrame:
    """(key, text) -> key and the bases that the letters a to z of the text in lower case stand for; other letters are left out, a null stays one."""
    src = texts.select(F.col(key), F.lower(text).alias("_text"))
    kind = dict(src.dtypes)[key]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            col = b.column(1).cast(pa.string())
            offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int32)
            data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            # in UTF-8 all bytes of other letters are over 127
            bases = _BASE_OF[data]
            ends = np.append(np.int32(0), np.cumsum(bases > 0, dtype=np.int32))[offsets - offsets[0]]
            found = pa.StringArray.from_buffers(len(col), pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(bases[bases > 0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.compute.if_else(col.is_valid(), found, pa.scalar(None, pa.string()))], names=[key, out])

    bound_batches(texts.sparkSession)
    return src.mapInArrow(run, f"`{key}` {kind}, `{out}` string")


def chunked(seqs: DataFrame, key: str, halo: int = 0, width: int = WIDTH, seq: str = "seq") -> DataFrame:
    """(key, seq) -> key, at, piece; a null or empty sequence has no chunk.  A sequence is cut in one pass."""
    if halo > width:
        raise ValueError("a halo reaches no further than the next chunk")
    cuts = F.regexp_extract_all(F.col(seq), F.lit(f"(?s)(.{{1,{width}}})"), 1)
    rows = seqs.select(F.col(key), cuts.alias("_cuts")).select(key, F.posexplode(F.expr(f"transform(_cuts, (p, i) -> concat(p, substring(coalesce(get(_cuts, i + 1), ''), 1, {halo})))")).alias("_nth", "piece"))
    return rows.select(key, (F.col("_nth").cast("long") * width).alias("at"), "piece")


def fetch(chunks: DataFrame, regions: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """regions (key, start, stop; from 0, both inside) with their ``seq``, clipped to the sequence; a region outside has an empty one.

    A region meets only its own chunks, by number; a chunk gives its first ``width`` bases, not its halo.
    """
    asked = regions.select(key, "start", "stop").distinct()
    first = F.greatest(F.col("start"), F.lit(0))
    numbers = F.when((F.col("stop") >= first), F.expr(f"sequence(greatest(start, 0) div {width}, stop div {width})"))
    parts = asked.select(key, "start", "stop", F.explode(numbers).alias("_nth")).join(chunks.select(key, F.expr(f"at div {width}").alias("_nth"), "at", "piece"), [key, "_nth"])
    low, high = F.greatest(F.col("start") - F.col("at"), F.lit(0)), F.least(F.col("stop") - F.col("at"), F.lit(width - 1))
    piece = F.substring(F.col("piece"), (low + 1).cast("int"), (high - low + 1).cast("int"))
    whole = parts.groupBy(key, "start", "stop").agg(F.array_sort(F.collect_list(F.struct("at", piece.alias("p")))).alias("_p"))
    found = whole.select(key, "start", "stop", F.array_join(F.col("_p.p"), "").alias("seq"))
    return regions.join(found, [key, "start", "stop"], "left").fillna("", ["seq"])


def reverse_matrix(matrix: Sequence[Sequence[float]]) -> list[list[float]]:
    """The matrix whose hits are those of the other strand; columns are A, C, G, T and all other letters."""
    return [[row[3], row[2], row[1], row[0], *row[4:]] for row in reversed(matrix)]


def scores(codes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Score of each whole window of base numbers (A, C, G, T, other: 0 to 4)."""
    n = len(codes) - len(matrix) + 1
    out = np.zeros(max(n, 0))
    for j, row in enumerate(matrix if n > 0 else ()):
        out += row[codes[j : j + n]]
    return out


def scan(seqs: DataFrame, key: str, matrix: Sequence[Sequence[float]], least: float, both: bool = False, width: int = WIDTH, seq: str = "seq") -> DataFrame:
    """key, start (from 0), strand and score of all windows that score ``least`` or more; both cases of letters count alike.

    ``matrix`` has a row for each place with weights of A, C, G, T and, where given, all other
    letters (otherwise the least of the four).  Chunks go through numpy; sequences of any length take the memory of
    chunks, and ``HITS`` hits, with those of one chunk more, are held at once.
    """
    if not matrix:
        raise ValueError("a matrix has at least one place")
    full = [[*row[:4], row[4] if len(row) > 4 else min(row)] for row in matrix]
    strands = [("+", np.array(full, float))] + ([("-", np.array(reverse_matrix(full), float))] if both else [])
    number = np.full(256, 4, np.uint8)
    for i, b in enumerate(BASES):
        number[[ord(b), ord(b.lower())]] = i
    chunks = chunked(seqs, key, len(matrix) - 1, width, seq)
    kind = dict(chunks.dtypes)[key]

    def hits(col: pa.Array, rows: list, starts: list, signs: list, found: list) -> pa.RecordBatch:
        n = [len(x) for x in found]
        taken = col.take(pa.array(np.repeat(np.array(rows, np.int64), n)))
        sign = pa.DictionaryArray.from_arrays(np.repeat(np.array(signs, np.int8), n), [x for x, _ in strands]).cast(pa.string())
        return pa.RecordBatch.from_arrays([taken, pa.array(np.concatenate(starts), pa.int64()), sign, pa.array(np.concatenate(found))], names=[key, "start", "strand", "score"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            held, n = ([], [], [], []), 0
            for i in range(b.num_rows):
                at = b.column(1)[i].as_py()
                # one byte a letter; letters outside Latin-1 are others
                codes = number[np.frombuffer(b.column(2)[i].as_py().encode("latin-1", "replace"), np.uint8)]
                for k, (_, m) in enumerate(strands):
                    s = scores(codes, m)[:width]
                    hit = np.flatnonzero(s >= least)
                    if not len(hit):
                        continue
                    for x, y in zip(held, (i, hit + at, k, s[hit])):
                        x.append(y)
                    n += len(hit)
                if n >= HITS:
                    yield hits(b.column(0), *held)
                    held, n = ([], [], [], []), 0
            if n:
                yield hits(b.column(0), *held)

    bound_batches(seqs.sparkSession)
    return chunks.mapInArrow(run, f"`{key}` {kind}, start long, strand string, score double")
