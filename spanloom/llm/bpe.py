"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file.

Long texts are cut by a regular expression at safe boundaries (before ASCII
white space behind an ASCII letter or digit, where every pre-token ends), so one
call never sees more than about ``PART`` characters that have such a boundary.
Decoding gives raw bytes, so ids that split a character stay exact.

Defined cases: null is the empty text (no ids); special tokens' strings are
ordinary text; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, quoted

PART = 100_000
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n\t\r])")
_encodings: dict = {}


def encoding(path: str, pattern: str):
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def parts(text: str, size: int = PART) -> Iterator[str]:
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc, text: str) -> list[int]:
    if len(text) <= PART:
        return enc.encode_ordinary(text)
    return [i for part in parts(text) for i in enc.encode_ordinary(part)]


def encoded(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (array of int) of every document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for b in it:
            ids = [encode(enc, t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    bound_batches(docs.sparkSession)
    src = docs.select(quoted(id_col), quoted(text_col))
    return src.mapInArrow(run, f"`{id_col}` {src.dtypes[0][1]}, ids array<int>")


def decoded(tokens: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``bytes`` (binary) of every row of ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for b in it:
            raw = [enc.decode_bytes(ids.as_py() or []) for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    bound_batches(tokens.sparkSession)
    src = tokens.select(quoted(id_col), quoted(ids_col))
    return src.mapInArrow(run, f"`{id_col}` {src.dtypes[0][1]}, bytes binary")


def round_trip_digest(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id, n_tokens, ids_sha256, decoded_sha256."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for b in it:
            n, ids_sha, raw_sha = [], [], []
            for t in b.column(1):
                ids = encode(enc, t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                raw_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    bound_batches(docs.sparkSession)
    src = docs.select(quoted(id_col), quoted(text_col))
    return src.mapInArrow(run, f"`{id_col}` {src.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
