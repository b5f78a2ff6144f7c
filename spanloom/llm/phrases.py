"""Phrase collocation mining by direct-address tiling.

Words get ids by frequency rank.  Neighbouring ids are pairs (a, b); the plane of
pairs is cut in tiles of ``TILE`` x ``TILE`` ids.  Ranks put most occurrences in few
tiles: those are counted by a dense bincount, one cell for each pair; the other
tiles are sparse and counted as sorted coordinates (COO).  Frequent pairs are ranked
again and get ids of their own: a pair of neighbouring pairs is a phrase of three
words, a pair of those one of four, and so on, since no phrase is more frequent than
its parts.  Each task counts what it reads; Spark adds the tasks' counts.

Ids are sent to the tasks for at most ``HEAD`` words and ``LONGER`` times as many
phrases of each greater length, the most frequent ones; of phrases only numbers are sent, 12 bytes for
each, and they are spelled by joins.  Phrases beyond that aren't lost: tasks get a
bitmap of fixed size of their hashes, and longer phrases that may hold one of them are
counted by their words in a pass over the texts, exactly, since the bitmap has no false
negatives.

A phrase is scored by each of its cuts in two, first part and rest:
floor(1000 * a * n / (l * r)), with the phrase's count a, the counts l and r of both
parts, and n words of its language.  The lowest cut counts, ties to the shortest
first part.  Arithmetic is decimal, of 38 digits.

Defined cases: a null text is empty; a null language is ``und``; texts without a
frequent phrase give no row; ties in the ranking are ordered by count, then phrase
(bytes of UTF-8); repeated rows count each; extra columns aren't read.  A phrase never
spans pieces or rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bound_batches, quoted, written

LEAST = 100
LONGEST = 5
TOP = 2000
HEAD = 1 << 20
LONGER = 4
TILE_BITS = 10
TILE = 1 << TILE_BITS
DENSE = TILE * TILE // 16  # occurrences from which a tile is counted densely
BUFFER = 1 << 21  # occurrences that a task counts at once
PIECE = 4 << 20  # bytes of a text that are split at once
DISTINCT = 200_000  # words or phrases that a task holds before it hands on their counts
FILTER_BITS = 24
SALTS = 64

_NEW = ord("\n")
#: A-Z in lower case, ends of pieces as line feeds
_FOLD = bytes(_NEW if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(rb"[^ \t\n]+|\n")


def tokens(raw: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """Words and ends of pieces (line feeds) of a text, in lists of about ``size`` bytes."""
    raw, at = raw.translate(_FOLD), 0
    while len(raw) - at > size:
        cut = max(raw.rfind(c, at, at + size) for c in (b" ", b"\t", b"\n"))
        if cut <= at:  # a word of more than size bytes
            after = [c for c in (raw.find(c, at + size) for c in (b" ", b"\t", b"\n")) if c >= 0]
            cut = min(after, default=len(raw) - 1)
        yield _TOKEN.findall(raw, at, cut + 1)
        at = cut + 1
    yield _TOKEN.findall(raw, at)


def _key(lang: bytes, phrase: bytes) -> int:
    return zlib.crc32(lang + b"\0" + phrase) >> (32 - FILTER_BITS)


@dataclass
class Level:
    """Phrases of one length: ranked ones, and a bitmap of all others that are frequent."""

    table: DataFrame | None = None  # rank, lang, phrase
    words: tuple[list[str], list[str]] = ((), ())  # languages and words by rank, of single words only
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted pairs of parts' ids
    ranks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # their ids
    others: np.ndarray | None = None

    def ids(self) -> dict[bytes, dict[bytes, int]]:
        out: dict[bytes, dict[bytes, int]] = {}
        for i, (lang, phrase) in enumerate(zip(*self.words)):
            out.setdefault(lang.encode(), {})[phrase.encode()] = i
        return out

    def may_hold(self, lang: bytes, phrase: bytes) -> bool:
        cell = _key(lang, phrase)
        return self.others is not None and bool(self.others[cell >> 6] >> np.uint64(cell & 63) & np.uint64(1))


def pair_codes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where two ranked phrases follow each other, and their pair."""
    at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
    return at, (s[at].astype(np.int64) << 32) | s[at + 1]


def longer(s: np.ndarray, level: Level) -> np.ndarray:
    """Ids of the phrases of one word more that begin at each place, -1 where there is no ranked one."""
    out = np.full(max(len(s) - 1, 0), -1, np.int32)
    if len(level.codes):
        at, code = pair_codes(s)
        i = np.minimum(np.searchsorted(level.codes, code), len(level.codes) - 1)
        hit = level.codes[i] == code
        out[at[hit]] = level.ranks[i[hit]]
    return out


def count_tiles(s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, counts) of neighbouring ids: dense tiles by bincount, all others as sorted coordinates."""
    _, code = pair_codes(s)
    a, b = code >> 32, code & 0xFFFFFFFF
    across = int(b.max(initial=0) >> TILE_BITS) + 1
    tile = (a >> TILE_BITS) * across + (b >> TILE_BITS)
    numbers, inverse, often = np.unique(tile, return_inverse=True, return_counts=True)
    sparse = (often < DENSE)[inverse]
    for k in np.flatnonzero(often >= DENSE):
        mine = inverse == k
        cells = np.bincount(((a[mine] & (TILE - 1)) << TILE_BITS) | (b[mine] & (TILE - 1)), minlength=TILE * TILE)
        found = np.flatnonzero(cells)
        row, col = int(numbers[k]) // across, int(numbers[k]) % across
        yield (((row << TILE_BITS) + (found >> TILE_BITS)) << 32) | ((col << TILE_BITS) + (found & (TILE - 1))), cells[found]
    if sparse.any():
        yield np.unique(code[sparse], return_counts=True)


def _lang(col: str) -> Column:
    return F.coalesce(quoted(col).cast("string"), F.lit("und")).alias("lang")


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(_lang(lang_col), F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias("text"))


def _counted(counts: dict[bytes, Counter]) -> pa.RecordBatch:
    rows = [(g, w, c) for g, own in counts.items() for w, c in own.items()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[2] for r in rows], pa.int64())],
        names=["lang", "phrase", "f"],
    )


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, count), and one row of a null word for each language: all its words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, Counter] = {}
        total: Counter = Counter()
        for b in it:
            for lang, text in zip(b.column(0), b.column(1)):
                lang = lang.as_py().encode()
                own = counts.setdefault(lang, Counter())
                for part in tokens(text.as_py()):
                    own.update(part)
                own.pop(b"\n", None)
            if sum(map(len, counts.values())) >= DISTINCT:
                for g, own in counts.items():
                    total[g] += sum(own.values())
                yield _counted(counts)
                counts = {}
        for g, own in counts.items():
            total[g] += sum(own.values())
        yield _counted(counts)
        yield pa.RecordBatch.from_arrays([pa.array([g.decode() for g in total], pa.string()), pa.nulls(len(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "phrase", "f"])

    bound_batches(texts.sparkSession)
    return texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def word_ids(texts: DataFrame, words: Level) -> DataFrame:
    """The ids of each text's words, -1 for words without one and for ends of pieces."""
    sent = texts.sparkSession.sparkContext.broadcast(words.ids())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found, ends = [np.zeros(0, np.int32)], [0]
            for lang, text in zip(b.column(0), b.column(1)):
                get = sent.value.get(lang.as_py().encode(), {}).get
                n = 0
                for part in tokens(text.as_py()):
                    found.append(np.fromiter(map(get, part, repeat(-1)), np.int32, len(part)))
                    n += len(part)
                ends.append(ends[-1] + n)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))], names=["ids"])

    return texts.mapInArrow(run, "ids array<int>")


def tile_counts(ids: DataFrame, between: list[Level]) -> DataFrame:
    """(code, count) of pairs of ranked phrases one word shorter; ``between``: the levels from two words up to those."""
    sent = ids.sparkSession.sparkContext.broadcast([(x.codes, x.ranks) for x in between])

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s = np.concatenate(held)
        for codes, ranks in sent.value:
            s = longer(s, Level(codes=codes, ranks=ranks))
        if len(s) > 1:
            for code, n in count_tiles(s):
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "f"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            col = b.column(0)
            values, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                held += [values[lo:hi].astype(np.int32), np.full(1, -1, np.int32)]
                n += hi - lo + 1
                if n >= BUFFER:
                    yield from counted(held)
                    held, n = [], 0
        if held:
            yield from counted(held)

    return ids.mapInArrow(run, "code long, f long").groupBy("code").agg(F.sum("f").alias("f"))


def tail_counts(texts: DataFrame, levels: list[Level]) -> DataFrame:
    """Counts of phrases of one word more than the last level's that may hold a frequent phrase without an id."""
    words = levels[0].ids()
    sent = texts.sparkSession.sparkContext.broadcast((words, [Level(codes=x.codes, ranks=x.ranks, others=x.others) for x in levels]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = sent.value
        counts: dict[bytes, Counter] = {}
        for b in it:
            for lang, text in zip(b.column(0), b.column(1)):
                lang = lang.as_py().encode()
                own, mine = counts.setdefault(lang, Counter()), ids.get(lang, {})
                toks = [t for part in tokens(text.as_py()) for t in part]
                # -2: a phrase that may be frequent and has no id
                s = np.fromiter((mine.get(t, -2 if t != b"\n" and known[0].may_hold(lang, t) else -1) for t in toks), np.int32, len(toks))
                for size, level in enumerate(known[1:], 2):
                    up = longer(s, level)
                    if level.others is not None:
                        for i in np.flatnonzero((s[:-1] != -1) & (s[1:] != -1) & (up < 0)).tolist():
                            if level.may_hold(lang, b" ".join(toks[i : i + size])):
                                up[i] = -2
                    s = up
                size = len(known) + 1
                for i in np.flatnonzero((s[:-1] != -1) & (s[1:] != -1) & ((s[:-1] < 0) | (s[1:] < 0))).tolist():
                    own[b" ".join(toks[i : i + size])] += 1
            if sum(map(len, counts.values())) >= DISTINCT:
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    return texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _spelled(pairs: DataFrame, parts: Level) -> DataFrame:
    """(code, f) with language and words: the first part and the last word of the second."""
    first = parts.table.select(F.col("rank").alias("_a"), "lang", F.col("phrase").alias("_first"))
    last = parts.table.select(F.col("rank").alias("_b"), F.element_at(F.split("phrase", " "), -1).alias("_last"))
    both = pairs.select("code", "f", F.shiftright("code", 32).alias("_a"), F.expr("code & 4294967295L").alias("_b")).join(first, "_a").join(last, "_b")
    return both.select("lang", F.concat_ws(" ", "_first", "_last").alias("phrase"), "f", "code")


def _ranks(found: DataFrame, level: Level) -> DataFrame:
    """rank, lang and phrase of the phrases that have an id."""
    ids = level.ids()
    sent = found.sparkSession.sparkContext.broadcast((ids, level.codes, level.ranks))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, ranks = sent.value
        for b in it:
            if ids:  # words: a code is only a hash
                rank = [ids[x.as_py().encode()][y.as_py().encode()] for x, y in zip(b.column(0), b.column(1))]
            else:
                rank = ranks[np.searchsorted(codes, b.column(2).to_numpy())]
            yield pa.RecordBatch.from_arrays([pa.array(rank, pa.int32()), b.column(0), b.column(1)], names=["rank", "lang", "phrase"])

    return found.select("lang", "phrase", "code").mapInArrow(run, "rank int, lang string, phrase string")


def _level(found: DataFrame, head: int, words: bool = False) -> Level:
    """At most ``head`` phrases that have a code, the most frequent ones, get ids, all others a place in the bitmap.

    Phrases of one frequency all get ids or none does, so the counts of frequencies say who does, and nothing is sorted.
    """
    often = found.where("code is not null").groupBy("f").count().toArrow()  # its rows are under the root of twice the words
    f = often.column("f").to_numpy()
    order = np.argsort(-f)
    fits = np.flatnonzero(np.cumsum(often.column("count").to_numpy()[order]) <= head)
    floor = int(f[order[fits[-1]]]) if len(fits) else 1 << 62
    mine = F.col("code").isNotNull() & (F.col("f") >= floor)
    columns = ["code", "f", "lang", "phrase"] if words else ["code", "f"]
    ranked = found.where(mine).select(*columns).toArrow()  # at most head rows
    codes = ranked.column("code").to_numpy()
    by_rank = np.lexsort((codes, -ranked.column("f").to_numpy()))
    ranks = np.empty(len(codes), np.int32)
    ranks[by_rank] = np.arange(len(codes), dtype=np.int32)
    order = np.argsort(codes)
    level = Level(codes=codes[order], ranks=ranks[order])
    if words:
        level.words = tuple(ranked.column(c).take(pa.array(by_rank)).to_pylist() for c in ("lang", "phrase"))
    level.table = _ranks(found.where(mine), level)
    if found.count() > len(codes):
        cell = F.shiftrightunsigned(F.crc32(F.concat("lang", F.lit("\0"), "phrase").cast("binary")), 32 - FILTER_BITS)
        cells = found.where(~mine).select(F.shiftright(cell, 6).alias("w"), cell.alias("c"))
        cells = cells.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(c & 63 as int))")).alias("b")).toArrow()
        level.others = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        level.others[cells.column("w").to_numpy()] = cells.column("b").to_numpy().view(np.uint64)
    return level


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, head: int = HEAD, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words with at least ``least`` occurrences: (lang, phrase, f, size); and (lang, n)."""
    texts = _texts(docs, text_col, lang_col)
    counts = written(word_counts(texts).where(F.col("phrase").isNull() | (F.col("f") >= least)), "words")
    totals = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    # words have no parts: their own hash stands for the code
    found = [counts.where("phrase is not null").withColumn("code", F.xxhash64("lang", "phrase"))]
    levels = [_level(found[0], head, words=True)]
    ids = written(word_ids(texts, levels[0]), "word-ids")
    for size in range(2, longest + 1):
        pairs = tile_counts(ids, levels[1:]).where(F.col("f") >= least)
        new = _spelled(pairs, levels[-1])
        if any(x.others is not None for x in levels):
            new = new.unionByName(tail_counts(texts, levels).where(F.col("f") >= least).withColumn("code", F.lit(None).cast("long")))
        found.append(written(new, f"phrases-{size}"))
        if size < longest:
            levels.append(_level(found[-1], LONGER * head))
            if not len(levels[-1].codes) and levels[-1].others is None:
                break
    everything = found[0].withColumn("size", F.lit(1))
    for size, more in enumerate(found[1:], 2):
        everything = everything.unionByName(more.withColumn("size", F.lit(size)))
    return everything.drop("code"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, head: int = HEAD, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase goes where one of its extensions by a word is as frequent as itself:
    then all its occurrences lie in that one's (a longer one that is as frequent
    has such an extension between).
    """
    all_, totals = frequent_phrases(docs, least, longest, head, text_col, lang_col)
    n_langs = totals.count()
    words = F.split("phrase", " ")
    cand = all_.where("size >= 2").withColumn("words", words)
    part = lambda first, length: F.array_join(F.slice("words", first, length), " ")
    grown = cand.where("size >= 3").select("lang", "f", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
    kept = cand.join(grown, ["lang", "phrase", "f"], "left_anti")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(all_.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(all_.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(totals) if n_langs <= 100_000 else totals, "lang")
    whole = "cast({} as decimal(17,0))".format
    score = F.expr(f"cast(1000 as decimal(4,0)) * ({whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # first inside parts of each language, so that no task sorts all of one
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = best.withColumn("_nth", F.row_number().over(salted)).where(F.col("_nth") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
