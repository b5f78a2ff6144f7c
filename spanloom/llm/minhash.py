"""Near-duplicate documents: DartMinHash signatures, banded joining, exact checks.

A text's elements are its shingles of five words (runs of letters and digits,
ASCII lower case), weighted by how often they occur; texts of one to four words
are one shingle.  Similarity is weighted Jaccard: sum of minima over sum of maxima.

Signatures (DartMinHash): every element throws hashed darts at its region, one
unit of weight for each occurrence; a dart has a rank, the arrival time of a
Poisson process seeded by the element, and a coordinate.  A text keeps each
coordinate's earliest dart.  Ranks are drawn only up to a limit set by the total
weight, doubled for texts that leave a coordinate empty, so that the work is
about k ln k darts and not k hashes for each element.

Joining: equal texts are one node.  Nodes that share a band of ``ROWS`` coordinates
are candidates (a pair of similarity 0.8 shares none with a chance of 5 in 100,000).
In buckets of up to ``SMALL`` nodes all pairs are candidates, in larger ones first
each node and the bucket's first.  Candidates whose signatures agree enough, and
whose bound allows the similarity, are checked on the shingles of their whole texts
(as 64-bit hashes).  The bound is exact: a text's shingles are counted in ``SKETCH``
classes of their hashes, and two texts share at most the sum of the classes' minima.
Links of
similarity ``least`` or more are merged into classes: first each node's nearest
candidate, then the candidates that still are of different classes, since a pair
inside a class can't change it.  Large buckets that hold several classes then are
compared in full, by blocks of about ``BLOCK`` nodes: every node outside the bucket's
largest class with every node of another class, once for its ``NEAREST`` nodes, then
for all.  Nodes with many candidates are salted before their texts are
joined; pairs of two such nodes are checked by blocks of about ``CHECK_BLOCK`` nodes, so
that a text travels once for each block and not for each pair.  Signatures travel
as one byte for each coordinate; that can only make pairs agree more.

Defined cases: null and empty texts and texts without words have no shingles;
they form a class only with equal texts (null equals empty); null ids are larger
than any id; of a class the smallest id stays, of rows that repeat it one; an
empty table gives an empty result; extra columns are not read, or carried along
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.graph import components

from ._bytes import batches, mix, word_rows
from ._common import HOT_GROUPS, attached, bound_batches, once, quoted, rowed, unrowed, written

SHINGLE = 5
LEAST = 0.8
COORDINATES = 128
ROWS = 5
SMALL = 16
#: nodes of a block of a large bucket, and nodes of other classes that each node is checked with in the first rounds
BLOCK = 4096
NEAREST = 4
#: classes of shingles that are counted for the bound, at most 255 of each, and bytes of a signature with counts and weight
SKETCH = 512
WIDTH = COORDINATES + SKETCH + 8
#: rows of a broadcast table of nodes, of at most about 100 bytes each
BROADCAST_NODES = 200_000
#: candidates of a node from which on they are salted, and salts
BUSY = 64
SALTS = 64
#: busy nodes of a block whose texts are checked together, and shingles of a block at once
CHECK_BLOCK = 48
COLUMNS = 1 << 14
#: shingles that are worked on at once
AT_ONCE = 1 << 19

_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all shingles with repeats, in text order."""
    h, row = word_rows(data, offsets)
    n = len(h)
    count = np.bincount(row, minlength=len(offsets) - 1)
    last = np.cumsum(count)  # behind the row's last word
    out, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for lo in range(0, n, AT_ONCE):
        at = np.arange(lo, min(lo + AT_ONCE, n))
        own = row[at]
        end = last[own]
        some = (at + SHINGLE <= end) | ((at == end - count[own]) & (count[own] < SHINGLE))
        at, end = at[some], end[some]
        made = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            made = made * _STEP + np.where(at + k < end, h[np.minimum(at + k, n - 1)], np.uint64(k + 1))
        out.append(mix(made))
        rows.append(own[some])
    return np.concatenate(out), np.concatenate(rows)


def elements(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Unit regions: the n-th occurrence of a shingle in its row is an element of its own."""
    out = np.empty_like(h)
    parts = -(-len(h) // (4 * AT_ONCE))
    group = h % np.uint64(parts) if parts > 1 else None
    for part in range(parts):
        own = slice(None) if group is None else np.flatnonzero(group == part)
        x, r = h[own], row[own]
        order = np.lexsort((x, r))
        x, r = x[order], r[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
        begin = np.flatnonzero(new)
        nth = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
        x += nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        out[order if group is None else own[order]] = x
    return out


def darts(element: np.ndarray, row: np.ndarray, n_rows: int, k: int = COORDINATES) -> np.ndarray:
    """Signatures, (n_rows, k) of 32-bit dart names; rows without elements stay all ones."""
    shift = np.uint64(64 - int(k).bit_length() + 1)
    low = np.uint64((1 << int(shift)) - 1)
    weight = np.bincount(row, minlength=n_rows)
    limit = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    best = np.full(n_rows * k, _NONE)
    while len(element):
        for at in range(0, len(element), AT_ONCE):
            e, r = element[at : at + AT_ONCE], row[at : at + AT_ONCE].astype(np.int64)
            arrival, live, turn = np.zeros(len(e)), np.arange(len(e)), 0
            while len(live):
                turn += 1
                dart = mix(e[live] + np.uint64(turn * int(_STEP) & (1 << 64) - 1))
                arrival[live] -= np.log(((dart & low).astype(np.float64) + 0.5) / float(int(low) + 1))
                inside = arrival[live] < limit[r[live]]
                live, dart = live[inside], dart[inside]
                rank = arrival[live].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
                np.minimum.at(best, r[live] * k + (dart >> shift).astype(np.int64), rank | (mix(dart) >> np.uint64(33)))
        empty = (best.reshape(n_rows, k) == _NONE).any(1) & (weight > 0)
        limit = limit * 2
        again = empty[row]
        element, row = element[again], row[again]
    return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n_rows, k)


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature matrix, the number of shingles of each text, and their numbers by class (at most 255)."""
    out, count, classes = [np.zeros((0, COORDINATES), np.uint32)], [np.zeros(0, np.int64)], [np.zeros((0, SKETCH), np.uint8)]
    for lo, hi, data, offsets in batches(column, 1 << 20):
        h, row = shingles(data, offsets)
        out.append(darts(elements(h, row), row, hi - lo))
        count.append(np.bincount(row, minlength=hi - lo))
        by_class = np.bincount(row.astype(np.int64) * SKETCH + (h % np.uint64(SKETCH)).astype(np.int64), minlength=(hi - lo) * SKETCH)
        classes.append(np.minimum(by_class, 255).astype(np.uint8).reshape(-1, SKETCH))
    return np.concatenate(out), np.concatenate(count), np.concatenate(classes)


def agreement(least: float) -> int:
    """Agreeing coordinates under which a pair isn't checked: five deviations under ``least``."""
    return max(1, int(COORDINATES * least - 5 * np.sqrt(COORDINATES * least * (1 - least))))


def _unpacked(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, numbers by class, and weights."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)
    weight = np.ascontiguousarray(raw[:, COORDINATES + SKETCH :]).view("<i8").ravel()
    return raw[:, :COORDINATES], raw[:, COORDINATES : COORDINATES + SKETCH], weight


def possible(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether rows ``x`` of ``a`` and ``y`` of ``b``, (numbers by class, weights), can have similarity ``least``.

    What a class counts beyond 255 is common to both texts as far as both have such a rest.
    """
    out, rests = [np.zeros(0, bool)], [w - c.sum(1, dtype=np.int64) for c, w in (a, b)]
    for at in range(0, len(x), 1 << 14):
        u, v = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
        both = np.minimum(a[0][u], b[0][v]).sum(1, dtype=np.int64) + np.minimum(rests[0][u], rests[1][v])
        out.append(both >= (least - 1e-9) * (a[1][u] + b[1][v] - both))
    return np.concatenate(out)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, bands) of 64-bit keys; the band's number is part of the key."""
    bands = sig.shape[1] // ROWS
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for k in range(ROWS):
        key = mix(key * _STEP + sig[:, k::ROWS][:, :bands])
    return key.view(np.int64)


def weighted_jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Similarity of the shingles' 64-bit hashes of two columns' texts, row by row; 0 where a side has no shingles."""
    out = np.zeros(len(a))
    limit = 0
    sizes = np.diff(np.concatenate([[0], np.cumsum([len(x.as_py() or "") + len(y.as_py() or "") for x, y in zip(a, b)])]))
    at = 0
    while at < len(a):  # pairs of about a megabyte at a time
        to, limit = at + 1, sizes[at]
        while to < len(a) and limit + sizes[to] < 1 << 20:
            limit += sizes[to]
            to += 1
        side = []
        for col in (a, b):
            es, rs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
            for lo, _, data, offsets in batches(col.slice(at, to - at), 1 << 20):
                h, row = shingles(data, offsets)
                es.append(elements(h, row))
                rs.append(row + np.int32(lo))
            side.append((np.concatenate(es), np.concatenate(rs)))
        n = to - at
        both, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        parts = max(1, -(-(len(side[0][0]) + len(side[1][0])) // (8 * AT_ONCE)))
        for part in range(parts):
            e, r = (np.concatenate([x[k] if parts == 1 else x[k][x[0] % np.uint64(parts) == part] for x in side]) for k in (0, 1))
            order = np.lexsort((e, r))
            e, r = e[order], r[order]
            both += np.bincount(r[1:][(e[1:] == e[:-1]) & (r[1:] == r[:-1])], minlength=n)
            total += np.bincount(r, minlength=n)
        out[at:to] = both / np.maximum(total - both, 1)
        at = to
    return out


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _nodes(docs: DataFrame, text_col: str) -> DataFrame:
    """One row for each different text with shingles: node, bands, signature (its lowest bytes, numbers by class, weight)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sig, count, by_class = signatures(b.column(1))
            some = np.flatnonzero(count > 0)
            keys = band_keys(sig[some])
            bands = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * keys.shape[1], pa.array(keys.ravel()))
            raw = [row.tobytes() for row in np.hstack([sig[some].astype(np.uint8), by_class[some], count[some].astype("<i8")[:, None].view(np.uint8)])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), bands, pa.array(raw, pa.binary())], names=["node", "bands", "sig"])

    bound_batches(docs.sparkSession)
    src = docs.select(node_of(quoted(text_col)).alias("node"), quoted(text_col).alias("_text"))
    rows = src.mapInArrow(run, "node binary, bands array<long>, sig binary")
    return written(rows.groupBy("node").agg(F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig")), "near")


def _members(nodes: DataFrame, *carried: str) -> DataFrame:
    """A row for each node and band: key, node, band, and what is carried."""
    rows = nodes.select("node", *carried, F.posexplode("bands").alias("band", "key"))
    return rows.withColumn("key", F.col("key").cast("string"))


def _large(nodes: DataFrame) -> DataFrame:
    """Buckets of more than ``SMALL`` nodes: _key, n."""
    sums = nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return written(sums.where(F.col("n") > SMALL).select(F.col("key").cast("string").alias("_key"), "n"), "near", nodes.count() * (COORDINATES // ROWS))


def _in_large(nodes: DataFrame, large: DataFrame, n_large: int) -> DataFrame:
    """The rows of large buckets, narrow: key, node, band.  Written once, since every later step starts from them."""
    met = attached(_members(nodes), "key", large, "_key", n_large, BROADCAST_NODES)
    return written(met.where("n is not null").select("key", "node", "band"), "near")


def candidate_pairs(nodes: DataFrame, large: DataFrame, n_large: int, in_large: DataFrame) -> DataFrame:
    """Pairs (a, b) to check first: all of buckets of up to ``SMALL`` nodes, each with the first node of larger ones.

    Sizes and first nodes are aggregated before rows meet them, so a large bucket
    is never gathered.
    """
    met = attached(_members(nodes).select("key", "node"), "key", large, "_key", n_large, BROADCAST_NODES)
    small = met.where("n is null").groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("all")).where("size(all) > 1")
    small = small.select(F.explode(F.expr("transform(sequence(1, size(all) - 1), i -> struct(all[i] as b, slice(all, 1, i) as before))")).alias("x"))
    small = small.select(F.explode("x.before").alias("a"), F.col("x.b").alias("b"))
    first = written(in_large.groupBy(F.col("key").alias("_key")).agg(F.min("node").alias("first")), "near", n_large)
    star = attached(in_large.select("key", "node"), "key", first, "_key", n_large, BROADCAST_NODES).select(F.col("first").alias("a"), F.col("node").alias("b"))
    return small.unionByName(star).where("a != b").distinct()


def agreeing(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], ra: np.ndarray, rb: np.ndarray, nearest: int | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different classes that agree enough and can have similarity ``least``: all, or each row's ``nearest``.

    a, b: signatures, numbers by class, weights.
    """
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    (sa, sb), enough = (a[0], b[0]), agreement(least)
    ta, tb = np.ascontiguousarray(sa.T), np.ascontiguousarray(sb.T)
    for lo in range(0, len(sa), 128):
        same = np.zeros((len(sa[lo : lo + 128]), len(sb)), np.uint8)
        for k in range(COORDINATES):
            same += ta[k, lo : lo + 128, None] == tb[k]
        same[(same < enough) | (ra[lo : lo + 128, None] == rb)] = 0
        x, y = np.nonzero(same)
        can = possible(a[1:], b[1:], x + lo, y, least)
        if nearest is None or nearest >= len(sb):
            x, y = x[can], y[can]
        else:
            same[x[~can], y[~can]] = 0
            best = np.argpartition(same, len(sb) - nearest, axis=1)[:, -nearest:]
            x, n = np.nonzero(np.take_along_axis(same, best, 1))
            y = best[x, n]
        xs.append(x + lo)
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def _open_rows(nodes: DataFrame, found: DataFrame, in_large: DataFrame, n_large: int, last: bool) -> DataFrame:
    """Nodes of the large buckets that hold several classes: key, node, sig, band (the key's), root, major (the largest class), n, few (nodes outside it); in the ``last`` round bands too.

    Which buckets those are is found on keys and classes alone; signatures are
    fetched once for each node that remains.
    """
    rooted = attached(in_large, "node", found.withColumnRenamed("node", "_of"), "_of", found.count(), BROADCAST_NODES)
    rooted = written(rooted.withColumn("root", F.coalesce("root", "node")), "near")
    shares = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("own"))
    opened = shares.groupBy(F.col("key").alias("_key")).agg(F.sum("own").alias("n"), F.max(F.struct("own", "root")).alias("most"), F.count(F.lit(1)).alias("classes"))
    opened = opened.where("classes > 1").select("_key", "n", F.col("most.root").alias("major"), (F.col("n") - F.col("most.own")).alias("few"))
    opened = written(opened, "near", n_large)
    rows = attached(rooted, "key", opened, "_key", opened.count(), BROADCAST_NODES).where("n is not null")
    # at most one place for each band, so a node's list is short
    of = written(rows.groupBy(F.col("node").alias("_of")).agg(F.any_value("root").alias("root"), F.collect_list(F.struct("key", "band", "major", "n", "few")).alias("places")), "near")
    held = nodes.select("node", "sig", "bands") if last else nodes.select("node", "sig")
    held = attached(held, "node", of, "_of", of.count(), BROADCAST_NODES).where("places is not null")
    return written(held.withColumn("_p", F.explode("places")).select(*held.drop("places").columns, "_p.*"), "near")


def _open_pairs(rows: DataFrame, nearest: int | None, least: float) -> DataFrame:
    """Agreeing pairs of different classes of open rows.

    Every node is in one block; nodes outside the largest class are dealt into
    parts too, and every part meets every block.  Without ``nearest``, a pair is
    given by the first band only that it shares.
    """
    blocks, parts = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil(F.col("few") / BLOCK).cast("int")
    block, part = (F.pmod(F.xxhash64(F.lit(seed), "node"), F.greatest(count, F.lit(1))).cast("int") for seed, count in ((1, blocks), (2, parts)))
    every = lambda count: F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)
    few = F.col("root") != F.col("major")
    # bands by their lowest 31 bits; only the last round reads them
    earlier = F.transform("bands", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")) if nearest is None else F.lit(None).cast("array<int>")
    values = [few.alias("few"), F.col("band").cast("short").alias("band"), F.col("node"), F.col("root"), F.col("sig"), earlier.alias("earlier")]
    as_row = rows.select("key", block.alias("i"), F.explode(every(parts)).alias("j"), F.lit(False).alias("asks"), *values)
    asking = rows.where(few).select("key", F.explode(every(blocks)).alias("i"), part.alias("j"), F.lit(True).alias("asks"), *values)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        node, asks = t.column("node").combine_chunks(), t.column("asks").to_numpy()
        root = t.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        sig = _unpacked(t.column("sig"))
        u, v = np.flatnonzero(asks), np.flatnonzero(~asks)
        x, y = agreeing(tuple(c[u] for c in sig), tuple(c[v] for c in sig), root[u], root[v], nearest, least)
        if nearest is None and len(x):
            # of two nodes outside the largest class only one asks
            name, order = node.to_pylist(), np.zeros(len(node), np.int64)
            order[sorted(range(len(name)), key=name.__getitem__)] = np.arange(len(name))
            few = t.column("few").to_numpy()[v]
            one = ~few[y] | (order[u[x]] < order[v[y]])
            x, y = x[one], y[one]
            bands = np.array(t.column("earlier").to_pylist(), np.int32)[:, : int(t.column("band")[0].as_py())]
            first = [~(bands[u[x[k : k + 65536]]] == bands[v[y[k : k + 65536]]]).any(1) for k in range(0, len(x), 65536)]
            first = np.concatenate([np.zeros(0, bool), *first])
            x, y = x[first], y[first]
        return pa.table({"a": node.take(pa.array(u[x])), "b": node.take(pa.array(v[y]))})

    found = as_row.unionByName(asking).groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found if nearest is None else found.distinct()


def _met(pairs: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """a, b, and the ``value`` of both nodes.

    A node with over ``BUSY`` pairs (of the ``HOT_GROUPS`` with most) has its pairs
    salted and its value copied once for each salt that occurs, so that the pairs
    of one node don't meet in one task.
    """
    out = pairs
    for side, other, named in (("a", "b", "_va"), ("b", "a", "_vb")):
        busy = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BUSY).orderBy(F.desc("_n"), side).limit(HOT_GROUPS)
        busy = busy.select(F.col(side).alias("_busy"))  # at most HOT_GROUPS rows
        salt = F.when(F.col("_busy").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.lit(SALTS))).cast("int")
        out = out.join(F.broadcast(busy), F.col(side) == F.col("_busy"), "left").withColumn("_salt", salt).drop("_busy")
        copies = busy.withColumn("_salts", F.sequence(F.lit(0), F.lit(SALTS - 1)))
        values = nodes.select(F.col("node").alias("_node"), F.col(value).alias(named)).join(F.broadcast(copies), F.col("_node") == F.col("_busy"), "left")
        values = values.select("_node", named, F.explode(F.coalesce("_salts", F.array(F.lit(0)))).alias("_own"))
        out = out.join(values, (F.col(side) == F.col("_node")) & (F.col("_salt") == F.col("_own"))).drop("_node", "_own", "_salt")
    return out.select("a", "b", "_va", "_vb")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree enough and whose bound allows ``least``, with the number of coordinates that agree."""
    enough = agreement(least)

    def agree(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, y = _unpacked(b.column(2)), _unpacked(b.column(3))
            same, every = (x[0] == y[0]).sum(1), np.arange(len(x[0]))
            keep = pa.array(np.flatnonzero((same >= enough) & possible(x[1:], y[1:], every, every, least)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(same).take(keep)], names=["a", "b", "same"])

    return _met(pairs, nodes, "sig").mapInArrow(agree, "a binary, b binary, same long")


def block_similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Similarity of every text of ``a`` with every one of ``b``, as ``weighted_jaccard`` has it."""
    both, sides = np.zeros((len(a), len(b))), []
    for col in (a, b):
        found = [elements(h, row) for h, row in (shingles(data, offsets) for _, _, data, offsets in batches(col, 0))]  # text by text
        sides.append((np.concatenate([np.zeros(0, np.uint64), *found]), np.repeat(np.arange(len(col)), [len(x) for x in found]), np.array([len(x) for x in found])))
    parts = max(1, -(-(len(sides[0][0]) + len(sides[1][0])) // COLUMNS))
    for part in range(parts):
        (ea, ra), (eb, rb) = ((e, r) if parts == 1 else (e[own], r[own]) for e, r, own in ((e, r, e % np.uint64(parts) == part) for e, r, _ in sides))
        seen, at = np.unique(np.concatenate([ea, eb]), return_inverse=True)
        has = np.zeros((len(a), len(seen)), np.float32), np.zeros((len(b), len(seen)), np.float32)
        has[0][ra, at[: len(ea)]] = 1
        has[1][rb, at[len(ea) :]] = 1
        both += has[0] @ has[1].T
    return both / np.maximum(sides[0][2][:, None] + sides[1][2] - both, 1)


def _checked_blocks(texts: DataFrame, pairs: DataFrame, n_busy: int, least: float) -> DataFrame:
    """The pairs of busy nodes whose texts have similarity ``least`` or more."""
    blocks = max(1, -(-n_busy // CHECK_BLOCK))
    of = lambda x: F.pmod(F.xxhash64(x), F.lit(blocks)).cast("int")
    swap = of("a") > of("b")
    dealt = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    dealt = dealt.select(of("a").alias("i"), of("b").alias("j"), "a", "b")
    wanted = dealt.select("i", "j", F.explode(F.array("a", "b")).alias("_w")).distinct()
    sides = wanted.join(texts, F.col("_w") == F.col("node")).select(F.col("i").alias("i"), F.col("j").alias("j"), "node", "text")

    def run(p: pa.Table, t: pa.Table) -> pa.Table:
        place = {x: k for k, x in enumerate(t.column("node").to_pylist())}
        x, y = (np.array([place[v] for v in p.column(side).to_pylist()], np.int64) for side in ("a", "b"))
        u, x = np.unique(x, return_inverse=True)
        v, y = np.unique(y, return_inverse=True)
        text = t.column("text").combine_chunks()
        sim = block_similarities(text.take(pa.array(u)), text.take(pa.array(v)))[x, y]
        keep = np.flatnonzero(sim >= least - 1e-12)
        return pa.table({"a": p.column("a").take(pa.array(keep)), "b": p.column("b").take(pa.array(keep)), "similarity": sim[keep]})

    return dealt.groupBy("i", "j").cogroup(sides.groupBy("i", "j")).applyInArrow(run, "a binary, b binary, similarity double")


def _checked(docs: DataFrame, text_col: str, likely: DataFrame, least: float) -> DataFrame:
    """The pairs whose texts have similarity ``least`` or more."""
    wanted = likely.select(F.explode(F.array("a", "b")).alias("_want")).groupBy("_want").agg(F.count(F.lit(1)).alias("_pairs"))
    wanted = written(wanted, "near", 2 * likely.count())
    n, n_busy = wanted.agg(F.count(F.lit(1)), F.count(F.when(F.col("_pairs") > BUSY, 1))).first()
    texts = docs.select(node_of(quoted(text_col)).alias("node"), quoted(text_col).alias("text"))
    texts = attached(texts, "node", wanted, "_want", n, BROADCAST_NODES).where("_pairs is not null")
    texts = texts.groupBy("node").agg(F.any_value("text").alias("text"), F.any_value("_pairs").alias("_pairs"))

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sim = weighted_jaccard(b.column(2), b.column(3))
            keep = pa.array(np.flatnonzero(sim >= least - 1e-12))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(sim[keep.to_numpy()])], names=["a", "b", "similarity"])

    pairs, found = likely.select("a", "b"), None
    if n_busy:
        busy = wanted.where(F.col("_pairs") > BUSY)
        for side in ("a", "b"):
            named = busy.select(F.col("_want").alias("_of"), F.lit(True).alias(f"_busy_{side}"))
            pairs = attached(pairs, side, named, "_of", n_busy, BROADCAST_NODES)
        pairs = pairs.select("a", "b", F.coalesce(F.col("_busy_a") & F.col("_busy_b"), F.lit(False)).alias("_both"))
        found = _checked_blocks(texts.where(F.col("_pairs") > BUSY), pairs.where("_both").select("a", "b"), n_busy, least)
        pairs = pairs.where("not _both").select("a", "b")
    one = _met(pairs, texts, "text").mapInArrow(check, "a binary, b binary, similarity double")
    return written(one if found is None else one.unionByName(found), "near")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs of nodes of different classes."""
    n, out = found.count(), pairs
    for side in ("a", "b"):
        named = found.select(F.col("node").alias("_of"), F.col("root").alias(f"_r{side}"))
        out = attached(out, side, named, "_of", n, BROADCAST_NODES)
    return out.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")


def classes(docs: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """node -> root (its class's smallest node), for the nodes of classes of two and more texts."""
    nodes = _nodes(docs, text_col)
    large = _large(nodes)
    n_large = large.count()
    in_large = _in_large(nodes, large, n_large)
    likely = written(_likely(candidate_pairs(nodes, large, n_large, in_large), nodes, least), "near")
    # maxima are combined before the exchange, so a node with many candidates isn't gathered
    near = [likely.groupBy(x).agg(F.max(F.struct("same", y)).alias("best")).select(x, F.col(f"best.{y}").alias(y)).select("a", "b") for x, y in (("a", "b"), ("b", "a"))]
    links = _checked(docs, text_col, written(near[0].union(near[1]).distinct(), "near", 2 * likely.count()), least)
    found = components(links, "a", "b")
    rest = _apart(likely, found)
    for nearest in (NEAREST, None):
        more = _open_pairs(_open_rows(nodes, found, in_large, n_large, nearest is None), nearest, least)
        if nearest is not None:
            more = more.unionByName(rest).distinct()
        more = written(more, "near")
        if more.isEmpty():
            break  # no pair of different classes agrees enough, so the last round has none either
        checked = _checked(docs, text_col, more, least)
        if not checked.isEmpty():
            links = links.unionByName(checked)
            found = components(links, "a", "b")
    return found


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, carry: bool = False) -> DataFrame:
    """Every row with _id, _class (smallest id of its class), _size, _kept, and all its columns in ``_row`` where ``carry``."""
    found = classes(docs, text_col, least)
    rows = docs.select(quoted(id_col).alias("_id"), node_of(quoted(text_col)).alias("_node"), *[rowed(docs)] * carry)
    # light: one row for each text, then for each text of a class of several rows
    texts = rows.groupBy("_node").agg(F.min("_id").alias("_class"), F.count(F.lit(1)).alias("_size"))
    texts = texts.join(found, F.col("_node") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_node"))
    texts = written(texts.where("root is not null or _size > 1").select(F.col("_node").alias("_of"), "_root", "_class", "_size"), "near")
    sums = texts.groupBy("_root").agg(F.min("_class").alias("_class"), F.sum("_size").alias("_size")).withColumnRenamed("_root", "_sum")
    n = texts.count()
    sums = written(sums, "near", n)
    table = written(attached(texts.select("_of", "_root"), "_root", sums, "_sum", sums.count(), BROADCAST_NODES), "near", n)
    repeated = not rows.groupBy("_id").count().where("count > 1").isEmpty()
    out = attached(rows, "_node", table, "_of", table.count(), BROADCAST_NODES)
    out = out.withColumn("_class", F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_class")))
    out = out.withColumn("_size", F.coalesce("_size", F.lit(1)).cast("long")).withColumn("_kept", F.col("_id").eqNullSafe(F.col("_class")))
    if repeated:
        out = once(out.withColumn("_root", F.coalesce("_root", "_node")), ["_root", "_id"], "_kept")
    return out.drop("_node", "_root")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row for every document: id, class_id, class_size, kept."""
    return marked(docs, id_col, text_col, least).select(F.col("_id").alias(id_col), F.col("_class").alias("class_id"), F.col("_size").alias("class_size"), F.col("_kept").alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One document of each class, with all its columns."""
    return unrowed(marked(docs, id_col, text_col, least, carry=True).where("_kept"), docs.columns)
