import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, codec, exact_dedup, langid, minhash, packing, quality, sharding, topk, toxicity
from spanloom.llm._chunks import ChunkEncoder

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000
ODD = [
    (1, "a  b c"), (2, "a b\nc"), (3, None), (4, ""), (5, None), (6, "one two three four five six seven"), (6, "one two three four five six seven"),
    (None, "null id"), (8, LONG), (9, "don't  it's 　 x"), (10, "<|endoftext|> 日本語 é"), (11, "..!?"),
]
SCHEMA = "doc_id long, text string, kept boolean, lang string, size int, rank string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, True, "en" if t else None, 3, "x") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(odd, empty):
    got = sharding.shard_digest(odd, bucket_bytes=1000).collect()
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in ODD)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard_digest(empty).isEmpty()


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"digest": lambda c: F.substring(F.sha2(c, 256), 1, 1)}])
def test_exact_dedup(odd, empty, options):
    got = exact_dedup.exact_dedup(odd, **options).collect()
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in ODD]
    for (i, _), n in zip(ODD, norm):
        mine = [r for r in got if r.doc_id == i]
        same = [j for (j, _), m in zip(ODD, norm) if m == n]
        assert all(r.group_size == len(same) and r.keep_id == min((j for j in same if j is not None), default=None) for r in mine)
    assert sum(r.kept for r in got) == len(set(norm)) and len(got) == len(ODD)
    kept = exact_dedup.drop_exact_copies(odd, **options)
    assert kept.columns == odd.columns and kept.count() == len(set(norm))
    assert exact_dedup.exact_dedup(empty, **options).isEmpty()


def test_packing(odd, empty):
    got = packing.packed(odd, P.path("byte_bpe_50k.json"), partition_rows=3).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    n = sum(len(x) for x in [*ChunkEncoder(P.path("byte_bpe_50k.json")).library.encode_batch([t or "" for _, t in ODD], add_special_tokens=False)]) + len(ODD)
    assert sum(r.length for r in got) == n
    assert packing.packed(empty, P.path("byte_bpe_50k.json")).isEmpty()


def test_best_fit_and_bounds():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x = rng.integers(1, 101, 200)
        bins, offsets, fill = packing.best_fit_decreasing(x, 100)
        assert fill.max() <= 100 and (np.bincount(bins, x) == fill).all() and len(fill) >= packing.lower_bound(x, 100)
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3 and packing.lower_bound(np.array([34] * 6), 100) == 3


def test_chunks_equal_the_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = ChunkEncoder(P.path(name))
        got = [i[o[k] : o[k + 1]].tolist() for lo, hi, i, o in e.encode(pa.array([t for _, t in ODD])) for k in range(hi - lo)]
        assert got == [e.library.encode(t or "", add_special_tokens=False).ids for _, t in ODD]


def test_chunks_that_hold_the_mark():
    texts = ["one two\n~ three\n~", " ~ \n~\n~ x", "\n~", *(f"w{k} v{k}\n~ ~{k}" for k in range(200))]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = ChunkEncoder(P.path(name))
        for _ in range(2):  # new chunks, then known ones
            got = [i[o[k] : o[k + 1]].tolist() for lo, hi, i, o in e.encode(pa.array(texts)) for k in range(hi - lo)]
            assert got == [e.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_codec_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2047, 2048, 2049, 4096, 4097, 9000):
        ids = (rng.zipf(1.2, n) % 49408).astype(np.uint32)
        data = codec.pack_segment(ids, np.array([n]))
        assert (codec.unpack_segment(data)[0] == ids).all()
    broken = bytearray(data)
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        codec.unpack_segment(bytes(broken))


def test_token_files(odd, empty):
    got = {(r.doc_id, r.start): r for r in codec.token_file_digest(odd, P.path("word_bpe_49k.json")).collect()}
    order = sorted(got.values(), key=lambda r: r.start)
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:k]) for k in range(len(order))]
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(ODD)
    assert codec.token_file_digest(empty, P.path("word_bpe_49k.json")).isEmpty()


def test_byte_bpe(odd, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(path, P.PATTERN)
    assert bpe.encode(enc, LONG) == enc.encode_ordinary(LONG)
    got = bpe.round_trip_digest(odd, path, P.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)
    assert bpe.decoded(bpe.encoded(odd, path, P.PATTERN), path, P.PATTERN).count() == len(ODD)
    assert bpe.round_trip_digest(empty, path, P.PATTERN).isEmpty()


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 12)]) for i in range(120)] + [(200, None), (220, [1.0, None]), (240, [float("nan")]), (260, [1e7] * 3), (261, [1e7] * 3), (None, [0.5] * 12)]
    rows += [(300 + i, [0.25] * 12) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, 5, part_rows=50, query_rows=4).collect())
    v = {i: [int(np.floor(np.float64(np.float32(x)) * 64)) for x in e] for i, e in rows if i is not None and e and None not in e and np.isfinite(e).all()}
    want = []
    for q in v:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))[:5]
            want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(s)]
    assert got == sorted(want)


def test_near_dedup(spark, odd, empty):
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    near = [[*base[:k], "changed", *base[k + 1 :]] for k in range(5, 290, 5)]
    other = [[f"v{x}" for x in rng.integers(0, 10**6, 200)] for _ in range(20)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate([base, *near, *other])], "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_dedup(docs).collect()}
    assert all(got[i].class_id == 0 for i in range(len(near) + 1)) and all(got[i].class_size == 1 for i in range(len(near) + 1, len(got)))
    kept = minhash.drop_near_copies(odd)
    # rows 1 and 2 have the same words
    assert kept.columns == odd.columns and kept.count() == len({t or "" for _, t in ODD}) - 1
    assert minhash.near_dedup(empty).isEmpty()


def test_bound_never_drops_a_pair():
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    texts = [" ".join(words[: 5 * k]) for k in range(1, 80, 3)]
    # shingles that repeat over 255 times, and texts shorter than a shingle
    texts += [" ".join(["a"] * n) for n in (1, 3, 300, 380, 400, 900)] + ["b c " * n for n in (1, 250, 300, 350)]
    sig, count, by_class = minhash.signatures(pa.array(texts))
    x, y = (g.ravel() for g in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    exact = minhash.weighted_jaccard(pa.array([texts[k] for k in x]), pa.array([texts[k] for k in y]))
    for least in (0.5, 0.8, 0.95):
        can = minhash.possible((by_class, count), (by_class, count), x, y, least)
        assert can[exact >= least].all() and not can[exact < least / 2].all()


def brute_classes(texts):
    """Each text's class by all pairs: the first place of its component at similarity 0.8."""
    grams = []
    for t in texts:
        w, seen = re.findall("[a-z0-9]+", t.lower()), Counter()
        shingles = [tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))] if w else []
        grams.append({(x, seen.update([x]) or seen[x]) for x in shingles} or {t})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j]:
                both = len(grams[i] & grams[j])
                if both >= 0.8 * (len(grams[i]) + len(grams[j]) - both):
                    root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


@pytest.mark.parametrize("block", [1024, 100])
def test_near_dedup_of_a_base_and_its_edits(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    texts = []
    # 4 to 6 changes: 0.88 to 0.82 to the base, mostly under 0.8 to each other; 8 changes are under 0.8 to the base
    for n in (6, 6, 6, 5, 4) * 66 + (8,) * 60:
        edit = list(base)
        for k in rng.choice(np.arange(5, 290, 6), n, replace=False):
            edit[k] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(edit))
    texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_dedup(docs).collect()}
    want = brute_classes(texts)
    assert max(Counter(want).values()) > 300 and len(set(want)) > 20
    assert [got[i] for i in range(len(texts))] == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    a = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 800))
    b = " ".join([*a.split()[:700], *(f"x{x}" for x in rng.integers(0, 10**6, 100))])
    sig, _, _ = minhash.signatures(pa.array([a, b]))
    exact = minhash.weighted_jaccard(pa.array([a]), pa.array([b]))[0]
    assert exact == pytest.approx(696 / 896, abs=1e-9) and abs((sig[0] == sig[1]).mean() - exact) < 0.2


def test_language_of_only_empty_texts(spark):
    model = langid.train([b"one two three four", b"eins zwei drei vier"], np.array([0, 1]), ["a", "b"], steps=2)
    rows = langid.identify(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").coalesce(1), model).collect()
    assert {(r._id, r._lang, r._score) for r in rows} == {(1, "und", 0.0), (2, "und", 0.0)}


def test_models(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lang = langid.language_of(docs).join(docs, "doc_id")
    held = lang.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.9
    got = {r.doc_id: r for r in langid.language_of(odd).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[11].lang_pred == "und" and got[1].lang_pred == "en"
    assert langid.language_of(empty).isEmpty()
    bag = toxicity.train(pa.array(["you awful idiot. fine day"] * 10 + ["fine day. good work"] * 10), np.array([1] * 10 + [0] * 10))
    found = toxicity.offending(spark.createDataFrame([(1, "good work. you awful idiot.")], "doc_id long, text string"), bag).collect()
    assert [r.sentence.strip() for r in found] == ["you awful idiot."] and found[0].start == 10
    for f in (toxicity.toxicity_of, quality.quality_of):
        assert f(odd, labels).count() == len(ODD) and f(empty, labels).isEmpty()
        assert f(docs, labels).agg(F.min("score") >= 0, F.max("score") <= 1).first()[:] == (True, True)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_chunks_of_one_hash_keep_their_ids():
    """Two texts that any polynomial hash modulo 2**64 confuses."""
    x = "a"
    while len(x) < 2048:
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    texts = [x, y, f"{x} {y}", " ".join([x, y, "hi there"] * 400), "", "z" * 3_000_000]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = ChunkEncoder(P.path(name))
        got = [i[o[k] : o[k + 1]].tolist() for lo, hi, i, o in e.encode(pa.array(texts[:5])) for k in range(hi - lo)]
        assert got == [e.library.encode(t, add_special_tokens=False).ids for t in texts[:5]]


def test_codec_is_smaller_than_zlib_on_its_blocks(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    e = ChunkEncoder(P.path("word_bpe_49k.json"))
    ids = np.concatenate([i for _, _, i, _ in e.encode(pa.array(texts))]).astype(np.uint32)
    own = len(codec.pack_segment(ids, np.array([len(ids)])))
    other = sum(len(zlib.compress(ids[k : k + codec.BLOCK].astype("<u2").tobytes(), 9)) for k in range(0, len(ids), codec.BLOCK))
    assert own < 0.85 * other


def test_token_digest_equals_the_library(odd):
    library = ChunkEncoder(P.path("word_bpe_49k.json")).library
    want = sorted(zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in ODD)
    assert sorted(r.ids_crc32 for r in codec.token_file_digest(odd, P.path("word_bpe_49k.json")).collect()) == want


def test_noisy_or_of_many_sentences():
    rows = np.repeat([0, 1, 2], [100_000, 3, 2])
    z = np.concatenate([np.full(100_000, -14.0), [-5.0, 3.0, -9.0], [0.0, 0.0]])
    p = 1 / (1 + np.exp(-z))
    plain = [1 - np.prod(1 - p[rows == k]) for k in range(3)]
    got = toxicity.noisy_or(z, rows, 3)
    assert got == pytest.approx(plain) and got[0] < 0.1 and got[1] > 0.9 and got[2] == pytest.approx(0.75)
    assert toxicity.noisy_or(np.full(1000, -2.2), np.zeros(1000, int), 1)[0] > 0.99  # weak signs in many sentences add up


def _auc(y, score):
    pairs = [(a > b) + 0.5 * (a == b) for a in score[y == 1] for b in score[y == 0]]
    return sum(pairs) / len(pairs)


@pytest.mark.parametrize("sf, plain", [("sf0.01", 0.974), ("sf0.1", 0.9805)])
def test_toxicity_held_out(spark, sf, plain):
    """Ranks held-out texts no worse than a noisy-or without weights for clean bags (``plain``); long clean texts stay clean."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    bag = toxicity.fit(docs, labels)
    held = docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0 and toxic is not null").orderBy("doc_id").select("text", "toxic").toPandas()
    score, y = toxicity.document_scores(bag, pa.array(held.text.tolist())), held.toxic.to_numpy()
    assert _auc(y, score) >= plain and ((score >= 0.5) == y).mean() > 0.95
    clean = held.text[(y == 0) & (score < 0.1)].tolist()[:100]
    assert toxicity.document_scores(bag, pa.array(["\n".join(clean)]))[0] < 0.5


def test_top_k_fails_on_what_a_long_cannot_hold(spark):
    for v in ([1e30], [3e9]):
        df = spark.createDataFrame([(0, v), (1, v), (20, [0.5])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="over 64 bits"):
            topk.top_k(df).collect()


def test_stages_carry_clashing_names(spark):
    names = ["_id", "_row", "_text", "_score", "_lang", "_kept", "_digest", "_size", "_keep", "a.b"]
    rows = [(k, "you and me and the others there" if k < 3 else f"text number {k}", "en", *range(len(names))) for k in range(5)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", *names])
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    for out, n in ((exact_dedup.drop_exact_copies(docs), 3), (minhash.drop_near_copies(docs), 3), (toxicity.keep_clean(docs, labels), 5), (langid.keep_identified(docs), 5)):
        assert out.columns == docs.columns and out.count() == n
