"""Phrase mining and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from spanloom.llm import periodic, phrases


def brute_phrases(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) >= 2 and a >= least}
        inside = {q[i:j] for q in cand for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and 100 * cand[q] >= 100 * own[q[i:j]]}
        rows_ = []
        for p, a in cand.items():
            if p in inside:
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((score, a, " ".join(p), own[p[:k]], own[p[k:]]))
        rows_.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, lf, r, n[lang], s) for i, (s, a, p, lf, r) in enumerate(rows_[:top], 1)]
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["The", "the", "of", "é", "É", "new", "york", "CITY", "a", "bb", "ccc", "x'y", "日本", " z"]
    weights = [9, 9, 8, 2, 2, 3, 3, 3, 5, 3, 2, 1, 2, 1]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", "; ", "! ", "?", ":", "\r\n", "\x0c"]
    rows = []
    for _ in range(n):
        text = ""
        for w in rng.choices(words, weights, k=rng.randrange(0, 90)):
            text += w + (" " if rng.random() < 0.8 else rng.choice(ends))
            if rng.random() < 0.15:
                text += "new york city of the "
        rows.append((rng.choice(["en", "de", None]), text))
    return rows + [("en", None), ("en", ""), (None, "..."), rows[0], rows[0]]


@pytest.mark.parametrize("head", [1 << 18, 7, 1])
def test_phrases_equal_brute_force(spark, head):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, g, t, "e", 0) for i, (g, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, f int").repartition(5)
    got = phrases.collocations(docs, least=6, top=40, head=head)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 6, 5, 40)


def test_phrases_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert phrases.collocations(docs).collect() == []


def test_scores_pass_64_bits(spark, monkeypatch):
    all_ = spark.createDataFrame([("en", "a b", 3_000_000_000_000, 2), ("en", "a", 5_000_000_000_000, 1), ("en", "b", 4_000_000_000_007, 1)], "lang string, phrase string, f long, size int")
    totals = spark.createDataFrame([("en", 9_000_000_000_000_001)], "lang string, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: (all_, totals))
    (row,) = phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect()
    assert row.score == 1000 * 3_000_000_000_000 * 9_000_000_000_000_001 // (5_000_000_000_000 * 4_000_000_000_007)


def test_tiles_dense_and_sparse(monkeypatch):
    rng = np.random.default_rng(5)
    s = np.minimum(rng.zipf(1.3, 60_000) - 2, 5000).astype(np.int32)
    want = Counter((int(a), int(b)) for a, b in zip(s[:-1], s[1:]) if a >= 0 and b >= 0)
    for dense in (10, 500, 1 << 40):
        monkeypatch.setattr(phrases, "DENSE", dense)
        got = Counter()
        for code, n in phrases.count_tiles(s):
            for c, k in zip(code.tolist(), n.tolist()):
                got[c >> 32, c & 0xFFFFFFFF] += k
        assert got == want


def test_tokens_of_long_texts():
    raw = ("word " * 50 + "Q" * 300 + " a,b\tc" * 40 + "." + "z" * 200).encode()
    whole = [t for part in phrases.tokens(raw) for t in part]
    for size in (10, 64, 201):
        assert [t for part in phrases.tokens(raw, size) for t in part] == whole


def brute_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q):
                found.setdefault((i, size), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(11)
    texts = [np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(40, np.int64)]
    for _ in range(120):
        w = []
        while len(w) < rng.randrange(1, 700):
            kind = rng.random()
            if kind < 0.4:
                unit = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, rng.choice([4, 10, 40, 90])))]
                w += (unit * rng.randrange(1, 9))[: rng.randrange(1, 400)]
            else:
                w += [rng.randrange(rng.choice([2, 60])) for _ in range(rng.randrange(30))]
        texts.append(np.array(w, np.int64))
    got = periodic.find_runs(texts)
    for w, g in zip(texts, got):
        assert g == brute_runs(w.tolist())
        assert g == periodic.find_runs([w])[0]


def test_run_digest_and_collapse(spark):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 9), (None, "b b b b b b c"), (5, "x y\x1cz " * 5), (4, "a " * 9)]
    for i in range(10, 130):
        rows.append((i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 120)))))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    got = sorted(map(tuple, periodic.run_digest(docs).collect()), key=str)
    want = []
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = brute_runs(w)
        top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        text = " ".join(x for k, x in enumerate(w) if k not in gone)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert any(r[1] for r in got)
    assert periodic.run_digest(docs.limit(0)).collect() == []
    clean = {r.doc_id: r.text for r in periodic.collapsed(docs).where("doc_id in (4, 5)").collect()}
    assert clean == {4: "a", 5: "x y\x1cz"} or clean == {4: "a", 5: " ".join(["x y\x1cz"] * 5)}
    assert {(r.start, r.length, r.period, r.repeated) for r in periodic.periodic_runs(docs).where("doc_id = 4").collect()} == {(0, 9, 1, "a")}


def test_words_of_long_texts():
    raw = ("word \x0b" * 50 + "Q" * 300 + " a\tb" * 40 + "z" * 200).encode()
    for size in (10, 64, 201):
        words = periodic.Vocabulary()
        spelled = [list(words)[k] for k in periodic.word_numbers(raw, words, size)]
        assert spelled == raw.split()


def test_more_phrases_than_words_get_ids(spark, monkeypatch):
    rows = corpus(3)
    docs = spark.createDataFrame([(g, t) for g, t in rows], "lang string, text string").repartition(5)
    words = phrases.word_counts(phrases._texts(docs, "text", "lang")).where("phrase is not null and f >= 6").count()
    pairs = phrases.frequent_phrases(docs, least=6, longest=2)[0].where("size = 2").count()
    assert words < pairs  # so ids for as many pairs as words would leave some to the pass over the texts

    def slow(*a):
        raise AssertionError("phrases are counted by their words")

    monkeypatch.setattr(phrases, "tail_counts", slow)
    got = phrases.collocations(docs, least=6, top=40, head=words)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 6, 5, 40)
