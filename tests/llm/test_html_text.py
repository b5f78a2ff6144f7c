"""Page parsing, exact marginals of the tree model, its gradient and held-out accuracy."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from spanloom.llm import html_text as H


@pytest.fixture(scope="module")
def model():
    return H.train(H.labelled_pages())


def blocks(page):
    return [x for x in H.parse(page).texts if x is not None]


def test_blocks():
    assert blocks("<p>a <b>b<i>c</i>\n\t d</b></p> e<br>f<div>g</div>") == ["a bc d", "e f", "g"]
    assert blocks("<p>one<p>two</p></p><ul><li>x<li>y</ul>z") == ["one", "two", "x", "y", "z"]
    assert blocks("<script>if (a < b) '</p>'</script><style>p{}</style><!-- <p>no</p> -->a &amp; b&nbsp;&#233; 3 < 4 &lt;p&gt;") == ["a & b é 3 < 4 <p>"]
    assert blocks('<div title="a > b" class=\'x\'>t</div>') == ["t"]
    assert blocks("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert blocks("") == [] and blocks("only text") == ["only text"] and blocks("a<p") == ["a"] and blocks("a</p>b") == ["a", "b"]
    # a quote without an end: the tag ends at the next >
    assert blocks('<a href="x>y') == ["y"] and blocks('<div class="x>t</div>u') == ["t", "u"]
    assert blocks("<p>" * 3 + "x" + "<div>" * 5000 + "y") == ["x", "y"]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    trees = [H.parse("<div class=post><h1>T</h1><p>a. b</p><ul><li>x<li>y</ul></div><nav><a>q</a></nav>"), H.parse("text<p>u")]
    numbers = {}
    f = H.forest(trees, numbers, grow=True)
    weights, edges = rng.normal(size=len(numbers)), rng.normal(size=(len(H.KINDS), 2, 2))
    p, pair = H.messages(f, weights, edges)
    n = len(f.parent)
    score = np.bincount(f.node, weights[f.feature], n)
    total, want, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        y = np.array(y)
        w = np.exp((score * y).sum() + sum(edges[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        total += w
        want += w * y
        for i in range(n):
            if f.parent[i] >= 0:
                both[i, y[f.parent[i]], y[i]] += w
    assert np.allclose(p, want / total) and np.allclose(pair, both / total)


def test_training_follows_the_gradient():
    pages = H.labelled_pages(12, seed=3)
    numbers = {}
    f = H.forest([H.parse(p) for p in pages], numbers, grow=True)
    rng = np.random.default_rng(2)
    m = H.Model(numbers, rng.normal(size=len(numbers)) * 0.3, rng.normal(size=(len(H.KINDS), 2, 2)) * 0.3)
    p, pair = H.messages(f, m.weights, m.edges)
    g = np.bincount(f.feature, (f.label - p)[f.node], len(numbers))
    child = f.parent >= 0
    seen, expected = np.zeros_like(m.edges), np.zeros_like(m.edges)
    np.add.at(seen, (f.kind[child], f.label[f.parent[child]], f.label[child]), 1)
    np.add.at(expected, f.kind[child], pair[child])
    for table, grad, places in ((m.weights, g, [(k,) for k in range(0, len(numbers), 17)]), (m.edges, seen - expected, [(0, 1, 1), (1, 0, 1), (5, 0, 0)])):
        for k in places:
            before = table[k]
            table[k] = before + 1e-4
            up = H.log_likelihood(pages, m)
            table[k] = before - 1e-4
            down = H.log_likelihood(pages, m)
            table[k] = before
            assert (up - down) / 2e-4 == pytest.approx(grad[k], abs=1e-3)


def test_held_out_pages(model):
    trees = [H.parse(p) for p in H.labelled_pages(300, seed=99)]
    right = total = 0
    for t, leaves in zip(trees, model.leaves(trees)):
        for y, (_, p) in zip((y for y, x in zip(t.label, t.texts) if x is not None), leaves):
            right, total = right + (y == (p >= 0.5)), total + 1
    assert right / total > 0.98


ARTICLE = "<h1>The long way home</h1><p>First paragraph of the story, with some words in it. It goes on.</p><p>Short.</p><div class='ad'>Buy this now, it is cheap!</div><p>Last &amp; final <i>words</i>.</p>"
TEXT = "The long way home\nFirst paragraph of the story, with some words in it. It goes on.\nShort.\nLast & final words."
AROUND = [
    "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>", "<header><h1>Daily</h1><p>All the news</p></header>",
    "<div class='cookie-notice'><p>We use cookies to make this site work. Please accept them.</p><button>OK</button></div>",
    "<aside class=sidebar><h3>Related</h3><p>Another story that you may like to read today.</p><a href=/x>More</a></aside>",
    "<form action=/s><label>Search</label><input name=q><button>Go</button></form>",
    "<section id=comments><h3>Comments</h3><div class=comment>Joe: <p>I liked this story a lot, thank you for writing it. Really.</p></div></section>",
    "<footer>&copy; example.com. All rights reserved.</footer>",
]


@pytest.mark.parametrize("main", ["article", "main", "div class=content", "div id=main", "section class='post'"])
def test_pages_by_hand(model, main):
    top, bottom = "".join(AROUND[:3]), "".join(AROUND[3:])
    page = f"<html><head><title>x</title><style>a{{}}</style></head><body>{top}<{main}>{ARTICLE}</{main.split()[0]}>{bottom}</body></html>"
    assert H.main_texts([page], model) == [TEXT]


def test_main_text_of(spark):
    page = f"<body>{AROUND[0]}<article>{ARTICLE}</article>{AROUND[6]}"
    rows = [(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (None, "u", page, "t"), (1, "u", page, "t"), (4, "v", "<article>" + "<p>word word.</p>" * 20_000 + "</article>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in H.main_text_of(pages).collect()), key=str)
    long = "\n".join(["word word."] * 20_000)
    want = [(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (3, "u", "", 0), (None, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (4, "v", long, len(long))]
    assert got == sorted(want, key=str)
    assert H.main_text_of(pages.limit(0)).collect() == []
