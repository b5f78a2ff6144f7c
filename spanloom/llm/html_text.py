"""Main text of web pages by a tree-structured graphical model.

A page is parsed to a tree of its block elements; each piece of running text is a
leaf.  Every node has a hidden label, content or not.  A node's potential is
log-linear in its tag, the words of its class, id and role, and what its text looks
like (length, share of links, share of the page, sentence ends); an edge's potential
is a table of parent's and child's labels for each kind of child.  Sum-product
messages go up the tree and down again and give each node's exact marginal; leaves
of at least ``LEAST`` are the main text.  Weights maximise the likelihood of labelled
pages (gradients are observed minus expected features, from the same messages).

Labelled pages carry the attribute ``data-main="1"`` or ``"0"``, which holds for an
element and what is in it.  No table of the corpus has such labels, so
``labelled_pages`` lays out pages of many designs from a seed; own ones can be given.

Character references are decoded, white space inside a block becomes one space,
blocks are joined in page order by a line feed.  Scripts, styles, templates, titles
and comments are never text.  ``br`` is white space.

Defined cases: null and empty pages have the empty text; a page without markup is one
block and judged as such; end tags without a start are ignored, missing ones are implied;
an unfinished tag at the end of a page is dropped; repeated rows are rows of their own;
extra columns aren't read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import bound_batches, quoted

LEAST = 0.5
PAGES = 800  # labelled pages that are laid out
BYTES = 4 << 20  # characters of pages whose messages are passed together

#: fixed values: elements that don't end a block
INLINE = frozenset(
    "a abbr acronym b basefont bdi bdo big br cite code data del dfn em font i img ins kbd mark map area nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: fixed values: elements without an end
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
#: fixed values: elements whose insides aren't markup or text of the page
RAW = frozenset("script style title textarea template noembed noframes xmp iframe svg math object".split())
#: fixed values: an element of the first kind ends at the next one of its group, unless one of the last stands between
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: kinds of children, each with an edge potential of its own
KINDS = ("text", "p", "heading", "item", "table", "box", "main", "aside", "other")
KIND_OF = (
    {"p": 1, "blockquote": 1, "pre": 1, "figure": 1, "figcaption": 1}
    | dict.fromkeys(HEADINGS, 2)
    | dict.fromkeys(["li", "ul", "ol", "dl", "dt", "dd"], 3)
    | dict.fromkeys(["table", "tbody", "thead", "tfoot", "tr", "td", "th"], 4)
    | dict.fromkeys(["div", "section", "center"], 5)
    | dict.fromkeys(["article", "main"], 6)
    | dict.fromkeys(["nav", "aside", "header", "footer", "form", "menu", "dialog", "button", "select", "label", "fieldset"], 7)
)

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}


@dataclass
class Tree:
    """A page: node 0 is the page itself; parents come before children."""

    parent: list[int]
    depth: list[int]
    tags: list[str]  # "" for text
    names: list[tuple[str, ...]]  # words of class, id and role
    texts: list[str | None]
    linked: list[int]  # characters in links, of text nodes
    label: list[int]


def parse(page: str) -> Tree:
    t = Tree([-1], [0], ["html"], [()], [None], [0], [0])
    stack, open_tags = [0], Counter()
    pieces: list[str] = []
    in_link = linked = 0
    quotes = True  # every quote so far had its end

    def add(tag: str, names: tuple[str, ...], text: str | None, n_linked: int, label: int | None) -> int:
        up = stack[-1]
        t.parent.append(up)
        t.depth.append(t.depth[up] + 1)
        t.tags.append(tag)
        t.names.append(names)
        t.texts.append(text)
        t.linked.append(n_linked)
        t.label.append(t.label[up] if label is None else label)
        return len(t.tags) - 1

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                add("", (), text, min(linked, len(text)), None)
            pieces.clear()
        linked = 0

    def close(tag: str) -> None:
        while t.tags[stack[-1]] != tag:
            open_tags[t.tags[stack.pop()]] -= 1
        open_tags[t.tags[stack.pop()]] -= 1

    def text_of(raw: str) -> None:
        nonlocal linked
        if raw:
            decoded = html.unescape(raw) if "&" in raw else raw
            pieces.append(decoded)
            if in_link:
                linked += len(decoded.strip())

    at = 0
    while True:
        lt = page.find("<", at)
        if lt < 0:
            text_of(page[at:])
            break
        text_of(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        m = _NAME.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = len(page) if end < 0 else end + 1
            else:
                text_of("<")
                at = lt + 1
            continue
        end = page.find(">", m.end())
        if end < 0:
            break
        if quotes and ('"' in (inside := page[m.end() : end]) or "'" in inside):
            whole = _QUOTED.match(page, m.end())
            if whole:
                end = whole.end() - 1
            else:
                quotes = False
        tag, ends, inside, at = m[1].lower(), page[lt + 1] == "/", page[m.end() : end], end + 1
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        if ends:
            in_link = 0
            if open_tags[tag] > 0:
                close(tag)
            continue
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if t.tags[stack[-1]] == "p" or (tag in HEADINGS and t.tags[stack[-1]] in HEADINGS):
            open_tags[t.tags[stack.pop()]] -= 1
        if tag in ENDED_BY:
            group, fence = ENDED_BY[tag]
            if any(open_tags[g] > 0 for g in group):
                for node in reversed(stack):
                    if t.tags[node] in fence:
                        break
                    if t.tags[node] in group:
                        close(t.tags[node])
                        break
        if tag in VOID:
            continue
        names, label = [], None
        if inside:
            for key, a, b, c in _ATTRIBUTE.findall(inside):
                if key.lower() == "data-main":
                    label = int((a or b or c) == "1")
                else:
                    names += [w.lower() for w in _WORD.findall(a or b or c)]
        node = add(tag, tuple(names), None, 0, label)
        if not inside.endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
    flush()
    return t


def _bin(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(edges, x, "right")


LENGTHS = [1, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]
SHARES = [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 0.99]
LINKS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.95]


@dataclass
class Forest:
    """Trees of many pages, nodes by depth, so that each level is a slice."""

    parent: np.ndarray
    level: np.ndarray  # begin of each depth
    kind: np.ndarray
    node: np.ndarray  # feature (node, number) pairs
    feature: np.ndarray
    order: np.ndarray  # place of each node in the order of the pages
    label: np.ndarray


def forest(trees: list[Tree], numbers: dict, grow: bool = False) -> Forest:
    """Features of all nodes; ``grow`` gives new features a number, else only known ones count."""
    n = sum(len(t.tags) for t in trees)
    parent, depth = np.empty(n, np.int64), np.empty(n, np.int64)
    own, linked, kind, sentence, size = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    nodes, features, label, at = [], [], np.empty(n, np.int64), 0
    tag_of: dict = {}

    def number(key: tuple) -> int:
        if grow:
            return numbers.setdefault(key, len(numbers))
        return numbers.get(key, -1)

    bounds = []
    for t in trees:
        k = len(t.tags)
        parent[at : at + k] = np.array(t.parent) + at
        parent[at] = -1
        depth[at : at + k] = t.depth
        label[at : at + k] = t.label
        for i, (tag, names, text) in enumerate(zip(t.tags, t.names, t.texts)):
            if text is not None:
                own[at + i], linked[at + i] = len(text), t.linked[i]
                sentence[at + i] = text[-1] in ".!?…\"'”»:;" and len(text) > 1
            else:
                kind[at + i] = KIND_OF.get(tag, 8)
                if (tag, names) not in tag_of:
                    keys = {("tag", tag)} | {("name", w) for w in names}
                    tag_of[tag, names] = [f for f in map(number, sorted(keys)) if f >= 0]
                for f in tag_of[tag, names]:
                    nodes.append(at + i)
                    features.append(f)
        bounds.append((at, at + k))
        at += k
    order = np.argsort(depth, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    level = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    up = np.where(parent[order] >= 0, place[parent[order]], -1)
    # text and links of whole subtrees, from the deepest level up
    size, links = own[order].copy(), linked[order].copy()
    ends = (own * sentence)[order]
    for d in range(len(level) - 2, 0, -1):
        s = slice(level[d], level[d + 1])
        for x in (size, links, ends):
            np.add.at(x, up[s], x[s])
    total = np.repeat([size[place[a]] for a, _ in bounds], [b - a for a, b in bounds])[order] if n else size
    leaf = (own > 0)[order]
    share, density, closed = size / np.maximum(total, 1), links / np.maximum(size, 1), ends / np.maximum(size, 1)
    dense = [("length", _bin(size, LENGTHS)), ("share", _bin(share, SHARES)), ("links", _bin(density, LINKS)), ("closed", _bin(closed, [0.01, 0.5, 0.99]))]
    f_node, f_number = [place[np.array(nodes, np.int64)]] if nodes else [np.zeros(0, np.int64)], [np.array(features, np.int64)]
    for name, values in dense:
        code = values * 2 + leaf
        table = np.full(64, -1, np.int64)
        for v in np.unique(code).tolist():
            table[v] = number((name, v))
        got = table[code]
        f_node.append(np.flatnonzero(got >= 0))
        f_number.append(got[got >= 0])
    return Forest(up, level, kind[order], np.concatenate(f_node), np.concatenate(f_number).astype(np.int64), place, label[order])


def messages(f: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of content of each node, and the marginals of each edge's two labels [node, parent's, own]."""
    n = len(f.parent)
    score = np.bincount(f.node, weights[f.feature], n)
    inside = np.zeros((n, 2))
    inside[:, 1] = score
    upward = np.zeros((n, 2))
    for d in range(len(f.level) - 2, 0, -1):
        s = slice(f.level[d], f.level[d + 1])
        x = edges[f.kind[s]] + inside[s][:, None, :]
        upward[s] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        np.add.at(inside, f.parent[s], upward[s])
    outside, pair = np.zeros((n, 2)), np.zeros((n, 2, 2))
    for d in range(1, len(f.level) - 1):
        s = slice(f.level[d], f.level[d + 1])
        up = f.parent[s]
        x = (inside[up] + outside[up] - upward[s])[:, :, None] + edges[f.kind[s]]
        outside[s] = np.logaddexp(x[:, 0], x[:, 1])
        x = x + inside[s][:, None, :]
        x = np.exp(x - x.max(axis=(1, 2), keepdims=True))
        pair[s] = x / x.sum(axis=(1, 2), keepdims=True)
    both = inside + outside
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), pair


@dataclass
class Model:
    numbers: dict  # feature -> number
    weights: np.ndarray
    edges: np.ndarray  # [kind of child, parent's label, own label]

    def leaves(self, trees: list[Tree]) -> Iterator[list[tuple[str, float]]]:
        """(text, marginal) of all leaves of each page, in page order."""
        f = forest(trees, self.numbers)
        p, at = messages(f, self.weights, self.edges)[0][f.order], 0
        for t in trees:
            yield [(text, float(p[at + i])) for i, text in enumerate(t.texts) if text is not None]
            at += len(t.tags)


def train(pages: Iterable[str], steps: int = 150, rate: float = 0.1, decay: float = 0.01) -> Model:
    """Gradient ascent (Adam) on the likelihood of the labels of all nodes, with a penalty of squares."""
    trees, numbers = [parse(p) for p in pages], {}
    f = forest(trees, numbers, grow=True)
    weights, edges = np.zeros(len(numbers)), np.zeros((len(KINDS), 2, 2))
    child = f.parent >= 0
    seen = np.zeros_like(edges)
    np.add.at(seen, (f.kind[child], f.label[f.parent[child]], f.label[child]), 1)
    moments = [np.zeros_like(x) for x in (weights, weights, edges, edges)]
    n = len(trees)
    for step in range(1, steps + 1):
        p, pair = messages(f, weights, edges)
        g = np.bincount(f.feature, (f.label - p)[f.node], len(numbers)) / n - decay * weights
        expected = np.zeros_like(edges)
        np.add.at(expected, f.kind[child], pair[child])
        for k, (x, dx) in enumerate(((weights, g), (edges, (seen - expected) / n - decay * edges))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (dx - m)
            v += 0.01 * (dx * dx - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(numbers, weights, edges)


def log_likelihood(pages: Iterable[str], model: Model) -> float:
    """Of all labels, by the tree's own recursion; for tests of the gradient."""
    trees = [parse(p) for p in pages]
    f = forest(trees, model.numbers)
    score = np.bincount(f.node, model.weights[f.feature], len(f.parent))
    child = f.parent >= 0
    value = (score * f.label).sum() + model.edges[f.kind[child], f.label[f.parent[child]], f.label[child]].sum()
    inside = np.stack([np.zeros(len(score)), score], 1)
    for d in range(len(f.level) - 2, 0, -1):
        s = slice(f.level[d], f.level[d + 1])
        x = model.edges[f.kind[s]] + inside[s][:, None, :]
        np.add.at(inside, f.parent[s], np.logaddexp(x[:, :, 0], x[:, :, 1]))
    return float(value - np.logaddexp(inside[~child, 0], inside[~child, 1]).sum())


#: fixed values: names that designers give to boxes of each sort
CONTENT_NAMES = "content article post entry story main body text single page-content article-body post-content entry-content story-body main-content articleBody prose markdown field-item blog-post".split()
BOILERPLATE = {
    "menu": "nav navbar navigation menu main-menu topnav breadcrumb breadcrumbs tabs toolbar".split(),
    "header": "header site-header top masthead branding logo banner-top topbar".split(),
    "footer": "footer site-footer bottom copyright legal colophon credits foot".split(),
    "sidebar": "sidebar aside side widget widgets rail secondary column-right related related-posts recommended popular trending tags tag-cloud".split(),
    "advert": "ad ads advert advertisement adsense banner promo promotion sponsor sponsored dfp commercial".split(),
    "notice": "cookie cookies cookie-notice consent gdpr notice alert popup modal overlay paywall disclaimer message".split(),
    "form": "form search searchbox subscribe newsletter login signup contact-form poll".split(),
    "comments": "comments comment-list commentlist discussion responses disqus replies reader-comments comment-section".split(),
    "share": "share sharing social social-links follow buttons pagination pager byline author-box meta".split(),
}


class _Designer:
    """Lays out one labelled page after another from a seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.brief = self.plain = False  # a page of very short paragraphs; one without punctuation

    def word(self) -> str:
        return "".join(self.r.choice("aeiouylnrstdmkpbcfghv") for _ in range(self.r.randrange(1, 11)))

    def sentence(self, least: int = 1, most: int = 24) -> str:
        words = [self.word() for _ in range(self.r.randrange(least, most + 1))]
        if len(words) > 6 and self.r.random() < 0.6:
            words[3] += ","
        return " ".join(words).capitalize() + self.r.choice("....!?") * (not self.plain)

    def prose(self, most: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randrange(1, most + 1)))

    def link(self, most: int = 4) -> str:
        return f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randrange(1, most + 1)))}</a>'

    def links(self, n: int) -> str:
        items = [self.link() for _ in range(n)]
        style = self.r.randrange(4)
        if style == 0:
            return " | ".join(items)
        if style == 1:
            return "".join(f"<div>{x}</div>" for x in items)
        return "<ul>" + "".join(f"<li>{x}" + "</li>" * (style == 2) for x in items) + "</ul>"

    def attribute(self, names: list[str]) -> str:
        roll, name = self.r.random(), self.r.choice(names)
        if roll < 0.25:
            return ""
        if roll < 0.55:
            return f' id="{name}"'
        return f' class="{name}{self.r.choice(["", " clearfix", " col-md-8", " wrap", "-inner", " box"])}"'

    def box(self, sort: str, plain: str, inner: str, always: bool = False) -> str:
        tag = self.r.choice([plain, "div", "section"]) if plain not in ("div", "section") else plain
        attribute = self.attribute(BOILERPLATE[sort]) if tag == plain and plain not in ("div", "section", "p") and not always else ""
        if not attribute and (tag in ("div", "section", "p") or always):
            attribute = f' class="{self.r.choice(BOILERPLATE[sort])}"'
        return f'<{tag}{attribute} data-main="0">{inner}</{tag}>'

    def paragraph(self) -> str:
        text = self.sentence(1, 3) if self.brief else self.prose(self.r.choice([1, 2, 7]))
        if self.r.random() < 0.25:
            text += " " + self.link() + " " + self.sentence()
        if self.r.random() < 0.2:
            text = f"<b>{text}" + "</b>" * self.r.randrange(2)
        return f"<p>{text}" + "</p>" * (self.r.random() < 0.85)

    def piece(self, sort: str) -> str:
        r = self.r
        if sort == "menu":
            return self.box(sort, "nav", self.links(r.randrange(3, 12)))
        if sort == "header":
            return self.box(sort, "header", f"<h1>{self.word()} {self.word()}</h1>" * r.randrange(2) + f"<p>{self.sentence(2, 7)}</p>" * r.randrange(2) + self.links(r.randrange(1, 6)))
        if sort == "footer":
            return self.box(sort, "footer", r.choice(["&copy; ", "", "Copyright "]) + f"{self.word()}.example.com &middot; {self.prose(3)}" + (self.links(3) if r.random() < 0.5 else ""))
        if sort == "sidebar":
            inner = "".join(r.choice([f"<h3>{self.word()}</h3>{self.links(5)}", f"<p>{self.prose(2)}</p>", f"<div>{self.link()}</div>"]) for _ in range(r.randrange(1, 4)))
            return self.box(sort, "aside", inner)
        if sort == "advert":
            return self.box(sort, "div", r.choice([self.prose(3), f"<p>{self.prose(2)}</p>{self.link()}", self.sentence()]))
        if sort == "notice":
            return self.box(sort, "div", f"<p>{self.prose(2)}</p>" + f"<button>{self.word()}</button>" * r.randrange(2))
        if sort == "form":
            return self.box(sort, "form", f"<label>{self.word()}</label><input type=text>" * r.randrange(1, 4) + f"<p>{self.sentence()}</p>" * r.randrange(2) + f"<button>{self.word()}</button>")
        if sort == "comments":
            one = lambda: f'<{r.choice(["li", "div"])} class="comment">{self.word()}: <p>{self.prose(4)}</p></li></div>'
            return self.box(sort, "section", f"<h3>{self.word()}</h3>" + "".join(one() for _ in range(r.randrange(1, 6))), always=True)
        return self.box("share", "div", self.links(r.randrange(2, 5)))

    def content(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.8:
            parts.append(f"<h1>{self.sentence(3, 10)[: r.randrange(20, 70)]}</h1>")
        self.brief = r.random() < 0.12
        self.plain = r.random() < 0.12
        for _ in range(r.choice([1, 1, 2, 4, 8, 15]) * (1 + 3 * self.brief)):
            roll = r.random()
            if roll < 0.74:
                parts.append(self.paragraph())
            elif roll < 0.8:
                parts.append(f"<h2>{self.sentence(1, 6)[:-1]}</h2>{self.paragraph()}")
            elif roll < 0.84:
                parts.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randrange(2, 6))) + "</ul>")
            elif roll < 0.88:
                parts.append(f"<blockquote><p>{self.prose(3)}</p></blockquote>")
            elif roll < 0.91:
                parts.append("<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.sentence()}</td></tr>" for _ in range(3)) + "</table>")
            elif roll < 0.94:
                parts.append(f"<pre>{self.prose(2)}</pre>")
            else:
                parts.append(self.piece(r.choice(["advert", "share", "form", "sidebar", "notice"])))
        if r.random() < 0.1:
            parts.append(f"<p>{' '.join(self.sentence() for _ in range(r.randrange(20, 200)))}</p>")
        if r.random() < 0.2:
            parts.append(f"{self.prose(2)}<br><br>{self.prose(2)}")
        self.brief = self.plain = False
        if r.random() < 0.1:
            parts.append(self.piece("comments"))
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.4:
            open_, close = f'<article{self.attribute(CONTENT_NAMES)} data-main="1">', "</article>"
        elif kind < 0.5:
            open_, close = f'<main{self.attribute(CONTENT_NAMES)} data-main="1">', "</main>"
        elif kind < 0.6:
            open_, close = f'<main><div class="{r.choice(CONTENT_NAMES)}" data-main="1">', "</div></main>"
        elif kind < 0.9:
            tag = r.choice(["div", "div", "section", "td"])
            open_, close = f'<{tag} {r.choice(["class", "id"])}="{r.choice(CONTENT_NAMES)}" data-main="1">', f"</{tag}>"
        else:
            tag = r.choice(["div", "section"])
            open_, close = f'<{tag} class="{self.word()}" data-main="1">', f"</{tag}>"
        main = open_ + self.content() + close
        before = "".join(self.piece(s) for s in r.sample(["menu", "header", "advert", "notice", "form", "sidebar", "menu"], r.randrange(0, 5)))
        after = "".join(self.piece(s) for s in r.sample(["comments", "sidebar", "footer", "footer", "advert", "share", "notice", "form"], r.randrange(0, 5)))
        if r.random() < 0.3:
            main = f'<div class="{r.choice(["wrapper", "container", "page", "row", "site"])}">{main}{self.piece("sidebar") * r.randrange(2)}</div>'
        head = f'<head><title>{self.sentence()}</title><script>var x = "</p>";</script></head>'
        return f"<!DOCTYPE html><html>{head}<body>{before}{main}{after}" + "</body></html>" * r.randrange(2)


def labelled_pages(n: int = PAGES, seed: int = 7) -> list[str]:
    """Pages of many designs with ``data-main`` labels."""
    designer = _Designer(seed)
    return [designer.page() for _ in range(n)]


def main_texts(pages: list[str | None], model: Model, least: float = LEAST) -> list[str]:
    out: list[str] = []
    trees: list[Tree] = []
    size = 0
    for k, page in enumerate(pages):
        trees.append(parse(page or ""))
        size += len(page or "")
        if size >= BYTES or k + 1 == len(pages):
            out += ["\n".join(text for text, p in leaves if p >= least) for leaves in model.leaves(trees)]
            trees, size = [], 0
    return out


def extracted(pages: DataFrame, model: Model, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep``, text and n_chars of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = main_texts(b.column(len(keep)).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=[*keep, "text", "n_chars"])

    bound_batches(pages.sparkSession)
    src = pages.select(*map(quoted, keep), quoted(html_col))
    return src.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in src.dtypes[:-1]) + ", text string, n_chars long")


def main_text_of(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    return extracted(pages, train(labelled_pages()), html_col, keep)
