"""Operator 7: main text of HTML pages, by gradient-boosted trees over DOM nodes.

Each block element of a page is a node with features of its own (tag, attribute tokens), of its subtree
(text, links, marks, paragraphs and their densities), and of its place (depth, siblings, parent,
position). Boosted trees give the probability that a node holds main text; they are trained here, once a process and
in some ten seconds, on pages that `Sample` makes up, whose main blocks are known: no page of any table is learned from.

Hierarchical decoding picks the most likely consistent labelling: a node can only be in if its parent
is, so from the leaves up each node is worth the better of leaving out its whole subtree and of being
in with the best of its children. No block is kept below a node that is left out, and none is left
in doubt.

Cases: null or empty pages give the empty text. Scripts, styles, comments, head and the like never
give text; formulas do. Unclosed and stray tags are closed as browsers do for paragraphs, list items and
cells. A head ends at the first text or tag that can't stand in one; a muted tag that the page never closes
ends at the next block, and any of them where an element around it closes;
a tag cut off at the end of the page is dropped. Pages of any length and depth are read once, in time that grows with their
tags; a page is held by one task. A page whose nodes are all out has the empty
text; a node for which leaving it out and keeping it are equally likely is left out. Repeated rows are separate pages
and give equal texts. Other columns, of any name, travel in the struct column `rest`. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.exchange import loose

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z", re.S)
MUTE = frozenset("script style noscript template head title svg textarea iframe canvas object audio video select".split())
#: What may stand in a head; and blocks, which end a muted tag that the page never closes.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
BLOCKS = frozenset("address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr output picture q ruby rp rt s samp small source span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom mspace merror mtable mtr mtd mmultiscripts mprescripts semantics annotation annotation-xml".split())
#: An opening tag that ends an open element of its kind, up to the nearest of the tags that bound it.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
KINDS = "p div article main section nav header footer aside form ul li table td h1 h2 h3 blockquote pre figure button body".split()
HINTS = [
    r"article|content|post|entry|story|main|body|text",
    r"\bads?\b|advert|sponsor|promo|banner",
    r"comment|reply|disqus|discussion|respon",
    r"nav|menu|breadcrumb|pagination|pager|tabs|toolbar",
    r"foot|copyright|legal|imprint|colophon",
    r"head|masthead|logo|brand|topbar",
    r"side|related|widget|recommend|teaser|popular|trending|more",
    r"form|login|search|newsletter|subscri|signup|register",
    r"cookie|consent|notice|alert|modal|popup|overlay|gdpr|warning|paywall",
    r"share|social|follow|tags|meta|byline|author",
]
_hints = [re.compile(x) for x in HINTS]
_named = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_hidden = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Marks main blocks of sampled pages: a private-use character that no sample contains otherwise.
MAIN = "\ue000"


@lru_cache(maxsize=65536)
def _attributes(text: str) -> tuple[float, ...]:
    names = " ".join(re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower().replace("_", " ").replace("-", " ") for x in _named.findall(text))
    return (*(float(bool(h.search(names))) for h in _hints), float(bool(_hidden.search(text))))


class Opened:
    """Open elements, outermost first, each with a value; the innermost of a name is found without a search."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.values: list = []
        self.places: dict[str, list[int]] = {}

    def __len__(self) -> int:
        return len(self.names)

    def push(self, name: str, value=None) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.values.append(value)

    def last(self, *names: str) -> int:
        """Place of the innermost of these names, -1 if none is open."""
        return max((p[-1] for p in map(self.places.get, names) if p), default=-1)

    def cut(self, size: int) -> None:
        for name in reversed(self.names[size:]):
            self.places[name].pop()
        del self.names[size:], self.values[size:]


class Page:
    """Nodes of a page in document order (parents first) and its text blocks."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.depth, self.attrs = ["body"], [-1], [0], [""]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        stack, open_ = Opened(), 0
        stack.push("body", 0)
        run: list[str] = []
        linked, in_link, at = 0, False, 0
        mute = Opened()  # muted tags around, and whether the page closes them
        closes = 0  # how many objects and templates around the page closes
        inner = Opened()  # blocks opened inside of them
        pairs: dict[str, set[int]] = {}

        def flush() -> None:
            nonlocal run, linked
            if run:
                text = " ".join(entities.unescape("".join(run)).split())
                if text:
                    self.blocks.append((open_, text, min(linked, len(text))))
                run, linked = [], 0

        def pop(size: int) -> None:
            nonlocal open_
            stack.cut(size)
            open_ = stack.values[-1]

        def unmute(size: int = 0) -> None:
            nonlocal closes
            closes -= sum(end and name in ("object", "template") for name, end in zip(mute.names[size:], mute.values[size:], strict=True))
            mute.cut(size)
            if not size:
                inner.cut(0)

        def closed(name: str, start: int) -> bool:
            if name not in pairs:
                waiting, pairs[name] = [], set()
                for t in re.finditer(rf"<(/?){name}(?=[\s/>])([^<>]*)", html, re.I):
                    if not t[1] and not t[2].endswith("/"):
                        waiting.append(t.start())
                    elif t[1] and waiting:
                        pairs[name].add(waiting.pop())
            return start in pairs[name]

        def only_head() -> bool:
            return len(mute) == 1 and mute.names[0] == "head"

        def inside(name: str, closing: bool) -> bool:
            """Whether a tag belongs to the muted tags around; ends those that it ends."""
            if name == "body" or name == "html" and closing:
                unmute()
            elif closing:
                if (place := inner.last(name)) >= 0:
                    inner.cut(place)
                elif name not in INLINE and not closes and stack.last(name) > 0:
                    unmute()
            elif only_head() and name not in HEAD:
                unmute()
            else:
                while name in BLOCKS and mute and not mute.values[-1]:
                    unmute(len(mute) - 1)
                if mute and name not in INLINE and name not in VOID:
                    inner.push(name)
            return bool(mute)

        find, n = TOKEN.search, len(html)
        while at < n:
            m = find(html, at)
            end = m.start() if m else n
            if only_head() and html[at:end].strip():
                unmute()
            if end > at and not mute:
                run.append(html[at:end])
                if in_link:
                    linked += end - at
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, attrs = m[1] or m[4], m[3] or m[6] or ""
            if name in MUTE:
                if closing:
                    if (place := mute.last(name)) >= 0:
                        unmute(place)
                    continue
                if only_head() and name not in HEAD:
                    unmute()
                if name in RAW:
                    m = re.compile(rf"</{name}", re.I).search(html, at)
                    at = html.find(">", m.end()) + 1 if m else 0
                    at = at or n
                elif not attrs.endswith("/"):
                    ends = name != "head" and closed(name, m.start())
                    closes += ends and name in ("object", "template")
                    mute.push(name, ends)
                continue
            if mute and inside(name, bool(closing)):
                continue
            if name in INLINE:
                if name == "a":
                    in_link = not closing
                elif name in ("br", "img"):
                    run.append(" ")
                continue
            flush()
            in_link = False
            if closing:
                if (place := stack.last(name)) > 0:
                    pop(place)
                continue
            if name in ("html", "body"):
                if name == "body":
                    self.attrs[0] = attrs
                continue
            if stack.names[-1] == "p":
                pop(len(stack) - 1)
            if name in ENDS:
                same, stop = ENDS[name]
                if (place := stack.last(*same)) > stack.last(*stop):
                    pop(place)
            if name in VOID:
                continue
            self.tag.append(name)
            self.parent.append(open_)
            self.depth.append(len(stack))
            self.attrs.append(attrs)
            if not attrs.endswith("/") or name not in ("embed", "param"):
                open_ = len(self.tag) - 1
                stack.push(name, open_)
        flush()


def _up(values: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Sums over subtrees."""
    out = values.copy()
    order = np.argsort(depth, kind="stable")
    border = np.searchsorted(depth[order], np.arange(depth.max() + 2 if len(depth) else 1))
    for d in range(len(border) - 2, 0, -1):
        at = order[border[d] : border[d + 1]]
        np.add.at(out, parent[at], out[at])
    return out


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of the pages, their parents (by row), depths, and the first row of each page."""
    first = np.cumsum([0] + [len(p.tag) for p in pages])
    n = first[-1]
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f) for p, f in zip(pages, first, strict=False)] or [np.zeros(0, np.int64)]).astype(np.int64)
    depth = np.array([d for p in pages for d in p.depth], np.int64)
    kinds = {k: i for i, k in enumerate(KINDS)}
    kind = np.array([kinds.get(t, len(KINDS)) for p in pages for t in p.tag], np.int64)
    hint = np.array([_attributes(a) for p in pages for a in p.attrs], float).reshape(n, len(HINTS) + 1)
    own = np.zeros((n, 6))  # blocks, characters, in links, marks, long blocks, words
    for p, f in zip(pages, first, strict=False):
        for node, text, linked in p.blocks:
            own[f + node] += (1, len(text), linked, text.count(",") + text.count(".") + text.count("?") + text.count("!"), len(text) > 120, text.count(" ") + 1)
    counted = np.concatenate([own, np.ones((n, 1)), (kind == kinds["p"])[:, None], (kind == kinds["li"])[:, None], np.isin(kind, [kinds["h1"], kinds["h2"], kinds["h3"]])[:, None]], 1)
    total = _up(counted, parent, depth)
    up = np.maximum(parent, 0)
    page = np.repeat(first[:-1], np.diff(first))
    before = np.concatenate([[0], np.cumsum(own[:, 1])])[:-1]
    order = np.lexsort((np.arange(n), up))
    new = np.concatenate([[True], up[order][1:] != up[order][:-1]]) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    index = np.empty(n)
    index[order] = np.arange(n) - start
    children = np.bincount(up[parent >= 0], minlength=n)
    blocks = np.maximum(total[:, 0], 1)
    size = np.maximum(total[:, 1], 1)
    names = [("nav", "header", "footer", "aside", "form"), ("article", "main"), ("ul", "table")]
    # Hints and kinds of the node or of any ancestor.
    above = np.concatenate([hint, *(np.isin(kind, [kinds[x] for x in group])[:, None] for group in names)], 1)
    order = np.argsort(depth, kind="stable")
    border = np.searchsorted(depth[order], np.arange(depth.max() + 2 if n else 1))
    for d in range(1, len(border) - 1):
        at = order[border[d] : border[d + 1]]
        above[at] = np.maximum(above[at], above[parent[at]])
    x = np.concatenate(
        [
            kind[:, None], kind[up][:, None], hint, above,
            np.log1p(total[:, :2]), (total[:, 2] / size)[:, None], (total[:, 3] / size)[:, None], (total[:, 4] / blocks)[:, None], np.log1p(total[:, 1] / blocks)[:, None],
            np.log1p(total[:, 6:7]), (total[:, 7] / total[:, 6])[:, None], (total[:, 8] / total[:, 6])[:, None], (total[:, 9] / total[:, 6])[:, None],
            (size / np.maximum(total[up, 1], 1))[:, None], (size / np.maximum(total[page, 1], 1))[:, None], (total[:, 4] / np.maximum(total[page, 4], 1))[:, None],
            np.log1p(own[:, 1:2]), depth[:, None], index[:, None], (index / np.maximum(children[up], 1))[:, None], children[up][:, None],
            ((before - before[page]) / np.maximum(total[page, 1], 1))[:, None], (total[:, 5] / blocks)[:, None], (total[up, 4] / np.maximum(total[page, 4], 1))[:, None],
        ],
        1,
    )
    return x, parent, depth, first


class BoostedTrees:
    """Gradient-boosted regression trees for the logistic loss, on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self.bin(x)
        n, f = x.shape
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(n, self.base)
        self.depth, self.trees = depth, []
        shift = np.arange(f) * bins
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**depth, np.int64), np.full(2**depth, bins, np.int64)
            for d in range(depth):
                width = 2**d
                cell = ((node - width + 1 if d else node)[:, None] * (f * bins) + shift + b).ravel()
                gs = np.bincount(cell, np.repeat(g, f), width * f * bins).reshape(width, f, bins).cumsum(2)
                hs = np.bincount(cell, np.repeat(h, f), width * f * bins).reshape(width, f, bins).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                best = gain.reshape(width, -1).argmax(1)
                good = gain.reshape(width, -1).max(1) > 1e-3
                spot = np.arange(width) + width - 1
                feature[spot], cut[spot] = best // bins, np.where(good, best % bins, bins)
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            margin += value[leaf]
            self.trees.append((feature, cut, value))

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.int16)

    def margins(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bin(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def decode(margin: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The most likely labels where a node is in only if its parent is."""
    inside, outside = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    without = _up(outside, parent, depth)
    best = inside.copy()
    order = np.argsort(depth, kind="stable")
    border = np.searchsorted(depth[order], np.arange(depth.max() + 2 if len(depth) else 1))
    for d in range(len(border) - 2, 0, -1):
        at = order[border[d] : border[d + 1]]
        np.add.at(best, parent[at], np.maximum(best[at], without[at]))
    kept = best > without
    for d in range(1, len(border) - 1):
        at = order[border[d] : border[d + 1]]
        kept[at] &= kept[parent[at]]
    return kept


class Sample:
    """A page of a random layout; its main blocks begin with MAIN.

    Layouts are drawn, not taken from any table: prose, recipes, glossaries, data tables and documentation, in an
    article, main, section, div or cell of a layout table, with boilerplate around and between, under names that are
    usual on the web, or under none; one page in five has its paragraphs in the body or in one plain element.
    """

    LETTERS = "aeiounrstlmdkgbphfvzcé"

    def __init__(self, rng: random.Random) -> None:
        self.rng = rng

    def some(self, *options):
        return self.rng.choice(options)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, n: int, end: bool = True) -> str:
        w = ["".join(self.rng.choice(self.LETTERS) for _ in range(self.rng.randint(2, 10))) for _ in range(n)]
        for i in range(self.rng.randint(5, 14), n, self.rng.randint(6, 16)):
            w[i] += self.some(".", ",", ",", "?", ";")
        return " ".join(w).capitalize() + (self.some(".", ".", ".", "!", "?") if end else "")

    def named(self, *names: str, often: float = 0.65) -> str:
        if not self.chance(often):
            return ""
        name = self.some("", "", "page-", "site-", "c-", "js-") + self.some(*names) + self.some("", "", "-inner", "-wrap", "__body", "_1", " clearfix")
        return f' {self.some("class", "class", "id")}="{name}"'

    def inline(self, n: int) -> str:
        """Text of n words, at times with markup inside."""
        parts = self.words(n).split(" ")
        for _ in range(self.some(0, 0, 1, 2)):
            i = self.rng.randrange(len(parts))
            tag = self.some("em", "strong", "i", "b", "span", "code", "a href='/x'", "sup")
            parts[i] = f"<{tag}>{parts[i]}" + ("" if self.chance(0.05) else f"</{tag.split()[0]}>")
        if self.chance(0.08):
            parts.insert(self.rng.randrange(len(parts)), "<br>")
        return " ".join(parts)

    def anchors(self, n: int, between: str = " ") -> str:
        return between.join(f'<a href="/{i}">{self.words(self.rng.randint(1, 4), False)}</a>' for i in range(n))

    def links(self, n: int) -> str:
        form = self.rng.random()
        if form < 0.6:
            close = self.some("</li>", "</li>", "")
            return "<ul>" + "".join(f"<li>{self.anchors(1)}{close}" for _ in range(n)) + "</ul>"
        if form < 0.8:
            return self.anchors(n, self.some(" ", " | ", " · ", " / "))
        return "".join(f"<div>{self.anchors(1)}</div>" for _ in range(n))

    def boiler(self, kind: str) -> str:
        n = self.rng.randint
        if kind == "nav":
            return self.some(f"<nav{self.named('nav', 'menu', often=0.3)}>{self.links(n(3, 10))}</nav>", f"<div{self.named('nav', 'menu', 'navbar', 'topnav', 'tabs', often=0.85)}>{self.links(n(3, 10))}</div>", f"<p{self.named('breadcrumb', 'crumbs')}>{self.anchors(n(2, 4), ' &raquo; ')}</p>")
        if kind == "header":
            inside = f"<{(t := self.some('div', 'p', 'span'))}>{self.words(n(1, 6), False)}</{t}>" + self.some("", self.links(4), f"<p>{self.words(n(3, 9))}</p>")
            return self.some(f"<header{self.named('header', 'masthead', 'top', often=0.4)}>{inside}</header>", f"<div{self.named('header', 'masthead', 'logo', 'branding', often=0.9)}>{inside}</div>")
        if kind == "ad":
            inside = self.some(self.words(n(2, 30)), f"<p>{self.words(n(3, 30))}</p>", f"<p>{self.words(n(3, 30))}</p>{self.anchors(1)}")
            names = "ad", "ads", "advert", "advertisement", "sponsored", "promo", "promoted", "banner"
            return f"<{(t := self.some('div', 'div', 'aside', 'section'))}{self.named(*names, often=0.95)}>{inside}</{t}>"
        if kind == "side":
            head = self.some("", f"<h3>{self.words(2, False)}</h3>", f"<h4>{self.words(n(1, 3), False)}</h4>", f"<strong>{self.words(2, False)}</strong>")
            inside = "".join(self.some(f"<div>{self.anchors(1)}<p>{self.words(n(4, 25))}</p></div>", f"<p>{self.anchors(1)}</p>") for _ in range(n(1, 5))) + self.some("", self.links(n(2, 6)))
            return self.some(f"<aside{self.named('sidebar', 'related', often=0.5)}>{head}{inside}</aside>", f"<div{self.named('sidebar', 'related', 'widget', 'recommended', 'teaser', 'most-read', 'trending', often=0.95)}>{head}{inside}</div>")
        if kind == "form":
            fields = "".join(f"<label>{self.words(n(1, 3), False)}</label><input name='q{i}'>" for i in range(n(1, 3)))
            return f"<form{self.named('login', 'search', 'newsletter', 'subscribe', 'contact')}>{self.some('', '<p>' + self.words(n(4, 20)) + '</p>')}{fields}<button>{self.words(1, False)}</button></form>"
        if kind == "notice":
            return f"<div{self.named('cookie', 'notice', 'consent', 'alert', 'gdpr', 'overlay', 'paywall', often=0.95)}>{self.some('<p>' + self.words(n(8, 40)) + '</p>', self.words(n(8, 30)))}<button>{self.words(1, False)}</button></div>"
        if kind == "comments":
            tag = self.some("div", "li", "article")
            each = "".join(f"<{tag}{self.named('comment', 'reply', 'comment-item')}>{self.some('<b>' + self.words(2, False) + '</b>', '<p>' + self.words(2, False) + '</p>', '')}<p>{self.words(n(3, 50))}</p></{tag}>" for _ in range(n(1, 6)))
            each = f"<{self.some('ol', 'ul')}>{each}" if tag == "li" else each
            return f"<{(t := self.some('section', 'div'))}{self.named('comments', 'comment-list', 'discussion', 'disqus', 'responses', often=1)}>{self.some('', '<h2>' + self.words(n(1, 2), False) + '</h2>', '<h3>' + self.words(2, False) + '</h3>')}{each}</{t}>"
        if kind == "share":
            return f"<{(t := self.some('div', 'p', 'ul'))}{self.named('share', 'social', 'tags', 'byline', 'meta', 'author-links', often=0.95)}>{self.anchors(n(2, 5))} {self.some('', self.words(n(1, 3), False))}</{t}>"
        if kind == "pager":
            return f"<div{self.named('pager', 'pagination', 'prev-next', often=0.9)}>{self.anchors(n(2, 4))}</div>"
        mark = self.some("&copy; 2019", "© 2021", "(c)", "Copyright", "Imprint", "")
        inside = f"{mark} {self.words(n(2, 15))}"
        inside = self.some(inside, f"<p>{inside}</p>", f"<p>{inside}</p>{self.links(n(2, 6))}", f"{self.links(n(2, 6))}<div>{inside}</div>")
        return self.some(f"<footer{self.named('footer', often=0.3)}>{inside}</footer>", f"<div{self.named('footer', 'copyright', 'legal', 'imprint', 'colophon', often=0.95)}>{inside}</div>")

    def block(self, kind: str) -> str:
        """A main block, or several."""
        n = self.rng.randint
        long = lambda: MAIN + self.inline(self.some(1, 3, 8, 20, 40, 60, 120, 200))
        short = lambda: MAIN + self.inline(n(1, 12))
        if kind == "p":
            return f"<p{self.some('', '', '', self.named('lead', 'intro', 'text'))}>{long()}" + ("" if self.chance(0.15) else "</p>")
        if kind == "head":
            tag = self.some("h2", "h2", "h3", "h4")
            return f"<{tag}>{MAIN}{self.words(n(1, 7), False)}</{tag}>"
        if kind == "list":
            tag, close = self.some("ul", "ol"), self.some("</li>", "</li>", "")
            return f"<{tag}>" + "".join(f"<li>{short()}{close}" for _ in range(n(2, 8))) + f"</{tag}>"
        if kind == "quote":
            return self.some(f"<blockquote><p>{long()}</p></blockquote>", f"<blockquote>{long()}</blockquote>")
        if kind == "pre":
            return f"<pre>{MAIN}{self.words(n(3, 30))}</pre>"
        if kind == "div":
            return f"<div>{long()}</div>"
        if kind == "figure":
            return f"<figure><img src='/i.png'><figcaption>{short()}</figcaption></figure>"
        if kind == "terms":
            return "<dl>" + "".join(f"<dt>{MAIN}{self.words(n(1, 3), False)}<dd>{short()}" + self.some("", "</dd>") for _ in range(n(2, 8))) + "</dl>"
        width, close = n(2, 4), self.some("</td>", "</td>", "")
        return f"<table{self.some('', self.named('data', 'prices'))}>" + "".join("<tr>" + "".join(f"<td>{MAIN}{self.words(n(1, 4), False)}{close}" for _ in range(width)) + "</tr>" for _ in range(n(2, 6))) + "</table>"

    def main(self) -> str:
        kinds = self.some(["p"] * 8 + ["head", "list", "quote", "div", "figure"], ["p"] * 8 + ["head", "quote"], ["p", "list", "list", "head"], ["terms", "terms", "p", "head"], ["table", "p", "head"], ["pre", "p", "p", "head", "list", "table"])
        title = f"<{(t := self.some('h1', 'h1', 'h1', 'h2'))}>{MAIN}{self.words(self.rng.randint(2, 12), False)}</{t}>" if self.chance(0.92) else ""
        if self.chance(0.2):
            title += self.boiler("share")
        out = []
        for _ in range(self.some(1, 2, 3, 5, 8, 13, 20)):
            out.append(self.block(self.rng.choice(kinds)))
            if self.chance(0.05):
                out.append(self.boiler(self.some("ad", "ad", "side", "form", "share")))
        if self.chance(0.25):
            out.append(self.boiler(self.some("share", "pager")))
        # The title stands beside the text, or the text in an element of its own.
        if self.chance(0.35):
            out = [f"<{(t := self.some('div', 'div', 'section'))}{self.named('body', 'text', 'content', 'entry-content', 'article-body', 'post-content')}>", *out, f"</{t}>"]
            title = f"<header>{title}</header>" if self.chance(0.3) else title
        return title + "".join(out)

    def sentences(self, n: int) -> str:
        return " ".join(self.inline(self.rng.randint(3, 16)) for _ in range(n))

    def plain(self) -> str:
        """A page whose paragraphs stand in the body or in one element, mostly without a name, with little or nothing around."""
        n = self.rng.randint
        text = "".join(f"<p>{MAIN}{self.some('', '', 'a &amp; b ')}{self.sentences(n(1, 4))}{self.some('</p>', '</p>', '</p>', '')}" for _ in range(self.some(1, 2, 2, 3, 5, 8, 12)))
        title = f"<h1>{MAIN}{self.words(n(1, 8), False)}</h1>" if self.chance(0.6) else ""
        wrap = self.some("", "", "", "div", "div", "section", "article", "main")
        body = f"<{wrap}>{title}{text}</{wrap}>" if wrap and self.chance(0.5) else title + (f"<{wrap}>{text}</{wrap}>" if wrap else text)
        kinds = [k for k in ("nav", "header", "side", "ad", "notice", "form") if self.chance(0.12)]
        before = "".join(map(self.boiler, kinds)) + (self.links(n(3, 8)) if self.chance(0.2) else "")
        after = (self.links(n(3, 8)) if self.chance(0.2) else "") + "".join(self.boiler(k) for k in ("comments", "side", "pager", "share", "footer") if self.chance(0.12))
        head = self.some("", f"<head><title>{self.words(3, False)}</title></head>")
        return self.some(f"{before}{body}{after}", f"<html>{head}<body>{before}{body}{after}</body></html>", f"<!DOCTYPE html><html>{head}<body>{before}{body}{after}</body></html>")

    def page(self) -> str:
        if self.chance(0.2):
            return self.plain()
        wrap = self.some("article", "article", "article", "main", "div", "section")
        names = self.named("article", "content", "post", "story", "entry", "main", "text", often=0.4 if wrap in ("article", "main") else 0.85)
        body = f"<{wrap}{names}>{self.main()}{self.boiler('comments') if self.chance(0.2) else ''}</{wrap}>"
        for _ in range(self.some(0, 0, 1, 2)):
            left, right = ("", self.boiler("side")) if self.chance(0.7) else (self.boiler(self.some("side", "nav")), "")
            body = f"<div{self.named('container', 'wrapper', 'row', 'columns', 'page')}>{left if self.chance(0.4) else ''}{body}{right if self.chance(0.4) else ''}</div>"
        if self.chance(0.08):
            side = f"<td{self.named('menu', 'nav', 'left')}>{self.links(self.rng.randint(3, 8))}</td>"
            body = f"<table><tr>{side}<td>{body}</td></tr></table>"
        before = "".join(self.boiler(k) for k in ("notice", "header", "nav", "ad", "form") if self.chance({"nav": 0.75, "ad": 0.5}.get(k, 0.35)))
        after = "".join(self.boiler(k) for k in ("comments", "side", "ad", "form", "pager", "notice", "footer") if self.chance({"footer": 0.8, "ad": 0.15}.get(k, 0.25)))
        head = f"<title>{self.words(3, False)}</title>" + self.some("", "<style>p{margin:0}</style>", "<script>let n=1<2;</script>", "<meta charset=utf-8>")
        whole = f"{self.some('<!DOCTYPE html>', '')}<html><head>{head}</head><body{self.named('home', 'single', often=0.2)}>{before}{body}{after}</body></html>"
        return whole[: self.rng.randint(len(whole) // 2, len(whole))] if self.chance(0.08) else whole


def sample_page(rng: random.Random) -> str:
    return Sample(rng).page()


_trained: list[BoostedTrees] = []


def model(pages: int = 700, seed: int = 11) -> BoostedTrees:
    """The trees, trained once a process on sampled pages: a node counts as in if it holds main text."""
    if not _trained:
        rng = random.Random(seed)
        made = [Page(sample_page(rng)) for _ in range(pages)]
        has = [np.zeros(len(p.tag)) for p in made]
        for p, mark in zip(made, has, strict=True):
            for k, (node, text, linked) in enumerate(p.blocks):
                if MAIN in text:
                    mark[node] = 1
                    p.blocks[k] = node, text.replace(MAIN, ""), linked
        x, parent, depth, _ = features(made)
        y = (_up(np.concatenate(has), parent, depth) > 0).astype(float)
        _trained.append(BoostedTrees(x, y))
    return _trained[0]


def main_texts(htmls: list[str | None], trees: BoostedTrees) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    x, parent, depth, first = features(pages)
    kept = decode(trees.margins(x), parent, depth) if len(x) else np.zeros(0, bool)
    return ["\n".join(text for node, text, _ in p.blocks if kept[f + node]) for p, f in zip(pages, first, strict=False)]


def extract_main_text(pages: DataFrame, html: str = "html", batch: int = 64) -> DataFrame:
    """pages' other columns in `rest`, and text: the main blocks in page order, joined by newlines."""
    sent = pages.sparkSession.sparkContext.broadcast(model())
    others = [F.col(f"`{c}`") for c in pages.columns if c != html]
    framed = pages.select(F.col(f"`{html}`").alias("html"), (F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            column, texts = rows["html"], []
            for i in range(0, len(column), batch):
                texts += main_texts(column[i : i + batch].to_pylist(), sent.value)
            yield pa.RecordBatch.from_pydict({"rest": loose(rows["rest"]), "text": pa.array(texts, pa.string())})

    return framed.mapInArrow(run, f"rest {framed.schema['rest'].dataType.simpleString()}, text string")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("rest.page_id", "rest.url", "text", F.length("text").cast("long").alias("n_chars"))
