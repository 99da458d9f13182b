"""Signals and parts of HTML pages, in built-in functions where they suffice and html.parser where not."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from newsloom.functions.urls import domain
from newsloom.schemas import fields

# Hosts whose pages count as news.
NEWS_HOSTS = [
    "spiegel.de", "zeit.de", "faz.net", "sueddeutsche.de", "tagesschau.de", "bild.de", "welt.de", "focus.de", "taz.de", "tagesspiegel.de", "handelsblatt.com", "wiwo.de", "stern.de", "n-tv.de", "zdf.de", "phoenix.de",
    "hessenschau.de", "fr.de", "fnp.de", "op-online.de", "hna.de", "giessener-allgemeine.de", "mittelhessen.de", "fuldaerzeitung.de",
    "proasyl.de", "caritas.de", "diakonie.de", "awo.org", "drk.de", "der-paritaetische.de", "zentralwohlfahrtsstelle.de",
    "bmas.de", "bmfsfj.de", "bmg.bund.de", "hessen.de", "soziales.hessen.de", "innen.hessen.de",
    "hessischer-landtag.de", "cdu-hessen.de", "spd-hessen.de", "gruene-hessen.de", "fdp-hessen.de", "dielinke-hessen.de", "staatskanzlei.hessen.de", "kultusministerium.hessen.de", "finanzministerium.hessen.de", "wirtschaft.hessen.de",
    "dpa.de", "epd.de", "kna.de", "diw.de",
]
# Marks of pages that scripts fill.
SPA_MARKERS = ["{{ ", "ng-app", "ng-bind", "data-reactroot", "__next_data__", "v-app", "nuxt", "_nuxt", "app-root"]
# Parts of a page that the fallback removes.
DROP_TAGS = ["script", "style", "nav", "header", "footer", "aside", "iframe", "noscript", "svg", "form", "button"]
DROP_CLASSES = ["advertisement", "ad-container", "social-share", "related-articles", "comments", "newsletter"]
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _meta(html: Column, attribute: str, value: str) -> Column:
    """The content of the first meta element whose attribute has the value, in either order of attributes."""
    a = F.regexp_extract(html, rf"""(?is)<meta[^>]*\b{attribute}\s*=\s*["']{value}["'][^>]*\bcontent\s*=\s*["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta[^>]*\bcontent\s*=\s*["']([^"']*)["'][^>]*\b{attribute}\s*=\s*["']{value}["']""", 1)
    return F.when(a != "", a).when(b != "", b)


def article_points(html: Column) -> Column:
    """Points for an article: type, element, schema and linked data two each, dates and author one each."""
    has = lambda p: F.rlike(html, F.lit("(?is)" + p)).cast("int")
    kind = r"(?:Article|NewsArticle|BlogPosting)"
    typed = F.coalesce(F.contains(F.lower(_meta(html, "property", "og:type")), F.lit("article")).cast("int"), F.lit(0))
    date = r"""["'][^"']*(?:published|datePublished)"""
    author = F.greatest(has(r"""<meta[^>]*\bname\s*=\s*["']author["']"""), has(r"""<meta[^>]*\bproperty\s*=\s*["']article:author["']"""))
    linked = has(rf"""<script[^>]*application/ld\+json[^>]*>(?:(?!</script).)*"@type"\s*:\s*"{kind}\"""")
    return 2 * typed + 2 * has(r"<article[\s>]") + 2 * has(rf"""itemtype\s*=\s*["'][^"']*schema\.org[^"']*{kind}""") + 2 * linked + has(rf"<meta[^>]*\bproperty\s*=\s*{date}") + has(rf"<meta[^>]*\bname\s*=\s*{date}") + author


def is_news_article(html: Column, url: Column) -> Column:
    known = F.rlike(domain(url), F.lit("|".join(re.escape(d) for d in NEWS_HOSTS)))
    return known | (article_points(html) >= 2)


def page_title(html: Column) -> Column:
    """The title that pages give for sharing, else the title element, else the first heading."""
    bare = lambda c: F.nullif(F.trim(F.regexp_replace(c, "<[^>]*>", "")), F.lit(""))
    element = bare(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    heading = bare(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return F.coalesce(F.trim(_meta(html, "property", "og:title")), F.trim(_meta(html, "name", "twitter:title")), element, heading)


def looks_like_spa(html: Column) -> Column:
    return F.rlike(F.lower(html), F.lit("|".join(re.escape(m) for m in SPA_MARKERS)))


class _Tree(HTMLParser):
    """Elements of a page as [tag, attributes, parent, children or text]."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, None, []]
        self.open = self.root
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = [tag, {k: v or "" for k, v in attrs}, self.open, []]
        self.open[3].append(node)
        if tag not in _VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[3].append([tag, dict(attrs), self.open, []])

    def handle_endtag(self, tag: str) -> None:
        at = self.open
        while at is not None and at[0] != tag:
            at = at[2]
        if at is not None and at[2] is not None:
            self.open = at[2]

    def handle_data(self, data: str) -> None:
        self.open[3].append(data)


def _walk(node: list) -> Iterator[list]:
    stack = [node]
    while stack:
        at = stack.pop()
        yield at
        stack.extend(x for x in reversed(at[3]) if isinstance(x, list))


def _text(node: list, drop=lambda n: False) -> str:
    parts, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            if at.strip():
                parts.append(at.strip())
        elif not drop(at):
            stack.extend(reversed(at[3]))
    return " ".join(parts)


def _unwanted(node: list) -> bool:
    names = node[1].get("class", "").split()
    return node[0] in DROP_TAGS or any(n in DROP_CLASSES for n in names) or any("cookie" in n or "consent" in n for n in [node[1].get("class", "")])


def main_content(html: str | None) -> str:
    """The first of article, main and elements with content-like classes of more than 200 characters, else the body's first 5000."""
    root = _Tree(html or "").root
    kept, hidden = [], set()
    for node in _walk(root):
        if id(node[2]) in hidden or _unwanted(node):
            hidden.add(id(node))
        else:
            kept.append(node)
    first = lambda ok: next((n for n in kept if ok(n)), None)
    named = lambda p: lambda n: any(re.search(p, c, re.I) for c in [*n[1].get("class", "").split(), n[1].get("class", "")])
    for ok in (lambda n: n[0] == "article", lambda n: n[0] == "main", named(r"article.*(body|content|text)"), named(r"(story|post|entry).*(body|content|text)"), named(r"^content$")):
        node = first(ok)
        if node and len(text := _text(node, _unwanted)) > 200:
            return text
    body = first(lambda n: n[0] == "body")
    return _text(body, _unwanted)[:5000] if body else ""


@F.pandas_udf(StringType())
def main_content_of(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in htmls:
        yield s.map(main_content)


def select(root: list, selector: str) -> list[list]:
    """Elements under a list of simple selectors (tag, .class, #id or tag.class) joined by spaces."""
    found = [root]
    for part in selector.split():
        m = re.fullmatch(r"([\w-]*)((?:[.#][\w-]+)*)", part)
        tag, marks = (m[1], re.findall(r"([.#])([\w-]+)", m[2])) if m else (part, [])
        ok = lambda n: (not tag or n[0] == tag) and all(v in n[1].get("class", "").split() if k == "." else n[1].get("id") == v for k, v in marks)  # noqa: B023, E731
        found = list({id(n): n for top in found for n in _walk(top) if n is not top and ok(n)}.values())
    return found


SCRAPED = ArrayType(fields(title=StringType(), content=StringType(), link=StringType(), date=StringType()))


def scrape(item: str, title: str, content: str | None = None, link: str | None = None, date: str | None = None):
    """A function of an HTML column: one entry for each element of the item selector with a title."""

    def entries(html: str | None) -> list[dict]:
        out = []
        for node in select(_Tree(html or "").root, item):
            pick = lambda s: next(iter(select(node, s)), None) if s else None  # noqa: B023, E731
            head = pick(title)
            text = _text(head) if head else ""
            if not text.strip():
                continue
            target = pick(link) if link else next((n for n in _walk(head) if n[0] == "a"), None)
            body, when = pick(content), pick(date)
            out.append({"title": text, "content": _text(body) if body else "", "link": target[1].get("href") if target else None, "date": _text(when) if when else None})
        return out

    @F.pandas_udf(SCRAPED)
    def run(htmls: pd.Series) -> pd.Series:
        return htmls.map(entries)

    return run


def scraped_id(title: Column) -> Column:
    return F.substring(F.md5(title), 1, 16)
