"""The main text of HTML pages by composite text density.

A page becomes a tree of elements. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts and reader comments are cut off by element, role, class or id. Each remaining node has a
density: its characters for each tag, raised where few of them are links. The sum of a node's
child densities says where dense text gathers; the subtree with the largest sum is the main text,
with what outside it is as dense as the thinnest node on the path from there to the body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

# Names of HTML, and words that pages use for what is no part of an article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CUT = set("script style title noscript template iframe object svg canvas audio video map nav footer aside form button input select textarea datalist fieldset dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
ASIDE = set("""ad ads adsbygoogle outbrain taboola advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion promoted sidebar sidebars widget widgets menu menus nav navbar
navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert alerts popup modal overlay toast newsletter subscribe subscription signup login signin share sharing social
related recommended recommendations teaser teasers comment comments commentlist disqus respond reply replies responses feedback discussion announcement announcements banner banners colophon form forms search pagination pager toolbar disclaimer copyright""".split())
ABOVE = set("header masthead topbar".split())
BESIDE = set("comment comments reply teaser related recommended ad advert promo sponsored".split())
NOT = set("has with no is without".split())

#: Elements nested deeper lie beside each other, as in browsers.
DEEP = 512

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z))""", re.S)
_MARK = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _aside(name: str, attrs: str, inside: bool) -> bool:
    """Whether role, class or id say that an element is no part of the article. ``inside``: it lies in one."""
    if name in ("html", "body") or not attrs:
        return False
    for kind, value in _MARK.findall(attrs):
        value = unescape(value.strip("\"'"))
        if kind.lower() == "role":
            if value.strip().lower() in ROLES and not (inside and value.strip().lower() == "banner"):
                return True
            continue
        for word in value.split():
            if name in ("article", "main"):
                if word.lower() in BESIDE:
                    return True
                continue
            parts = [p.lower() for p in _PART.findall(word)]
            if parts and parts[0] not in NOT and any(p in ASIDE or (p in ABOVE and not inside) for p in parts):
                return True
    return False


class Page:
    """The elements of a page in page order, as lists: ``name``, ``attrs``, ``parent``, ``end`` (one past the
    last descendant), and ``pieces``, (node, text) in page order with a blank at each block's edge."""

    def __init__(self, html: str):
        self.name, self.attrs, self.parent, self.end = ["body"], [""], [-1], [0]
        self.pieces: list[tuple[int, str]] = []
        open_, count, over, at = [0], {"body": 1}, {}, 0

        def close(depth: int) -> None:
            while len(open_) > depth:
                node = open_.pop()
                count[self.name[node]] -= 1
                self.end[node] = len(self.name)
                if self.name[node] not in INLINE:
                    self.pieces.append((node, " "))

        def above(names: set[str], walls: set[str]) -> int:
            """The depth of the topmost open element of ``names``, 0 if there is none within ``walls``."""
            for depth in range(len(open_) - 1, 0, -1):
                if self.name[open_[depth]] in names:
                    return depth
                if self.name[open_[depth]] in walls:
                    return 0
            return 0

        while m := _TAG.search(html, at):
            if m.start() > at:
                self.pieces.append((open_[-1], unescape(html[at : m.start()])))
            at = m.end()
            if m[1]:
                name = m[1].lower()
                if name == "br":
                    self.pieces.append((open_[-1], " "))
                elif over.get(name):
                    over[name] -= 1
                elif name not in ("html", "body") and count.get(name):
                    # The end of an inline element doesn't close blocks, that of a cell's part not the cell.
                    depth = len(open_) - 1
                    if name in INLINE:
                        while depth and self.name[open_[depth]] != name and self.name[open_[depth]] in INLINE:
                            depth -= 1
                        depth = depth if self.name[open_[depth]] == name else 0
                    else:
                        depth = above({name}, set() if name in ("table", "td", "th", "tr", "tbody", "thead", "tfoot") else {"td", "th", "table"})
                    if depth:
                        close(depth)
            elif m[2]:
                name = m[2].lower()
                if name in ("html", "body", "head"):
                    continue
                if name not in INLINE and count.get("p"):
                    depth = above({"p"}, {"td", "th", "table", "button", "object"})
                    if depth:
                        close(depth)
                if name in CLOSES and any(count.get(x) for x in CLOSES[name]):
                    while depth := above(CLOSES[name], WALLS.get(name, {"table"})):
                        close(depth)
                if name == "a" and count.get("a") and (depth := above({"a"}, {"td", "th", "table"})):
                    close(depth)
                node = len(self.name)
                self.name.append(name)
                self.attrs.append(m[3])
                self.parent.append(open_[-1])
                self.end.append(node + 1)
                if name not in INLINE:
                    self.pieces.append((node, " "))
                if name in RAW:
                    stop = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(html, at)
                    self.pieces.append((node, unescape(html[at : stop.start()])))
                    at = stop.end()
                elif len(open_) >= DEEP and name not in VOID:
                    over[name] = over.get(name, 0) + 1
                elif name not in VOID:
                    open_.append(node)
                    count[name] = count.get(name, 0) + 1
        if at < len(html):
            self.pieces.append((open_[-1], unescape(html[at:])))
        close(0)

    def cut(self) -> tuple[list[bool], list[int]]:
        """Whether a node is cut off, and the outermost article (or main part) that a node lies in, -1 if none."""
        n = len(self.name)
        article = [x == "article" for x in self.name]
        main = [x == "main" or "main" in a and bool(re.search(r"role\s*=\s*[\"']?main\b", a, re.I)) for x, a in zip(self.name, self.attrs, strict=True)]
        holds = [a or b for a, b in zip(article, main, strict=True)]
        for k in range(n - 1, 0, -1):
            holds[self.parent[k]] |= holds[k]
        off, scope = [False] * n, [-1] * n
        for k in range(1, n):
            p = self.parent[k]
            inside = scope[p] >= 0
            off[k] = off[p] or self.name[k] in CUT or (self.name[k] == "header" and not inside) or ((not holds[k] or article[k]) and _aside(self.name[k], self.attrs[k], inside))
            scope[k] = scope[p] if inside else k if (article[k] or main[k]) and not off[k] else -1
        if any(article[k] and not off[k] for k in range(n)):
            # Where there are articles, they compete and main parts around them don't.
            scope = [-1] * n
            for k in range(1, n):
                scope[k] = scope[self.parent[k]] if scope[self.parent[k]] >= 0 else k if article[k] and not off[k] else -1
        return off, scope


def densities(page: Page, off: list[bool]) -> tuple[list[float], list[float], list[bool]]:
    """Each node's density, the sum of its children's with that of its own text, and whether it is hardly more than links."""
    n = len(page.name)
    chars, tags, link_chars, link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    link = [False] * n
    for k in range(1, n):
        link[k] = page.name[k] == "a" or link[page.parent[k]]
    for k, piece in page.pieces:
        if piece != " " and not off[k]:
            size = len(" ".join(piece.split()))
            own[k] += size
            chars[k] += size
            link_chars[k] += size * link[k]
    for k in range(n - 1, 0, -1):
        if not off[k]:
            p = page.parent[k]
            chars[p] += chars[k]
            tags[p] += tags[k] + 1
            link_chars[p] += link_chars[k]
            link_tags[p] += link_tags[k] + (page.name[k] == "a")
    share = link_chars[0] / max(1, chars[0])

    def density(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        base = log(c * lc / max(1, c - lc) + share * c + e)
        return c / max(1, t) * log(1 + c / max(1, lc) * (max(1, t) / max(1, lt))) / log(1 + base)

    each = [density(*x) for x in zip(chars, tags, link_chars, link_tags, strict=True)]
    total = [density(own[k], 0, own[k] * link[k], int(link[k])) for k in range(n)]
    for k in range(n - 1, 0, -1):
        if not off[k]:
            total[page.parent[k]] += each[k]
    links = [t >= 2 and 5 * lc >= 4 * c for t, lc, c in zip(link_tags, link_chars, chars, strict=True)]
    return each, total, links


def _subtrees(page: Page, off: list[bool], scope: list[int]) -> list[int]:
    """The roots of the main text, in page order: none lies in another. Marks menus in ``off``."""
    each, total, links = densities(page, off)
    n = len(page.name)
    scoped = any(scope[k] >= 0 and each[k] > 0 for k in range(n))
    able = [k for k in range(n) if not off[k] and each[k] > 0 and (not scoped or scope[k] >= 0)]
    if not able:
        return []
    best = max(able, key=lambda k: (total[k], -k))
    if scoped:
        return [scope[best]]
    least, k = each[best], best
    while k >= 0:
        least, k = min(least, each[k]), page.parent[k]
    # Thinner blocks of links alone are menus, whatever their name.
    for k in range(1, n):
        off[k] |= off[page.parent[k]] or (links[k] and each[k] < least and page.name[k] not in INLINE)
    # What is as dense as the path's thinnest node: there too, the subtree of the largest sum.
    found, k = [], 0
    while k < n:
        if off[k] or (each[k] < least and not k < best < page.end[k]):
            k = page.end[k]
        elif k < best < page.end[k]:
            k += 1
        else:
            found.append(best if k == best else max((x for x in range(k, page.end[k]) if not off[x]), key=lambda x: (total[x], -x)))
            k = page.end[k]
    if len(found) == 1:
        return found
    # Blocks between those, and headings right above, belong to them.
    first, last = found[0], found[-1]
    node = page.parent[first]
    while last >= page.end[node]:
        node = page.parent[node]
    kids = [k for k in range(node + 1, page.end[node]) if page.parent[k] == node and not off[k]]
    low, high = (max(n for n, k in enumerate(kids) if k <= x) for x in (first, last))
    while low and re.fullmatch("h[1-6]", page.name[kids[low - 1]]):
        low -= 1
    return [node] if low == 0 and high == len(kids) - 1 else kids[low : high + 1]


def main_text(html: str | None) -> str:
    """The main text of one page; empty where there is none."""
    page = Page(html or "")
    off, scope = page.cut()
    roots = _subtrees(page, off, scope)
    out, at = [], 0
    for k, piece in page.pieces:
        while at < len(roots) and k >= page.end[roots[at]]:
            out.append(" ")
            at += 1
        if at < len(roots) and k >= roots[at] and not off[k]:
            out.append(piece)
    return " ".join("".join(out).split())


@F.pandas_udf(StringType())
def _texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(main_text, na_action=None)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col``, the main text, and ``n_chars``, its code points; columns of those names are
    replaced, all others stay.

    A row's result depends on its own page alone: nothing is shuffled, equal pages have equal texts,
    repeated rows and null ids stay as they are, an empty table gives an empty one. Null and empty
    pages and pages without text have the empty text. Pages of any length are read whole, and tags
    that are never closed, nested too deep or out of order are borne.
    """
    made = pages.withColumn(text_col, _texts(F.col(html_col).cast("string")))
    return made.withColumn("n_chars", F.length(text_col).cast("long"))


def op13_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op13_text_density": op13_text_density}
