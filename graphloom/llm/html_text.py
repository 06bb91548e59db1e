"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element; what a page marks as furniture (menus, forms, adverts and the like)
leaves blank lines, and so do the edges of article and main elements. Text lengths, weighted by tags, are summed over a sliding window of lines: a
block runs from the point where the sums surge to the point where they dive to zero. On every page the heaviest block is the core of the text. The
innermost element that holds the core's paragraphs then says how far the text goes, so that short lines beside an advert are not lost.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.common import arrow, rows

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+>""", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|style|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose content is not text of the page.
OPAQUE = frozenset("script style noscript template svg math textarea iframe object select canvas audio video head title datalist".split())
#: Elements that a page marks as furniture.
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rb rt rp input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role values that mark furniture wherever they stand.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay"
    " sidebar sidebars menu menus nav navbar navigation navigator breadcrumb breadcrumbs footer foot pager pagination toolbar complementary contentinfo"
    " comment comments commentlist disqus reply replies respond discussion share sharing social related recommended newsletter subscribe signup login search widget widgets skip masthead".split()
)
#: Those of them whose element is furniture whatever it holds. The others may also stand on a wrapper around the page ("has-sidebar").
FIRM_HINTS = frozenset("comment comments commentlist disqus reply replies respond discussion related recommended".split())
#: Words that do so only outside the article, where a heading may stand in such a block.
OUTER_HINTS = frozenset("header head top side".split())
#: Elements whose text is a paragraph of some kind; words in their class mark nothing.
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption caption summary".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Lines in a window, and the weighted sum of characters in one from which text surges.
WINDOW, SURGE = 3, 86
#: Weight of a character in an article or main element, against one elsewhere.
NAMED = 64


def _furniture(name: str, rest: str, inside: bool) -> str:
    """Whether an element is furniture: ``firm``ly, ``loose``ly (by a word that wrappers bear too), or not (empty)."""
    if name in FURNITURE or name == "header" and not inside:
        return "firm"
    if not rest or name in ("html", "body", "main"):
        return ""
    plain = name in PARAGRAPH
    loose = ""
    for key, a, b, c in ATTRIBUTE.findall(rest):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "firm"
        if key in ("class", "id", "role") and not plain:
            words = {w.lower() for w in WORD.findall(value)}
            if words & FIRM_HINTS:
                return "firm"
            if name != "article" and (words & HINTS or not inside and words & OUTER_HINTS):
                loose = "loose"
    return loose


class Page:
    """The lines of a page: text, characters outside links, whether it lies in an article or main element, whether it is a paragraph, and the
    place of its first tag among all tags."""

    def __init__(self, html: str):
        self.tags = tags = list(TAG.finditer(html))
        self.ends = ends = self._ends(tags)
        regions = self._regions(tags, ends)
        self.lines: list[tuple[str, int, int, bool, int]] = []
        parts: list[str] = []
        linked, anchors, at, k, region, deep, first = 0, 0, 0, 0, 0, 0, 0

        def flush(blank: int = 0) -> None:
            nonlocal linked
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                self.lines.append((text, max(0, len(text) - linked), region, deep > 0, first))
            linked = 0
            self.lines.extend([("", 0, region, False, k)] * blank)

        starts = [a for a, _, _ in regions]
        edges = {k for a, b, _ in regions for k in (a, b)}
        top = tags[max(regions, key=lambda r: tags[r[1]].end() - tags[r[0]].start())[0]].start() if regions else None
        while k < len(tags):
            tag = tags[k]
            if tag.start() > at:
                first = k if not parts else first
                parts.append(html[at : tag.start()])
                linked += (tag.start() - at) * (anchors > 0)
            at = tag.end()
            name = (tag["name"] or "").lower()
            here = bisect_right(starts, k) - 1
            if k in edges:
                flush(WINDOW)
            region = regions[here][2] if here >= 0 and k <= regions[here][1] else 0
            if not name:
                k += 1
                continue
            if name in OPAQUE and not tag["close"] and not (tag["rest"] or "").endswith("/"):
                end = ends.get(k)
                if end is None and name in ("script", "style", "textarea", "noscript", "template", "iframe"):
                    flush()
                    at, k = len(html), len(tags)  # never closed: nothing after it is text
                    break
                if end is not None:
                    if name not in ("svg", "math", "canvas"):
                        flush()
                    k, at = end + 1, tags[end].end()
                    continue
            elif not tag["close"] and k in ends and self._skipped(_furniture(name, tag["rest"] or "", region > 0), tag.start(), tags[ends[k]].end(), len(html), top):
                if name not in INLINE:
                    flush(WINDOW)
                k, at = ends[k] + 1, tags[ends[k]].end()
                continue
            if name == "a":
                anchors = max(0, anchors + (-1 if tag["close"] else 1))
            elif name not in INLINE:
                flush()
                if name in PARAGRAPH:  # closed or not, what follows another block's tag is no longer of it
                    deep = max(0, deep - 1) if tag["close"] else deep + 1 if k in ends else 1
                elif name != "br":
                    deep = 0
            k += 1
        if at < len(html):
            first = k if not parts else first
            parts.append(html[at:])
        flush()

    def holder(self, first: int, last: int) -> tuple[int, int] | None:
        """The innermost element but html and body that is open from the tag ``first`` to the tag ``last``, as its own first and last tag."""
        found = None
        for k, end in self.ends.items():
            if k < first and last <= end and (tag := self.tags[k]["name"].lower()) not in PARAGRAPH and tag not in ("html", "body") and (found is None or k > found[0]):
                found = (k, end)
        return found

    @staticmethod
    def _ends(tags) -> dict[int, int]:
        """The closing tag of each opening one that has one. Inside scripts and the like, only their own closing tag counts."""
        open_by_name: dict[str, list[int]] = {}
        ends: dict[int, int] = {}
        raw = ""
        for k, tag in enumerate(tags):
            name = (tag["name"] or "").lower()
            if not name or raw and not (tag["close"] and name == raw):
                continue
            if tag["close"]:
                raw = ""
                if held := open_by_name.get(name):
                    ends[held.pop()] = k
            elif name not in VOID:
                open_by_name.setdefault(name, []).append(k)
                if name in ("script", "style", "textarea", "title", "iframe"):
                    raw = name
        return ends

    @staticmethod
    def _skipped(kind: str, start: int, end: int, size: int, top: int | None) -> bool:
        """Loose furniture is none if it holds the article or, where none is named, most of the page."""
        return kind == "firm" or kind == "loose" and not (start < top < end if top is not None else 2 * (end - start) > size)

    @staticmethod
    def _regions(tags, ends: dict[int, int]) -> list[tuple[int, int, int]]:
        """Outermost article elements (2), else main ones (1), as (first tag, last tag, kind), in no firm furniture, and at least half as long as
        the longest of them."""
        opened = sorted(ends.items())
        firm, last = [], -1
        for k, end in opened:
            if k > last and _furniture(tags[k]["name"].lower(), tags[k]["rest"] or "", True) == "firm":
                firm.append((k, end))
                last = end
        starts = [k for k, _ in firm]
        for kind, wanted in ((2, "article"), (1, "main")):
            found, last = [], -1
            for k, end in opened:
                at = bisect_right(starts, k) - 1
                named = tags[k]["name"].lower() == wanted or wanted == "main" and re.search(r"role\s*=\s*[\"']?main\b", tags[k]["rest"] or "", re.I)
                if k > last and named and not (at >= 0 and k <= firm[at][1]):
                    found.append((k, end, kind))
                    last = end
            if found:
                size = lambda r: tags[r[1]].end() - tags[r[0]].start()
                most = max(map(size, found))
                return [r for r in found if 2 * size(r) >= most]
        return []


def main_lines(html: str) -> list[str]:
    """The lines of a page's core block, those between a surge and a dive of its line-block distribution, and of the element around its paragraphs.

    Where no element but the body holds them, every block that surges counts."""
    page = Page(html)
    lines = page.lines
    # A line that is mostly a link weighs nothing; in a named element a character weighs more than outside.
    weights = [len(text) * (NAMED if region else 1) if region or 2 * own >= len(text) else 0 for text, own, region, _, _ in lines]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    most = max(sums, default=0)
    surge, blocks, i = min(SURGE, most), [], 0
    while i < len(sums) and most:
        if sums[i] < surge or not weights[i]:
            i += 1
            continue
        end = i
        while end < len(sums) and sums[end]:  # the dive
            end += 1
        blocks.append((i, end))
        i = end + 1
    if not blocks:
        return []
    core = max(blocks, key=lambda b: sum(weights[b[0] : b[1]]))
    own = [x for x in lines[core[0] : core[1]] if x[0]]
    tops = [x for x in own if x[3]] or own
    around = page.holder(tops[0][4], tops[-1][4])
    if around is None:
        return [lines[k][0] for a, b in blocks for k in range(a, b) if weights[k]]
    return [x[0] for x in lines if x[0] and around[0] < x[4] <= around[1]]


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page, blocks joined by a space.

    Null html counts as empty and gives an empty text, as does a page without any; null urls stay null; repeated rows stay; an empty
    table gives an empty one; other columns are ignored. Pages are read whole, however long."""

    def run(batches):
        for ids, urls, htmls in rows(batches, "page_id", "url", "html"):
            texts = [" ".join(main_lines(x)) for x in htmls]
            yield arrow(FIELDS, (ids, urls, texts, list(map(len, texts))))

    slim = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
