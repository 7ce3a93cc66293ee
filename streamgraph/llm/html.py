"""Operator 6: the main text of web pages by tree scoring.

A forgiving parser builds the element tree. Blocks of text pass points for length and
commas to their ancestors, discounted by link density; the best container and those of
its siblings that read like text are kept, whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

# Element names of HTML, and names that sites give to parts that are not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article body center details div dl fieldset figure html main ol section table tbody tr ul".split())
SCOPE = frozenset("html body table td th caption article section div main button".split())
DROPPED = frozenset("head nav footer aside form button select textarea dialog menu svg math canvas object audio video map script style noscript template iframe title xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion banner nav navbar navigation menu submenu "
    "topbar breadcrumb breadcrumbs sidebar sidenav footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login signin share sharing social related recommended recommendations comment comments disqus respond replies pagination pager "
    "paginator widget widgets toolbar copyright disclaimer skip outbrain taboola header".split()
)
KEPT = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends: the names it closes, and where the search for them stops.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])), "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
}

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<loose>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Page:
    """The element tree as parallel lists; a parent stands before its children. ``pieces``: (element, text) in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.dropped, self.article, self.named = ["#"], [0], [False], [False], [False]
        self.pieces: list[tuple[int, str]] = []
        self._stack = [0]
        self._parse(html)
        if any(self.named):
            self._drop_named()

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.pieces.append((self._stack[-1], " "))
            return
        if tag in BLOCK:
            self._close_paragraph()
        if tag in ENDS:
            names, stops = ENDS[tag]
            for k in range(len(self._stack) - 1, 0, -1):
                if self.tag[self._stack[k]] in names:
                    del self._stack[k:]
                    break
                if self.tag[self._stack[k]] in stops:
                    break
        up = self._stack[-1]
        inside = self.article[up] or tag in ("article", "main")
        self.tag.append(tag)
        self.parent.append(up)
        self.article.append(inside)
        unwanted, named = self._unwanted(tag, attrs, self.article[up])
        self.dropped.append(self.dropped[up] or unwanted)
        self.named.append(named)
        if tag not in VOID:
            self._stack.append(len(self.tag) - 1)
        elif tag in BLOCK:
            self.pieces.append((len(self.tag) - 1, " "))

    def _close_paragraph(self) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[k]]
            if name == "p":
                del self._stack[k:]
                return
            if name in SCOPE:
                return

    def _close(self, tag: str) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[k]]
            if name == tag:
                del self._stack[k:]
                return
            if tag not in BLOCK and name in BLOCK:
                return

    @staticmethod
    def _unwanted(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
        """Whether the element goes in any case, and whether its class or id says that it may."""
        if tag in KEPT:
            return False, False
        if tag in DROPPED or tag == "header" and not in_article:
            return True, False
        if "=" not in attrs and "hidden" not in attrs:
            return False, False
        named = False
        for name, *values in _ATTR.findall(attrs):
            value = next((v for v in values if v), "")
            match name.lower():
                case "hidden":
                    return True, False
                case "aria-hidden" if value.lower() == "true":
                    return True, False
                case "style" if _HIDDEN.search(value):
                    return True, False
                case "role" if value.lower() in ROLES:
                    return True, False
                case "class" | "id":
                    found = {x.lower() for x in _NAME.findall(value)}
                    named = named or bool(found & UNLIKELY) and not (found & UNLIKELY == {"header"} and in_article)
        return False, named

    def _drop_named(self) -> None:
        """Drop elements by class or id, unless they hold an article or main, or half of the page's unlinked text.

        Half of the text doesn't count (long comments) beside an article or main elsewhere of more than a tenth of it.
        """
        n, tag, parent = len(self.tag), self.tag, self.parent
        linked, plain, end = [False] * n, [0] * n, list(range(1, n + 1))
        for i in range(1, n):
            linked[i] = linked[parent[i]] or tag[i] == "a"
        for node, piece in self.pieces:
            if not self.dropped[node] and not linked[node]:
                plain[node] += len(piece.strip())
        for i in range(n - 1, 0, -1):  # elements stand in page order, so those below i are i + 1 to end[i] - 1
            plain[parent[i]] += plain[i]
            end[parent[i]] = max(end[parent[i]], end[i])
        bodies = [i for i in range(1, n) if tag[i] in ("article", "main") and not self.dropped[i] and plain[i]]
        for i in range(1, n):
            if self.named[i] and not self.dropped[i]:
                k = bisect_right(bodies, i)
                holds = k < len(bodies) and bodies[k] < end[i]
                if not holds and plain[i] and 2 * plain[i] >= plain[0]:
                    holds = not any(10 * plain[j] > plain[i] for j in bodies if end[j] <= i or j >= end[i])
                self.dropped[i] = not holds
            self.dropped[i] = self.dropped[i] or self.dropped[parent[i]]

    def _parse(self, html: str) -> None:
        at = 0
        while m := _TOKEN.search(html, at):
            if m.start() > at:
                self.pieces.append((self._stack[-1], unescape(html[at : m.start()])))
            at = m.end()
            if end := m["end"]:
                self._close(end.lower())
            elif tag := (m["start"] or m["loose"] or "").lower():
                attrs = m["attrs"] or m["rest"] or ""
                self._open(tag, attrs)
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE).search(html, at)
                    at = close.end()
                    self._close(tag)
            elif m["cdata"]:
                self.pieces.append((self._stack[-1], m["cdata"]))
        if at < len(html):
            self.pieces.append((self._stack[-1], unescape(html[at:])))

    def text(self) -> str:
        """The kept blocks in page order, white space made one space."""
        keep = self._kept()
        out, last = [], None
        for node, piece in self.pieces:
            if not self.dropped[node] and keep[node]:
                block = self._block[node]
                if last is not None and block != last:
                    out.append(" ")
                out.append(piece)
                last = block
        return " ".join("".join(out).split())

    def _kept(self) -> list[bool]:
        n = len(self.tag)
        tag, parent = self.tag, self.parent
        self._block = block = list(range(n))
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[parent[i]] or tag[i] == "a"
            if tag[i] not in BLOCK:
                block[i] = block[parent[i]]
        own, commas, length, links = [0] * n, [0] * n, [0] * n, [0] * n
        for node, piece in self.pieces:
            if not self.dropped[node]:
                size = len(piece.strip())
                own[block[node]] += size
                commas[block[node]] += piece.count(",") + piece.count("，") + piece.count("、") + piece.count("،")
                length[node] += size
                if linked[node]:
                    links[node] += size
        for i in range(n - 1, 0, -1):
            length[parent[i]] += length[i]
            links[parent[i]] += links[i]
        score = [0.0] * n
        for i in range(n):
            if own[i]:
                points = (own[i] >= 25) + commas[i] + own[i] / 100
                up, level = i if tag[i] in CONTAINER else parent[i], 0
                while up and level < 6:
                    if tag[up] in CONTAINER:
                        score[up] += points / (1, 2, 6, 9, 12, 15)[level]
                        level += 1
                    up = parent[up]
                if not level:  # in no container: the root is it
                    score[0] += points
        density = [links[i] / length[i] if length[i] else 0.0 for i in range(n)]
        score = [s * (1 - d) for s, d in zip(score, density, strict=True)]
        best = max(range(n), key=lambda i: (score[i], -i))
        keep = [False] * n
        if not best:
            keep[0] = score[0] > 0
            for i in range(1, n):
                if not parent[i]:
                    keep[i] = keep[0] and (tag[i] not in BLOCK or density[i] < 0.5)
        else:
            up = best
            while up and tag[up] != "article":
                up = parent[up]
            top = up or best
            keep[top] = True
            if tag[top] not in ("article", "body", "html"):
                for i in range(1, n):
                    if parent[i] == parent[top] and i != top and not self.dropped[i] and length[i]:
                        fair = score[i] >= max(10.0, 0.2 * score[best]) and density[i] < 0.5
                        prose = tag[i] in ("p", "pre", "blockquote") and (length[i] > 80 and density[i] < 0.25 or not links[i])
                        keep[i] = fair or prose or tag[i] in HEADINGS and density[i] < 0.5
        for i in range(1, n):
            keep[i] = keep[i] or keep[parent[i]] and (parent[i] > 0 or best > 0)
        return keep


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, ``text`` of the article and ``n_chars``, its code points.

    Null or empty html, and pages without text, give the empty string; null or repeated ids
    and null urls are carried as they are; other columns are not read; an empty table gives
    no rows. Pages of any length are taken whole, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.sliced(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
