"""Main text of web pages by line-block distribution.

A page's markup is stripped into lines, one per block element.  Lines inside menus, headers, footers and
the like weigh nothing, others the length of their text outside links; a marked article adds to the weight of
its lines, and takes from that of all others.  Weights are summed over sliding windows of lines; where the sums
surge a text begins, where they dive to nothing it ends, and all lines between that aren't shut out belong to
the article.  A class or id that speaks of a menu, an advert and so on shuts its element out, unless that holds
a marked article or most of the page's text.  Time is in proportion to the page, however deep its elements are
nested.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window; text characters in a window that make a surge, which a line of a marked article has at once.
LINES, SURGE = 3, 40
#: Where an article is marked, other lines weigh their length divided by this.
UNMARKED = 10
#: Of several articles that of the most text is kept, and those that have this share of it; a hint on an element that holds this share of the page's text counts for nothing.
SHARE = 0.5

# Elements of HTML by what they mean here.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "svg", "math", "iframe", "object", "select", "canvas", "audio", "video", "xmp")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
OUTSIDE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "head"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HINTS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "skip",
    "header", "masthead", "topbar", "footer", "sidebar", "rail", "widget", "related", "recommended", "trending",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall",
    "share", "sharing", "social", "copyright", "legal", "disclaimer", "search",
}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "discussion", "respond", "replies", "reply"}
#: Words after a hint that say nothing of their own, and words before header that make it the article's.
FRAMES = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "column", "container", "content", "form", "group", "holder", "icons", "inner", "item", "items", "left", "link", "links", "list", "message", "outer", "panel", "region", "right", "row", "section", "slot", "thread", "top", "unit", "wrap", "wrapper"}
OWN_HEADER = {"article", "chapter", "content", "entry", "news", "post", "recipe", "section", "story"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}

MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:[\"'][^>]*)?)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {t: re.compile(rf"</{t}(?=[\s>/])[^>]*(?:>|\Z)", re.IGNORECASE) for t in RAW}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
COMMENT_HEADING = re.compile(r"(?:\d+\s+)?(?:reader )?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?:?", re.IGNORECASE)


@dataclass
class Line:
    """links: characters inside links; hint: the number of the innermost hinted element; article: that of the outermost marked one, or 0."""

    text: str
    links: int
    outside: bool
    hint: int
    article: int
    heading: bool


def hinted(token: str) -> str:
    """What a class or an id says of its element: comments, other, or nothing.  Its last word that isn't a frame counts."""
    words = [w.lower() for w in WORD.findall(token)]
    while len(words) > 1 and words[-1] in FRAMES:
        words.pop()
    if not words or words[-1] == "header" and OWN_HEADER & set(words[:-1]):
        return ""
    return "comments" if words[-1] in COMMENTS else "other" if words[-1] in HINTS else ""


def judged(tag: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether an element's content is no part of an article by its name, role or style, and what its class and id say."""
    if tag in OUTSIDE or tag == "header" and not inside:
        return True, ""
    found = ""
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        low = value.lower()
        if name == "hidden" or name == "aria-hidden" and low == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", low):
            return True, ""
        if tag in ("html", "body", "main"):
            continue
        if name == "role" and low in ROLES:
            return True, ""
        if name in ("class", "id"):
            for token in value.split():
                said = hinted(token)
                found = said if said == "comments" or not found and tag != "article" else found
    return False, found


class Open:
    """The open elements of a page, with how many of them shut their content out, are a heading or a link, and which are hinted or an article."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int, int]] = []  # element, shut out, the hint and article around it
        self.names: Counter = Counter()
        self.outside = self.hint = self.article = self.articles = 0
        #: of each hint the one around it, what it says, and whether it holds an article; 0 is none
        self.hints: list[list] = [[0, "", False]]

    def push(self, tag: str, outside: bool, said: str, article: bool) -> None:
        self.stack.append((tag, outside, self.hint, self.article))
        self.names[tag] += 1
        self.outside += outside
        if article:
            self.hints[self.hint][2] = True
            if not self.article:
                self.articles += 1
                self.article = self.articles
        if said:
            self.hints.append([self.hint, said, False])
            self.hint = len(self.hints) - 1

    def pop(self) -> str:
        tag, outside, self.hint, self.article = self.stack.pop()
        self.names[tag] -= 1
        self.outside -= outside
        return tag

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def heading(self) -> bool:
        return any(self.names[h] for h in HEADINGS)

    def end(self, tag: str) -> None:
        """Close the last element of this name and all in it; an inline one closes none outside its block."""
        if not self.names[tag]:
            return
        if tag in INLINE:
            for name, *_ in reversed(self.stack):
                if name == tag:
                    break
                if name not in INLINE:
                    return
        while self.pop() != tag:
            pass


def shut_out(found: list[Line], hints: list[list]) -> None:
    """Mark the lines outside that stand in hinted elements, after a heading of comments, or in lesser articles."""
    own = [len(x.text) - x.links for x in found]
    weight = [0] * len(hints)
    for x, w in zip(found, own, strict=True):
        weight[x.hint] += 0 if x.outside else w
    for k in range(len(hints) - 1, 0, -1):  # elements have larger numbers than those around them
        up, _, holds = hints[k]
        weight[up] += weight[k]
        hints[up][2] = hints[up][2] or holds
    total, gone = weight[0], [False] * len(hints)
    for k in range(1, len(hints)):
        up, said, holds = hints[k]
        gone[k] = gone[up] or (weight[k] < total if said == "comments" else not holds and weight[k] < SHARE * total)
    for x in found:
        x.outside = x.outside or gone[x.hint]
    size: Counter = Counter()
    for x, w in zip(found, own, strict=True):
        size[x.article] += 0 if x.outside else w
    most = max((n for k, n in size.items() if k), default=0)
    said = told = False
    for x in found:
        told = told or said and x.heading and not x.outside and COMMENT_HEADING.fullmatch(x.text) is not None
        said = said or not x.outside and not x.heading
        x.outside = x.outside or told or x.article > 0 and size[x.article] < SHARE * most


def lines(page: str) -> list[Line]:
    """The page's text by block, in order, with the characters inside links and whether the block stands in the article or outside of any."""
    found: list[Line] = []
    parts: list[str] = []
    links = at = 0
    opened = Open()

    def text(raw: str) -> None:
        nonlocal links
        if raw:
            parts.append(raw)
            if opened.names["a"]:
                links += len(raw.strip())

    def close() -> None:
        nonlocal links
        if parts:
            if joined := " ".join(html.unescape("".join(parts)).split()):
                found.append(Line(joined, min(links, len(joined)), opened.outside > 0, opened.hint, opened.article, opened.heading()))
            parts.clear()
        links = 0

    while at < len(page):
        m = MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        tag = m[2].lower()
        if tag == "br":
            parts.append(" ")
        elif m[1]:
            if tag not in INLINE:
                close()
            opened.end(tag)
        elif tag in RAW_END:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag in VOID:
            if tag == "hr":
                close()
        else:
            if tag not in INLINE:
                close()
                while opened.stack and (opened.top() in INLINE or opened.top() == "p" and tag in ENDS_P or opened.top() == tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    opened.pop()
            if not m[3].rstrip().endswith("/") or tag not in INLINE:
                opened.push(tag, *judged(tag, m[3], opened.article > 0), tag in ("article", "main") or "itemprop" in m[3] and "articleBody" in m[3])
    close()
    shut_out(found, opened.hints)
    return found


def weighed(found: list[Line]) -> list[int]:
    """What each line counts for in the windows."""
    marked = any(x.article and not x.outside for x in found)
    plain = [0 if x.outside else len(x.text) - x.links for x in found]
    return [w // UNMARKED if marked and not x.article else w + SURGE if x.article and not x.outside else w for x, w in zip(found, plain, strict=True)]


def between(weights: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) of each run of lines between a surge, where LINES lines of some weight reach least, with those right before them, and the dive of the sums to nothing."""
    so_far = [0, *accumulate(weights)]
    sums = [so_far[min(i + LINES, len(weights))] - so_far[i] for i in range(len(weights))]
    unbroken = [0] * (len(weights) + 1)  # lines of some weight from here on
    for i in range(len(weights) - 1, -1, -1):
        unbroken[i] = unbroken[i + 1] + 1 if weights[i] else 0
    runs, i = [], 0
    while i < len(weights):
        if weights[i] and so_far[i + min(LINES, unbroken[i])] - so_far[i] >= least:
            first = last = j = i
            while first > (runs[-1][1] + 1 if runs else 0) and weights[first - 1]:
                first -= 1
            while j < len(weights) and sums[j]:
                if weights[j]:
                    last = j
                j += 1
            runs.append((first, last))
            i = j
        i += 1
    return runs


def headed(runs: list[tuple[int, int]], found: list[Line], weights: list[int]) -> list[tuple[int, int]]:
    """The runs, each from the heading before it on if nothing but lines without weight stands between."""
    out, after = [], 0
    for first, last in runs:
        k = first - 1
        while k >= after and not weights[k]:
            k -= 1
        out.append((k if k >= after and found[k].heading else first, last))
        after = last + 1
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line breaks; empty for null, empty and textless pages."""
    found = lines(page or "")
    weights = weighed(found)
    runs = between(weights, SURGE) or between(weights, 1)
    marked = any(x.article and not x.outside for x in found)
    return "\n".join(found[k].text for a, b in headed(runs, found, weights) for k in range(a, b + 1) if not found[k].outside and (weights[k] >= SURGE or not marked or found[k].article))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    pages: page_id, url and html; other columns are ignored.  Null and empty html and pages without text give
    the empty text; pages of any length and depth are read whole.  Repeated rows are repeated, and no rows give
    no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                few = batch.slice(at, 64)
                texts = [main_text(x.as_py()) for x in few.column(2)]
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return plain.mapInArrow(read, "page_id long, url string, text string, n_chars long")
