"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped first: every block of a page (what stands between two tags that start or
end a block) becomes one line. A line weighs the characters of its words outside links; lines
inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments weigh
nothing, and where a page marks its article, so do the lines outside it. Weights are summed
over sliding windows of ``WINDOW`` lines. The text starts where the sum surges to ``SURGE`` (or
at the first line of a marked article), ends where the next windows have dived to nothing, and
all lines with weight between those points are kept; lines that have none are left out. Short
lines inside such a stretch, headings among them, therefore stay.

Marks come from the element names and roles of the language and from words in class and id. A
word in class or id does not count on an element that holds the article, so a page frame
called "with-sidebar" stays. Unclosed elements end with their parents; an article or footer
ends an open menu or advert; a page that breaks off keeps what came before; a tag that breaks
off is dropped. Scripts, styles and other raw text never become lines.

Each row is judged alone: NULL and empty html give an empty text, repeated rows give equal
results, an empty table stays empty, pages of any length are read whole. Only page_id, url and
html are read; extra columns are not.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourstat.llm.common import prepare

#: Lines of a window, and the characters outside links in one window that start a text.
WINDOW, SURGE = 3, 80

# Elements and words of the language of web pages
RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "output", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr", "br",
}
BOILERPLATE = {
    "nav", "menu", "aside", "footer", "form", "button", "select", "option", "fieldset", "input", "dialog", "head", "datalist", "progress",
    "meter", "legend",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "status"}
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "sponsor", "sponsored",
    "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "foot",
    "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup",
    "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "signin", "search", "share", "sharing", "social",
    "related", "recommended", "recommendations", "widget", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond",
    "discussion", "copyright", "legal", "disclaimer", "pagination", "pager", "skip", "form",
}
HEADS = {"header", "head", "pageheader", "siteheader"}
ARTICLE_WORDS = {"articlebody", "articletext", "maincontent"}
CLOSES_OPEN_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: Elements that end an open menu, sidebar or form that was never closed.
LANDMARKS = {"article", "main", "footer", "body"}
ENDED_BY_LANDMARKS = ("nav", "aside", "menu", "head", "form", "header")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPEAKING = re.compile(r"class|id|role|itemprop|hidden|style", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Element:
    """An element while its page is read: where it stands and what its marks say."""

    tag: str
    parent: int
    #: Marked as boilerplate by its name or role, or by a word in class or id.
    named: bool = False
    worded: bool = False
    #: The article itself, and an element that holds it.
    article: bool = False
    holds_article: bool = False


@dataclass(slots=True)
class Line:
    """The text of one block, the element it stands in and its characters inside links."""

    text: str
    element: int
    linked: int


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


@lru_cache(4096)
def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether name or role say boilerplate, a word does, a word says page head, and it is an article."""
    a = _attributes(attributes)
    words = {w for v in (a.get("class", ""), a.get("id", "")) for w in _WORD.findall(_CAMEL.sub(" ", v).lower())}
    role = a.get("role", "").strip().lower()
    hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true"
    hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()) is not None
    joined = {a.get(k, "").strip().lower().replace("-", "").replace("_", "") for k in ("itemprop", "class", "id")}
    article = tag in ("article", "main") or role in ("main", "article") or bool(joined & ARTICLE_WORDS)
    return tag in BOILERPLATE or role in ROLES or hidden, bool(words & MARKS), tag == "header" or bool(words & HEADS), article


def _element(tag: str, attributes: str, parent: int, inside_article: bool) -> Element:
    if tag in ("html", "body"):
        return Element(tag, parent)
    named, worded, head, article = _marks(tag, attributes if _SPEAKING.search(attributes) else "")
    if head and not inside_article:
        # The head of a page; inside an article it holds the title.
        named, worded = named or tag == "header", True
    return Element(tag, parent, named, worded, article and not named and not worded)


def strip_markup(page: str) -> tuple[list[Element], list[Line]]:
    """Elements and lines of a page, in page order."""
    elements = [Element("", -1)]
    lines: list[Line] = []
    stack = [0]
    text: list[str] = []
    linked: list[str] = []
    depth_a = in_article = 0
    depths: defaultdict[str, list[int]] = defaultdict(list)  # where the open elements of a name are in the stack
    last_article = page.lower().rfind("</article")

    def flush() -> None:
        if not text:
            return
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            lines.append(Line(line, stack[-1], len("".join(html.unescape("".join(linked)).split())) if linked else 0))
        text.clear()
        linked.clear()

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if depth_a:
                linked.append(piece)

    def pop_to(size: int) -> None:
        nonlocal depth_a, in_article
        if any(elements[k].tag not in INLINE for k in stack[size:]):
            flush()
        for k in stack[size:]:
            depths[elements[k].tag].pop()
            depth_a -= elements[k].tag == "a"
            in_article -= elements[k].article
        del stack[size:]

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        m = _TOKEN.match(page, start)
        if m is None:  # a "<" that starts no tag is text
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        at = m.end()
        close, tag, rest, end = m.group(1, 2, 3, 4) if m.group(2) else m.group(5, 6, 7, 8)
        if tag is None:
            continue
        if not end:
            break  # a tag that breaks off
        tag = tag.lower()
        if close:
            if depths[tag]:
                pop_to(depths[tag][-1])
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            if tag not in INLINE:
                flush() if tag not in ("script", "style", "template", "noscript") else add(" ")
            if not rest.rstrip().endswith("/"):
                ended = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = ended.end() if ended else size
            continue
        if tag == "br":
            add("\n")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in CLOSES_OPEN_P:
            for depth in range(len(stack) - 1, 0, -1):
                if elements[stack[depth]].tag == "p":
                    pop_to(depth)
                    break
                if elements[stack[depth]].tag not in INLINE:
                    break
        if tag in LANDMARKS:
            # An article that is not closed any more ends where the page's footer starts.
            ended = ENDED_BY_LANDMARKS + (("article",) if tag == "footer" and at > last_article else ())
            if outermost := [depths[t][0] for t in ended if depths[t]]:
                pop_to(min(outermost))
        if tag not in INLINE:
            flush()
        e = _element(tag, rest, stack[-1], in_article > 0)
        elements.append(e)
        stack.append(len(elements) - 1)
        depths[tag].append(len(stack) - 1)
        depth_a += tag == "a"
        if e.article:
            in_article += 1
            up = e.parent
            while up > 0 and not elements[up].holds_article:
                elements[up].holds_article = True
                up = elements[up].parent
        if rest.rstrip().endswith("/"):
            pop_to(len(stack) - 1)
    flush()
    return elements, lines


def weights(elements: list[Element], lines: list[Line]) -> tuple[np.ndarray, bool]:
    """Characters of each line that speak for main text, and whether the page marks its article."""
    out = np.zeros(len(elements), bool)  # inside boilerplate
    inside = np.zeros(len(elements), bool)  # inside an article
    for k, e in enumerate(elements[1:], 1):
        out[k] = out[e.parent] or e.named or (e.worded and not e.holds_article)
        inside[k] = inside[e.parent] or (e.article and not out[k])
    where = np.array([line.element for line in lines], int)
    size = np.array([len(line.text) - line.text.count(" ") for line in lines], int)
    linked = np.array([line.linked for line in lines], int)
    own = np.where(out[where], 0, size)
    marked = bool((own * inside[where]).any())
    if marked:
        return own * inside[where], True
    # Without a marked article a line that is mostly links speaks for a menu.
    return np.where(2 * linked > size, 0, own), False


def main_lines(weight: np.ndarray, surge: int, window: int = WINDOW) -> np.ndarray:
    """Which lines lie between a surge and the next dive, and have weight themselves.

    The sum of a window belongs to its first line. A stretch starts at the first line with
    weight of a window that reaches ``surge`` and ends before the first window without any.
    """
    n = len(weight)
    total = np.concatenate([[0], np.cumsum(weight)])
    sums = total[np.minimum(np.arange(n) + window, n)] - total[:n]
    keep = np.zeros(n, bool)
    at = 0
    while at < n:
        found = np.flatnonzero(sums[at:] >= surge)
        if not len(found):
            break
        start = at + int(found[0])
        dive = np.flatnonzero(sums[start:] == 0)
        end = start + int(dive[0]) if len(dive) else n
        keep[start:end] = True
        at = end + 1
    return keep & (weight > 0)


def extract(page: str | None) -> str:
    """The main text of one page, its blocks joined by newlines."""
    if not page:
        return ""
    elements, lines = strip_markup(page)
    if not lines:
        return ""
    weight, marked = weights(elements, lines)
    keep = main_lines(weight, 1 if marked else SURGE)
    if not keep.any():
        # No window reaches the surge: a short page, of which all lines with weight are the text.
        keep = weight > 0
    return "\n".join(line.text for line, k in zip(lines, keep) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, ``text`` and ``n_chars`` of every page; one pass without a shuffle."""
    prepare(pages.sparkSession)
    read = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = dict(read.dtypes)
    return read.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
