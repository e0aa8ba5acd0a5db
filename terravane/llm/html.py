"""Main text of HTML pages: a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive, tags negative; a
linear scan finds the contiguous region with the best sum (the first of equal
ones), and the text of that region is the article.  Within the region, words of
containers with a negative weight are cut out: adverts and forms in its midst.

Weights are learned from labelled pages, those whose markup names its content
(exactly one ``article`` or ``main`` element).  A container is described by its
element and the words of its class, id and role; its weight is the log odds that
such a container stands in the content.  A word outside of the content is charged
to its outermost container only, so that a list in a menu says nothing about
lists.  Tags, links and plain words have weights of their own.  Names that pages
commonly give to menus, adverts and the like (``HINTS``, ``NEVER``, ``ROLES``) are
no rules: they are prior counts, which labelled pages outvote, and all that there
is where no page is labelled.  Names are counted in ``BINS`` bins by hash, so the
model's size is fixed.

Character references are decoded, white space in a block becomes one blank, blocks
are joined by one line feed.  A null or empty page, one without text, and one where
no region scores positive give an empty text.  Broken or cut-off markup is read as
far as it goes: an element that is never closed ends with its parent, and only an
unclosed script or style runs to the end.  Pages of any length are read whole.
Repeated rows give repeated results, an empty table gives none; a null id or url
stays null, and other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import _text

#: fixed values: elements by what they mean for the text
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe"}
FOREIGN = {"svg", "math", "canvas", "select", "object"}
NEVER = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "head"}
GENERIC = {"html", "body", "div", "span", "section", "center", "article", "main", "a", "b", "i", "em", "strong", "font"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
INLINE = {"a", "b", "i", "em", "strong", "span"}
#: fixed values: words of class names that hint at something else than content
HINTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "promo", "promotion", "sponsor", "sponsored", "sidebar", "side", "menu", "nav", "navbar", "navigation", "footer", "header", "masthead", "topbar", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "toolbar", "pagination", "pager", "widget", "copyright", "legal", "search", "form", "hidden", "alert"}
#: fixed values: words that say nothing beside a hint, as in "site-header"
STRUCTURE = {"site", "page", "global", "top", "bottom", "left", "right", "area", "list", "box", "bar", "block", "container", "wrapper", "wrap", "inner", "outer", "section", "item", "items", "links", "link", "buttons", "button", "col", "column", "row", "primary", "secondary", "mobile", "desktop", "js", "is", "ui", "policy", "posts", "unit", "slot", "thread"}
CONTENT = {"article", "post", "entry", "content", "main", "story", "body", "text"}
#: fixed values: hints that hold beside a name of content, as in "post-comments"
STRONG = {"comment", "comments", "sidebar", "footer", "related", "nav", "ad", "ads", "advert", "share"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])(hidden)(?![\w-])")
_CLOSERS = re.compile(r"</(svg|math|canvas|select|object|noscript|template|textarea|title|iframe)\s*>", re.I)

#: weights where no labelled page is seen
DEFAULT = {"word": 1.0, "link": 0.2, "never": -0.2, "tag": -0.4}
#: a region rarely goes on over the bounds of an element that names its content
BOUND = {"article": -25.0, "main": -25.0}
#: bins of container names; a container below ``REFUSED`` is no content
BINS, REFUSED = 1 << 16, -1.0


def hinted(token: str) -> bool:
    """Whether a class or id is made of hints: "site-header" is, "side-effects" is not."""
    parts = {p for p in re.split(r"[^a-z]+", token.lower()) if p}
    rest = parts - HINTS - STRUCTURE
    return bool(parts & HINTS) and (not rest or rest <= CONTENT and bool(parts & STRONG))


@lru_cache(maxsize=1 << 14)
def names_of(tag: str, attributes: str, in_content: bool) -> tuple[str, ...]:
    """What describes a container: its element, class and id words, its role, and whether it is hidden."""
    out = [] if tag in GENERIC else [tag + "+" if tag == "header" and in_content else tag]
    for m in _ATTR.finditer(attributes):
        if m[5]:
            out.append("@hidden")
            continue
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            out += ["." + t for t in value.split()]
        elif name == "role" and value in ROLES:
            out.append("@" + value)
        elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.append("@hidden")
    return tuple(out)


def listed(name: str) -> bool:
    return name in NEVER or name in FOREIGN or name in RAW or name[0] == "@" or name[0] == "." and hinted(name[1:])


@lru_cache(maxsize=1 << 16)
def bin_of(name: str) -> int:
    return zlib.crc32(name.encode()) % BINS


class Node:
    """An open element; ``names`` is empty where nothing describes it."""

    __slots__ = ("content", "holds", "link", "names", "parent", "refused", "tag")

    def __init__(self, parent: Node | None, tag: str, names: tuple[str, ...]):
        self.parent, self.tag, self.names = parent, tag, names
        self.content = tag in BOUND or parent is not None and parent.content
        self.link = tag == "a" or parent is not None and parent.link
        self.holds = False  # whether the content stands in it
        self.refused: bool | None = None


ROOT = Node(None, "", ())


def events(page: str) -> list[tuple[str, str, Node]]:
    """(tag, or "" for text; text; innermost container) in page order."""
    out: list[tuple[str, str, Node]] = []
    stack: list[Node] = []
    last = {m[1].lower(): m.start() for m in _CLOSERS.finditer(page)}
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag, top = m[2], stack[-1] if stack else ROOT
        if tag is None:
            if m[4] is not None:
                out.append(("", m[4], top))
            continue
        tag = tag.lower()
        if m[1]:
            out.append(("/" + tag, "", top))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        closed = m[0].endswith("/>") or tag in VOID or (tag in RAW or tag in FOREIGN) and tag not in ("script", "style") and last.get(tag, -1) < at
        if tag in BLOCK:
            # a block ends foreign content that was left open
            for k, node in enumerate(stack):
                if node.tag in ("svg", "math", "select"):
                    del stack[k:]
                    break
            top = stack[-1] if stack else ROOT
        if tag in ("p", "li", "td", "tr", "dt", "dd", "option") and stack and stack[-1].tag == tag:
            stack.pop()
            top = stack[-1] if stack else ROOT
        node = Node(top, tag, names_of(tag, m[3], top.content))
        out.append((tag, "", node))
        if closed:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(node)
    return out


def _tag_name(tag: str) -> str:
    name = tag.lstrip("/")
    return name if name in BLOCK or name in VOID or name in RAW or name in INLINE else "other"


def label_counts(page: str) -> Counter:
    """(name, "in" or "out") of a labelled page: tags, words and the bins of containers."""
    seen: Counter = Counter()
    found = events(page)
    marks = [k for k, e in enumerate(found) if e[0] in BOUND]
    ends = [k for k, e in enumerate(found) if e[0].lstrip("/") in BOUND and e[0][0] == "/"]
    if len(marks) != 1 or len(ends) != 1 or ends[0] < marks[0]:
        return seen
    content = found[marks[0]][2]
    holder = content.parent
    while holder is not None:
        holder.holds = True
        holder = holder.parent
    for k, (tag, text, node) in enumerate(found):
        inside = marks[0] < k < ends[0]
        side = "in" if inside else "out"
        if tag:
            if tag.lstrip("/") not in BOUND and not any(map(listed, node.names)):
                seen[_tag_name(tag), side] += 1
            continue
        n = len(text.split())
        if not n:
            continue
        # the outermost container that is described, below the content or outside of it
        top, at = None, node
        while at is not None and at is not content and not at.holds:
            if at.names:
                top = at
            at = at.parent
        doubtful = top is not None and any(map(listed, top.names))
        if top is not None and not (inside and doubtful):  # an advert in the content says nothing for adverts
            for name in top.names:
                seen[f"#{bin_of(name)}", side] += n
        seen["#never" if doubtful else "#link" if node.link else "#word", side] += n
    return seen


def weights(seen: dict[tuple[str, str], int]) -> dict[str, float]:
    """Words gain and tags lose by the log odds of standing in content; bins keep their counts' odds."""
    names = {k[0] for k in seen}
    if not names:
        return {}
    out: dict[str, float] = {}
    for n in names:
        a, b = seen.get((n, "in"), 0), seen.get((n, "out"), 0)
        odds = float(np.log((a + 1) / (b + 1)))
        if n == "#word":
            out[n] = max(0.5, min(2.0, odds))
        elif n == "#link":
            out[n] = max(-0.5, min(1.0, odds))
        elif n == "#never":
            out[n] = max(-0.5, min(-0.1, odds))
        elif n[0] == "#":
            out[n + "+"], out[n + "-"] = a, b
        else:
            out[n] = max(-3.0, min(-0.25, odds))
    return out


#: prior counts (inside, outside) of a container's name
PRIOR, PRIOR_LISTED = (1.0, 1.0), (1.0, 12.0)


class Weigher:
    """The weights of containers, by name."""

    def __init__(self, weight: dict[str, float]):
        self.weight = weight
        self.known: dict[str, bool] = {}

    def bad(self, name: str) -> bool:
        found = self.known.get(name)
        if found is None:
            a, b = PRIOR_LISTED if listed(name) else PRIOR
            k = f"#{bin_of(name)}"
            odds = np.log((self.weight.get(k + "+", 0) + a) / (self.weight.get(k + "-", 0) + b))
            if len(self.known) > 1 << 16:
                self.known.clear()
            found = self.known[name] = bool(odds < REFUSED)
        return found

    def refused(self, node: Node) -> bool:
        """Whether a container, or one around it, is no content."""
        if node.refused is None:
            node.refused = any(map(self.bad, node.names)) or node.parent is not None and self.refused(node.parent)
        return node.refused


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first contiguous stretch with the largest sum; (0, 0) if none is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, region = total, (start, k + 1)
    return region


def extract(page: str | None, weight: dict[str, float] | Weigher) -> str:
    """The article of one page."""
    if not page:
        return ""
    weigher = weight if isinstance(weight, Weigher) else Weigher(weight)
    weight = weigher.weight
    found = events(page)
    word, link, never = (weight.get(f"#{k}", DEFAULT[k]) for k in ("word", "link", "never"))
    scores, bad = [], []
    for tag, text, node in found:
        ROOT.refused = False
        refused = weigher.refused(node)
        bad.append(refused)
        if tag:
            name = tag.lstrip("/")
            scores.append(0.0 if refused else BOUND.get(name) or weight.get(_tag_name(name), DEFAULT["tag"]))
        else:
            scores.append(len(text.split()) * (never if refused else link if node.link else word))
    a, b = best_region(scores)
    good = [k for k in range(a, b) if scores[k] > 0]
    first, last = (good[0], good[-1]) if good else (0, 0)
    # the region ends with a word; a block that it cuts is completed
    while a > 0 and found[a - 1][0].lstrip("/") not in BLOCK and not bad[a - 1]:
        a -= 1
    while b < len(found) and found[b][0].lstrip("/") not in BLOCK and not bad[b]:
        b += 1
    blocks, now = [], []
    for k in range(a, b):
        tag, text, _ = found[k]
        if not tag:
            if not (bad[k] and first < k < last):
                now.append(text)
        elif tag.lstrip("/") in BLOCK:
            blocks.append("".join(now))
            now = []
        elif tag == "br":
            now.append(" ")
    blocks.append("".join(now))
    done = (" ".join(html.unescape(x).split()) for x in blocks)
    return "\n".join(x for x in done if x)


def learn(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all pages whose markup names its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in _text.slices(batch, "html"):
                for page in part.column(0):
                    seen.update(label_counts(page.as_py() or ""))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["name", "side", "n"])

    rows = pages.select(F.col(html_col).cast("string").alias("html")).mapInArrow(run, "name string, side string, n long").groupBy("name", "side").agg(F.sum("n").alias("n"))
    return weights({(r["name"], r["side"]): r["n"] for r in rows.collect()})  # two rows for each known tag and each bin


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row."""
    weight = learn(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(weight)
        for batch in batches:
            for part in _text.slices(batch, "html"):
                texts = [extract(p.as_py(), weigher) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
