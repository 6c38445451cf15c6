"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. Elements that hold no article
text by their name or role (menus, forms) leave no lines but a
gap as wide as the window, and the edge of a container that holds blocks leaves one empty line.
A container whose class or id names such a kind is left out as well, if its
text and links do not speak against it. Text lengths, links discounted, are summed over a sliding window of lines: a sum that reaches
SURGE is a surge, one that falls below DIVE is a dive, and the text between the two is a run. The
runs inside the page's article are joined; without such an element those inside main, or else those
inside the deepest container that holds nearly all of their text. Joining them keeps the short lines
between runs and drops blocks of links. An article also keeps its short lines at both ends, and the
headings of its own header.

Markup may be broken: a head without its end tag ends where something stands that no head
holds, another element at the end tag of what it stands in. A form, or an element without its end
tag, is not left out by its name if it holds blocks and nearly all text of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import map_slices

TEXTS = "page_id long, url string, text string, n_chars long"

#: Lines a window sums over.
WINDOW = 3
#: An element is left out by its name or not: it holds this many times the text of the rest of the page.
HOLDS = 9
#: Characters outside links in a window that begin a run; on pages of short lines, half of the largest window.
SURGE = 80
#: Below this share of the surge a window ends a run.
DIVE = 0.25
#: A container gives way to one inside it that holds this share of the text in runs.
NESTED = 0.9

# Element names of the HTML standard, fixed values.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "ins", "kbd", "label", "mark", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img",
}
#: What may stand in a head, besides elements of raw text.
HEAD = {"title", "base", "link", "meta", "style", "script", "noscript", "template", "head"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINER = {"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "td", "frameset"}
TABLE = {"table", "tbody", "td"}
#: Block elements that end an open paragraph.
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "th", "option", "thead", "tfoot"}
DROPPED = {
    "head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "template",
    "object", "svg", "canvas", "audio", "video", "map", "input", "fieldset", "datalist", "search",
} | RAW
DROPPED_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "toolbar", "dialog",
    "alertdialog", "alert", "note", "status",
}
#: Containers whose class or id is judged; headings, paragraphs, list items and inline elements are not.
JUDGED = {"div", "section", "table", "tbody", "td", "center", "ul", "ol", "dl", "figure", "details"}
COMMENTS = {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus"}
ADVERTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo",
    "promotion", "promoted",
}
#: Words that name a part of a page beside the article.
BESIDE = {
    "banner", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "header", "masthead",
    "topbar", "footer", "sidebar", "sidebars", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter",
    "subscribe", "signup", "login", "signin", "searchbox", "pagination", "pager", "toolbar",
}
#: Everyday words, which need a short text or one of links to count.
PERHAPS = {
    "foot", "aside", "rail", "widget", "widgets", "notice", "notices", "notification", "overlay", "alert", "disclaimer",
    "subscription", "register", "form", "search", "discussion", "feedback", "share", "sharing", "social", "related",
    "recommended", "recommendations", "teaser", "trending", "popular", "copyright", "legal", "tags", "hidden", "print",
    "toc", "skip", "paywall",
}
#: With one of these, a class tells how a page is laid out: has-sidebar, comments-open.
STATES = {
    "has", "no", "with", "without", "open", "closed", "on", "off", "enabled", "disabled", "allowed", "layout", "count",
}
#: A block named by an everyday word is short if the rest of the page has this many times its text.
SHORT_OF = 4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|\S+)")
_SPACE = re.compile(r"\s+")
_ROOT = 0
#: What explicit element a line is in.
_MAIN, _ARTICLE = 1, 2


@dataclass
class Line:
    """Text of one block; ``owner`` is its container, ``links`` the characters inside links."""

    text: str
    owner: int
    scope: int
    links: int
    title: bool
    named: int

    def weight(self) -> int:
        return max(0, len(self.text) - 2 * self.links)


@dataclass
class Named:
    """A container with a telling class or id, inside ``outer`` of them (-1: none)."""

    kind: str
    outer: int
    in_article: bool
    holds_title: bool = False


@dataclass
class Dropped:
    """An element left out by its name: where it begins, its text outside links, and the blocks in it."""

    start: int
    name: str
    closed: bool = False
    weight: int = 0
    blocks: int = 0


@dataclass
class Page:
    """Lines and gaps (None); each container's parent, and the block it belongs to: tables have none of their own."""

    lines: list[Line | None] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    in_link: int = 0
    title: bool = False
    parent: list[int] = field(default_factory=lambda: [_ROOT])
    block: list[int] = field(default_factory=lambda: [_ROOT])
    articles: set[int] = field(default_factory=set)
    named: list[Named] = field(default_factory=list)
    named_now: int = -1
    dropped: list[Dropped] = field(default_factory=list)

    def flush(self, owner: int, scope: int) -> None:
        if self.parts:
            text = _SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()
            if text:
                self.lines.append(Line(text, owner, scope, 0 if self.title else self.links, self.title, self.named_now))
            self.parts = []
        self.links = 0
        self.title = False

    def gap(self, size: int) -> None:
        if self.lines:
            empty = 0
            while empty < size and self.lines[-1 - empty] is None:
                empty += 1
            self.lines.extend([None] * (size - empty))

    def holds(self, named: int) -> None:
        """A title or main element stands in a named container, so it is no part beside."""
        while named >= 0:
            self.named[named].holds_title = True
            named = self.named[named].outer

    def open(self, owner: int, name: str) -> int:
        """A container inside ``owner``."""
        self.parent.append(owner)
        self.block.append(self.block[owner] if name in TABLE else len(self.block))
        return len(self.parent) - 1


def _kind(name: str, attributes: str) -> str:
    """What the class and id of a container name: comments, adverts, beside, perhaps or nothing."""
    if not attributes or name not in JUDGED and name != "article":
        return ""
    words: set[str] = set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id"):
            for token in "".join(values).split():
                own = {w.lower() for w in _WORD.findall(token)}
                words |= own if STATES.isdisjoint(own) else set()
    if not words.isdisjoint(COMMENTS):
        return "comments"
    if name == "article":
        return ""
    if not words.isdisjoint(ADVERTS):
        return "adverts"
    return "beside" if not words.isdisjoint(BESIDE) else "perhaps" if not words.isdisjoint(PERHAPS) else ""


def _beside(name: str, attributes: str) -> bool:
    """Whether an element's name, role or state says that it is not article text."""
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "role" and value.lower() in DROPPED_ROLES:
            return True
        if key == "aria-hidden" and value.lower() == "true":
            return True
    return "hidden" in attributes and "hidden" in _QUOTED.sub("", attributes).lower().split()


def _is_main(name: str, attributes: str) -> bool:
    return name == "main" or "role" in attributes.lower() and any(
        key.lower() == "role" and "".join(values).lower() == "main" for key, *values in _ATTRIBUTE.findall(attributes)
    )


def leave_out(page: Page) -> None:
    """Takes out the named containers that hold what they say; inner ones first, a gap stays."""
    if not page.named:
        return
    # characters, those in links, those that count, and of these the ones in article elements
    sums = np.zeros((len(page.named) + 1, 4), np.int64)
    for x in page.lines:
        if x is not None:
            weight = x.weight()
            sums[x.named] += (len(x.text), x.links, weight, weight if x.scope == _ARTICLE else 0)
    own = sums.tolist()
    _, _, left, left_article = sums.sum(axis=0).tolist()
    out: set[int] = set()
    for i in range(len(page.named) - 1, -1, -1):
        x, (size, links, weight, article) = page.named[i], own[i]
        if goes(x, 2 * links > size, weight, left - weight, article, left_article - article):
            out.add(i)
            left, left_article = left - weight, left_article - article
        elif x.outer >= 0:
            own[x.outer] = [a + b for a, b in zip(own[x.outer], own[i], strict=True)]
    gone = [False] * len(page.named)
    for i, x in enumerate(page.named):
        gone[i] = i in out or x.outer >= 0 and gone[x.outer]
    lines, page.lines = page.lines, []
    for x in lines:
        if x is not None and x.named >= 0 and gone[x.named]:
            page.gap(WINDOW)
        else:
            page.lines.append(x)


def goes(x: Named, linked: bool, weight: int, rest: int, article: int, rest_article: int) -> bool:
    """Whether a named container's text is beside the article; ``rest`` is what the page has without it."""
    if linked or weight < SURGE and weight * SHORT_OF <= rest:
        return True
    if x.kind == "perhaps":
        return False
    if not rest:
        return weight < SURGE
    if x.in_article:  # only a comment or an advert is ever long there
        return x.kind != "beside" and rest_article > 0
    return not x.holds_title and not (x.kind == "beside" and article > 0 and not rest_article)


def lines_of(page: str, kept: frozenset[int] = frozenset()) -> Page:
    """The page's blocks in order; gaps where boilerplate stood or a container ends.

    Elements that begin at a place in ``kept`` are not left out by their name.
    """
    out = Page()
    stack: list[tuple[str, int, int, int]] = [("", _ROOT, 0, -1)]
    skip, depth, at = "", 0, 0
    inner: Counter[str] = Counter()  # containers open in the element that is left out
    linked, heading = False, -1
    find = _TOKEN.search
    while True:
        m = find(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not skip:
            out.parts.append(text)
            if out.in_link:
                out.links += len(text)
        elif text:
            size = len(text.strip())
            out.dropped[-1].weight += -size if linked else size
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        closing, name = bool(m[1]), m[2].lower()
        if not closing and name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if skip == "head" and not closing and name not in HEAD:
            skip = ""  # its end tag was left out
        if skip in LEAVES and not closing and (name == skip or name in LEAVES and skip == "p"):
            skip = ""  # its end tag was left out
        if skip in LEAVES and closing and name in CONTAINER:
            skip = ""
        _, owner, scope, named = stack[-1]
        if skip:
            linked = not closing if name == "a" else linked
            out.dropped[-1].blocks += not closing and name in ("p", "article", "main", "h1")
            if skip == "header" and scope == _ARTICLE and name in HEADINGS:
                if closing and heading >= 0:
                    out.parts = [_TOKEN.sub("", page[heading : m.start()])]
                    out.title = name == "h1"
                    if out.title:
                        out.holds(named)
                    out.flush(owner, scope)
                heading = -1 if closing else at
            if name == skip:
                depth += -1 if closing else 1
                if depth == 0:
                    skip, out.dropped[-1].closed = "", True
                continue
            if name not in CONTAINER:
                continue
            inner[name] += -1 if closing else 1
            if not closing or inner[name] >= 0 or all(s[0] != name for s in stack):
                continue
            skip = ""  # its end tag was left out
        if name in VOID:
            if name == "br":
                out.parts.append(" ")
            elif name == "hr":
                out.flush(owner, scope)
            continue
        if not closing and m.start() not in kept and _beside(name, m[3]) and not m[3].endswith("/"):
            if name not in INLINE:
                out.flush(owner, scope)
                out.gap(WINDOW)
            skip, depth, linked, heading = name, 1, False, -1
            inner.clear()
            out.dropped.append(Dropped(m.start(), name))
            continue
        if name == "a":
            out.in_link = 0 if closing else 1
        if name in INLINE:
            continue
        out.flush(owner, scope)
        out.in_link = 0
        out.title = name == "h1" and not closing
        if name == "h1" and not closing:
            out.holds(named)
        if name in CONTAINER or name in JUDGED:
            if not closing:
                kind = _kind(name, m[3])
                if name in CONTAINER:
                    out.gap(1)
                    owner = out.open(owner, name)
                if kind:
                    out.named.append(Named(kind, named, scope == _ARTICLE))
                    named = len(out.named) - 1
                elif name == "article":
                    out.articles.add(owner)
                    scope = _ARTICLE
                elif _is_main(name, m[3]):
                    out.holds(named)
                    scope = max(scope, _MAIN)
                stack.append((name, owner, scope, named))
            elif any(s[0] == name for s in stack):
                if name in CONTAINER:
                    out.gap(1)
                while stack.pop()[0] != name:
                    pass
            out.named_now = stack[-1][3]
    out.flush(*stack[-1][1:3])
    leave_out(out)
    return out


def candidates(lines: list[Line | None]) -> tuple[np.ndarray, float]:
    """Which lines are in a run between a surge and the next dive, and what a surge is on this page."""
    weight = np.array([0 if x is None else x.weight() for x in lines], np.int64)
    if not weight.any():  # nothing but links
        weight = np.array([0 if x is None else len(x.text) for x in lines], np.int64)
    total = np.concatenate((np.zeros(WINDOW, np.int64), np.cumsum(weight), np.full(WINDOW - 1, weight.sum())))
    block = total[WINDOW:] - total[:-WINDOW]  # the window that ends at each line, and those that end behind the last
    reach = np.lib.stride_tricks.sliding_window_view(block, WINDOW).max(axis=1)  # the largest window a line is in
    surge = min(SURGE, block.max() / 2)
    up = np.concatenate(([False], reach >= max(1.0, DIVE * surge), [False]))
    begin, end = np.flatnonzero(up[1:] & ~up[:-1]), np.flatnonzero(up[:-1] & ~up[1:])
    inside = np.zeros(len(lines), bool)
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        inside[a:b] = reach[a:b].max() >= surge
    return inside & (weight > 0), surge


def heaviest(page: Page, run: np.ndarray, surge: float) -> set[int]:
    """The deepest container with nearly all text of the runs, their titles too, and all containers inside it."""
    own, titles = [0] * len(page.parent), [0] * len(page.parent)
    for x, inside in zip(page.lines, run.tolist(), strict=True):
        if inside:
            own[x.owner] += max(x.weight(), 1)
            titles[x.owner] += x.title
    below, heavy = own.copy(), [_ROOT] * len(own)
    for c in range(len(own) - 1, _ROOT, -1):
        up = page.parent[c]
        below[up] += below[c]
        titles[up] += titles[c]
        if heavy[up] == _ROOT or below[c] >= below[heavy[up]]:
            heavy[up] = c
    best = _ROOT
    while (c := heavy[best]) != _ROOT and own[best] < surge and below[c] >= NESTED * below[best]:
        if titles[c] < titles[best]:
            break
        best = c
    within = {best}
    for c in range(best + 1, len(own)):
        if page.parent[c] in within:
            within.add(c)
    return within


def joined(page: Page, at: list[int], run: np.ndarray, article: bool) -> list[str]:
    """Lines of the runs among ``at``, and of the stretches between them that are not blocks of links."""
    lines = page.lines
    inside = [i for i in at if run[i]]
    first, last = (inside[0], inside[-1]) if inside and not article else (-1, len(lines))
    texts = {page.block[lines[i].owner] for i in inside} | (page.articles if article else set())
    kept: list[str] = []
    stretch: list[Line] = []

    def close() -> None:
        block = page.block[stretch[0].owner]
        linked = 2 * sum(x.links for x in stretch) > sum(len(x.text) for x in stretch)
        if not linked or block in texts and (article or len(stretch) < WINDOW):
            kept.extend(x.text for x in stretch)
        stretch.clear()

    for i in at:
        x = lines[i]
        if stretch and (run[i] or page.block[x.owner] != page.block[stretch[0].owner]):
            close()
        if run[i]:
            kept.append(x.text)
        elif first < i < last:
            stretch.append(x)
    if stretch:
        close()
    return kept


def held(page: Page) -> frozenset[int]:
    """Where forms, and elements without their end tag, begin that hold nearly all text of the page."""
    rest = sum(x.weight() for x in page.lines if x is not None)
    return frozenset(
        d.start
        for d in page.dropped
        if d.blocks and (d.name == "form" or not d.closed) and d.weight >= max(SURGE, HOLDS * rest)
    )


def main_text(page: str) -> str:
    """The article's blocks, joined by a newline each; empty if the page has none."""
    found, kept = lines_of(page), frozenset()
    while more := held(found) - kept:
        kept |= more
        found = lines_of(page, kept)
    lines = [i for i, x in enumerate(found.lines) if x is not None]
    if not lines:
        return ""
    run, surge = candidates(found.lines)
    scope = max(found.lines[i].scope for i in lines)
    if scope:
        at = [i for i in lines if found.lines[i].scope == scope]
    else:
        within = heaviest(found, run, surge)
        at = [i for i in lines if found.lines[i].owner in within]
    return "\n".join(joined(found, at, run, scope == _ARTICLE))


def extract(pages: DataFrame) -> DataFrame:
    """Main text and its length for each page; all columns may be missing.

    A missing or empty html, and one without article text, gives an empty text. Repeated
    rows and ids give one row each. Columns beyond ``page_id``, ``url`` and ``html`` are
    ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )

    def texts(part: pa.RecordBatch) -> dict:
        found = [main_text(h) for h in part.column("html").to_pylist()]
        ids = {c: part.column(c) for c in ("page_id", "url")}
        return ids | {"text": found, "n_chars": [len(t) for t in found]}

    return map_slices(rows, texts, TEXTS, "html")
