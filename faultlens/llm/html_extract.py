"""Main text of web pages by minimum cuts.

A page is cut into blocks of text, in page order. What is known of a block by itself (its ancestors'
tags, classes and roles, its length, sentences and links) gives a cost for each of the labels content and
boilerplate; the costs are the capacities to the two terminals of a graph. Edges between neighbours in
the page, weaker the further apart they are in the DOM, and between blocks that follow each other within
the same container make cuts through what belongs together costly. The minimum cut, found by maximum flow, labels all
blocks at once.

What is in an element that is no article by its tag or by a word of its class, id or role (a menu, a
sidebar, a form, reader comments) has an infinite capacity to boilerplate, whatever is around that
element, and no edges: it says nothing of what comes next. Of a header within an article only the
headings stay. Words of html, body and elements that wrap the page, and what follows has-, with-, no-,
without-, category- or tag- in a name, aren't held against their text; nor is a form that wraps the page.
If a cut leaves nothing, the page may be short: what isn't excluded is labelled again without the cost
of being short.

Scripts, styles, the head and comments of the markup are no text. Inline tags don't end a block, a
<br> is white space in it. Character references are decoded, white space inside a block becomes one
space, blocks are joined by one newline.

Defined results: a null, empty or textless page has an empty text; broken and cut-off markup is read as
far as it goes; rows that repeat give repeated results; a null page_id or url is passed on; extra
columns are ignored; an empty table gives no rows. A block whose labels cost the same is
boilerplate. A very long page is one task's work, linear in its length but for the flow.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?][^>]*>|<[/!?a-zA-Z][^>]*+\Z|[^<]+|<""", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "iframe", "object", "math")}
_NAMED = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")
#: A class that tells what is elsewhere: what follows is no word of the element itself.
_LACKS = re.compile(r"(?:^|[^a-z])(?:has|with|no|without|category|cat|tag|topic)[^a-z].*")

#: HTML's void and block-level elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
INLINE = frozenset("a abbr b em i small span strong sub sup u".split())
#: Elements that end an open element of the given names.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements, and words of a class, id or role, that are no part of an article.
OUTSIDE = frozenset("nav footer aside form button select textarea dialog menu label head title".split())
WORDS_OUTSIDE = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu menubar sidebar sidenav aside rail footer masthead topbar comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup signin login popup modal overlay breadcrumb breadcrumbs pagination pager copyright legal disclaimer widget toolbar search complementary contentinfo hidden".split())
#: Evidence for content.
TAG_FOR = {"article": 4, "main": 3, "p": 0.5, "blockquote": 0.5}
WORD_FOR = {"main": 2, "article": 3, "content": 2, "post": 2, "entry": 2, "story": 2, "body": 1}
MOST_FOR = 8.0
#: Evidence of the ancestors that shows an article.
IN_ARTICLE = 2.0
SMOOTH, SAME_CONTAINER = 1.2, 0.6
#: Words of running text outside an element that show that it isn't the whole page's wrapper.
PROSE = 15


class Outside:
    """An element that speaks against its text, unless it turns out to wrap the page. It knows the one around it, so that a chain costs nothing more a level."""

    __slots__ = ("above", "blocked", "held", "leads", "spared", "tag")

    def __init__(self, tag: str, above: Outside | None) -> None:
        self.tag, self.above = tag, above
        self.leads = False  # it holds a <main> or <h1>
        self.held = 0  # text that may be content
        self.spared = False
        self.blocked = True  # it or one around it isn't spared


@dataclass
class Block:
    text: str
    prior: float  # evidence of the ancestors for content
    linked: int
    heading: bool
    depth: int
    gap: int  # depth of the lowest common ancestor with the block before
    parent: int
    outside: Outside | None  # the innermost
    never: bool  # it can be no content

    @property
    def excluded(self) -> bool:
        return self.never or self.outside is not None and self.outside.blocked


@dataclass(frozen=True)
class Within:
    """What is known of an open element and its ancestors."""

    tag: str = ""
    prior: float = 0.0
    number: int = 0
    outside: Outside | None = None
    never: bool = False
    header: bool = False  # of an article: only headings stay
    mute: bool = False  # an inline element that is no part of the block around it
    block: int = 0  # where in the stack the innermost block-level element is


def _words(attrs: str, whole: bool) -> tuple[float, bool, bool, bool]:
    """(evidence for content, a word against it, a word for a header, hidden) of an element's attributes.

    With ``whole`` only a class, id or role as a whole speaks against the element, not a part of it (as in ``ad-free``).
    """
    good, against, header, hidden = 0.0, False, False, False
    for m in _NAMED.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id", "role"):
            words = {w for name in value.split() for w in _PART.findall(_LACKS.sub("", name))}
            against |= not (set(value.split()) if whole else words).isdisjoint(WORDS_OUTSIDE)
            header |= "header" in words
            good += sum(WORD_FOR.get(w, 0) for w in words)
        else:
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
    return good, against, header, hidden


def blocks(page: str) -> tuple[list[Block], list[Outside]]:
    """The page's blocks, and the elements that speak against theirs, each after the one around it."""
    out: list[Block] = []
    against_: list[Outside] = []
    stack = [Within()]
    open_: dict[str, int] = {}
    text: list[str] = []
    linked, anchors, number, least, heading = 0, 0, 0, 0, False

    def end_block() -> None:
        nonlocal linked, least
        joined = " ".join("".join(text).split())
        if joined:
            depth = len(stack) - 1
            k = stack[-1].block
            at, inner = stack[k], stack[-1]
            out.append(Block(joined, at.prior, min(linked, len(joined)), heading, depth, min(least, depth), stack[max(0, k - 1)].number, inner.outside, inner.never or inner.header and not heading))
            least = depth
        text.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal anchors, least
        while len(stack) > to:
            tag = stack.pop().tag
            open_[tag] -= 1
            anchors -= tag == "a"
        least = min(least, len(stack) - 1)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            t = m[0]
            if (t[0] != "<" or t == "<") and not stack[-1].mute:
                t = html.unescape(t) if "&" in t else t
                text.append(t)
                if anchors:
                    linked += len(t.strip())
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                end_block()
                heading = False
            if open_.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop(k)
            continue
        if tag in _RAW:
            if not m[3].endswith("/"):
                close = _RAW[tag].search(page, at)
                at = close.end() if close else end
            continue
        if tag in BLOCK:
            end_block()
            heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
            closes = CLOSES.get(tag, ()) if tag in CLOSES else ("p",)
            if stack[stack[-1].block].tag in closes:
                pop(stack[-1].block)
        elif tag == "br" or tag == "hr":
            text.append(" ")
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "body" and open_.get("head"):  # a head that was never closed
            k = next(i for i, s in enumerate(stack) if s.tag == "head")
            pop(k)
        number += 1
        above = stack[-1]
        good, against, of_header, hidden = _words(m[3], tag in ("article", "main")) if m[3] else (0.0, False, False, False)
        if above.outside and (tag == "main" or tag == "h1"):
            above.outside.leads = True
        inside = bool(open_.get("article") or open_.get("main"))
        header = above.header or (tag == "header" or of_header) and (inside or good > 0)
        never = above.never or hidden or tag in OUTSIDE and tag != "form" or tag == "header" and not header
        # words of html and body are about the page, not about a part of it
        named = tag == "form" or tag not in ("html", "body") and (against or of_header and not header)
        mute = above.mute or tag in INLINE and (named or hidden)
        outside = above.outside
        if named:
            outside = Outside(tag, outside)
            against_.append(outside)
        stack.append(Within(tag, min(MOST_FOR, above.prior + TAG_FOR.get(tag, 0.0) + good), number, outside, never, header, mute, len(stack) if tag in BLOCK else above.block))
        open_[tag] = open_.get(tag, 0) + 1
        anchors += tag == "a"
    end_block()
    return out, against_


def costs(b: Block, short: float = 1.0) -> tuple[float, float]:
    """(cost of labelling it boilerplate, cost of labelling it content); ``short`` is the cost of having no words."""
    if b.excluded:
        return (0.0, math.inf)
    evidence = _evidence(b, short)
    return (max(0.0, evidence), max(0.0, -evidence))


def _evidence(b: Block, short: float = 1.0) -> float:
    words = b.text.count(" ") + 1
    evidence = b.prior
    evidence += min(2.5, math.log2(1 + words / 8)) - short
    evidence += 0.5 if b.text[-1] in ".!?…\"”" and words > 3 else 0.0
    evidence -= 3.0 * b.linked / len(b.text)
    return evidence + (1.0 if b.heading else 0.0)


def spare_wrappers(found: list[Block], against: list[Outside]) -> None:
    """Spares elements that wrap the page.

    A wrapper holds most of the page's text, and also its <main> or <h1>, or all of its running text with no
    article beside it: a list of comments longer than the article is none. An <article> with an <h1>
    needs no such share, a form without <main> or <h1> is none. Elements with most of the text lie in each other; they
    are decided from the outermost on. Linear in blocks and elements.
    """
    known = [b for b in found if not b.never]
    size = sum(len(b.text) for b in known)
    for b in known:
        if b.outside:
            b.outside.held += len(b.text)
    for x in reversed(against):
        if x.above:
            x.above.held += x.held
            x.above.leads |= x.leads
    chain = [x for x in against if x.held and 2 * x.held > size]
    level = {x: i for i, x in enumerate(chain)}
    for x in against:
        x.spared = x.leads and x.held > 0 and (x in level or x.tag in ("article", "main"))
    # how many of the chain an element lies in, and whether one apart from the chain is against it
    inside: dict[Outside, tuple[int, bool]] = {}
    for x in against:
        n, apart = inside[x.above] if x.above else (0, False)
        inside[x] = (n + 1, apart) if x in level else (n, apart or not x.spared)
    prose, articles = [0] * (len(chain) + 1), [False] * (len(chain) + 1)
    for b in known:
        n, apart = inside[b.outside] if b.outside else (0, False)
        articles[n] |= b.prior >= IN_ARTICLE
        if not apart and not b.heading and _evidence(b) > 0:
            prose[n] += b.text.count(" ") + 1
    others, beside, open_ = 0, False, True
    for i, x in enumerate(chain):  # beside it is what lies in fewer of the chain
        others += prose[i] if open_ else 0
        beside |= articles[i]
        if not x.leads and x.tag != "form":
            x.spared = others < PROSE and not beside
        open_ &= x.spared
    for x in against:
        x.blocked = not x.spared or x.above is not None and x.above.blocked


def min_cut(keep: list[float], drop: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: True keeps. Edges cost their weight if cut. By Dinic's maximum flow."""
    n = len(keep)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        if keep[i] > drop[i]:
            arc(source, i, keep[i] - drop[i], 0.0)
        elif drop[i] > keep[i]:
            arc(i, sink, drop[i] - keep[i], 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue and level[sink] < 0:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                at = to[path[k] ^ 1]
                del path[k:]
                continue
            moved = False
            while tried[at] < len(out[at]):
                e = out[at][tried[at]]
                if room[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    path.append(e)
                    at = to[e]
                    moved = True
                    break
                tried[at] += 1
            if moved:
                continue
            if at == source:
                break
            e = path.pop()
            at = to[e ^ 1]
            tried[at] += 1


def main_text(page: str | None) -> str:
    found, against = blocks(page) if page else ([], [])
    if not found:
        return ""
    spare_wrappers(found, against)
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.excluded:
            continue
        if i and not found[i - 1].excluded:
            apart = (found[i - 1].depth - b.gap) + (b.depth - b.gap)
            edges.append((i - 1, i, SMOOTH / (1 + max(0, apart))))
        if b.parent in last:
            edges.append((last[b.parent], i, SAME_CONTAINER))
        last[b.parent] = i
    kept: list[bool] = []
    for short in (1.0, 0.0):
        both = [costs(b, short) for b in found]
        kept = min_cut([c[0] for c in both], [c[1] for c in both], edges)
        if any(kept):
            break
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, text, n_chars. No shuffle: a page is read by itself."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
