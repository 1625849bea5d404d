"""HTML extraction by minimum cut: classifier costs at the terminals, smoothness between neighbouring blocks."""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import binary_column, trimmed

# Elements of HTML by what they do to a text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math canvas audio video textarea select button datalist title xmp noframes".split())
DROPPED = frozenset("nav footer aside form menu dialog search fieldset".split())
#: Words in class, id or role that speak against and for an element.
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sidebar menu nav navigation navbar footer masthead comment comments commentlist "
    "disqus cookie cookies consent gdpr notice notices alert promo promotion sponsor sponsored related recommended share sharing social subscribe "
    "newsletter signup breadcrumb breadcrumbs pagination pager widget popup modal overlay toolbar login copyright complementary contentinfo "
    "search form reply replies respond outbrain taboola paywall".split()
)
#: Of these, those that also speak against an article inside, and against an element that holds most of a page.
ALWAYS_AGAINST = frozenset(
    "comment comments commentlist disqus reply replies respond related recommended outbrain taboola cookie cookies consent gdpr newsletter "
    "subscribe signup share sharing social".split()
)
#: Words of class names that say what a page has or lacks beside the element: what follows them is no sign.
BESIDE = frozenset("has with without no not is show hide".split())
IN_FAVOUR = frozenset("article articlebody content post entry story main body text".split())

# The classifier: log-odds that a block is content, added up.
BIAS, IN_ARTICLE, FAVOUR, PER_LENGTH, PER_LINK = 0.3, 4.0, 0.7, 0.5, -2.5
DROP, NEGATIVE, HEADER, FEW_WORDS = -12.0, -9.0, -3.0, -0.2
# What it costs to cut between a block and the one before it, and between neighbouring blocks of one parent.
ADJACENT, SIBLING = 0.75, 1.5
#: An element with a weak sign against it that holds this share of a page's text is only a wrapper.
WRAPPER = 0.8

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_REST = re.compile(r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SIGN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS: dict[str, re.Pattern] = {}
_SIGNS: dict[tuple[str, str], tuple[float, bool]] = {}


def _sign(name: str) -> tuple[float, bool]:
    """The log-odds of one class name, id or role, and whether that is weak: a whole word is a sign; a part of a
    compound is a weak one, unless the compound says what stands beside."""
    parts = [w.lower() for w in _SIGN.findall(name)]
    told = parts[: next((i for i, w in enumerate(parts) if w in BESIDE), len(parts))]
    against = [w for w in told if w in AGAINST]
    if against:
        return NEGATIVE, len(parts) > 1 and not ALWAYS_AGAINST.intersection(against)
    return (HEADER if "header" in told else FAVOUR if IN_FAVOUR.intersection(told) else 0.0), False


def _own(tag: str, attributes: str) -> tuple[float, bool]:
    """Log-odds that an element adds to all blocks in it, and whether they are weak: void where it is only a wrapper."""
    key = (tag, attributes)
    if (found := _SIGNS.get(key)) is not None:
        return found
    score = DROP if tag in DROPPED else HEADER if tag == "header" else IN_ARTICLE if tag in ("article", "main") else 0.0
    weak = tag in ("form", "fieldset")
    if attributes and tag not in ("html", "body"):
        if _HIDDEN.search(attributes):
            score, weak = score + DROP, False
        elif tag not in ("article", "main"):
            signs = [_sign(name) for m in _ATTRIBUTE.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split()]
            worst = min((x for x, _ in signs), default=0.0)
            if worst < 0:
                weak = (weak or tag not in DROPPED) and all(w for x, w in signs if x == worst)
                score += worst
            else:
                score += max((x for x, _ in signs), default=0.0)
    if len(_SIGNS) > 20_000:
        _SIGNS.clear()
    _SIGNS[key] = (score, weak)
    return score, weak


@dataclass
class _Elements:
    """The elements with blocks of a page in page order; the first is the page itself."""

    tag: list[str] = field(default_factory=lambda: [""])
    above: list[int] = field(default_factory=lambda: [0])
    own: list[tuple[float, bool]] = field(default_factory=lambda: [(0.0, False)])
    size: list[int] = field(default_factory=lambda: [0])

    def add(self, tag: str, above: int, own: tuple[float, bool]) -> int:
        self.tag.append(tag)
        self.above.append(above)
        self.own.append(own)
        self.size.append(0)
        return len(self.tag) - 1

    def scores(self) -> list[float]:
        """Log-odds of each element with what it is in. A weak sign against a wrapper of an article, or of nearly all text, is void."""
        size, holds = self.size[:], [t in ("article", "main") for t in self.tag]
        for i in range(len(size) - 1, 0, -1):
            size[self.above[i]] += size[i]
            holds[self.above[i]] |= holds[i]
        out = [0.0] * len(size)
        for i in range(1, len(size)):
            (own, weak), above = self.own[i], out[self.above[i]]
            if own < 0 and weak and (holds[i] or size[i] >= WRAPPER * size[0]):
                own = 0.0
            if own < 0 and above > 0 and self.tag[i] != "header":
                above = 0.0  # an advert or a comment in an article
            out[i] = min(above, 0.0) + own if above < 0 and 0 < own < IN_ARTICLE else above + own
        return out


def markup(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, slash, tag, attributes) of each tag with the text before it, and of the text at the end, in linear time.

    A tag ends at the first > outside quotation marks. Where marks are never closed, it and all later ones end at the first >.
    What is no tag is text; comments, declarations and the contents of RAW elements are left out.
    """
    start = at = 0
    end, loose = len(page), False
    while (at := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), at):
            sign = "-->" if page.startswith("<!--", at) else ">"
            stop = page.find(sign, at + 2)
            if stop < 0 and sign == ">":
                break
            yield page[start:at], "", "", ""
            start = at = end if stop < 0 else stop + len(sign)
            continue
        name = _NAME.match(page, at)
        if not name:
            at += 1
            continue
        close = -1
        if not loose:
            rest = _REST.match(page, name.end())
            close = rest.end() if rest else -1
            if not rest:
                stop = page.find("<", name.end())
                own = page[name.end() : stop if stop >= 0 else end]
                loose = own.count('"') % 2 == 1 or own.count("'") % 2 == 1
        if loose:
            close = page.find(">", name.end()) + 1
            if not close:
                break
        if close < 0:
            at = name.end()
            continue
        tag, attributes = name[2].lower(), page[name.end() : close - 1]
        yield page[start:at], name[1], tag, attributes
        start = at = close
        if tag in RAW and not name[1] and not attributes.endswith("/"):
            stop = _ENDS.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)).search(page, at)
            start = at = stop.end() if stop else end
    yield page[start:], "", "", ""


def blocks(page: str) -> list[tuple[str, float, int]]:
    """(text, log-odds of being content, parent) of each block of text in page order.

    White space inside a block is one space, character references are decoded. Elements that are never closed
    end with what they are in; what isn't markup is text.
    """
    elements, found = _Elements(), []
    stack: list[int] = [0]
    opened: Counter = Counter()
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if not parts:
            return
        joined = "".join(parts)
        text = " ".join((_html.unescape(joined) if "&" in joined else joined).split())
        parts.clear()
        share, linked = linked, 0
        if text:
            elements.size[stack[-1]] += len(text)
            found.append((text, stack[-1], share))

    def push(tag: str, own: tuple[float, bool]) -> None:
        stack.append(elements.add(tag, stack[-1], own))
        opened[tag] += 1

    def pop() -> str:
        tag = elements.tag[stack.pop()]
        opened[tag] -= 1
        return tag

    for text, closing, tag, attributes in markup(page):
        if text:
            parts.append(text)
            linked += len(text) if in_link else 0
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in BLOCKS:
            flush()
            in_link = False
            if tag in VOID:
                continue
            if closing:
                while opened[tag] and pop() != tag:
                    pass
                continue
            last = elements.tag[stack[-1]]
            if last == "p" or (tag in ("li", "option", "dd", "dt", "td", "th", "tr") and last == tag):
                pop()
            push(tag, _own(tag, attributes))
        elif tag and tag not in VOID and tag not in RAW and not closing and attributes and _own(tag, attributes)[0] <= NEGATIVE:
            # an inline element that is hidden or an advert: as a block of its own
            flush()
            push(tag, _own(tag, attributes))
        elif closing and len(stack) > 1 and elements.tag[stack[-1]] == tag:
            flush()
            pop()
    flush()

    above, out = elements.scores(), []
    for text, i, share in found:
        words = text.count(" ") + 1
        score = above[i] + BIAS + PER_LENGTH * math.log1p(words / 10) + PER_LINK * min(1.0, share / len(text)) + (FEW_WORDS if words < 5 else 0.0)
        leaf = elements.tag[i] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dd", "dt")
        out.append((text, score, elements.above[i] if leaf else i))
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: least sum of capacities cut, by shortest augmenting paths (Dinic).

    A score over 0 is the capacity from the source, one under 0 that to the sink; edges work both ways. Of
    several minimum cuts it is the one with the fewest nodes on the source's side.
    """
    n = len(scores)
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, w in edges:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to += (b, a)
        room += (w, w)
    supply, demand = [max(s, 0.0) for s in scores], [max(-s, 0.0) for s in scores]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            u = queue.popleft()
            reached = reached or demand[u] > tiny
            for e in graph[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for start in range(n):
            while level[start] == 0 and supply[start] > tiny:
                path, u = [], start
                while True:
                    if demand[u] > tiny:
                        flow = min([supply[start], demand[u], *(room[e] for e in path)])
                        supply[start] -= flow
                        demand[u] -= flow
                        for e in path:
                            room[e] -= flow
                            room[e ^ 1] += flow
                        break
                    while tried[u] < len(graph[u]):
                        e = graph[u][tried[u]]
                        if room[e] > tiny and level[to[e]] == level[u] + 1:
                            break
                        tried[u] += 1
                    if tried[u] < len(graph[u]):
                        path.append(graph[u][tried[u]])
                        u = to[path[-1]]
                    elif path:
                        level[u] = -2
                        u = to[path.pop() ^ 1]
                    else:
                        level[start] = -2
                        break


def smoothness(found: list[tuple[str, float, int]]) -> list[tuple[int, int, float]]:
    """Edges between neighbouring blocks of one parent, and from any other block to the one before it."""
    edges, last = [], {}
    for i, (_, _, parent) in enumerate(found):
        before = last.get(parent)
        if before is not None:
            edges.append((before, i, SIBLING))
        if i and before != i - 1:
            edges.append((i - 1, i, ADJACENT))
        last[parent] = i
    return edges


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by two line ends; empty if there is none."""
    found = blocks(page or "")
    scores = [s for _, s, _ in found]
    if not any(s > 0 for s in scores):
        return ""
    if min(scores) <= 0:
        found = [b for b, kept in zip(found, minimum_cut(scores, smoothness(found)), strict=True) if kept]
    return "\n\n".join(text for text, _, _ in found)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of pages (page_id, url, html), in their own partitions.

    Null and empty html gives an empty text, as does a page of boilerplate alone. Bytes that aren't UTF-8 are
    replaced. Repeated rows stay, further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text((h or b"").decode("utf-8", "replace")) for h in binary_column(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
    return rows.mapInArrow(trimmed(run), f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
