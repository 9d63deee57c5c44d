"""Main text of web pages by minimum cut.

A page becomes a chain of text blocks. A linear classifier over tags, names
and text gives each block a cost of being called boilerplate and one of being
called content: the capacities to the two terminals. Neighbouring blocks, and
blocks under one parent, are tied by smoothness edges, the stronger the nearer
they are in the tree. The minimum cut labels all blocks of a page together.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import byte_slices, inner_id, outer_id

SLICE_CHARS = 4_000_000
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: What no silent element holds: if its end tag comes later, it was left open. Some can't hold one of their own either.
_CONTENT = re.compile(r"<(?:article|main|h1)\b|</(?:article|main|body)\b", re.I)
_LEFT_OPEN = {t: re.compile(rf"{_CONTENT.pattern}|<{t}\b", re.I) for t in ("button", "select", "noscript", "iframe")}

# Element names of HTML by their part in a page.
_RAW = frozenset("script style textarea title".split())  # markup inside is text: without an end they run to the page's end
_SILENT = _RAW | frozenset("noscript template iframe object svg canvas audio video select button annotation".split())
_MATH = frozenset("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var br img wbr input".split()) | _MATH
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
           "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_AWAY = frozenset("nav footer aside form menu dialog head fieldset".split())
_AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager "
    "pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription tags teaser toc toolbar topbar widget widgets".split())
# Of these, the ones that also name a frame around everything, or say what a page has.
_FRAME_NAMES = frozenset("banner footer header menu nav promo recommended related share sharing sidebar social tag tags teaser toc toolbar topbar "
                         "widget widgets".split())
# What follows one of these in a name is about the page, not what the element is.
_ABOUT = frozenset("has hide hides no non not show shows with without".split())
_TEXT_NAMES = frozenset("article articlebody content entry main post story text".split())
_ENDS = frozenset(".!?…\"'”»")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Weights of the classifier, in units of capacity.
AWAY, HEADER, HOME, TEXT_NAME = -60, -40, 40, 15
PARAGRAPH, TITLE, HEADING, LINKED, SENTENCE, LONGEST = 10, 15, 8, -40, 5, 15
#: Smoothness: neighbours under one parent, near in the tree, anywhere; next block under the same parent further on.
SIBLINGS, NEAR, FAR, SAME_PARENT = 12, 6, 2, 6


class _Element:
    __slots__ = ("tag", "parent", "depth", "evidence", "framed", "inside", "linked", "says")

    def __init__(self, tag: str, attributes: str, parent: _Element | None):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.inside = (parent.inside if parent else False) or tag in ("article", "main")
        self.linked = (parent.linked if parent else False) or tag == "a"
        self.framed = False
        own = self._own(attributes)
        # The nearest element that says anything decides: a reader comment in an article, an article in a frame of menus.
        self.evidence = own if own is not None else parent.evidence if parent else 0
        self.says = self if own is not None or parent is None else parent.says

    def _own(self, attributes: str) -> int | None:
        tag = self.tag
        found = {k.lower(): html.unescape(a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        if found and tag not in ("html", "body"):
            names = set()
            for name in (found.get("class", "") + " " + found.get("id", "")).split():
                parts = re.split(r"[^a-z]+", name)
                names.update(parts[:next((i for i, x in enumerate(parts) if x in _ABOUT), len(parts))])
            names |= {n[:-1] for n in names if n.endswith("s")}
            if tag in ("article", "main"):
                names -= {"sidebar", "header", "footer", "nav", "menu", "widget", "social", "share", "tag", "tags", "banner", "toc"}
            away = names & _AWAY_NAMES
            if found.get("role") in _AWAY_ROLES or found.get("aria-hidden") == "true" or re.search(
                    r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
                return AWAY
            if away and tag not in _HEADINGS:
                # A header inside the article holds its title; its heading still counts as content.
                self.framed = away <= _FRAME_NAMES and tag not in _AWAY
                return HEADER // 8 if away == {"header"} and self.inside else AWAY
            if found.get("role") == "main":
                return HOME
            if names & _TEXT_NAMES and tag not in _AWAY:
                return HOME if tag in ("article", "main") else max(TEXT_NAME, self.parent.evidence if self.parent else 0)
        if re.search(r"\bhidden\b(?!\s*=\s*.?false)", re.sub(r"""=\s*("[^"]*"|'[^']*')""", "", attributes)):
            return AWAY
        if tag in _AWAY:
            return AWAY
        if tag == "header":
            return HEADER // 8 if self.inside else HEADER
        return HOME if tag in ("article", "main") else None


def blocks(page: str) -> list[tuple[str, _Element, float]]:
    """Text blocks in page order: text, element, share of linked characters."""
    out: list[tuple[str, _Element, float]] = []
    top = _Element("html", "", None)
    stack, pieces, linked, at = [top], [], 0, 0
    owner = top

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip(" ")
            if text:
                out.append((text, owner, min(1.0, linked / len(text))))
            pieces, linked = [], 0

    def close(names: tuple[str, ...] | list[str], fences) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in fences:
                return

    def say(raw: str) -> None:
        nonlocal linked, owner
        text = html.unescape(raw) if "&" in raw else raw
        if not pieces:
            if not _SPACE.sub("", text):
                return
            owner = next(e for e in reversed(stack) if e.tag not in _INLINE)
        pieces.append(text)
        if stack[-1].linked:
            linked += len(text.strip())

    def after_silent(tag: str, at: int) -> int:
        """Where the page goes on: behind the end tag, or, if the element was left open, behind its own text."""
        end = ends.get(tag)
        if end is None or end[0] < at:
            m = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            end = ends[tag] = m.span() if m else (length, length)
        if tag in _RAW:
            return end[1]
        if end[0] < length and not (_LEFT_OPEN.get(tag) or _CONTENT).search(page, at, end[0]):
            return end[1]
        more = page.find("<", at)
        return more if more >= 0 else length

    length, ends = len(page), {}
    while at < length:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i]
                        break
                    if stack[i].tag not in _INLINE:
                        break
                continue
            flush()
            close((tag,), ())
            continue
        if tag in _SILENT:
            if not m[3].endswith("/"):
                at = after_silent(tag, at)
            continue
        if tag in _INLINE:
            if tag == "br":
                if pieces:
                    pieces.append(" ")
            elif tag not in _VOID:
                stack.append(_Element(tag, m[3], stack[-1]))
            continue
        flush()
        if tag in _VOID:
            continue
        close(("p",), [e.tag for e in stack if e.tag not in _INLINE and e.tag != "p"])
        if tag in _CLOSES:
            names, fences = _CLOSES[tag]
            for _ in names.split():
                close(names.split(), fences)
        while stack[-1].tag in _INLINE:  # a block ends inline elements that were left open
            stack.pop()
        if tag not in ("html", "body"):
            stack.append(_Element(tag, m[3], stack[-1]))
    flush()
    return out


def score(text: str, element: _Element, linked: float) -> int:
    """Classifier: above 0 content is likelier."""
    tag = element.tag
    s = element.evidence + min(len(text) // 20, LONGEST) + round(LINKED * linked if linked > 0.3 else 0)
    if text[-1] in _ENDS:
        s += SENTENCE
    if element.evidence > AWAY:
        s += (TITLE + HOME * element.inside) if tag == "h1" else HEADING if tag in _HEADINGS else PARAGRAPH if tag in ("p", "blockquote", "pre") else 0
    return s


def _tie(a: _Element, b: _Element) -> int:
    if a is b or a.parent is b.parent:
        return SIBLINGS
    x, y, steps = a, b, 0
    while x is not y and steps <= 3:
        if x.depth >= y.depth and x.parent:
            x = x.parent
        elif y.parent:
            y = y.parent
        steps += 1
    return NEAR if x is y else FAR


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay on the content side of a minimum cut: cutting a node
    off its likelier side costs |score|, separating an edge its capacity. Nodes
    that may go either way count as content. Augmenting paths from one node
    after the other, to the nearest node with room; a part without a way out is
    never entered again, so on the chain of a page the work stays local."""
    n = len(scores)
    left, near = list(scores), [[] for _ in range(n)]
    cap: list[int] = []
    for a, b, c in edges:
        near[a].append((b, len(cap)))
        near[b].append((a, len(cap) + 1))
        cap += [c, c]
    closed = [False] * n  # no way leads from here to a node with room, nor ever will
    for start in range(n):
        while left[start] > 0 and not closed[start]:
            came: dict[int, tuple[int, int] | None] = {start: None}
            queue, end = deque([start]), -1
            while queue and end < 0:
                a = queue.popleft()
                for b, e in near[a]:
                    if cap[e] and b not in came and not closed[b]:
                        came[b] = (a, e)
                        if left[b] < 0:
                            end = b
                            break
                        queue.append(b)
            if end < 0:
                for a in came:
                    closed[a] = True
                break
            path, at = [], end
            while came[at] is not None:
                path.append(came[at][1])
                at = came[at][0]
            flow = min(left[start], -left[end], *(cap[e] for e in path))
            left[start] -= flow
            left[end] += flow
            for e in path:
                cap[e] -= flow
                cap[e ^ 1] += flow
    lost = [x < 0 for x in left]
    queue = deque(i for i in range(n) if lost[i])
    while queue:
        b = queue.popleft()
        for a, e in near[b]:
            if cap[e ^ 1] and not lost[a]:
                lost[a] = True
                queue.append(a)
    return [not x for x in lost]


def _unframe(found: list[tuple[str, _Element, float]]) -> None:
    """On a page where nothing else speaks for content, the element that holds
    most of the sentences is no sidebar, whatever its class is called."""
    if any(element.evidence > 0 for _, element, _ in found):
        return
    prose: dict[int, float] = {}
    for text, element, linked in found:
        if text[-1] in _ENDS:
            prose[id(element.says)] = prose.get(id(element.says), 0) + len(text) * (1 - linked)
    for _, element, _ in found:
        if element.says.framed and 2 * prose.get(id(element.says), 0) > sum(prose.values()):
            element.evidence = HOME if element.inside else 0


def main_text(page: str) -> str:
    found = blocks(page)
    _unframe(found)
    edges, last = [], {}
    for i, (_, element, _) in enumerate(found):
        if i:
            edges.append((i - 1, i, _tie(found[i - 1][1], element)))
        j = last.get(id(element.parent))
        if j is not None and j < i - 1:
            edges.append((j, i, SAME_PARENT))
        last[id(element.parent)] = i
    kept = minimum_cut([score(*b) for b in found], edges)
    return "\n".join(b[0] for b, k in zip(found, kept) if k)


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in byte_slices(batch, "html", SLICE_CHARS):
            texts = [main_text(h) if h else "" for h in part["html"]]
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text
    (blocks of the article joined by newlines), n_chars.

    NULL and empty pages, and pages without an article, have an empty text.
    Pages of any length are read whole. Ties of the cut count as content.
    Rows are independent: repeated rows, NULL ids and an empty table need
    nothing special. Other columns are not looked at.
    """
    rows = pages.select(inner_id("page_id").alias("page_id"), "url", "html")
    out = rows.mapInPandas(_run, "page_id long, url string, text string, n_chars long")
    return out.withColumn("page_id", outer_id(F.col("page_id")))
