"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each with its root-to-leaf tag path. Text length and punctuation are summed per
path and divided by its blocks, smoothed over the page's order, fused by their product and held against a threshold; the
blocks of the paths above it are content. Class names and forms are a weak feature: they scale a path's fused ratio down, unless they stand
around the content itself. Headings, short paragraphs and lists of the article have low ratios of their own: in the smallest container that holds nearly
all content, or in article and main elements that hold some, they belong to it unless they are links or marked.

Tokens and the element tree are made in one pass; work is linear in the page, also for markup that is left open or nested without end.

Defined results: null and empty html, and pages of markup alone, give an empty text; repeated rows are extracted
each; unclosed and misnested markup is read as browsers do (a tag cut off by the page's end is dropped); pages of any length are read whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import released

#: Elements by their part in a page.
RAW = frozenset("script style noscript template svg math iframe object textarea title canvas video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split()
)
#: An opened element closes an open one of these, unless one of the second stands between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
FURNITURE_TAGS = frozenset("nav aside footer form head button select dialog menu fieldset".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login menu navbar navigation nav breadcrumb breadcrumbs sidebar side rail widget widgets related recommended recommendations "
    "comment comments respond disqus reply replies share sharing social footer footnav masthead toolbar pagination pager skip tags toc disclaimer paywall teaser teasers trending "
    "popular search complementary contentinfo navigation".split()
)
#: Beside these, other parts of a class or id don't change what it marks: site-footer, comments-area.
SHAPES = frozenset("site page main post area box block list section container wrapper wrap left right top bottom primary secondary buttons links items item bar inner posts text".split())
#: Elements that may stand around a whole page, so they are judged like marks by class.
AROUND = frozenset(("form", "fieldset"))
CONTENT_TAGS = frozenset(("article", "main"))
CONTAINERS = frozenset("article main section div body td center html blockquote figure".split())
PUNCTUATION = re.compile(r"[.,;:!?，。、；：！？…·¡¿]")
#: A tag; quotes count only after an equals sign. Possessive, so it never looks at a place twice.
TAG = re.compile(r"<(/?)([a-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>", re.I)
LOOSE_TAG = re.compile(r"<(/?)([a-z][^\s/>]*+)([^>]*+)>", re.I)
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?=[\s>=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: A path is content if its fused ratio reaches this share of the page's highest; marks scale a ratio by that much.
THRESHOLD, MARKED = 0.12, 0.02
#: The article's container holds this share of the content's characters.
HELD = 0.85
#: Weights of a block and its neighbours on either side.
KERNEL = (0.25, 0.5, 0.25)
#: Elements nested deeper are siblings at this depth, as in browsers.
DEPTH = 512


class Block(NamedTuple):
    text: str
    linked: int
    node: int


class Page:
    """The element tree in page order (a parent's number is below its children's) and the blocks of text."""

    def __init__(self):
        self.names, self.parents, self.paths = [""], [-1], [0]
        self.vetoed, self.marked = [False], [False]
        #: The nearest marked element and the outermost article or main at or around each, or -1.
        self.under, self.content = [-1], [-1]
        self.numbers: dict[tuple[int, str, str], int] = {}
        self.blocks: list[Block] = []

    def add(self, parent: int, name: str, mark: str, vetoed: bool, marked: bool) -> int:
        k = len(self.names)
        self.names.append(name)
        self.parents.append(parent)
        self.paths.append(self.numbers.setdefault((self.paths[parent], name, mark), len(self.numbers) + 1))
        self.vetoed.append(vetoed or self.vetoed[parent])
        self.marked.append(marked)
        self.under.append(k if marked else self.under[parent])
        self.content.append(self.content[parent] if self.content[parent] >= 0 else k if name in CONTENT_TAGS else -1)
        return k

    def sums(self, values: dict[int, int]) -> list[int]:
        """Values of elements, each with all below it."""
        found = [0] * len(self.names)
        for k, v in values.items():
            found[k] = v
        for k in range(len(found) - 1, 0, -1):
            found[self.parents[k]] += found[k]
        return found


def _marks(attributes: str) -> list[str]:
    return [x for m in MARKS.finditer(attributes) for x in re.split(r"[^a-z]+", next(g for g in m.groups() if g is not None).lower()) if x]


def _is_furniture(attributes: str) -> bool:
    """Whether a whole word of class, id or role marks page furniture: all its parts do, but for shapes."""
    for m in MARKS.finditer(attributes):
        for token in next(g for g in m.groups() if g is not None).lower().split():
            parts = [x for x in re.split(r"[^a-z]+", token) if len(x) > 1 and x not in SHAPES]
            if parts and all(x in FURNITURE_WORDS for x in parts):
                return True
    return False


def tokens(html: str):
    """(text, closes, name, attributes) in order: a text, or a tag with its name in lower case."""
    at, tag = 0, TAG
    while (lt := html.find("<", at)) >= 0:
        if lt > at:
            yield html[at:lt], False, "", ""
        after = html[lt + 1 : lt + 3]
        if not re.match("/?[a-zA-Z]", after):
            if after[:1] not in ("!", "?", "/"):
                yield "<", False, "", ""
                at = lt + 1
                continue
            comment = html.startswith("<!--", lt) and not html.startswith(("<!-->", "<!--->"), lt)
            end = html.find("-->" if comment else ">", lt + 4 * comment)
            if end < 0:
                return
            at = end + (3 if comment else 1)
            continue
        m = tag.match(html, lt)
        if not m:  # a quote is left open to the end: from here on quotes are nothing
            tag = LOOSE_TAG
            if not (m := tag.match(html, lt)):
                return
        at, name = m.end(), m[2].lower()
        if name in RAW and not m[1] and not (name in ("svg", "math") and m[3].endswith("/")):
            if not (end := ENDS[name].search(html, at)):
                return
            close = html.find(">", end.end())
            if close < 0:
                return
            at = close + 1
            continue
        yield "", bool(m[1]), name, m[3]
    if at < len(html):
        yield html[at:], False, "", ""


def parse(html: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = []  # open block elements; those beyond DEPTH share a parent
    places: dict[str, list[int]] = {}  # of open elements by name
    parts: list[str] = []
    linked = links = 0
    hidden = ""  # the inline element whose text isn't shown

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                page.blocks.append(Block(text, min(linked, len(text)), stack[-1][1] if stack else 0))
        linked = 0

    def close(k):
        nonlocal links, hidden
        flush()
        while len(stack) > k:
            places[stack.pop()[0]].pop()
        links, hidden = 0, ""

    def last(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    for text, closes, name, attributes in tokens(html):
        if not name:
            if not hidden:
                parts.append(unescape(text))
                if links:
                    linked += len(parts[-1].strip())
        elif name == "br":
            parts.append(" ")
        elif closes:
            if name in INLINE:
                links -= name == "a" and links > 0
                hidden = "" if name == hidden else hidden
            elif places.get(name):
                close(places[name][-1])
            elif name == "p":
                flush()
        elif name in VOID:
            if name == "hr":
                flush()
        elif name in INLINE:
            links += name == "a"
            if not hidden and attributes and HIDDEN.search(attributes):
                hidden = name
        else:
            flush()
            links, hidden = 0, ""
            if name in CLOSES_PARAGRAPH and stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            if name in SIBLINGS:
                ends, stops = SIBLINGS[name]
                stop = last(stops)
                while (k := last(ends)) > stop:
                    close(k)
                    if name != "tr":
                        break
            parent = stack[min(len(stack), DEPTH) - 1][1] if stack else 0
            has = "=" in attributes
            marks = _marks(attributes) if has else []
            vetoed = (name in FURNITURE_TAGS and name not in AROUND) or (name == "header" and page.content[parent] < 0) or bool(attributes and HIDDEN.search(attributes))
            marked = name in AROUND or (has and name not in CONTENT_TAGS and name not in ("body", "html") and _is_furniture(attributes))
            places.setdefault(name, []).append(len(stack))
            stack.append((name, page.add(parent, name, marks[0] if marks else "", vetoed, marked)))
    flush()
    return page


def _smooth(values: list[float]) -> list[float]:
    n = len(values)
    return [sum(w * values[min(max(i + k - 1, 0), n - 1)] for k, w in enumerate(KERNEL)) for i in range(n)]


def content_paths(paths: list[int], texts: list[str], linked: list[int], weights: list[float]) -> set[int]:
    """The paths whose smoothed and fused ratios of text and punctuation are high enough, given the blocks in order and what each one's ratio is scaled by."""
    sums: dict[int, list[float]] = {}
    for path, text, n, w in zip(paths, texts, linked, weights, strict=True):
        s = sums.setdefault(path, [0, 0.0, 0.0])
        s[0] += 1
        if w:
            s[1] += len(text) - n
            s[2] += len(PUNCTUATION.findall(text)) * (1 - n / len(text))
    text = _smooth([sums[p][1] / sums[p][0] for p in paths])
    marks = _smooth([sums[p][2] / sums[p][0] for p in paths])
    fused: dict[int, float] = {}
    for path, t, m, w in zip(paths, text, marks, weights, strict=True):
        if w:
            fused[path] = fused.get(path, 0.0) + w * (t * (1 + m)) ** 0.5 / sums[path][0]
    top = max(fused.values(), default=0.0)
    return {path for path, value in fused.items() if value > 0 and value >= THRESHOLD * top}


def selected(page: Page, weights: list[float]) -> set[int]:
    return content_paths([page.paths[b.node] for b in page.blocks], [b.text for b in page.blocks], [b.linked for b in page.blocks], weights)


def _own(page: Page, content: list[Block], weigh=lambda b: len(b.text) - b.linked) -> dict[int, int]:
    found: dict[int, int] = {}
    for b in content:
        found[b.node] = found.get(b.node, 0) + weigh(b)
    return found


def around(page: Page) -> set[int]:
    """Marked elements that stand around the page's main article, or around all content but stray text: their marks say nothing."""
    paths = selected(page, [0.0 if page.vetoed[b.node] else 1.0 for b in page.blocks])
    content = [b for b in page.blocks if page.paths[b.node] in paths and not page.vetoed[b.node]]
    own = _own(page, content)
    weight = page.sums(own)
    free: set[int] = set()
    holds = [0] * len(page.names)  # whether a main article lies below
    for k in range(len(holds) - 1, 0, -1):
        if holds[k] or (page.names[k] in CONTENT_TAGS and weight[k] >= 0.5 * weight[0] and own):
            holds[page.parents[k]] = 1
    bare: dict[int, int] = {}  # content by the nearest marked element
    inside: set[int] = set()  # marked elements with content in an article that is not marked further
    for b in content:
        k = page.under[b.node]
        bare[k] = bare.get(k, 0) + len(b.text) - b.linked
        if page.content[b.node] >= 0:
            inside.add(k)
    below: dict[int, list[int]] = {}
    for k in range(1, len(page.names)):
        if page.marked[k]:
            below.setdefault(page.under[page.parents[k]], []).append(k)
    seen, done, queue, opened = 0, False, [], [-1]
    while True:
        while opened:  # what is not marked, or marked in vain
            k = opened.pop()
            seen += bare.get(k, 0)
            done = done or k in inside
            for x in below.get(k, ()):
                if holds[x]:
                    free.add(x)
                    opened.append(x)
                elif weight[x]:
                    heapq.heappush(queue, (-weight[x], x))
        if done or not queue or seen > (1 - HELD) * weight[0]:
            return free
        k = heapq.heappop(queue)[1]
        free.add(k)
        opened.append(k)


def main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by newlines."""
    page = parse(html or "")
    free = around(page) if any(page.marked) else set()
    furniture = [False] * len(page.names)
    for k in range(1, len(furniture)):
        furniture[k] = furniture[page.parents[k]] or (page.marked[k] and k not in free)
    paths = selected(page, [0.0 if page.vetoed[b.node] else MARKED if furniture[b.node] else 1.0 for b in page.blocks])
    chosen = [page.paths[b.node] in paths and not page.vetoed[b.node] for b in page.blocks]
    content = [b for b, c in zip(page.blocks, chosen, strict=True) if c]
    if not content:
        return ""
    weight = page.sums(_own(page, content))
    semantic = any(page.names[k] in CONTENT_TAGS and weight[k] >= 0.5 * weight[0] for k in range(1, len(weight)))
    box = next((k for k in range(len(weight) - 1, 0, -1) if page.names[k] in CONTAINERS and weight[k] >= HELD * weight[0]), 0)
    end = page.sums({k: 1 for k in range(len(weight))})[box] + box  # the box is the elements from its number to this
    first, kept = chosen.index(True), []
    for i, (b, c) in enumerate(zip(page.blocks, chosen, strict=True)):
        if not c and not page.vetoed[b.node] and not furniture[b.node]:
            heading = re.fullmatch("h[1-6]", page.names[b.node])
            if semantic:
                c = page.content[b.node] >= 0 and weight[page.content[b.node]] > 0
            elif box <= b.node < end:
                c = bool(heading) or b.linked < 0.5 * len(b.text)
            else:
                c = page.names[b.node] == "h1" and i < first
        if c:
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(lambda batches: released(run(batches)), f"page_id {kind}, url string, text string, n_chars bigint")
