"""Main-text extraction from HTML by a minimum cut over a page's text blocks.

1. A scanner cuts a page into blocks at block-level tags and keeps the tree of elements around them.
2. A logistic classifier, fitted on labelled pages made from a seed (``page_templates``), gives every block its
   log-odds of being content.  What an element's name or class words say is evidence of a few nats and no veto;
   it is discounted where the element holds most of the page's plain text, or is marked as an article as well.
3. Log-odds become terminal capacities.  Neighbours in page order and siblings are linked by smoothness
   capacities, the log-odds of equal labels at their distance in the tree, measured on the same labelled pages.
4. The maximum flow's cut labels the blocks with the least total cost.

Defined results: a null or empty page has no text, nor has one without content; white space inside a block
becomes one space; blocks keep page order; nothing is shortened.  Ties of the cut are content.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm import page_templates
from loomfield.llm.common import frugal, pieces, utf8

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements whose content isn't text of the page.
_SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select option textarea button datalist".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_ENDS = {t: re.compile(f"</{t}", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Kinds of evidence by class word; a word may end in more letters.
_KINDS = {
    "nav": "nav navbar navig menu breadcrumb paginat pager toolbar skip toc",
    "head": "header masthead topbar",
    "foot": "foot footer copyright colophon legal disclaimer",
    "side": "sidebar side aside widget related recommend share sharing social",
    "ad": "ad ads advert sponsor promo banner",
    "notice": "cookie consent gdpr notice alert popup modal overlay",
    "comments": "comment disqus reply replies respond discussion",
    "form": "search login signup newsletter subscri",
    "here": "article content main post entry story prose",
}
_SHORT = frozenset("ad ads side head foot nav skip toc".split())
_PARTS = re.compile(r"[a-z]+")
_ELEMENTS = {"nav": "nav", "menu": "nav", "footer": "foot", "aside": "side", "form": "form", "dialog": "notice", "header": "head"}
_ROLES = {"navigation": "nav", "menu": "nav", "menubar": "nav", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alert": "notice"}
_AWAY = ("nav", "head", "foot", "side", "ad", "notice", "comments", "form", "hidden")
_FEATURES = ("bias", "length", "links", "sentence", "commas", "paragraph", "heading", "item", "cell", "title", "article", "main", "here", *(f"{k}_name" for k in ("nav", "foot", "side", "form", "notice", "head")), *(f"{k}_word" for k in _AWAY))
_AT = {name: k for k, name in enumerate(_FEATURES)}
#: Labelled pages of the fit, its seed, and the ridge that keeps weights at some nats.
FIT_PAGES, FIT_SEED, RIDGE = 1200, 20_240, 1.0
#: Capacities are whole numbers: so many to a nat.
SCALE = 1000
_FAR = 8


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    depth: int
    names: frozenset[str]  # evidence by element name or role
    words: frozenset[str]  # evidence by class words
    plain: int = 0  # code points of unlinked text below
    heads: bool = False  # holds an h1
    evidence: dict[str, float] = field(default_factory=dict)


@dataclass(slots=True)
class Block:
    own: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@lru_cache(4096)
def kinds_of(value: str) -> frozenset[str]:
    """Kinds of evidence in a class or id."""
    found = set()
    for part in _PARTS.findall(value.lower()):
        for kind, words in _KINDS.items():
            if any(part == w if w in _SHORT else part.startswith(w) for w in words.split()):
                found.add(kind)
    return frozenset(found)


def scan(html: str) -> tuple[list[Block], list[Element]]:
    """Blocks with text, in page order, and the tree's elements, parents first."""
    elements = [Element("", -1, 0, frozenset(), frozenset())]
    stack: list[int] = [0]
    blocks: list[Block] = []
    state: dict = {"block": None, "silent": 0, "link": 0}
    at = 0

    def put(text: str) -> None:
        if state["silent"] or not text:
            return
        block = state["block"]
        if block is None:
            block = state["block"] = Block(stack[-1])
            blocks.append(block)
        block.parts.append(text)
        if state["link"]:
            block.linked += len(text.strip())

    def close(k: int) -> None:
        for e in stack[k:]:
            state["silent"] -= elements[e].tag in _SILENT
            state["link"] -= elements[e].tag == "a"
        del stack[k:]

    while at < len(html):
        m = _TAG.search(html, at)
        if not m:
            put(html[at:])
            break
        put(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attributes = m[1] if m[2] else m[4], (m[3] if m[2] else m[6]) or ""
        if tag in _BLOCK:
            state["block"] = None
        elif tag == "br":
            put(" ")
        if ending:
            k = next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == tag), None)
            if k is not None:
                # an inline end tag never closes blocks around it
                if tag in _BLOCK or tag in _SILENT or not any(elements[e].tag in _BLOCK for e in stack[k:]):
                    close(k)
                else:
                    state["silent"] -= tag in _SILENT
                    state["link"] -= tag == "a"
                    del stack[k]
            continue
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _BLOCK:
            ends = _CLOSES.get(tag, set())
            for k in range(len(stack) - 1, 0, -1):
                t = elements[stack[k]].tag
                if t == "p" or t in ends:
                    close(k)
                    break
                if t in _BLOCK:
                    break
        names, words = set(), set()
        if tag in _ELEMENTS:
            names.add(_ELEMENTS[tag])
        elif tag in ("article", "main"):
            names.add(tag)
        for name, value in _NAMED.findall(attributes) if attributes and tag not in ("html", "body") else ():
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                words |= kinds_of(value)
            elif name == "role" and (role := _ROLES.get(value.lower(), value.lower())) in (*_AWAY, "main", "article"):
                names.add(role)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                words.add("hidden")
        elements.append(Element(tag, stack[-1], elements[stack[-1]].depth + 1, frozenset(names), frozenset(words)))
        stack.append(len(elements) - 1)
        state["silent"] += tag in _SILENT
        state["link"] += tag == "a"
        if tag in _RAW:
            end = _ENDS[tag].search(html, at)
            at = end.start() if end else len(html)
    for block in blocks:
        block.text = " ".join(unescape("".join(block.parts)).split())
    return [b for b in blocks if b.text], elements


def gather(blocks: list[Block], elements: list[Element]) -> None:
    """Sums of text up the tree, then the evidence of elements down it; linear in the page."""
    for e in elements:
        e.plain = 0
    for b in blocks:
        elements[b.own].plain += max(0, len(b.text) - b.linked)
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        up.plain += e.plain
        up.heads |= e.heads or e.tag == "h1"
    whole = max(1, elements[0].plain)
    for e in elements[1:]:
        up = elements[e.parent].evidence
        if not e.names and not e.words:
            e.evidence = up
            continue
        e.evidence = own = dict(up)
        share = e.plain / whole
        # an element that holds the title and most of the text, or is marked as the article too, isn't boilerplate by its name
        main = e.heads and share > 0.5 or share > 0.9
        article, away = bool(e.names & {"article", "main"}) or "here" in e.words, 0.0
        for kind in e.names:
            if kind in ("article", "main"):
                own[kind] = 1.0
                continue
            # a form around the title or half of a page's text is the page's own
            weight = 0.0 if main or kind == "head" and "article" in up or kind == "form" and (e.heads or share > 0.5) else 1.0
            own[f"{kind}_name"], away = max(own.get(f"{kind}_name", 0.0), weight), max(away, weight)
        for kind in e.words:
            if kind == "here":
                own["here"] = 1.0
                continue
            weight = 1.0 if kind == "hidden" else 0.0 if main or article and kind != "comments" else 1.0 if kind == "comments" else 1 - share
            own[f"{kind}_word"], away = max(own.get(f"{kind}_word", 0.0), weight), max(away, weight)
        # the innermost mark counts: what an article holds as something else is less of an article
        for kind in ("article", "main", "here"):
            if kind in own:
                own[kind] *= 1 - away


def features(blocks: list[Block], elements: list[Element]) -> np.ndarray:
    gather(blocks, elements)
    x = np.zeros((len(blocks), len(_FEATURES)))
    for k, b in enumerate(blocks):
        n, tags, at = len(b.text), set(), b.own
        while at > 0 and len(tags) < 4:  # the elements next to the text
            tags.add(elements[at].tag)
            if elements[at].tag in _BLOCK:
                break
            at = elements[at].parent
        row = x[k]
        row[_AT["bias"]] = 1
        row[_AT["length"]] = math.log1p(min(n, 1000)) / 3
        row[_AT["links"]] = min(b.linked, n) / n
        row[_AT["sentence"]] = b.text[-1] in ".!?…:;\"”»)"
        row[_AT["commas"]] = min(b.text.count(","), 3) / 3
        row[_AT["paragraph"]] = bool(tags & {"p", "blockquote", "pre", "figcaption"})
        row[_AT["heading"]] = bool(tags & _HEADINGS)
        row[_AT["title"]] = "h1" in tags
        row[_AT["item"]] = bool(tags & {"li", "dd", "dt"})
        row[_AT["cell"]] = bool(tags & {"td", "th"})
        for kind, weight in elements[b.own].evidence.items():
            if kind in _AT:
                row[_AT[kind]] = weight
    return x


def neighbours(blocks: list[Block], elements: list[Element]) -> list[tuple[int, int, int]]:
    """(block, block, kind): neighbours in page order and the next block of one parent.

    The kind is the distance in the tree up to a bound, and whether an element with a mark of its own lies between.
    """
    out, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            x, y, far, crossed = blocks[k - 1].own, b.own, 0, False
            while x != y:
                if elements[x].depth < elements[y].depth:
                    x, y = y, x
                crossed |= bool(elements[x].names or elements[x].words)
                x, far = elements[x].parent, far + 1
            out.append((k - 1, k, min(far, _FAR) + (_FAR + 1) * crossed))
        own = elements[b.own]
        if own.parent in last and not own.names and not own.words:
            j = last[own.parent]
            if j != k - 1:
                out.append((j, k, 2 * _FAR + 2))
        last[own.parent] = k
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by feature, in nats
    links: np.ndarray  # by kind of neighbours, in nats

    def capacities(self, blocks: list[Block], elements: list[Element]) -> tuple[list[int], list[tuple[int, int, int]]]:
        """Whole-number scores, above zero for content, and weighted links."""
        scores = np.rint(features(blocks, elements) @ self.weights * SCALE).astype(int).tolist() if blocks else []
        link = np.rint(self.links * SCALE).astype(int).tolist()
        return scores, [(a, b, link[kind]) for a, b, kind in neighbours(blocks, elements) if link[kind]]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Ridge-penalised maximum likelihood by Newton's method."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled(pages: list[tuple[str, list[tuple[str, bool]]]]) -> list[tuple[list[Block], list[Element], np.ndarray]]:
    """Scanned pages whose blocks are those they were made of, with their labels."""
    out = []
    for html, said in pages:
        blocks, elements = scan(html)
        if [b.text for b in blocks] == [t for t, _ in said]:
            out.append((blocks, elements, np.asarray([x for _, x in said], bool)))
    return out


@cache
def fitted() -> Model:
    """The classifier and the links' weights; a function of the constants above alone."""
    known = labelled(page_templates.pages(FIT_PAGES, FIT_SEED))
    x, y = np.concatenate([features(b, e) for b, e, _ in known]), np.concatenate([z for _, _, z in known])
    equal = np.ones((2 * _FAR + 3, 2))
    for blocks, elements, z in known:
        for a, b, kind in neighbours(blocks, elements):
            equal[kind, int(z[a] == z[b])] += 1
    # two links meet in most blocks, so each has half of the evidence
    return Model(logistic(x, y), np.maximum(0, np.log(equal[:, 1] / equal[:, 0]) / 2))


def minimum_cut(scores: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Labels x that minimise sum of |score| over wrong signs plus sum of weights over links whose ends differ.

    Nodes whose score outweighs all their links keep their sign in every optimum, so they are settled first
    and their links move to their neighbours' scores; the maximum flow decides the rest.  Ties are content.
    """
    n = len(scores)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, w in links:
        near[a].append((b, w))
        near[b].append((a, w))
    s, free = list(scores), [sum(w for _, w in x) for x in near]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if label[k] is None and abs(s[k]) > free[k]:
            label[k] = s[k] > 0
            for j, w in near[k]:
                if label[j] is None:
                    s[j] += w if label[k] else -w
                    free[j] -= w
                    todo.append(j)
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        away = _sink_side(rest, s, {k: [(j, w) for j, w in near[k] if label[j] is None] for k in rest})
        for k in rest:
            label[k] = k not in away
    return [bool(x) for x in label]


def _sink_side(nodes: list[int], s: list[int], near: dict[int, list[tuple[int, int]]]) -> set[int]:
    """The nodes that can reach the sink in the residual graph of a maximum flow, by blocking flows over levels.

    Positive scores are capacities from the source, negative ones to the sink, links run both ways.
    """
    flow: dict[int, dict[int, int]] = {k: {} for k in nodes}
    for k in nodes:
        for j, w in near[k]:
            flow[k][j] = flow[k].get(j, 0) + w
    supply, demand = {k: s[k] for k in nodes if s[k] > 0}, {k: -s[k] for k in nodes if s[k] < 0}
    while True:
        level, queue, reached = {k: 0 for k in supply}, deque(supply), False
        while queue:
            k = queue.popleft()
            reached |= k in demand
            for j, w in flow[k].items():
                if w > 0 and j not in level:
                    level[j] = level[k] + 1
                    queue.append(j)
        if not reached:
            break
        turn = {k: iter(list(flow[k])) for k in level}
        for source in list(supply):
            path = [source]
            while path and source in supply:
                k = path[-1]
                if k in demand:
                    push = min(supply[source], demand[k], *(flow[a][b] for a, b in zip(path, path[1:], strict=False)))
                    for a, b in zip(path, path[1:], strict=False):
                        flow[a][b] -= push
                        flow[b][a] = flow[b].get(a, 0) + push
                    for table, end in ((supply, source), (demand, k)):
                        table[end] -= push
                        if not table[end]:
                            del table[end]
                    # back to where there is room yet
                    cut = next((i for i, (a, b) in enumerate(zip(path, path[1:], strict=False)) if not flow[a][b]), len(path) - 1)
                    del path[cut + 1 :]
                    continue
                for j in turn[k]:
                    if flow[k].get(j, 0) > 0 and level.get(j, -1) == level[k] + 1:
                        turn[k] = iter([j, *turn[k]])  # the link may have room left
                        path.append(j)
                        break
                else:
                    path.pop()
                    if path:
                        next(turn[path[-1]], None)
    sink, queue = set(demand), deque(demand)
    while queue:
        k = queue.popleft()
        for j in flow[k]:
            if j not in sink and flow[j].get(k, 0) > 0:
                sink.add(j)
                queue.append(j)
    return sink


def main_text(html: str, model: Model | None = None) -> str:
    blocks, elements = scan(html)
    labels = minimum_cut(*(model or fitted()).capacities(blocks, elements))
    return "\n".join(b.text for b, x in zip(blocks, labels, strict=True) if x)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` and each page's main text."""
    slim = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("__html"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("text", T.StringType(), False)])
    model = fitted()  # once, on the driver; some hundred bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, batch.num_columns - 1):
                texts = [main_text(x.decode(), model) if x else "" for x in utf8(part.column(part.num_columns - 1))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return slim.mapInArrow(frugal(run), schema)
