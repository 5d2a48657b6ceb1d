"""XML, RSS/Atom and JSON documents: own linear scanner without entity expansion, outlines, entries, items."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame

from loomfield.sources.rows import explode_text

MAX_CHARS, MAX_DEPTH, JSON_DEPTH, JSON_ITEMS = 8_000_000, 24, 12, 200


class FeedError(ValueError):
    pass


@dataclass
class Element:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # elements and strings

    def elements(self, name: str | None = None) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element) and name in (None, c.name)]

    def first(self, name: str) -> Element | None:
        return next(iter(self.elements(name)), None)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children).strip()


_REFERENCE = re.compile(r"&(?:#x([0-9a-fA-F]+)|#(\d+)|(lt|gt|amp|quot|apos));")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_OPEN = re.compile(r"""<([^\s/>!?]+)((?:[^"'>]|"[^"]*+"|'[^']*+')*+)>""")


def decode_xml(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            return _NAMED[m[3]]
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code <= 0x10FFFF else m[0]

    return _REFERENCE.sub(one, text) if "&" in text else text


def parse_xml(text: str, namespaces: bool = False, most: int = MAX_CHARS) -> Element:
    """The document's root; a document type is skipped and its entities stay unexpanded."""
    if len(text) > most:
        raise FeedError(f"the document has {len(text)} characters; at most {most} are read")
    short = (lambda n: n) if namespaces else (lambda n: n.rpartition(":")[2])
    at, stack, root = 0, [], None
    text = text.removeprefix("﻿")

    def fault(what: str, where: int):
        return FeedError(f"line {text.count(chr(10), 0, where) + 1}: {what}")

    while at < len(text):
        cut = text.find("<", at)
        words = text[at : cut if cut >= 0 else len(text)]
        if words.strip() and not stack:
            raise fault("text outside the root element", at)
        if words and stack:
            stack[-1].children.append(decode_xml(words))
        if cut < 0:
            break
        if text.startswith("<!--", cut):
            end, skip = text.find("-->", cut), 3
        elif text.startswith("<![CDATA[", cut):
            end, skip = text.find("]]>", cut), 3
            if end >= 0 and stack:
                stack[-1].children.append(text[cut + 9 : end])
        elif text.startswith("<?", cut):
            end, skip = text.find("?>", cut), 2
        elif text.startswith("<!", cut):
            depth, end = 0, -1
            for m in re.finditer(r"""[\[\]>]|"[^"]*"|'[^']*'""", text[cut:]):
                depth += (m[0] == "[") - (m[0] == "]")
                if m[0] == ">" and depth <= 0:
                    end = cut + m.start()
                    break
            skip = 1
        elif text.startswith("</", cut):
            end, skip = text.find(">", cut), 1
            if end >= 0:
                name = short(text[cut + 2 : end].strip())
                if not stack or stack[-1].name != name:
                    raise fault(f"</{name}> closes {f'<{stack[-1].name}>' if stack else 'nothing'}", cut)
                stack.pop()
        else:
            m = _OPEN.match(text, cut)
            if not m:
                raise fault("a tag isn't complete", cut)
            end, skip = m.end() - 1, 1
            inside = m[2].rstrip()
            alone = inside.endswith("/") or m[1].endswith("/")
            element = Element(short(m[1].rstrip("/")), {short(k): decode_xml(a or b) for k, a, b in _ATTRIBUTE.findall(inside) if namespaces or not k.startswith("xmlns")})
            if stack:
                stack[-1].children.append(element)
            elif root is not None:
                raise fault("a second root element", cut)
            else:
                root = element
            if not alone:
                stack.append(element)
        if end < 0:
            raise fault("a construct isn't closed", cut)
        at = end + skip
    if stack:
        raise fault(f"<{stack[-1].name}> isn't closed", len(text))
    if root is None:
        raise FeedError("line 1: no element")
    return root


def select(root: Element, path: str) -> list[Element]:
    """Elements by a slash path from the root's name, with ``*``, or by ``//name`` anywhere."""
    if path.startswith("//"):
        first, *rest = path[2:].split("/")
        found, todo = [], [root]
        while todo:
            e = todo.pop(0)
            found += [e] if first in ("*", e.name) else []
            todo[:0] = e.elements()
    else:
        first, *rest = path.strip("/").split("/")
        found = [root] if first in ("*", root.name) else []
    for step in rest:
        found = [c for e in found for c in e.elements(None if step == "*" else step)]
    return found


def tidy(text: str) -> str:
    lines = [re.sub(r"[ \t\f\v ]+", " ", x).strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def plain(text: str) -> str:
    """Markup inside a value becomes text."""
    if not re.search(r"</?[a-zA-Z][^>]*>", text):
        return tidy(text)
    text = re.sub(r"<(?:br|/?p|/?div|/?li|/?ul|/?ol|/?h[1-6]|/?tr)\b[^>]*>", "\n", text, flags=re.I)
    return tidy(unescape(re.sub(r"<[^>]+>", " ", text)))


def put(lines: list[str], depth: int, key: str, value: str, mark: str = ":") -> None:
    pad = "  " * depth
    if "\n" in value:
        lines.append(f"{pad}{key}{mark}")
        lines += [f"{pad}  {x}" for x in value.split("\n")]
    else:
        lines.append(f"{pad}{key}{mark} {value}".rstrip())


def outline(element: Element, depth: int = 0, most: int = MAX_DEPTH) -> str:
    lines: list[str] = []

    def tell(e: Element, d: int) -> None:
        inner = e.elements()
        own = plain("".join(c for c in e.children if isinstance(c, str)))
        if d >= most or not inner:
            put(lines, d, e.name, plain(e.text()))
        else:
            put(lines, d, e.name, own)
        for k, v in e.attributes.items():
            put(lines, d + 1, f"@{k}", v)
        if d < most:
            for c in inner:
                tell(c, d + 1)

    tell(element, depth)
    return "\n".join(lines)


def entries(text: str) -> Iterator[dict]:
    """Entries of an RSS 2.0, RSS 1.0 or Atom document."""
    root = parse_xml(text)
    channel = root.first("channel")
    if root.name == "feed":
        found = root.elements("entry")
    elif root.name in ("rss", "RDF"):
        found = [*(channel.elements("item") if channel else []), *root.elements("item")]
    else:
        raise FeedError(f"<{root.name}> is no feed")

    def of(e: Element, *names: str) -> str | None:
        return next((t for n in names if (c := e.first(n)) is not None and (t := c.text())), None)

    for n, e in enumerate(found, 1):
        if root.name == "feed":
            links = e.elements("link")
            link = next((x.attributes.get("href") for x in links if x.attributes.get("rel", "alternate") == "alternate"), None) or (links[0].attributes.get("href") if links else None)
            author = ", ".join(t for a in e.elements("author") if (t := of(a, "name") or a.text())) or None
            categories = [c.attributes.get("term") or c.text() for c in e.elements("category")]
            content = of(e, "content", "summary")
        else:
            enclosure = e.first("enclosure")
            link = of(e, "link") or (enclosure.attributes.get("url") if enclosure else None)
            author, categories, content = of(e, "creator", "author"), [c.text() for c in e.elements("category")], of(e, "encoded", "description")
        yield {"number": n, "title": plain(of(e, "title") or "") or None, "link": link, "published": of(e, "pubDate", "published", "updated", "date"), "author": author, "id": of(e, "guid", "id"), "categories": [c for c in categories if c], "content": plain(content) if content else None}


ENTRY = "number int, title string, link string, published string, author string, id string, categories array<string>, content string, text string"


def entry_text(e: dict) -> str:
    head = [("Title", e["title"]), ("Link", e["link"]), ("Published", e["published"]), ("Author", e["author"]), ("Categories", ", ".join(e["categories"]))]
    return "\n".join([*(f"{k}: {v}" for k, v in head if v), *([f"\n{e['content']}"] if e["content"] else [])]).strip()


def read_feeds(rows: DataFrame, key: str, xml: str) -> DataFrame:
    return explode_text(rows, key, xml, lambda t: (e | {"text": entry_text(e)} for e in entries(t)), ENTRY)


def read_xml_items(rows: DataFrame, key: str, xml: str, path: str, label: str = "Item") -> DataFrame:
    """(key, pos, label, text, error): an outline for each selected element; none selected is an error."""

    def kernel(text: str) -> Iterator[dict]:
        found = select(parse_xml(text), path)
        if not found:
            raise FeedError(f"nothing matches {path!r}")
        yield from ({"pos": n, "label": f"{label} {n}", "text": outline(e)} for n, e in enumerate(found, 1))

    return explode_text(rows, key, xml, kernel, "pos int, label string, text string")


def json_outline(value, depth: int = JSON_DEPTH, items: int = JSON_ITEMS, omit: frozenset[str] = frozenset(), redact: Callable | None = None) -> str:
    """Indented ``key: value`` lines; lists are numbered and cut with a note; too deep values are compact JSON."""
    lines: list[str] = []

    def scalar(x) -> str:
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else tidy(x) if isinstance(x, str) else json.dumps(x)

    def tell(key: str, x, d: int, path: str, mark: str = ":") -> None:
        if redact:
            x = redact(path, x)
        if isinstance(x, (dict, list)) and x and d < depth:
            lines.append("  " * d + f"{key}{mark}")
            walk(x, d + 1, path)
        else:
            put(lines, d, key, json.dumps(x, ensure_ascii=False, separators=(",", ":")) if isinstance(x, (dict, list)) else scalar(x), mark)

    def walk(x, d: int, path: str) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                if k not in omit:
                    tell(k, v, d, f"{path}.{k}" if path else k)
        else:
            for n, v in enumerate(x[:items]):
                tell(f"{n + 1}", v, d, f"{path}[{n}]", ".")
            if len(x) > items:
                lines.append("  " * d + f"({len(x) - items} more)")

    if isinstance(value, (dict, list)):
        walk(value, 0, "")
        return "\n".join(lines)
    return scalar(value)


def at_path(value, path: str):
    """The value at a path of dots and brackets, or None."""
    for step in re.findall(r"[^.\[\]]+|\[\d+\]", path):
        if step[0] == "[":
            k = int(step[1:-1])
            value = value[k] if isinstance(value, list) and k < len(value) else None
        else:
            value = value.get(step) if isinstance(value, dict) else None
        if value is None:
            return None
    return value


def read_json_items(rows: DataFrame, key: str, column: str, path: str, label: str = "Item", **options) -> DataFrame:
    """(key, pos, label, text, error): an outline for each element of the list at ``path``."""

    def kernel(text: str) -> Iterator[dict]:
        value = json.loads(text)
        found = at_path(value, path) if path else value
        if not isinstance(found, list):
            raise FeedError(f"no list at {path!r}")
        yield from ({"pos": n, "label": f"{label} {n}", "text": json_outline(x, **options)} for n, x in enumerate(found, 1))

    return explode_text(rows, key, column, kernel, "pos int, label string, text string")


def read_json(rows: DataFrame, key: str, column: str, **options) -> DataFrame:
    return explode_text(rows, key, column, lambda t: [{"text": json_outline(json.loads(t), **options)}], "text string")
