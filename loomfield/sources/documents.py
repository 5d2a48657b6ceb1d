"""Office documents (DOCX, ODT) as text and sections, page layouts from positioned runs, page selection."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from loomfield.sources.feeds import Element, FeedError, parse_xml
from loomfield.sources.rows import explode_text

PAGE_LIMIT_LABEL = 60


class DocumentError(ValueError):
    """``code`` is not-a-document, encrypted, unsupported or malformed."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class Block:
    kind: str  # heading, paragraph, item, table
    text: str = ""
    level: int = 0
    ordered: bool = False
    rows: list[list[str]] = field(default_factory=list)


def open_package(data: bytes) -> zipfile.ZipFile:
    if data[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
        raise DocumentError("encrypted", "an OLE container holds encrypted or old documents")
    if data[:5] == b"{\\rtf":
        raise DocumentError("unsupported", "rich text")
    if data[:4] != b"PK\x03\x04":
        raise DocumentError("not-a-document", "no zip archive")
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise DocumentError("malformed", str(e)) from None
    if any(i.flag_bits & 1 for i in package.infolist()):
        raise DocumentError("encrypted", "entries are encrypted")
    return package


def _part(package: zipfile.ZipFile, name: str) -> Element | None:
    if name not in package.namelist():
        return None
    try:
        return parse_xml(package.read(name).decode("utf-8"))
    except (FeedError, UnicodeDecodeError) as e:
        raise DocumentError("malformed", f"{name}: {e}") from None


def _walk(element: Element) -> Iterator[Element]:
    for c in element.elements():
        yield c
        yield from _walk(c)


def _value(element: Element | None, *path: str) -> str | None:
    for name in path:
        element = element.first(name) if element is not None else None
    return element.attributes.get("val", "") if element is not None else None


def squeeze(text: str) -> str:
    lines = [re.sub(r"[ \t\f\v ]+", " ", x).strip() for x in text.split("\n")]
    return re.sub(r"\n{2,}", "\n", "\n".join(lines)).strip()


class _Word:
    """WordprocessingML to blocks; tracked changes are read as accepted."""

    def __init__(self, package: zipfile.ZipFile, main: str):
        folder = main.rpartition("/")[0]
        near = lambda name: _part(package, f"{folder}/{name}" if folder else name)
        self.body = next(iter(_part(package, main).elements("body")), None)
        if self.body is None:
            raise DocumentError("malformed", "no body")
        self.styles = {s.attributes.get("styleId", ""): s for s in (near("styles.xml") or Element("none")).elements("style")}
        self.formats, self.notes = self._numbering(near("numbering.xml")), {}
        for name, tag in (("footnotes.xml", "footnote"), ("endnotes.xml", "endnote")):
            for n in (near(name) or Element("none")).elements(tag):
                if n.attributes.get("type") not in ("separator", "continuationSeparator"):
                    self.notes[tag, n.attributes.get("id")] = n
        self.cited: dict[tuple, int] = {}

    def _numbering(self, part: Element | None) -> dict[str, dict[int, str]]:
        if part is None:
            return {}
        kinds = {a.attributes.get("abstractNumId"): {int(v.attributes.get("ilvl", 0)): _value(v, "numFmt") or "" for v in a.elements("lvl")} for a in part.elements("abstractNum")}
        return {n.attributes.get("numId", ""): kinds.get(_value(n, "abstractNumId"), {}) for n in part.elements("num")}

    def _style(self, name: str | None) -> tuple[int | None, str | None, int]:
        """(heading level, list, list level) by the style's name or outline, else that of the one it is based on."""
        seen = set()
        while name and name not in seen and name in self.styles:
            seen.add(name)
            style = self.styles[name]
            title, outline = (_value(style, "name") or "").lower(), _value(style, "pPr", "outlineLvl")
            if title in ("title", "subtitle"):
                return 1, None, 0
            if m := re.fullmatch(r"heading (\d)", title):
                return int(m[1]), None, 0
            if outline is not None and outline.isdigit() and int(outline) < 9:
                return int(outline) + 1, None, 0
            if (number := _value(style, "pPr", "numPr", "numId")) is not None:
                return None, number, int(_value(style, "pPr", "numPr", "ilvl") or 0)
            name = _value(style, "basedOn")
        return None, None, 0

    def inline(self, element: Element) -> str:
        out = []
        for c in element.elements():
            if c.name in ("del", "moveFrom", "pPr", "rPr", "instrText", "delText", "Fallback"):
                continue
            if c.name == "t":
                out.append("".join(x for x in c.children if isinstance(x, str)))
            elif c.name in ("br", "cr"):
                out.append("\n")
            elif c.name == "tab":
                out.append("\t")
            elif c.name == "noBreakHyphen":
                out.append("-")
            elif c.name in ("footnoteReference", "endnoteReference"):
                key = (c.name.removesuffix("Reference"), c.attributes.get("id"))
                if key in self.notes:
                    out.append(f"[^{self.cited.setdefault(key, len(self.cited) + 1)}]")
            elif c.name == "docPr" and c.attributes.get("descr"):
                out.append(f"[image: {c.attributes['descr']}]")
            else:
                out.append(self.inline(c))
        return "".join(out)

    def blocks(self, parent: Element) -> Iterator[Block]:
        for c in parent.elements():
            if c.name == "p":
                text = squeeze(self.inline(c))
                properties = c.first("pPr")
                level, number, depth = self._style(_value(properties, "pStyle"))
                if (_value(properties, "pStyle") or "").upper().startswith("TOC"):
                    continue
                outline = _value(properties, "outlineLvl")
                if outline is not None and outline.isdigit() and int(outline) < 9:
                    level = int(outline) + 1
                own = _value(properties, "numPr", "numId")
                if own is not None:
                    number, depth = own, int(_value(properties, "numPr", "ilvl") or 0)
                if not text:
                    continue
                if level:
                    yield Block("heading", text, level)
                elif number and number != "0":
                    yield Block("item", text, depth, self.formats.get(number, {}).get(depth, "bullet") not in ("bullet", "none", ""))
                else:
                    yield Block("paragraph", text)
            elif c.name == "tbl":
                rows = []
                for r in c.elements("tr"):
                    cells = []
                    for cell in r.elements("tc"):
                        merged = cell.first("tcPr") is not None and cell.first("tcPr").first("vMerge") is not None and _value(cell, "tcPr", "vMerge") in ("", "continue")
                        text = "" if merged else " ".join(b.text for b in self.blocks(cell) if b.text)
                        cells += [text, *[""] * (int(_value(cell, "tcPr", "gridSpan") or 1) - 1)]
                    rows.append(cells)
                yield Block("table", rows=rows)
            elif c.name in ("sdt", "sdtContent", "ins", "moveTo", "smartTag", "customXml", "AlternateContent", "Choice"):
                yield from self.blocks(c)

    def read(self) -> tuple[list[Block], list[str]]:
        found = list(self.blocks(self.body))
        notes = [f"[^{n}]: {squeeze(' '.join(self.inline(p) for p in self.notes[key].elements('p')))}" for key, n in list(self.cited.items())]
        return found, notes


def _open_text(package: zipfile.ZipFile) -> tuple[list[Block], list[str]]:
    root = _part(package, "content.xml")
    body = next((e for e in _walk(root) if e.name == "text" and e.elements()), None) if root else None
    if body is None:
        raise DocumentError("malformed", "no text body")
    notes: list[str] = []

    def inline(e: Element) -> str:
        out = []
        for c in e.children:
            if isinstance(c, str):
                out.append(re.sub(r"\s+", " ", c))
            elif c.name == "s":
                out.append(" " * int(c.attributes.get("c", 1)))
            elif c.name == "tab":
                out.append("\t")
            elif c.name == "line-break":
                out.append("\n")
            elif c.name == "note":
                notes.append(f"[^{len(notes) + 1}]: {squeeze(c.first('note-body').text() if c.first('note-body') else '')}")
                out.append(f"[^{len(notes)}]")
            elif c.name not in ("annotation", "tracked-changes"):
                out.append(inline(c))
        return "".join(out)

    def blocks(parent: Element, depth: int = -1) -> Iterator[Block]:
        for c in parent.elements():
            if c.name == "h":
                yield Block("heading", squeeze(inline(c)), int(c.attributes.get("outline-level", 1)))
            elif c.name == "p":
                if text := squeeze(inline(c)):
                    yield Block("item", text, depth) if depth >= 0 else Block("paragraph", text)
            elif c.name == "list":
                for item in c.elements("list-item"):
                    yield from blocks(item, depth + 1)
            elif c.name == "table":
                yield Block("table", rows=[[" ".join(b.text for b in blocks(cell)) for cell in r.elements() if cell.name.endswith("table-cell")] for r in _walk(c) if r.name == "table-row"])
            elif c.name in ("section", "text-box", "frame"):
                yield from blocks(c, depth)

    return list(blocks(body)), notes


def parse_document(data: bytes) -> tuple[list[Block], list[str], dict[str, str]]:
    """(blocks, notes, metadata) of a DOCX or ODT file."""
    package = open_package(data)
    names = package.namelist()
    if "content.xml" in names:
        found, notes = _open_text(package)
        meta = _part(package, "meta.xml")
        fields = {"title": "title", "creator": "author", "creation-date": "created", "date": "modified"}
    else:
        rels = _part(package, "_rels/.rels")
        main = next((r.attributes.get("Target", "").lstrip("/") for r in (rels.elements() if rels else ()) if r.attributes.get("Type", "").endswith("/officeDocument")), "word/document.xml")
        if main not in names:
            raise DocumentError("not-a-document", "no main part")
        found, notes = _Word(package, main).read()
        meta = _part(package, "docProps/core.xml")
        fields = {"title": "title", "creator": "author", "created": "created", "modified": "modified"}
    told: dict[str, str] = {}
    for e in _walk(meta) if meta else ():
        if e.name in fields and e.text():
            told.setdefault(fields[e.name], e.text())
    return found, notes, told


def render_blocks(blocks: list[Block]) -> str:
    """``#`` headings, bulleted and numbered items by level, piped tables, blank lines around headings and tables."""
    out: list[str] = []
    counters: dict[int, int] = {}
    for b in blocks:
        if b.kind == "item":
            counters = {k: v for k, v in counters.items() if k <= b.level}
            counters[b.level] = counters.get(b.level, 0) + 1
            out.append("  " * b.level + (f"{counters[b.level]}. " if b.ordered else "- ") + b.text.replace("\n", " "))
            continue
        counters = {}
        if b.kind == "heading":
            out += ["", "#" * min(6, b.level) + " " + b.text.replace("\n", " "), ""]
        elif b.kind == "table":
            width = max(map(len, b.rows), default=0)
            lines = ["| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in [*r, *[""] * (width - len(r))]) + " |" for r in b.rows]
            out += ["", *lines[:1], *(["|" + " --- |" * width] if lines else []), *lines[1:], ""]
        else:
            out.append(b.text)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def document_text(data: bytes) -> str:
    blocks, notes, meta = parse_document(data)
    parts = []
    if meta:
        parts.append("Document metadata:\n" + "\n".join(f"{k}: {v}" for k, v in meta.items()))
    if text := render_blocks(blocks):
        parts.append("Document text:\n" + text)
    if notes:
        parts.append("Footnotes:\n" + "\n".join(notes))
    return "\n\n".join(parts)


def sections(data: bytes, label: str = "Document") -> Iterator[dict]:
    """What stands before the first heading of the highest level, then a section for each such heading."""
    blocks, _, _ = parse_document(data)
    top = min((b.level for b in blocks if b.kind == "heading"), default=None)
    parts: list[tuple[str, list[Block]]] = [(label, [])]
    seen: dict[str, int] = {}
    for b in blocks:
        if b.kind == "heading" and b.level == top:
            name = b.text.replace("\n", " ")
            name = f"{label} — {name if len(name) <= PAGE_LIMIT_LABEL else name[: PAGE_LIMIT_LABEL - 1] + '…'}"
            seen[name] = seen.get(name, 0) + 1
            parts.append((name if seen[name] == 1 else f"{name} ({seen[name]})", []))
        parts[-1][1].append(b)
    yield from ({"pos": n, "label": name, "text": text} for n, (name, own) in enumerate(parts) if (text := render_blocks(own)))


def read_documents(rows: DataFrame, key: str, content: str) -> DataFrame:
    return explode_text(rows, key, content, lambda data: [{"text": document_text(bytes(data))}], "text string")


def read_sections(rows: DataFrame, key: str, content: str, label: str = "Document") -> DataFrame:
    return explode_text(rows, key, content, lambda data: sections(bytes(data), label), "pos int, label string, text string")


def layout(runs: list[tuple[str, float, float, float, float]]) -> str:
    """Text of positioned runs (text, x, y, width, size): lines by baseline from the top, gaps as spaces, wide line gaps as blank lines."""
    lines: list[tuple[float, float, list]] = []
    for run in runs:
        text, _, y, _, size = run
        if not text.strip():
            continue
        own = next((line for line in lines if abs(line[0] - y) <= 0.5 * max(size, line[1])), None)
        if own:
            own[2].append(run)
        else:
            lines.append((y, size, [run]))
    out: list[str] = []
    before: tuple[float, float] | None = None
    for y, size, own in sorted(lines, key=lambda x: -x[0]):
        if before and before[0] - y > 1.6 * max(size, before[1]):
            out.append("")
        pieces, end = [], None
        for text, x, _, width, em in sorted(own, key=lambda r: r[1]):
            if end is not None:
                gap = (x - end) / (em or 1)
                pieces.append("  " if gap > 1.5 else " " if gap > 0.2 and not pieces[-1].endswith(" ") and not text.startswith(" ") else "")
            pieces.append(text)
            end = x + width
        out.append("".join(pieces).rstrip())
        before = (y, size)
    return "\n".join(out)


def select_pages(count: int, pages: list[int] | tuple[int, int] | None = None, most: int | None = None) -> list[int]:
    """Page numbers from a list, or from an inclusive range given as a pair in a tuple; in order, each once."""
    if pages is None:
        wanted = range(1, count + 1)
    elif isinstance(pages, tuple):
        wanted = range(max(1, pages[0]), min(count, pages[1]) + 1)
    else:
        wanted = sorted({p for p in pages if 1 <= p <= count})
    return list(wanted)[:most]
