"""Text of PDF pages by the standard library alone: objects, page tree, content streams, positioned runs.

Covers uncompressed and Flate streams, object streams, simple fonts, and composite fonts that bring a
ToUnicode table.  Encrypted files and other filters are errors of their own; a page without text is empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame

from loomfield.sources.documents import DocumentError, layout, select_pages
from loomfield.sources.rows import explode_text

_TOKEN = re.compile(rb"\s+|%[^\r\n]*|<<|>>|[\[\]{}]|/[^\s<>\[\](){}/%]*|<[0-9A-Fa-f\s]*>|\(|[^\s<>\[\](){}/%]+")
_REF = re.compile(r"^\d+$")


@dataclass(frozen=True)
class Ref:
    number: int


class Name(str):
    pass


class Word(str):
    """An operator or keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose bracket opens before ``at``."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            m = re.compile(rb"[0-7]{1,3}|\r\n|[\s\S]").match(data, at)
            if not m:
                break
            e, at = m[0], m.end()
            out += bytes([int(e, 8) & 255]) if e[:1].isdigit() and e[:1] < b"8" else b"" if e in (b"\r\n", b"\n", b"\r") else {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def parse(data: bytes, at: int = 0) -> Iterator[object]:
    """Values and operators of a piece of PDF syntax, nested ones as lists and dictionaries."""
    stack: list[list] = [[]]
    while at < len(data):
        m = _TOKEN.match(data, at)
        if not m:
            at += 1
            continue
        t, at = m[0], m.end()
        if t[:1].isspace() or t[:1] == b"%":
            continue
        if t in (b"<<", b"["):
            stack.append([])
            continue
        if t in (b">>", b"]"):
            if len(stack) == 1:
                continue
            inner = stack.pop()
            value: object = inner if t == b"]" else {str(k): v for k, v in zip(inner[::2], inner[1::2], strict=False)}
        elif t == b"(":
            value, at = _string(data, at)
        elif t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1]).decode()
            value = bytes.fromhex(digits + "0" * (len(digits) % 2))
        elif t[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), t[1:]).decode("latin-1"))
        else:
            text = t.decode("latin-1")
            try:
                value = int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)
            except ValueError:
                value = Word(text)
            if value == "R" and len(stack[-1]) >= 2 and all(isinstance(x, int) for x in stack[-1][-2:]):
                stack[-1].pop()
                value = Ref(stack[-1].pop())
        stack[-1].append(value)
        if len(stack) == 1 and isinstance(value, Word):
            yield from stack[0]
            stack[0] = []
    yield from stack[0]


class Document:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise DocumentError("not-a-document", "no PDF header")
        if re.search(rb"/Encrypt\s+(?:\d+\s+\d+\s+R|<<)", data):
            raise DocumentError("encrypted", "a password is needed")
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S):
            body, _, rest = m[2].partition(b"stream")
            value = next(parse(body), None)
            stream = re.sub(rb"\A\r?\n", b"", rest).rpartition(b"endstream")[0] if rest and isinstance(value, dict) else None
            self.objects[int(m[1])] = (value, stream)
        for value, stream in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and stream is not None:
                inner, first = self.inflate(value, stream), self.get(value.get("First"))
                heads = [x for x in parse(inner[:first]) if isinstance(x, int)]
                for number, start in zip(heads[::2], heads[1::2], strict=False):
                    self.objects.setdefault(number, (next(parse(inner, first + start), None), None))
        self.catalog = next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if self.catalog is None:
            raise DocumentError("malformed", "no catalogue")

    def get(self, value):
        seen = 0
        while isinstance(value, Ref) and seen < 20:
            value, seen = self.objects.get(value.number, (None, None))[0], seen + 1
        return value

    def inflate(self, head: dict, stream: bytes) -> bytes:
        length = self.get(head.get("Length"))
        stream = stream[:length] if isinstance(length, int) and length <= len(stream) else stream
        filters = self.get(head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f not in ("FlateDecode", "Fl"):
                raise DocumentError("unsupported", f"the filter {f}")
            try:
                stream = zlib.decompressobj().decompress(stream)
            except zlib.error as e:
                raise DocumentError("malformed", str(e)) from None
        return stream

    def content(self, value) -> bytes:
        if isinstance(found := self.get(value), list):
            return b"\n".join(map(self.content, found))
        head, stream = self.objects.get(value.number, (None, None)) if isinstance(value, Ref) else (None, None)
        return self.inflate(head, stream) if stream is not None else b""

    def pages(self) -> list[dict]:
        out: list[dict] = []

        def walk(node, above: dict, depth: int) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > 50:
                return
            own = above | {k: node[k] for k in ("Resources",) if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, own, depth + 1)
            else:
                out.append(own | node)

        walk(self.catalog.get("Pages"), {}, 0)
        return out

    def font(self, value) -> tuple[int, dict[int, str], dict[int, float]]:
        """Bytes of a code, text of codes, and widths in thousandths of an em."""
        font = self.get(value) or {}
        wide = 2 if font.get("Subtype") == "Type0" else 1
        table: dict[int, str] = {}
        if isinstance(font.get("ToUnicode"), Ref):
            table = unicode_table(self.content(font["ToUnicode"]))
        first, widths = self.get(font.get("FirstChar")) or 0, self.get(font.get("Widths")) or []
        return wide, table, {first + k: self.get(w) for k, w in enumerate(widths)}

    def runs(self, page: dict) -> list[tuple[str, float, float, float, float]]:
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        known: dict[str, tuple] = {}
        out, args = [], []
        font, size, lead, matrix, line = None, 1.0, 0.0, [1, 0, 0, 1, 0, 0], [1, 0, 0, 1, 0, 0]

        def move(x: float, y: float) -> None:
            a, b, c, d, e, f = line
            line[4:] = [x * a + y * c + e, x * b + y * d + f]
            matrix[:] = line

        def show(raw: bytes) -> None:
            wide, table, widths = known.get(font) or (1, {}, {})
            codes = [int.from_bytes(raw[k : k + wide], "big") for k in range(0, len(raw), wide)]
            text = "".join(table.get(c) or (bytes([c]).decode("cp1252", "replace") if wide == 1 else "") for c in codes)
            width = sum(widths.get(c, 500) for c in codes) / 1000 * size
            scale = (matrix[0] ** 2 + matrix[1] ** 2) ** 0.5
            out.append((text, matrix[4], matrix[5], width * scale, size * scale))
            matrix[4] += width * matrix[0]
            matrix[5] += width * matrix[1]

        for t in parse(self.content(page.get("Contents"))):
            if not isinstance(t, Word):
                args.append(t)
                continue
            try:
                if t == "BT":
                    matrix[:] = line[:] = [1, 0, 0, 1, 0, 0]
                elif t == "Tf":
                    font, size = args[-2], float(args[-1])
                    if font not in known:
                        known[font] = self.font(fonts.get(font))
                elif t in ("Td", "TD"):
                    lead = -args[-1] if t == "TD" else lead
                    move(args[-2], args[-1])
                elif t == "Tm":
                    matrix[:] = line[:] = args[-6:]
                elif t == "TL":
                    lead = args[-1]
                elif t == "T*":
                    move(0, -lead)
                elif t == "Tj":
                    show(args[-1])
                elif t in ("'", '"'):
                    move(0, -lead)
                    show(args[-1])
                elif t == "TJ":
                    for x in args[-1]:
                        if isinstance(x, bytes):
                            show(x)
                        else:
                            matrix[4] -= x / 1000 * size * matrix[0]
            except (IndexError, TypeError, ValueError):
                pass  # a broken operator draws nothing
            args = []
        return out


def unicode_table(data: bytes) -> dict[int, str]:
    """Codes to text from a ToUnicode table."""
    table: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf(?:char|range)", data, re.S):
        values = list(parse(body))
        if kind == b"char":
            table |= {int.from_bytes(a, "big"): text(b) for a, b in zip(values[::2], values[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            continue
        for a, b, to in zip(values[::3], values[1::3], values[2::3], strict=False):
            low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
            for k in range(low, min(high, low + 65535) + 1):
                if isinstance(to, list):
                    if k - low < len(to):
                        table[k] = text(to[k - low])
                elif to:
                    table[k] = text(to[:-2] + (int.from_bytes(to[-2:], "big") + k - low).to_bytes(4, "big")[-2:])
    return table


def page_texts(data: bytes, pages: list[int] | tuple[int, int] | None = None, most: int | None = None) -> Iterator[dict]:
    found = Document(data)
    every = found.pages()
    for n in select_pages(len(every), pages, most):
        yield {"page": n, "text": layout(found.runs(every[n - 1]))}


def read_pages(rows: DataFrame, key: str, content: str, pages: list[int] | tuple[int, int] | None = None, most: int | None = None) -> DataFrame:
    """(key, page, text, error) of every page chosen; a file that can't be read is one row with its error."""
    return explode_text(rows, key, content, lambda data: page_texts(bytes(data), pages, most), "page int, text string")


def parse_date(value: str | None) -> datetime | None:
    """A PDF date such as ``D:20260102030405+01'00'``, in UTC."""
    m = re.match(r"(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([+-])(\d{2})'?(\d{2})?|Z)?", (value or "").strip())
    if not m:
        return None
    year, month, day, *clock = (int(x) if x else 0 for x in m.groups()[:6])
    try:
        at = datetime(year, month or 1, day or 1, *clock, tzinfo=timezone.utc)
    except ValueError:
        return None
    away = timedelta(hours=int(m[8] or 0), minutes=int(m[9] or 0))
    return at - away if m[7] == "+" else at + away


def _text(value) -> str | None:
    if isinstance(value, (bytes, bytearray)):
        value = bytes(value)
        value = value.decode("utf-16", "replace") if value[:2] in (b"\xfe\xff", b"\xff\xfe") else value.decode("utf-8-sig") if value[:3] == b"\xef\xbb\xbf" else value.decode("cp1252", "replace")
    return value.strip() or None if isinstance(value, str) else None


INFO = "pages int, pages_with_text int, has_text boolean, title string, author string, subject string, keywords string, created timestamp, modified timestamp"


def info(data: bytes, most: int | None = None) -> dict:
    """Page counts and what the document says of itself: the information dictionary, else its XMP packet."""
    found = Document(data)
    every = found.pages()
    said = next((d for m in re.finditer(rb"/Info\s+(\d+)\s+\d+\s+R", data) if isinstance(d := found.get(Ref(int(m[1]))), dict)), {})
    xmp = re.search(rb"<x:xmpmeta.*?</x:xmpmeta>", data, re.S)
    packet = xmp[0].decode("utf-8", "replace") if xmp else ""

    def told(key: str, name: str) -> str | None:
        inside = re.search(rf"<{name}\b[^>]*>(.*?)</{name}>", packet, re.S)
        return _text(found.get(said.get(key))) or (" ".join(re.sub(r"<[^>]+>", " ", inside[1]).split()) or None if inside else None)

    def when(key: str, name: str) -> datetime | None:
        value = told(key, name)
        try:
            return parse_date(value) if value is None or value[:2] == "D:" else datetime.fromisoformat(value)
        except ValueError:
            return parse_date(value)

    chosen = select_pages(len(every), None, most)
    with_text = sum(bool(layout(found.runs(every[n - 1]))) for n in chosen)
    return {
        "pages": len(every), "pages_with_text": with_text, "has_text": with_text > 0, "title": told("Title", "dc:title"), "author": told("Author", "dc:creator"), "subject": told("Subject", "dc:description"),
        "keywords": told("Keywords", "pdf:Keywords"), "created": when("CreationDate", "xmp:CreateDate"), "modified": when("ModDate", "xmp:ModifyDate"),
    }


def metadata_text(said: dict) -> str:
    """``key: value`` lines of what is known, the number of pages last."""
    stamp = lambda x: x.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z") if x else None
    known = [(k, said[k]) for k in ("title", "author", "subject", "keywords")] + [(k, stamp(said[k])) for k in ("created", "modified")] + [("pages", str(said["pages"]))]
    return "\n".join(f"{k}: {v}" for k, v in known if v)


def page_marker(number: int) -> str:
    return f"--- Page {number} ---"


def document_text(data: bytes, metadata: bool = True, pages: list[int] | tuple[int, int] | None = None, most: int | None = None) -> str:
    """The metadata first, so that a cut loses pages before it, then each page that has text behind its marker."""
    body = "\n\n".join(f"{page_marker(p['page'])}\n{p['text']}" for p in page_texts(data, pages, most) if p["text"])
    head = f"Document metadata:\n{metadata_text(info(data))}" if metadata else ""
    return "\n\n".join(x for x in (head, f"Document text:\n{body}" if body and metadata else body) if x)


def read_info(rows: DataFrame, key: str, content: str, most: int | None = None) -> DataFrame:
    return explode_text(rows, key, content, lambda data: [info(bytes(data), most)], INFO)


def read_texts(rows: DataFrame, key: str, content: str, metadata: bool = True, most: int | None = None) -> DataFrame:
    """(key, text, error): every document as one text."""
    return explode_text(rows, key, content, lambda data: [{"text": document_text(bytes(data), metadata, None, most)}], "text string")


def read_sources(rows: DataFrame, key: str, content: str, label: str = "Document", metadata: bool = True) -> DataFrame:
    """(key, pos, label, text, error): the metadata and each page with text as sources of their own."""

    def kernel(data) -> Iterator[dict]:
        data = bytes(data)
        parts = [(f"{label} (metadata)", f"Document metadata:\n{metadata_text(info(data))}")] if metadata else []
        parts += [(f"{label} (page {p['page']})", p["text"]) for p in page_texts(data) if p["text"]]
        yield from ({"pos": n, "label": name, "text": text} for n, (name, text) in enumerate(parts))

    return explode_text(rows, key, content, kernel, "pos int, label string, text string")
