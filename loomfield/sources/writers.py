"""Small documents made from rows: the containers the readers take apart, for exports, round trips and tests."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from email.message import EmailMessage
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomfield.sources.rows import spread


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def docx(title: str, parts: list[tuple[str, str]]) -> bytes:
    """A Word document of headings and their paragraphs, with its title as metadata."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    one = lambda text, style="": f"<w:p>{style and f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>'}<w:r><w:t xml:space=\"preserve\">{escape(text)}</w:t></w:r></w:p>"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return zipped({
        "[Content_Types].xml": '<Types><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships><Relationship Id="r1" Type="{office}/officeDocument" Target="word/document.xml"/></Relationships>',
        "docProps/core.xml": f'<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>{escape(title)}</dc:title></cp:coreProperties>',
        "word/styles.xml": f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/document.xml": f"<w:document {w}><w:body>{''.join(one(h, 'H1') + one(t) for h, t in parts)}</w:body></w:document>",
    })


def odt(parts: list[tuple[str, str]]) -> bytes:
    """An OpenDocument text of headings and their paragraphs."""
    body = "".join(f'<text:h text:outline-level="1">{escape(h)}</text:h><text:p>{escape(t)}</text:p>' for h, t in parts)
    return zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f'<office:document-content xmlns:office="o" xmlns:text="t"><office:body><office:text>{body}</office:text></office:body></office:document-content>'})


def xlsx(sheet: str, rows: list[list[str | float]]) -> bytes:
    """A workbook of one sheet; numbers are numbers."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(value: str | float, at: str) -> str:
        return f'<c r="{at}"><v>{value!r}</v></c>' if isinstance(value, (int, float)) else f'<c r="{at}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'

    body = "".join(f'<row r="{n}">{"".join(cell(v, f"{chr(65 + k)}{n}") for k, v in enumerate(r))}</row>' for n, r in enumerate(rows, 1))
    return zipped({
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    })


def pdf(pages: list[str], title: str = "") -> bytes:
    """A PDF with a line of Latin text on each page."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages))) + b"] /Count %d >>" % len(pages), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    literal = lambda text: b"(" + text.encode("cp1252", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)") + b")"
    objects.append(b"<< /Title " + literal(title) + b" >>")
    for k, text in enumerate(pages):
        data = zlib.compress(b"BT /F1 12 Tf 72 720 Td " + literal(text) + b" Tj ET")
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (6 + 2 * k))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R /Info 4 0 R >>\n%%EOF"


def exif_block(camera: str = "", caption: str = "", orientation: int = 0, taken: str = "", place: tuple[float, float] | None = None) -> bytes:
    """A little-endian EXIF block; ``taken`` is ``YYYY:MM:DD HH:MM:SS``, ``place`` is (latitude, longitude)."""
    main: list[tuple[int, int, int, bytes]] = []
    text = lambda tag, value: (tag, 2, len(value.encode()) + 1, value.encode() + b"\0")
    if caption:
        main.append(text(0x010E, caption))
    if camera:
        main.append(text(0x0110, camera))
    if orientation:
        main.append((0x0112, 3, 1, struct.pack("<H", orientation)))
    if taken:
        main.append(text(0x0132, taken))
    out, size = bytearray(b"II*\0" + struct.pack("<I", 8)), lambda n: 2 + 12 * n + 4

    def directory(entries: list[tuple[int, int, int, bytes]], at: int) -> bytes:
        head, rest = struct.pack("<H", len(entries)), b""
        for tag, kind, n, data in sorted(entries):
            where = at + size(len(entries)) + len(rest)
            head += struct.pack("<HHI", tag, kind, n) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", where))
            rest += data + b"\0" * (len(data) % 2) if len(data) > 4 else b""
        return head + struct.pack("<I", 0) + rest

    if place is None:
        return bytes(out) + directory(main, 8)

    def degrees(x: float) -> bytes:
        seconds = round(abs(x) * 3_600_000)
        return struct.pack("<6I", seconds // 3_600_000, 1, seconds // 60_000 % 60, 1, seconds % 60_000, 1000)

    lat, lon = place
    spot = [text(1, "S" if lat < 0 else "N"), (2, 5, 3, degrees(lat)), text(3, "W" if lon < 0 else "E"), (4, 5, 3, degrees(lon))]
    pointer = lambda at: [*main, (0x8825, 4, 1, struct.pack("<I", at))]
    at = 8 + len(directory(pointer(0), 8))
    return bytes(out) + directory(pointer(at), 8) + directory(spot, at)


def jpeg(width: int, height: int, exif: bytes = b"") -> bytes:
    """A JPEG header: EXIF and the frame's size, without pixels."""
    segment = lambda mark, data: b"\xff" + bytes([mark]) + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + (segment(0xE1, b"Exif\0\0" + exif) if exif else b"") + segment(0xC0, b"\x08" + struct.pack(">HH", height, width) + b"\x01\x01\x11\x00") + b"\xff\xd9"


def with_exif(image: bytes, exif: bytes) -> bytes:
    """A JPEG with this EXIF block instead of its own."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("only a JPEG can take an EXIF block")
    out, at = [b"\xff\xd8", b"\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif], 2
    while image[at : at + 1] == b"\xff" and image[at + 1] in range(0xE0, 0xF0):
        size = 2 + struct.unpack_from(">H", image, at + 2)[0]
        if image[at + 4 : at + 10] != b"Exif\0\0":
            out.append(image[at : at + size])
        at += size
    return b"".join([*out, image[at:]])


def png(width: int, height: int) -> bytes:
    head = struct.pack(">II", width, height) + b"\x08\x02\x00\x00\x00"
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def wav(seconds: float, rate: int = 8000) -> bytes:
    """Silence of one byte a sample."""
    n = round(seconds * rate)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + bytes(n)


def message(sender: str, to: str, subject: str, body: str, files: list[tuple[str, str]]) -> bytes:
    """A MIME message with text attachments (name, text)."""
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = sender, to, subject, "Thu, 01 Jan 2026 10:00:00 +0000"
    m.set_content(body)
    for name, text in files:
        m.add_attachment(text, filename=name)
    return bytes(m)


def made(rows: DataFrame, key: str, make: Callable[[dict], bytes], out: str = "content") -> DataFrame:
    """(key, content): ``make`` of each row, a dictionary."""
    names = rows.columns
    schema = T.StructType([rows.schema[key], T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [make(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(key)), pa.array(content, pa.binary())], names=[key, out])

    return spread(rows).mapInArrow(run, schema)
