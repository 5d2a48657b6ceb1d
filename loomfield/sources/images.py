"""Image headers: dimensions, EXIF facts, checks, and URLs of a page's images."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions.text import format_size, image_type
from loomfield.sources.rows import explode_text

ACCEPTED = ("image/jpeg", "image/png", "image/gif", "image/webp")
MAX_BYTES = 20 * 1024 * 1024
_TURNS = {1: "upright", 2: "mirrored left to right", 3: "upside down", 4: "mirrored top to bottom", 5: "mirrored and turned left", 6: "turned right by 90 degrees", 7: "mirrored and turned right", 8: "turned left by 90 degrees"}


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            return
        if 0xD0 <= marker <= 0xD8 or marker == 1:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2:
            return
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def chunks(data: bytes, at: int, order: str, pad: int, after: int = 0) -> Iterator[tuple[bytes, bytes]]:
    """Named chunks: PNG names them behind the size, RIFF before it."""
    while at + 8 <= len(data):
        if order == ">":
            size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        else:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + after + (size % 2 if pad else 0)


def dimensions(data: bytes) -> tuple[int, int] | None:
    """(width, height) by the header of a JPEG, PNG, GIF or WebP image."""
    try:
        if data[:3] == b"\xff\xd8\xff":
            body = next((b for m, b in jpeg_segments(data) if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC)), None)
            return (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")) if body and len(body) >= 5 else None
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack_from(">II", data, 16)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack_from("<HH", data, 6)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            for name, body in chunks(data, 12, "<", 2):
                if name == b"VP8X":
                    return int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
                if name == b"VP8L" and body[:1] == b"\x2f":
                    bits = int.from_bytes(body[1:5], "little")
                    return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
                if name == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
                    w, h = struct.unpack_from("<HH", body, 6)
                    return w & 0x3FFF, h & 0x3FFF
    except struct.error:
        pass
    return None


def exif_block(data: bytes) -> bytes | None:
    if data[:3] == b"\xff\xd8\xff":
        return next((b[6:] for m, b in jpeg_segments(data) if m == 0xE1 and b[:6] == b"Exif\0\0"), None)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return next((b for n, b in chunks(data, 8, ">", 0, 4) if n == b"eXIf"), None)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        found = next((b for n, b in chunks(data, 12, "<", 2) if n == b"EXIF"), None)
        return found[6:] if found and found[:6] == b"Exif\0\0" else found
    return None


_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif(block: bytes) -> dict:
    """Facts of an EXIF block in either byte order; what can't be read is left out."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8:
        return {}

    def directory(at: int) -> dict[int, object]:
        out: dict[int, object] = {}
        if not 0 < at <= len(block) - 2:
            return out
        for k in range(min(512, struct.unpack_from(order + "H", block, at)[0])):
            entry = at + 2 + 12 * k
            if entry + 12 > len(block):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", block, entry)
            size = _SIZES.get(kind, 0) * n
            start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", block, entry + 8)[0]
            if not size or start + size > len(block):
                continue
            raw = block[start : start + size]
            if kind == 2:
                out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
            elif kind in (5, 10):
                pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * n, raw)
                out[tag] = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
            elif kind in (3, 4, 9):
                values = struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * n, raw)
                out[tag] = values[0] if n == 1 else list(values)
        return out

    main = directory(struct.unpack_from(order + "I", block, 4)[0])
    more = directory(main[0x8769]) if isinstance(main.get(0x8769), int) else {}
    place = directory(main[0x8825]) if isinstance(main.get(0x8825), int) else {}
    told: dict = {}
    stamp = more.get(0x9003) or more.get(0x9004) or main.get(0x0132)
    if isinstance(stamp, str) and (m := re.fullmatch(r"(\d{4}):(\d\d):(\d\d) (\d\d:\d\d:\d\d)", stamp)) and m[1] != "0000":
        told["taken"] = f"{m[1]}-{m[2]}-{m[3]}T{m[4]}{more.get(0x9011) or ''}"
    camera = " ".join(str(main[t]) for t in (0x010F, 0x0110) if main.get(t))
    for name, value in (("camera", camera), ("software", main.get(0x0131)), ("caption", main.get(0x010E))):
        if value:
            told[name] = value
    if main.get(0x0112) in _TURNS:
        told["orientation"] = _TURNS[main[0x0112]]

    def degrees(value, ref, negative: str):
        if isinstance(value, list) and len(value) == 3 and None not in value:
            d = value[0] + value[1] / 60 + value[2] / 3600
            return -d if ref == negative else d
        return None

    at = degrees(place.get(2), place.get(1), "S"), degrees(place.get(4), place.get(3), "W")
    if None not in at and abs(at[0]) <= 90 and abs(at[1]) <= 180:
        told["latitude"], told["longitude"] = at
    return told


def read_images(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, width, height, facts, error): header facts of each image; only headers are looked at."""

    def kernel(data) -> Iterator[dict]:
        data = bytes(data)
        size, block = dimensions(data), exif_block(data)
        yield {"width": size[0] if size else None, "height": size[1] if size else None, "facts": [(k, str(v)) for k, v in (exif(block) if block else {}).items()]}

    return explode_text(rows, key, content, kernel, "width int, height int, facts map<string,string>")


def check(content: Column, most: int = MAX_BYTES) -> Column:
    """Why an image can't be sent, or null."""
    kind, n = image_type(content), F.octet_length(content).cast("long")
    return F.when(content.isNull() | (n == 0), "unreadable: no bytes").when(n > most, F.concat(F.lit("too_large: "), format_size(n))).when(kind.isNull(), "unsupported: unknown format").when(~kind.isin(*ACCEPTED), F.concat(F.lit("unsupported: "), kind))


_JUNK = re.compile(r"(?:^|[/_.-])(?:icons?|logos?|sprites?|pixel|spacer|blank|avatar|badge|button|arrow|tracking)(?:[/_.-]|$)", re.I)
_SKIP = re.compile(r"\.(?:svg|gif|ico|bmp)(?:$|[?#])", re.I)
_IMG = re.compile(r"""<img\b((?:[^"'>]|"[^"]*+"|'[^']*+')*+)>""", re.I)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def _attributes(tag: str) -> dict[str, str]:
    return {n.lower(): unescape(a or b or c) for n, a, b, c in _ATTR.findall(tag)}


def page_images(html: str, base: str, most: int = 50, least_side: int = 100) -> list[dict]:
    """Image addresses of a page: preview tags, structured data, then images in the text; each once."""
    found: list[tuple[str, dict]] = []
    for tag in re.findall(r"<meta\b[^>]*>", html, re.I):
        a = _attributes(tag)
        if (a.get("property") or a.get("name") or "").lower() in ("og:image", "og:image:url", "og:image:secure_url", "twitter:image", "twitter:image:src"):
            found.append((a.get("content", ""), {}))

    def inside(value, wanted: bool) -> Iterator[str]:
        if isinstance(value, str):
            yield from [value] if wanted else []
        elif isinstance(value, list):
            for x in value:
                yield from inside(x, wanted)
        elif isinstance(value, dict):
            for k, x in value.items():
                yield from inside(x, k in ("image", "photo", "contentUrl", "thumbnailUrl") or wanted and k == "url")

    for block in re.findall(r"""<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>""", html, re.I | re.S):
        try:
            found += [(u, {}) for u in inside(json.loads(block), False)]
        except ValueError:
            continue
    for tag in _IMG.findall(html):
        a = _attributes(tag)
        sizes = []
        for part in (a.get("srcset") or a.get("data-srcset") or "").split(","):
            bits = part.split()
            if bits:
                sizes.append((float(bits[1][:-1]) if len(bits) > 1 and re.fullmatch(r"[\d.]+w", bits[1]) else 0.0, bits[0]))
        best = max(sizes, default=(0, ""))[1]
        number = lambda x: int(m[0]) if x and (m := re.match(r"\d+", x)) else None
        found.append((best or a.get("src") or a.get("data-src") or a.get("data-lazy-src") or "", {"alt": a.get("alt"), "width": number(a.get("width")), "height": number(a.get("height"))}))
    out, seen = [], set()
    for url, facts in found:
        try:
            whole = urljoin(base, url.strip()) if url.strip() else ""
            parts = urlsplit(whole)
        except ValueError:
            continue
        if parts.scheme not in ("http", "https") or not parts.netloc or whole in seen or _JUNK.search(parts.path) or _SKIP.search(parts.path):
            continue
        if any(facts.get(k) is not None and facts[k] < least_side for k in ("width", "height")):
            continue
        seen.add(whole)
        out.append({"pos": len(out), "url": whole} | facts)
        if len(out) == most:
            break
    return out


def read_page_images(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", most: int = 50) -> DataFrame:
    """(key, pos, url, alt, width, height, error) of every page."""
    both = pages.select(key, F.to_json(F.struct(F.col(html).alias("h"), F.col(url).alias("u"))).alias("__both"))

    def kernel(text: str) -> Iterator[dict]:
        page = json.loads(text)
        yield from page_images(page.get("h") or "", page.get("u") or "", most)

    return explode_text(both, key, "__both", kernel, "pos int, url string, alt string, width int, height int")
