"""Text shaping as native columns: HTML reduction, whitespace, sizes, clocks, budget cuts, numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named references that are decoded; ``amp`` comes last so that one pass decodes each reference once.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…",
    "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·",
    "deg": "°", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "frac12": "½", "frac14": "¼", "frac34": "¾",
    "times": "×", "laquo": "«", "raquo": "»", "amp": "&",
}
UNREAD = ("script", "style", "noscript", "template", "svg", "iframe", "head")
LINE_TAGS = sorted(
    "p div h1 h2 h3 h4 h5 h6 ul ol dl dt dd table thead tbody tfoot tr th td section article main aside nav header footer form fieldset "
    "figure figcaption blockquote pre hr address details dialog summary".split()
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once."""
    return F.transform(F.array(value), body)[0]


def decode_entities(text: Column) -> Column:
    """Numeric and named character references; others stay.  One pass: what a decoded ``&`` begins is text.

    The text is cut at references, so that each is looked at once.
    """
    ref = "&(?:#[xX][0-9a-fA-F]{1,8}|#[0-9]{1,10}|[a-zA-Z][a-zA-Z0-9]*);"
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(r: Column) -> Column:
        inner = F.lower(F.substring(r, F.lit(2), F.length(r) - 2))
        code = F.when(inner.startswith("#x"), F.conv(F.substr(inner, F.lit(3)), 16, 10)).otherwise(F.substr(inner, F.lit(2))).cast("long")
        # a character from its number, by the bytes of its UTF-32 form
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        fine = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(inner.startswith("#"), F.when(fine, char).otherwise(r)).otherwise(F.coalesce(F.try_element_at(named, inner), r))

    def joined(refs: Column) -> Column:
        return F.array_join(F.zip_with(F.split(text, ref, -1), refs, lambda piece, r: F.concat(piece, F.coalesce(one(r), F.lit("")))), "")

    return F.when(text.contains("&"), let(F.regexp_extract_all(text, F.lit(ref), F.lit(0)), joined)).otherwise(text)


def tidy_lines(text: Column, blank_lines: int = 1) -> Column:
    """Runs of spaces to one, lines trimmed, at most so many blank lines together, ends trimmed."""
    one = F.regexp_replace(text, "[ \\t\\f\\x0B\\u00A0]+", " ")
    edges = F.regexp_replace(one, "(?<=^|\\n)[^\\S\\n]+|[^\\S\\n]+(?=\\n|$)", "")
    few = F.regexp_replace(edges, "\\n{%d,}" % (blank_lines + 2), "\n" * (blank_lines + 1))
    return F.regexp_replace(few, "^\\s+|\\s+$", "")


def tidy_text(text: Column) -> Column:
    """``tidy_lines`` after carriage returns became line feeds."""
    return tidy_lines(F.regexp_replace(text, "\\r\\n?", "\n"))


def html_to_text(html: Column) -> Column:
    """A page's readable text by a fixed chain of replacements: no parser, so bad markup only worsens the text."""
    t = F.regexp_replace(html, "<!--[\\s\\S]*?-->", " ")
    for name in UNREAD:
        t = F.regexp_replace(t, f"(?i)<{name}\\b[^>]*>[\\s\\S]*?</{name}\\s*>", " ")
    t = F.regexp_replace(t, "(?i)<br\\s*/?>", "\n")
    t = F.regexp_replace(t, "(?i)<li\\b[^>]*>", "\n- ")
    t = F.regexp_replace(t, f"(?i)</?(?:{'|'.join(LINE_TAGS)})\\b[^>]*>", "\n")
    return tidy_lines(decode_entities(F.regexp_replace(t, "<[^>]+>", " ")))


def bare(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r\xa0\ufeff"))


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\\uFEFF", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as the limits of schemas count."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def omitted_marker(count: Column) -> Column:
    return F.concat(F.lit("[… "), F.format_number(count, 0), F.lit(" characters omitted …]"))


def truncate_text(text: Column, limit: Column, policy: str = "tail") -> Column:
    """``text`` within ``limit`` characters, with a marker where something was left out.

    The marker's length is reckoned for the whole text; a limit below it leaves the marker alone.
    """
    n = F.length(text)
    room = F.greatest(F.lit(0), limit - F.length(omitted_marker(n)) - 2)
    marker = omitted_marker(n - room)

    def last(k: Column) -> Column:
        return F.substring(text, n - k + 1, k)

    if policy == "tail":
        cut = F.concat(F.substring(text, F.lit(1), room), F.lit("\n"), marker)
    elif policy == "head":
        cut = F.concat(marker, F.lit("\n"), last(room))
    elif policy == "middle":
        front = F.ceil(room / 2).cast("int")
        cut = F.concat(F.substring(text, F.lit(1), front), F.lit("\n"), marker, F.lit("\n"), last(room - front))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return F.when(n <= limit, text).otherwise(cut)


def format_size(n: Column, half_even: bool = False) -> Column:
    """Bytes as B, KB or MB; halves of a tenth of a megabyte go up, or with ``half_even`` to the even tenth, as C's printf does."""
    mb = n / (1024 * 1024)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", F.bround(mb, 1) if half_even else mb), F.lit(" MB")))


def format_clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds, from zero."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("long"), F.pmod((s / 60).cast("long"), F.lit(60)), F.pmod(s, F.lit(60)))


def format_address(name: Column, address: Column) -> Column:
    n, a = F.nullif(name, F.lit("")), F.nullif(address, F.lit(""))
    return F.when(n.isNotNull() & a.isNotNull(), F.concat(n, F.lit(" <"), a, F.lit(">"))).otherwise(F.coalesce(n, a, F.lit("")))


def is_forward(subject: Column) -> Column:
    return F.coalesce(subject.rlike("(?i)^\\s*(?:fwd?|wg|tr|rv|enc)\\s*:"), F.lit(False))


def normalise_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, "\\s+", " ")))


def parse_number(text: Column) -> Column:
    """A number as people type it, with separators, currency or unit; null if it isn't one.

    The shape is checked before the cast, which would take more than numbers.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[\\s,€$£¥%]", ""), "^[A-Za-z]{3}(?=[\\d.-])", ""), "(?<=\\d)[A-Za-z]{1,4}$", "")
    value = bare.try_cast("double")
    return F.when(bare.rlike("^[-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?$") & (F.abs(value) < float("inf")), value)


def split_list(text: Column) -> Column:
    """Items between line breaks, or semicolons, or bars, or commas: the first of these that occurs."""
    by = F.when(text.contains("\n"), F.split(text, "\\r?\\n")).when(text.contains(";"), F.split(text, ";")).when(text.contains("|"), F.split(text, "\\|")).otherwise(F.split(text, ","))
    return F.filter(F.transform(by, lambda x: bare(x)), lambda x: F.length(x) > 0)


def image_type(content: Column) -> Column:
    """Type of an image by its first bytes, or null."""

    def at(k: int, n: int) -> Column:
        return F.hex(F.substring(content, k, n))

    brand = F.decode(F.substring(content, 9, 4), "UTF-8")
    return (
        F.when(at(1, 3) == "FFD8FF", "image/jpeg")
        .when(at(1, 8) == "89504E470D0A1A0A", "image/png")
        .when(at(1, 6).isin("474946383761", "474946383961"), "image/gif")
        .when((at(1, 4) == "52494646") & (at(9, 4) == "57454250"), "image/webp")
        .when(at(1, 4).isin("49492A00", "4D4D002A"), "image/tiff")
        .when(at(1, 2) == "424D", "image/bmp")
        .when((at(5, 4) == "66747970") & brand.isin("avif", "avis"), "image/avif")
        .when((at(5, 4) == "66747970") & brand.isin("heic", "heix", "hevc", "hevx"), "image/heic")
        .when((at(5, 4) == "66747970") & brand.isin("mif1", "msf1", "heim", "heis"), "image/heif")
    )
