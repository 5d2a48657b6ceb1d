"""E-mail messages, mailboxes and threads: parsing, quoted replies and signatures, rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.header import decode_header, make_header
from email.utils import getaddresses, parsedate_to_datetime
from datetime import timezone
from html import unescape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.text import format_address, format_size
from loomfield.sources.rows import explode_text

KNOWN = frozenset("from to cc bcc subject date message-id in-reply-to references mime-version content-type received return-path reply-to sender".split())
MESSAGE = (
    "message_id string, in_reply_to string, subject string, date timestamp, sender struct<name:string,address:string>, recipients array<struct<name:string,address:string>>, copies array<struct<name:string,address:string>>, "
    "headers map<string,string>, text string, html string, attachments array<struct<filename:string,media_type:string,data:binary,inline:boolean,content_id:string>>"
)
_TEXT_NAMES = re.compile(r"\.(?:txt|md|csv|tsv|html?)$", re.I)


class MailError(ValueError):
    pass


def _decoded(value: str) -> str:
    try:
        return str(make_header(decode_header(value)))
    except (LookupError, UnicodeError, ValueError):
        return value


def decode_bytes(data: bytes, charset: str | None = None) -> str:
    """By its byte-order mark, its charset, strict UTF-8, or windows-1252."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for name in (charset, "utf-8-sig"):
        try:
            if name:
                return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            pass
    return data.decode("cp1252", "replace")


def parse_message(raw: bytes | str) -> dict:
    message = message_from_bytes(raw.encode("utf-8", "surrogateescape") if isinstance(raw, str) else bytes(raw), policy=policy.compat32)
    headers: dict[str, str] = {}
    for name, value in message.items():
        text = re.sub(r"\r?\n[ \t]+", " ", _decoded(str(value))).strip()
        headers[name.lower()] = f"{headers[name.lower()]}, {text}" if name.lower() in headers else text
    if not KNOWN & headers.keys():
        raise MailError("no e-mail header was found")

    def people(name: str) -> list[dict]:
        raw_values = [str(v) for v in message.get_all(name, [])]
        return [{"name": _decoded(n) or None, "address": a or None} for n, a in getaddresses(raw_values) if n or a]

    texts: dict[str, list[str]] = {"plain": [], "html": []}
    attached = []
    for part in message.walk():
        if part.is_multipart():
            continue
        kind, data = part.get_content_type(), part.get_payload(decode=True) or b""
        name, disposition = part.get_filename(), part.get_content_disposition()
        if kind in ("text/plain", "text/html") and disposition != "attachment" and not name:
            texts[kind.partition("/")[2]].append(decode_bytes(data, part.get_content_charset()).replace("\r\n", "\n"))
        else:
            cid = (part.get("Content-ID") or "").strip("<> ") or None
            suffix = {"jpeg": "jpg", "plain": "txt"}.get(part.get_content_subtype(), part.get_content_subtype())
            attached.append({"filename": _decoded(name) if name else f"attachment-{len(attached) + 1}.{suffix}", "media_type": kind, "data": data, "inline": disposition == "inline" or cid is not None and disposition != "attachment", "content_id": cid})
    try:
        date = parsedate_to_datetime(headers["date"]) if "date" in headers else None
    except ValueError:
        date = None
    if date is not None:
        date = date.replace(tzinfo=timezone.utc) if date.tzinfo is None else date.astimezone(timezone.utc)
    return {
        "message_id": headers.get("message-id", "").strip("<> ") or None,
        "in_reply_to": headers.get("in-reply-to", "").strip("<> ") or None,
        "subject": headers.get("subject"),
        "date": date,
        "sender": next(iter(people("From")), None),
        "recipients": people("To"),
        "copies": people("Cc"),
        "headers": list(headers.items()),
        "text": "\n".join(texts["plain"]).strip() or None,
        "html": "\n".join(texts["html"]).strip() or None,
        "attachments": attached,
    }


def split_mbox(text: Column) -> Column:
    """Raw messages of a mailbox; text without a separating line is one message; quoted separators are restored."""
    lf = F.regexp_replace(text, "\\r\\n?", "\n")
    parts = F.split(F.regexp_replace(lf, "(?m)^From (?!:)\\S.*\\n?", "\u0001"), "\u0001", -1)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "(?m)^>(>*From )", "$1")), lambda p: F.length(F.trim(p)) > 0)


# what clients write, in four languages: fixed values
_FORWARDED = re.compile(r"-{2,}\s*(?:Forwarded message|Weitergeleitete Nachricht|Message transféré|Mensaje reenviado)\s*-{2,}|Begin forwarded message:?", re.I)
_EARLIER = re.compile(r"-{2,}\s*(?:Original(?: Message| Appointment)?|Urspr[üu]ngliche Nachricht|Message d'origine|Mensaje original|Reply above this line)\s*-{2,}|_{8,}", re.I)
_HEAD = re.compile(r"[*_]*(?:From|Von|De|Da)[*_]*\s*:\s*\S.*", re.I)
_HEAD_REST = (re.compile(r"[*_]*(?:Sent|Date|Gesendet|Datum|Envoy[ée]|Enviado|Fecha)[*_]*\s*:", re.I), re.compile(r"[*_]*(?:Subject|Betreff|Objet|Asunto)[*_]*\s*:", re.I))
_SAID = re.compile(r"(?:(?:On|Am|Le|El)\b.*\b(?:wrote|schrieb|[ée]crit|escribi[óo])\b.*:|.*\b(?:wrote|schrieb|a [ée]crit|escribi[óo])\s*:|\d{4}-\d{2}-\d{2}\b.*<[^>]+@[^>]+>:)", re.I)
_SAYS = re.compile(r"(?:On|Am|Le|El)\b", re.I)


class _Lines:
    """A message's lines one by one; in a forwarded part with a level of quotes less."""

    def __init__(self, text: str):
        self.lines, self.at, self.inside = re.split(r"\r\n|\r|\n", text), 0, False

    def peek(self, ahead: int = 0) -> str | None:
        if self.at + ahead >= len(self.lines):
            return None
        line = self.lines[self.at + ahead]
        return re.sub(r"^>\s?", "", line) if self.inside else line

    def header_block(self) -> bool:
        """A sender's line with a date and a subject among the next ones."""
        rest = [(self.peek(k) or "").strip() for k in range(1, 6)]
        return bool(_HEAD.fullmatch((self.peek() or "").strip())) and all(any(p.match(x) for x in rest) for p in _HEAD_REST)

    def forward_begins(self) -> bool:
        line = (self.peek() or "").strip()
        return bool(_FORWARDED.fullmatch(line)) or bool(re.fullmatch("-{10,}", line)) and bool(_HEAD.fullmatch((self.peek(1) or "").strip()))


def _without_attribution(kept: list[str]) -> list[str]:
    """Without the line, or the two or three, at the end that say who wrote what is quoted next."""
    for n in (1, 2, 3):
        if n <= len(kept) and _SAID.fullmatch(" ".join(x.strip() for x in kept[-n:] if x.strip())):
            return kept[:-n]
    return kept


def strip_quotes(text: str, forward: bool = False) -> str:
    """A message's own words: quoted lines and who wrote them go, and all behind the mark of an earlier message.

    What is forwarded is content: behind its mark, or in a message that ``forward`` calls one behind the first mark
    of an earlier message, one level of quotes goes and the rest stays, without the history quoted inside.
    """
    lines, out, begun = _Lines(text), [], False
    while (line := lines.peek()) is not None:
        bare = line.strip()
        earlier = bool(_EARLIER.fullmatch(bare)) or not lines.inside and lines.header_block()
        if not lines.inside and lines.forward_begins() or earlier and forward and not begun:
            lines.inside = begun = True
            out.append(line)
        elif bare.startswith(">"):
            out = _without_attribution(out)
        elif earlier:
            break
        elif _SAID.fullmatch(bare):
            pass
        elif _SAYS.match(bare) and _SAID.fullmatch(f"{bare} {(lines.peek(1) or '').strip()}"):
            lines.at += 1
        else:
            out.append(line)
        lines.at += 1
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


_CONTACT = re.compile(r"@|https?://|www\.|\+?\d[\d\s().-]{6,}")


def strip_signature(text: str) -> str:
    """Cut at the signature mark, then sent-from lines and a last short block with contact details."""
    lines = text.split("\n")
    if any(x.rstrip("\r") in ("-- ", "--") for x in lines):
        lines = lines[: next(k for k, x in enumerate(lines) if x.rstrip("\r") in ("-- ", "--"))]
    while lines and (not lines[-1].strip() or re.match(r"\s*(?:Sent from|Get Outlook|Von meinem|Envoyé de|Enviado desde)\b", lines[-1], re.I)):
        lines.pop()
    gap = next((k for k in range(len(lines) - 1, -1, -1) if not lines[k].strip()), -1)
    block = lines[gap + 1 :]
    if gap > 0 and 2 <= len(block) <= 6 and all(len(x) <= 70 and not re.search(r"[.!?]\s*$", x) for x in block) and any(_CONTACT.search(x) for x in block):
        lines = lines[:gap]
    return "\n".join(lines).strip()


_HIDDEN = re.compile(r"""<(\w+)\b[^>]*style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)[^"']*["'][^>]*>.*?</\1\s*>""", re.I | re.S)


def html_body(html: str) -> str:
    """A message's HTML as text: hidden parts go, quoted blocks get a mark for each level."""
    html = re.sub(r"<!--.*?-->", " ", html, flags=re.S)
    for name in ("script", "style", "head", "title", "template"):
        html = re.sub(rf"<{name}\b[^>]*>.*?</{name}\s*>", " ", html, flags=re.I | re.S)
    html = _HIDDEN.sub(" ", html)
    out, depth = [""], 0
    for piece in re.split(r"(<[^>]+>)", html):
        tag = re.match(r"<(/?)\s*(\w+)", piece)
        if not tag:
            out[-1] += re.sub(r"\s+", " ", re.sub("[​-‍⁠﻿­]", "", unescape(piece)))
        elif tag[2].lower() in ("br", "p", "div", "tr", "li", "blockquote", "table", "ul", "ol", "h1", "h2", "h3", "h4"):
            depth = max(0, depth + (tag[2].lower() == "blockquote") * (-1 if tag[1] else 1))
            out.append("> " * depth + "- " * (tag[2].lower() == "li" and not tag[1]))
    lines = [x.rstrip() if x.strip("> ") else x.strip(" ").rstrip() for x in out]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in lines)).strip()


def body_of(message: dict, quotes: bool = False, signature: bool = False) -> str:
    text = message.get("text") or (html_body(message["html"]) if message.get("html") else "")
    if not quotes:
        text = strip_quotes(text, bool(re.match(r"\s*(?:fwd?|wg|tr|rv|enc)\s*:", message.get("subject") or "", re.I)))
    return text if signature else strip_signature(text)


def read_messages(rows: DataFrame, key: str, raw: str, quotes: bool = False, signature: bool = False) -> DataFrame:
    """(key, message fields, body, error) for each raw message."""

    def kernel(value) -> Iterator[dict]:
        message = parse_message(value)
        yield message | {"body": body_of(message, quotes, signature)}

    return explode_text(rows, key, raw, kernel, f"{MESSAGE}, body string")


def message_text(message: str = "") -> Column:
    """Headers, attachments, a blank line and the body, from ``read_messages`` columns."""
    people = lambda c: F.array_join(F.transform(c, lambda p: format_address(p["name"], p["address"])), ", ")
    line = lambda name, value: F.when(F.length(value) > 0, F.concat(F.lit(f"{name}: "), value))
    sender = F.when(F.col("sender").isNotNull(), format_address(F.col("sender.name"), F.col("sender.address")))
    files = F.array_join(F.transform("attachments", lambda a: F.concat(F.when(a["inline"] & a["media_type"].startswith("image/"), "Inline image: ").otherwise("Attachment: "), a["filename"], F.lit(" ("), a["media_type"], F.lit(", "), format_size(F.octet_length(a["data"]).cast("long")), F.lit(")"))), "\n")
    head = F.concat_ws("\n", line("From", sender), line("To", people(F.col("recipients"))), line("Cc", people(F.col("copies"))), line("Subject", F.col("subject")), line("Date", F.date_format("date", "yyyy-MM-dd HH:mm:ss 'UTC'")), F.nullif(files, F.lit("")))
    return F.concat_ws("\n\n", head, F.nullif(F.col("body"), F.lit("")))


def text_attachments(messages: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(attachments with text, the others), each with the message's key."""
    every = messages.select(key, F.posexplode("attachments").alias("pos", "a")).select(key, "pos", "a.*")
    is_text = F.col("media_type").startswith("text/") | F.col("filename").rlike(f"(?i){_TEXT_NAMES.pattern}")
    return every.where(is_text).withColumn("text", F.decode("data", "UTF-8")).drop("data"), every.where(~is_text)


def thread_order(messages: DataFrame, thread: str, pos: str = "pos") -> DataFrame:
    """``messages`` numbered oldest first where all of a thread have dates, else as given, with labels."""
    whole = Window.partitionBy(thread)
    dated = F.bool_and(F.col("date").isNotNull()).over(whole)
    ranked = messages.withColumn("__dated", dated)
    ranked = ranked.withColumn("number", F.row_number().over(whole.orderBy(F.when(F.col("__dated"), F.col("date")), pos))).drop("__dated")
    who = F.coalesce(F.col("sender.name"), F.col("sender.address"))
    return ranked.withColumn("label", F.concat(F.lit("Message "), F.col("number").cast("string"), F.coalesce(F.concat(F.lit(" from "), who), F.lit("")), F.coalesce(F.concat(F.lit(" on "), F.date_format("date", "yyyy-MM-dd")), F.lit(""))))
