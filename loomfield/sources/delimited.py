"""Lenient delimited text and workbooks as rows of cells, shaped into tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.sources.rows import explode_text

DELIMITERS, SAMPLE_LINES, MAX_COLUMNS = (",", "\t", ";", "|"), 10, 256


def unquoted_counts(text: str, lines: int = SAMPLE_LINES) -> Iterator[dict[str, int]]:
    """Delimiters outside quotes on each of the first lines that have any text."""
    counts, quoted, blank, given = dict.fromkeys(DELIMITERS, 0), False, True, 0
    for c in text + "\n":
        if c == '"':
            quoted, blank = not quoted, False
        elif c in "\r\n" and not quoted:
            if not blank:
                yield counts
                given += 1
                if given == lines:
                    return
            counts, blank = dict.fromkeys(DELIMITERS, 0), True
        else:
            blank = False
            if not quoted and c in counts:
                counts[c] += 1


def detect_delimiter(text: str, lines: int = SAMPLE_LINES) -> str:
    """The delimiter as often on every sampled line, else the most frequent; comma where there is none."""
    sampled = list(unquoted_counts(text, lines))
    best, most = ",", 0
    for d in DELIMITERS:
        own = [c[d] for c in sampled]
        if own and own[0]:
            score = 1000 * (min(own) == max(own)) + min(own)
            if score > most:
                best, most = d, score
    return best


def parse_delimited(text: str, delimiter: str | None = None) -> list[list[str]]:
    """Ragged rows: any line end ends one outside quotes; quotes open at a cell's start; what follows them stays."""
    text = text.removeprefix("﻿")
    d = delimiter or detect_delimiter(text)
    rows, row, cell, at, n = [], [], [], 0, len(text)
    plain = re.compile(f"[^{re.escape(d)}\r\n]*")
    start = True
    while at < n:
        c = text[at]
        if start and c == '"':
            at += 1
            while True:
                end = text.find('"', at)
                if end < 0:
                    cell.append(text[at:])
                    at = n
                    break
                cell.append(text[at:end])
                at = end + 1
                if at < n and text[at] == '"':
                    cell.append('"')
                    at += 1
                else:
                    break
            start = False
            continue
        m = plain.match(text, at)
        if m.end() > at:
            cell.append(m[0])
            at, start = m.end(), False
            continue
        row.append("".join(cell))
        cell, start = [], True
        at += 1
        if c != d:
            if c == "\r" and at < n and text[at] == "\n":
                at += 1
            rows.append(row)
            row = []
    if cell or row or not start:
        rows.append([*row, "".join(cell)])
    return rows


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def _column(ref: str) -> int:
    k = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        k = 26 * k + ord(c) - 64
    return k - 1


def _excel_date(value: float, first_1904: bool) -> str:
    day = datetime(1904, 1, 1) if first_1904 else datetime(1899, 12, 30)
    moment = day + timedelta(seconds=round(value * 86400))
    return moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%dT%H:%M:%S")


def read_workbook(data: bytes, max_columns: int = MAX_COLUMNS) -> list[tuple[str, list[list[str | None]]]]:
    """(sheet, rows of text) for each worksheet; cells that a merge covers are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())

        def tree(part: str):
            return ElementTree.fromstring(z.read(part)) if part in names else None

        def text_of(node) -> str:
            return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))

        shared = [text_of(s) for s in tree("xl/sharedStrings.xml").findall(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        dated: list[bool] = []
        if (styles := tree("xl/styles.xml")) is not None:
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
            formats = styles.find(f"{_MAIN}cellXfs")
            for x in formats if formats is not None else ():
                k = int(x.get("numFmtId", 0))
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, ""))
                dated.append(k in _DATE_FORMATS or bool(re.search("[dmyhs]", code, re.I)))
        book, rels = tree("xl/workbook.xml"), tree("xl/_rels/workbook.xml.rels")
        target = {r.get("Id"): r.get("Target") for r in rels}
        props = book.find(f"{_MAIN}workbookPr")
        old = props is not None and props.get("date1904") in ("1", "true")
        out = []
        for sheet in book.iter(f"{_MAIN}sheet"):
            part = target[sheet.get(_REL)]
            root = tree(part.lstrip("/") if part.startswith("/") else f"xl/{part}")
            rows: list[list[str | None]] = []
            for r in root.iter(f"{_MAIN}row"):
                k = int(r.get("r", len(rows) + 1))
                while len(rows) < k:
                    rows.append([])
                cells = rows[k - 1]
                for c in r.findall(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    if at >= max_columns:
                        continue
                    cells.extend([""] * (at + 1 - len(cells)))
                    kind, v = c.get("t", "n"), c.findtext(f"{_MAIN}v", "")
                    if kind == "s":
                        cells[at] = shared[int(v)] if v else ""
                    elif kind == "inlineStr":
                        cells[at] = text_of(c)
                    elif kind == "b":
                        cells[at] = "true" if v == "1" else "false"
                    elif kind == "n" and v:
                        style = int(c.get("s", 0))
                        x = float(v)
                        cells[at] = _excel_date(x, old) if style < len(dated) and dated[style] else str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)
                    else:
                        cells[at] = v
            for m in root.iter(f"{_MAIN}mergeCell"):
                a, _, b = m.get("ref").partition(":")
                row = lambda ref: int(re.search(r"\d+", ref)[0]) - 1
                for k in range(row(a), min(row(b or a) + 1, len(rows))):
                    for j in range(_column(a), min(_column(b or a) + 1, len(rows[k]))):
                        if (k, j) != (row(a), _column(a)):
                            rows[k][j] = None
            out.append((sheet.get("name"), rows))
        return out


def headers(cells: list[str | None], width: int) -> list[str]:
    """Blank ones numbered, spaces collapsed, repeats counted."""
    seen: dict[str, int] = {}
    out = []
    for k in range(width):
        name = " ".join((cells[k] if k < len(cells) and cells[k] else "").split()) or f"Column {k + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return out


def shape(rows: list[list[str | None]], header_row: int = 1, max_rows: int | None = None, max_columns: int = MAX_COLUMNS) -> tuple[list[str], list[tuple[int, list[str]]], int]:
    """(headers, numbered rows, rows in all): blank rows go, short ones are padded, unused columns at the end go."""
    body = rows[header_row:] if header_row else rows
    head = rows[header_row - 1] if header_row and len(rows) >= header_row else []
    width = min(max_columns, max((k + 1 for r in [head, *body] for k, c in enumerate(r) if c and c.strip()), default=0))
    found = [(header_row + k + 1, [(r[j] or "") if j < len(r) else "" for j in range(width)]) for k, r in enumerate(body) if any(c and c.strip() for c in r)]
    return headers(head, width), found if max_rows is None else found[:max_rows], len(found)


TABLE = "sheet string, row_number long, total_rows long, cells map<string,string>"


def grids(data: bytes) -> list[tuple[str | None, list[list[str | None]]]]:
    """(sheet, rows of text): the worksheets of a workbook, or delimited text as one without a name."""
    return read_workbook(data) if data[:4] == b"PK\x03\x04" else [(None, parse_delimited(data.decode("utf-8", "replace")))]


def pick_sheet(names: list[str | None], wanted: str | int | None) -> list[int]:
    """Places of the sheets asked for: all, one by its number from 0, or one by its name in any case."""
    if wanted is None:
        return list(range(len(names)))
    if isinstance(wanted, int):
        found = [wanted] if 0 <= wanted < len(names) else []
    else:
        found = [k for k, n in enumerate(names) if n == wanted] or [k for k, n in enumerate(names) if n is not None and n.lower() == wanted.lower()]
    if not found:
        raise ValueError(f"no sheet {wanted!r}; there are {', '.join(map(str, names))}")
    return found[:1]


def read_table_column(rows: DataFrame, key: str, content: str, header_row: int = 1, max_rows: int | None = None, sheet: str | int | None = None) -> DataFrame:
    """(key, sheet, row_number, total_rows, cells map<string,string>, error): rows of workbooks or delimited text in a binary column."""

    def kernel(data) -> Iterator[dict]:
        found = grids(bytes(data))
        for k in pick_sheet([name for name, _ in found], sheet):
            names, shaped, total = shape(found[k][1], header_row, max_rows)
            yield from ({"sheet": found[k][0], "row_number": n, "total_rows": total, "cells": list(zip(names, cells, strict=True))} for n, cells in shaped)

    return explode_text(rows, key, content, kernel, TABLE)


def sheet_names(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, pos, sheet, error): the sheets of each workbook."""
    return explode_text(rows, key, content, lambda data: ({"pos": k, "sheet": name} for k, (name, _) in enumerate(grids(bytes(data)))), "pos int, sheet string")


def read_tables(spark: SparkSession, path: str, header_row: int = 1, max_rows: int | None = None, sheet: str | int | None = None) -> DataFrame:
    """(path, sheet, row_number, total_rows, cells, error) of delimited files and workbooks; a file is one task's, a broken one a row with its error."""
    return read_table_column(spark.read.format("binaryFile").load(path).select("path", "content"), "path", "content", header_row, max_rows, sheet)


def parse_column(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_number, cells): a row for each record of delimited text in a column."""
    from pyspark.sql import types as T

    slim = rows.select(F.col(key), F.col(text).alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, numbers, cells = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for n, row in enumerate(parse_delimited(t or ""), 1):
                    take.append(k)
                    numbers.append(n)
                    cells.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(numbers, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=[key, "row_number", "cells"])

    return slim.mapInArrow(run, T.StructType([slim.schema[key], T.StructField("row_number", T.LongType()), T.StructField("cells", T.ArrayType(T.StringType()))]))
