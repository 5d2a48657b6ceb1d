"""A PySpark data source for WARC archives: ``format("warc")``.

Reading plans partitions from file sizes: an uncompressed file is cut into ranges, and a range's task
starts at the first record header at or behind its beginning; gzip files are one range each.  Equality
and IN filters on record type, target address, record id and page id are taken over by the source.  A
task parses a record's header first; where the filters reject it, or no column needs the payload, it
seeks over the payload without reading or decoding it.  gzip files are inflated piece by piece, whether
each record is a member of its own or not, so memory holds one record and unwanted payloads are let go.

Any WARC/1.x archive is read: header names in any case, with or without a blank behind the colon, folded
lines; the payload of an ``application/http`` block is what follows its HTTP header.  Addresses stay as they
are written.  Bytes that are no record where one must begin raise an error, so none is lost silently.

Writing makes one archive file per task below the given folder, which all executors must share (the
folder may be any that pyarrow's file systems reach).  File names hold the task attempt, and only the
files of committed attempts are listed in the manifest, so retries of lost tasks leave no records behind.

Defined results: a null payload is empty; null page ids and addresses leave their header out and come back
as null; an empty table gives an archive without records.  A revisit names the record of the response it
refers to; rows that repeat a page id and payload have one record id.  Archives of ours begin with their first
record, without a ``warcinfo`` record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from loomfield.llm.common import keep, scratch_path

SCHEMA = "record_id string, record_type string, target_uri string, page_id long, payload_digest string, payload_length long, refers_to long, payload binary"
_COLUMNS = ("record_id", "record_type", "target_uri", "page_id", "payload_digest", "payload_length", "refers_to", "payload")
_HEADERS = {"warc-record-id": "record_id", "warc-type": "record_type", "warc-target-uri": "target_uri", "x-page-id": "page_id", "warc-payload-digest": "payload_digest", "x-payload-length": "payload_length", "x-refers-to-page-id": "refers_to"}
_PUSHED = ("record_id", "record_type", "target_uri", "page_id", "payload_digest")
_VERSION = b"WARC/1.1\r\n"
_START = b"WARC/1."
_LENGTH = re.compile(rb"(?im)^content-length[ \t]*:[ \t]*(\d+)[ \t]*\r?$")
#: What a header line can't carry as it is.
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_PIECE = 1 << 16
_LONGEST_HEADER = 1 << 20
_DATE = "2000-01-01T00:00:00Z"
RANGE_BYTES = 64 << 20


def file_system(path: str):
    """A pyarrow file system and the path in it; paths without a scheme are local."""
    from pyarrow import fs

    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path if scheme else path
    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page_id: int | None, url: str | None, payload_digest: str) -> str:
    """A response with a page id is named by both and its payload, so that revisits can name it."""
    name = f"{kind} {page_id} {payload_digest}" if page_id is not None and kind == "response" else f"{kind} {page_id} {url} {payload_digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes | None, payload_digest: str, payload_length: int, refers_to: int | None) -> bytes:
    """One record; a revisit has no block, but says the full payload's digest and length."""
    block = b"" if kind == "revisit" else payload or b""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(kind, page_id, url, payload_digest)}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {payload_length}"]
    if url is not None:
        if not url or _UNSAFE.search(url):
            lines += [f"WARC-Target-URI: {quote(url, safe='')}", "X-Target-URI-Quoted: true"]
        else:
            lines.append(f"WARC-Target-URI: {url}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines += [f"WARC-Refers-To: {record_id('response', refers_to, None, payload_digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return _VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    file: str
    records: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: tuple[str, ...]):
        self.path, self.columns = options["path"], columns
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else ""
            if name in _PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[FileRange]:
        from pyarrow import fs

        system, root = file_system(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            files = [(root, info.size)]
        else:
            found = {x.base_name: (x.path, x.size) for x in system.get_file_info(fs.FileSelector(root, recursive=False)) if x.type == fs.FileType.File}
            if "manifest.json" in found:
                with system.open_input_stream(found["manifest.json"][0]) as f:
                    listed = set(json.loads(f.read()))
                found = {k: v for k, v in found.items() if k in listed}
            files = sorted(v for k, v in found.items() if re.search(r"\.warc(\.gz)?$", k))
        out = []
        for path, size in files:
            step = size if path.endswith(".gz") else self.range_bytes
            out += [FileRange(path, s, min(size, s + step)) for s in range(0, size, max(1, step))]
        return out

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks for one partition where there is no file
            return
        system, _ = file_system(self.path)
        rows, size = [], 0
        for row in self._records(system, partition):
            rows.append(row)
            size += len(row["payload"] or b"") + 200
            if size > 8 << 20:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "payload_length": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.columns], names=list(self.columns))

    def _records(self, system, partition: FileRange) -> Iterator[dict]:
        if partition.path.endswith(".gz"):
            yield from self._compressed(system, partition)
            return
        with system.open_input_file(partition.path) as f:
            at, size = _seek_record(f, partition.start), f.size()
            while at is not None and at < partition.end:
                head, body = _header_at(f, at)
                row, length = self._row(head)
                if row is not None and "payload" in self.columns:
                    f.seek(body)
                    _fill(row, head, f.read(length))
                at = body + length + 4
                if at - 4 > size:
                    raise ValueError(f"{partition.path}: the record before {at} is cut off")
                if row is not None:
                    yield row
            # the record that begins behind the range must be where the next range finds it
            if at is not None and at < size and not _believed(f, at):
                raise ValueError(f"{partition.path}: no record at {at}")

    def _compressed(self, system, partition: FileRange) -> Iterator[dict]:
        with system.open_input_stream(partition.path, compression=None) as f:
            stream = Inflated(f)
            while (head := stream.header()) is not None:
                if not head.startswith(_START):
                    raise ValueError(f"{partition.path}: no record at {stream.at - len(head)} of the inflated bytes")
                row, length = self._row(head)
                if row is not None and "payload" in self.columns:
                    _fill(row, head, stream.take(length))
                else:
                    stream.skip(length)
                stream.skip(4, whole=False)
                if row is not None:
                    yield row

    def _row(self, head: bytes) -> tuple[dict | None, int]:
        row: dict = dict.fromkeys(_COLUMNS)
        said = headers(head)
        for name, column in _HEADERS.items():
            row[column] = said.get(name)
        for c in ("page_id", "payload_length", "refers_to"):
            row[c] = int(row[c]) if row[c] is not None and re.fullmatch(r"-?\d+", row[c]) else None
        if row["target_uri"] is not None and said.get("x-target-uri-quoted") == "true":
            row["target_uri"] = unquote(row["target_uri"])
        if row["payload_digest"] is not None:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if "content-length" not in said:
            raise ValueError(f"a record has no length: {head[:200]!r}")
        # of an HTTP block only reading it would tell
        if row["payload_length"] is None and not _is_http(said):
            row["payload_length"] = int(said["content-length"])
        return (row if all(row[k] in v for k, v in self.wanted.items()) else None), int(said["content-length"])


def headers(head: bytes) -> dict[str, str]:
    """Header values by lower-case name; a line that begins with a blank continues the one before, the first of equal names counts."""
    found: dict[str, str] = {}
    name = ""
    for line in re.split("\r?\n", head.decode("utf-8", "replace"))[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            key, _, value = line.partition(":")
            name = key.strip().lower()
            if name in found:
                name = ""
            else:
                found[name] = value.strip()
    return found


def _fill(row: dict, head: bytes, block: bytes) -> None:
    if _is_http(headers(head)):
        block = block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""
    row["payload"] = block


def _is_http(said: dict[str, str]) -> bool:
    return said.get("content-type", "").lower().startswith("application/http")


class Inflated:
    """The bytes of a gzip file's members, one after another, inflated piece by piece."""

    def __init__(self, f):
        self.f, self.raw, self.held, self.at = f, b"", bytearray(), 0
        self.z, self.open = zlib.decompressobj(31), False

    def _more(self) -> bool:
        """Hold some more bytes; false at the end."""
        while True:
            if not self.raw:
                self.raw = self.f.read(_PIECE)
            if not self.raw:
                # what zlib itself still holds back
                out = self.z.decompress(b"", _PIECE) if self.open else b""
                if self.open and not out and not self.z.eof:
                    raise ValueError("a gzip member is cut off")
                self.held += out
                self.open = self.open and not self.z.eof
                return bool(out)
            if not self.open:
                self.raw = self.raw.lstrip(b"\0")  # padding between members
                if not self.raw:
                    continue
                self.z, self.open = zlib.decompressobj(31), True
            out = self.z.decompress(self.raw, _PIECE)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.open = not self.z.eof
            if out:
                self.held += out
                return True

    def header(self) -> bytes | None:
        """Up to the empty line; null at the end of the file."""
        tried = 0
        while (end := self.held.find(b"\r\n\r\n", max(0, tried - 3))) < 0:
            tried = len(self.held)
            if tried > _LONGEST_HEADER or not self._more():
                if self.held.strip():
                    raise ValueError(f"no complete record header at {self.at} of the inflated bytes")
                return None
        return self.take(end + 4)

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError(f"the record at {self.at} of the inflated bytes is cut off")
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += n
        return out

    def skip(self, n: int, whole: bool = True) -> None:
        while n:
            if not self.held and not self._more():
                if whole:
                    raise ValueError(f"the record at {self.at} of the inflated bytes is cut off")
                return
            part = min(n, len(self.held))
            del self.held[:part]
            self.at += part
            n -= part


def _header_at(f, at: int) -> tuple[bytes, int]:
    """A record's header and where its block begins."""
    f.seek(at)
    head = f.read(2048)
    while (end := head.find(b"\r\n\r\n")) < 0:
        more = f.read(1 << 14)
        if not more or len(head) > _LONGEST_HEADER:
            raise ValueError(f"no complete record header at {at}")
        head += more
    if not head.startswith(_START):
        raise ValueError(f"no record at {at}")
    return head[: end + 4], at + end + 4


def _seek_record(f, start: int) -> int | None:
    """Where the first record at or behind ``start`` begins.

    Text in a payload may look like a record's start; one is believed if its header parses and another
    record, or the file's end, follows where its length says.
    """
    if start == 0:
        return 0 if f.size() else None
    f.seek(base := start - 4)
    data = b""
    while True:
        more = f.read(1 << 20)
        found = 0
        data += more
        while (found := data.find(b"\r\n\r\n" + _START, found)) >= 0:
            if _believed(f, at := base + found + 4):
                return at
            found += 1
        if not more:
            return None
        keep_bytes = len(_START) + 3
        base += max(0, len(data) - keep_bytes)
        data = data[-keep_bytes:]
        f.seek(base + len(data))


def _believed(f, at: int) -> bool:
    for _ in range(3):
        try:
            head, body = _header_at(f, at)
        except ValueError:
            return False
        m = _LENGTH.search(head)
        if not m or b"warc-record-id" not in head.lower():
            return False
        at = body + int(m[1]) + 4
        if at >= f.size():
            return at - 4 <= f.size()
    return True


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.gzip = options["path"], options.get("compression", "none") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
        n = 0
        with system.open_output_stream(f"{root}/{name}", compression=None) as f:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = record(row["record_type"], row["page_id"], row["target_uri"], row["payload"], row["payload_digest"], row["payload_length"], row["refers_to"])
                    if self.gzip:
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = z.compress(data) + z.flush()
                    f.write(data)
                    n += 1
        return Written(name, n)

    def commit(self, messages: list[Written]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/manifest.json") as f:
            f.write(json.dumps(sorted(m.file for m in messages if m and m.records)).encode())

    def abort(self, messages: list[Written]) -> None:
        system, root = file_system(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{root}/{m.file}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), tuple(schema.names))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Records of pages: of equal payloads the smallest page id is the response that others revisit.

    Digests of one page need no join; those of several are counted before the shuffle, and joining the
    pages with them splits hot digests.
    """
    payload = F.coalesce(F.encode(F.col(f"`{html}`"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("target_uri"), payload.alias("payload"), F.sha1(payload).alias("hex"), F.octet_length(payload).cast("long").alias("payload_length"))
    shared = rows.where(F.col("payload_length") >= least_bytes).groupBy(F.col("hex").alias("shared")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = keep(shared.drop("n"), "digests")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, rows.hex == shared.shared, "left").select(
        F.lit(None).cast("string").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        "page_id",
        base32(F.col("hex")).alias("payload_digest"),
        "payload_length",
        F.when(again, F.col("first")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def base32(hexed: Column) -> Column:
    """Upper-case base32 of a hex string of whole 20-bit groups."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    quads = F.transform(groups, lambda g: F.array(*[F.substring(letters, F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]))
    return F.array_join(F.flatten(quads), "")


def write(records: DataFrame, path: str, compression: str = "none") -> str:
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").option("path", path).option("compression", compression).save()
    return path


def read(spark, path: str, record_type: str | None = None, columns: tuple[str, ...] = _COLUMNS) -> DataFrame:
    """The archive's records; leave ``payload`` out of ``columns`` where it isn't needed, and it isn't read.

    Turns on the session's setting that lets Python sources take filters over.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    fields = {f.split()[0]: f for f in SCHEMA.split(", ")}
    found = spark.read.format("warc").schema(", ".join(fields[c] for c in columns)).load(path)
    return found.where(F.col("record_type") == record_type) if record_type else found


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages to an archive and read them back: responses with their payload, revisits by their header."""
    spark = pages.sparkSession
    path = write(with_revisits(pages), path or scratch_path(spark, "warc"))
    back = ("page_id", "record_type", "refers_to", "payload_digest", "payload_length")
    responses = read(spark, path, "response", (*back, "payload")).withColumn("payload_length", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32(F.sha1("payload")))
    revisits = read(spark, path, "revisit", back)
    return responses.select(*back).unionByName(revisits)
