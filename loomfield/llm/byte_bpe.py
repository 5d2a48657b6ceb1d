"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by the token-byte table.

Texts are cut into words where the public pattern always has a border: a run without white space with the
space before it, or white space alone; the library splits a word further.  Words are gathered in blocks of
bounded size.  A block is its dictionary (distinct words, the frequent ones first) and each text's positions
in it, as variable-length integers.  Dictionary words are shuffled by word, all words of one hash bucket in
one row, so that one task encodes a distinct word once; the ids return to their blocks, where texts are put
together again by position.  A block sends a word once, not for each use, so frequent words weigh no more
than rare ones.

A block is named by its dictionary, the file range its rows come from and its number there, so a task that runs
again finds its words again, and blocks of copies stay apart.  Input that isn't a plain read of files is written
to a table first, as its rows may come in another order each time.

Decoding looks ids up in the table of token bytes, a map-side join: the table has a row for each token of the
vocabulary, whatever the input's size.

Defined results: a null text is empty and has no ids; extra columns are ignored; repeated rows repeat.  A pattern
that has no border where texts are cut, tried on ``_PROBES``, raises an error.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm.common import frugal, keep, utf8

#: Bytes of text and distinct words after which a block is closed.
BLOCK_BYTES, BLOCK_WORDS = 16 << 20, 300_000
#: Fewest hash buckets of words; more where the session shuffles to more tasks.
BUCKETS = 256
_CACHE = 300_000
#: Ids decoded together.
_JOINED = 200_000
_TEXT, _ORDER = -1, -2
#: White space as Unicode (and so the library's pattern engine) has it; Python's own \s has four more.
_W = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PARTS = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]")
_PROBES = ("The Quick  brown\tfox, it's \n\n the 3.14 dogs' x_y", " naïve ÉTÉ, 漢字 🙂\x85a\xa0b\u2003c  \u3000 d", "a\x1cb\x1d c\r\n  \r\n e", "   ", "x   y    z \n q")
#: Ends a word in a row; no UTF-8 text has that byte.
_END = b"\xff"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pack_integers(values: np.ndarray) -> bytes:
    """Non-negative integers below 2^28, seven bits a byte, the last byte of each below 128."""
    sizes = 1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    left = values
    for back in range(int(sizes.max(initial=0))):
        some = sizes > back
        out[ends[some] - 1 - back] = (left[some] & 127) | (128 if back else 0)
        left = left >> 7
    return out.tobytes()


def unpack_integers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(4):
        some = first + k <= last
        out[some] = (out[some] << 7) | (raw[first[some] + k] & 127)
    return out


class _Block:
    def __init__(self, place: int = 0, number: int = 0):
        self.place, self.number = place, number
        self.index: dict[str, int] = {}
        self.bytes, self.rows, self.texts = 0, [], []

    def add(self, row, text: bytes) -> None:
        index = self.index
        add = index.setdefault
        self.texts.append(np.fromiter((add(w, len(index)) for w in _PARTS.findall(text.decode())), np.int32))
        self.rows.append(row)
        self.bytes += len(text)

    def full(self) -> bool:
        return self.bytes >= BLOCK_BYTES or len(self.index) >= BLOCK_WORDS

    def close(self) -> tuple[int, list[bytes], list[np.ndarray]]:
        """Its name, the words by falling frequency, and each text's positions among them."""
        uses = np.bincount(np.concatenate([*self.texts, np.empty(0, np.int32)]), minlength=len(self.index))
        order = np.argsort(-uses, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        words = [w.encode() for w in self.index]
        words = [words[k] for k in order.tolist()]
        name = xxhash.xxh3_64_intdigest(b"%d %d " % (self.place, self.number) + _END.join(words))
        return name - (1 << 63), words, [rank[x] for x in self.texts]


def by_bucket(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's bucket, and the words' order by bucket."""
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    return bucket, np.argsort(bucket, kind="stable")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Blocks of rows (id, text, place), each of one place only, numbered there."""
    block = _Block()
    for batch in batches:
        places = batch.column(2).to_pylist() if batch.num_columns > 2 else [0] * batch.num_rows
        for row, text, place in zip(batch.column(0), utf8(batch.column(1)), places, strict=True):
            if block.rows and (place != block.place or block.full()):
                yield block
                block = _Block(place, block.number + 1 if place == block.place else 0)
            block.place = place
            block.add(row, text or b"")
    if block.rows:
        yield block


def check_pattern(pattern: str) -> None:
    """Whether matches of ``pattern`` end wherever texts are cut."""
    import regex

    for probe in _PROBES:
        ends = {m.end() for m in regex.finditer(pattern, probe)}
        if "".join(_PARTS.findall(probe)) != probe or not {m.end() for m in _PARTS.finditer(probe)} <= ends:
            raise ValueError(f"the pattern has no border at all cuts of {probe!r}")


def source_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, place): rows in an order that holds, with the file range they come from."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    plan = slim._jdf.queryExecution().sparkPlan().toString()
    if not re.fullmatch(r"(?:(?:[:+\- ]*)(?:Project|Filter|FileScan) .*\n?)+", plan):
        slim = keep(slim, "texts")
    return slim.select("doc_id", "text", F.xxhash64(F.input_file_name(), F.call_function("input_file_block_start")).alias("place"))


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row."""
    check_pattern(pattern)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # bounded by the vocabulary
    kind = docs.schema[doc_id].dataType
    buckets = max(BUCKETS, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["block", "at", "data", "doc_id"]
    source = source_of(docs, doc_id, text)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            name, found, _ = block.close()
            if not found:  # only empty or null texts
                continue
            bucket, order = by_bucket(found, buckets)
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
            ordered = [found[k] for k in order.tolist()]
            squeeze = zstandard.ZstdCompressor(3).compress
            data = [squeeze(_END.join(ordered[a:b])) for a, b in zip(cuts, [*cuts[1:], len(ordered)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[cuts]], pa.int32()), pa.array([name] * len(data), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "block", "words"])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        tokens = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})._core_bpe.encode_ordinary
        squeeze, expand = zstandard.ZstdCompressor(3).compress, zstandard.ZstdDecompressor().decompress
        kind, known = "H" if max(ranks.value.values()) < 1 << 16 else "I", {}
        for batch in batches:
            for bucket, block, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = expand(row).split(_END)
                if missing := [w for w in found if w not in known]:
                    if len(known) > _CACHE:
                        known.clear()
                        missing = found
                    for w in missing:
                        known[w] = array(kind, tokens(w.decode())).tobytes()
                parts = [known[w] for w in found]
                # sizes first: one unsigned 16-bit number a word, or 32-bit where a word is that long
                sizes = array("H" if len(max(parts, key=len)) < 1 << 16 else "I", map(len, parts))
                data = squeeze(sizes.itemsize.to_bytes(1, "little") + len(parts).to_bytes(4, "little") + sizes.tobytes() + b"".join(parts))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary()), pa.nulls(1, id_type)], names=names)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            name, found, texts = block.close()
            order = by_bucket(found, buckets)[1]
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([_ORDER], pa.int32()), pa.array([place.astype("<u4").tobytes()], pa.binary()), pa.nulls(1, id_type)], names=names)
            for k in range(0, len(texts), 1000):
                part = texts[k : k + 1000]
                rows = pa.array([x.as_py() for x in block.rows[k : k + 1000]], id_type)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.int64()), pa.array([_TEXT] * len(part), pa.int32()), pa.array([pack_integers(x) for x in part], pa.binary()), rows], names=names)

    def together(group: pa.Table) -> Iterator[pa.RecordBatch]:
        at = group.column("at").to_numpy()
        data, rows = group.column("data"), group.column("doc_id").combine_chunks()
        expand = zstandard.ZstdDecompressor().decompress
        kind = "<u2" if max(ranks.value.values()) < 1 << 16 else "<u4"
        by = {int(at[k]): k for k in np.flatnonzero(at >= 0)}  # equal blocks send equal words
        sizes, flat = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for b in sorted(by):
            raw = expand(data[by[b]].as_py())
            n, wide = int.from_bytes(raw[1:5], "little"), raw[0]
            sizes.append(np.frombuffer(raw, f"<u{wide}", n, 5).astype(np.int64) // int(kind[2]))
            flat.append(np.frombuffer(raw, kind, -1, 5 + n * wide).astype(np.int32))
        sizes, flat = np.concatenate(sizes), np.concatenate(flat)
        place = np.frombuffer(data[int(np.flatnonzero(at == _ORDER)[0])].as_py(), "<u4") if (at == _ORDER).any() else None
        if place is None or len(place) != len(sizes):
            raise RuntimeError("a block's words are missing: the input's files changed while they were read")
        sizes, starts = sizes[place], (np.cumsum(sizes) - sizes)[place]
        texts = np.flatnonzero(at == _TEXT)
        for k in range(0, len(texts), 500):
            part, found, stops = texts[k : k + 500], [np.empty(0, np.int32)], [0]
            for t in part.tolist():
                where = unpack_integers(data[t].as_py())
                size = sizes[where]
                past = np.cumsum(size)
                total = int(past[-1]) if len(past) else 0
                found.append(flat[np.repeat(starts[where] - past + size, size) + np.arange(total)])
                stops.append(stops[-1] + total)
            lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
            taken = rows.take(pa.array(part, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken, lists], names=["doc_id", "ids"])

    def regroup(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together(pa.Table.from_batches(batches).combine_chunks())

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("doc_id", kind)])
    encoded = source.mapInArrow(frugal(words), "bucket int, block long, words binary").repartition("bucket").mapInArrow(frugal(ids), schema)
    both = encoded.unionByName(source.mapInArrow(frugal(places), schema))
    return both.groupBy("block").applyInArrow(regroup, T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


class TokenBytes:
    """The table of token bytes by id: where each token's bytes begin in one buffer, and how many they are."""

    def __init__(self, ranks: dict[bytes, int]):
        by_rank = {rank: token for token, rank in ranks.items()}
        tokens = [by_rank.get(k, b"") for k in range(max(by_rank, default=-1) + 1)]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and where each id's end; an id that the table hasn't has none."""
        there = (ids >= 0) & (ids < len(self.sizes))
        at = np.where(there, ids, 0)
        size = np.where(there, self.sizes[at], 0) if len(self.sizes) else np.zeros(len(ids), np.int64)
        ends = np.cumsum(size)
        first = self.starts[at] if len(self.sizes) else at
        return self.flat[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids: a join with the token-byte table on the map side; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(TokenBytes(read_ranks(path)))  # bounded by the vocabulary
    at, schema = encoded.columns.index(ids), T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, found = batch.column(at), []
            stops = lists.offsets.to_numpy().astype(np.int64)
            k = 0
            while k < len(lists):  # some hundred thousand ids at a time, or one long list
                to = max(k + 1, int(np.searchsorted(stops, stops[k] + _JOINED, "right")) - 1)
                flat, ends = sent.value.join(lists.values[stops[k] : stops[to]].to_numpy(zero_copy_only=False).astype(np.int64))
                past = np.concatenate([[0], ends])[stops[k : to + 1] - stops[k]].tolist()
                data = flat.tobytes()
                found += [data[a:b] for a, b in zip(past, past[1:], strict=False)]
                k = to
            if lists.null_count:
                found = [x if there else None for x, there in zip(found, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, out])

    return encoded.mapInArrow(frugal(run), schema)
