"""Packing of tokenised documents by first-fit decreasing with a tournament tree of bin capacities.

Documents are cut into pieces of at most ``capacity`` ids where they are tokenised, pieces go to
randomised groups of bounded expected size, and every group is packed alone.  Group choice hashes a piece's
row number in the kept table of pieces, so that nothing pieces have in common, be it the document, a null id or
being copies, can make a group large, and a retry gives the same.

Defined results: a null or empty text is a document of the end id alone; ties are broken by document
and start; repeated rows are packed as often as they come; an empty table gives no pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm.common import fresh, frugal, keep

CAPACITY, END_ID = 2048, 1
#: Expected pieces of a group: some thousand bins, so the few half-full ones at its end weigh little.
GROUP_PIECES = 8192
#: Bytes of text whose distinct parts are encoded together, words in one call of the library, texts put together at once.
SLICE_BYTES, _TOGETHER, _TEXTS = 24 << 20, 20_000, 500
_MARKS = ".,;:!?#*$%&|>()\""
_PROBES = ("The Quick brown\tfox, JUMPED over\n\nthe lazy dog... (twice!)", "naïve ÉTÉ, 漢字 🙂 a1b2 3.14 don't x_y state-of-the-art #tag $5 50% a|b <b>", " \x0b\x0c\r  ", "Supercalifragilistic; word: word? word\"", "ß İstanbul ﬁne e\u0301té")


class WordIds:
    """Ids of whole texts from ids of their parts between ASCII white space.

    The tokenizer drops white space and no pre-token crosses it, so a text's ids are those of its parts
    in order.  The distinct parts of a slice of texts are encoded once, and texts gather them by position.
    That a tokenizer is of this kind (case doesn't matter, marks are pre-tokens, words end in ``</w>``) is tried
    on ``_PROBES``; another one raises an error.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        for probe, found in zip(_PROBES, self.encode([x.encode() for x in _PROBES]), strict=True):
            if found != self.each([probe])[0].tobytes():
                raise ValueError(f"{path}: texts' ids aren't those of their parts between white space ({probe!r})")

    def each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters and each one's number of them; encoded together and parted after each token that ends a word."""
        ids, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for k in range(0, len(words), _TOGETHER):
            part = words[k : k + _TOGETHER]
            found = self.each([" ".join(part)])[0]
            size = np.diff(np.flatnonzero(self.last[found]), prepend=-1)
            if len(size) != len(part) or size.sum() != len(found):
                one = self.each(part)
                found, size = np.concatenate(one), np.fromiter(map(len, one), np.int64, len(one))
            ids.append(found)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, one after another, and each one's number of them."""
        # case never matters but in special tokens; marks after a word of letters are pre-tokens of their own
        low = pc.ascii_lower(parts)
        base = pc.ascii_rtrim(low, characters=_MARKS)
        plain = pc.and_(pc.utf8_is_alpha(base), pc.invert(pc.match_substring(low, "<")))
        plain_at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        rest = pc.filter(parts, pc.invert(plain))
        bases = pc.filter(base, plain).dictionary_encode()
        ids, sizes = self.words(bases.dictionary.to_pylist())
        units = [(ids, sizes)]
        # the second unit of a part is its marks; number 0 of those is nothing
        marked = pc.filter(low, plain)
        cut = (pc.binary_length(marked).to_numpy() - pc.binary_length(pc.filter(base, plain)).to_numpy()).astype(np.int64)
        some = np.flatnonzero(cut)
        tails = pa.array([x[-n:] for x, n in zip(marked.take(pa.array(some)).to_pylist(), cut[some].tolist(), strict=True)], pa.string()).dictionary_encode()
        for one in ([np.empty(0, "<u4"), *self.each(tails.dictionary.to_pylist())], self.each(rest.to_pylist())):
            units.append((np.concatenate([np.empty(0, "<u4"), *one]), np.fromiter(map(len, one), np.int64, len(one))))
        nothing = len(sizes)
        first = np.empty(len(parts), np.int64)
        second = np.full(len(parts), nothing)
        first[plain_at] = bases.indices.to_numpy()
        first[np.flatnonzero(~plain.to_numpy(zero_copy_only=False))] = nothing + len(units[1][1]) + np.arange(len(rest))
        second[plain_at[some]] = nothing + 1 + tails.indices.to_numpy()
        ids, sizes = (np.concatenate([u[k] for u in units]) for k in (0, 1))
        both = np.stack([first, second], axis=1).ravel()
        return gathered(ids, sizes, np.cumsum(sizes) - sizes, both), sizes[both].reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array | list[bytes | None]) -> Iterator[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers; null counts as empty."""
        texts = pa.array(texts, pa.binary()).cast(pa.string()) if isinstance(texts, list) else texts
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield from self._slice(pc.fill_null(texts.slice(at, to - at), ""))
            at = to

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        lists = pc.ascii_split_whitespace(texts)
        stops = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        ids, sizes = self.parts(coded.dictionary)
        starts, which = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        for k in range(0, len(texts), _TEXTS):
            own = stops[k : k + _TEXTS + 1]
            part = which[own[0] : own[-1]]
            past = np.concatenate([[0], np.cumsum(sizes[part])])[own - own[0]]
            data = gathered(ids, sizes, starts, part).tobytes()
            for a, b in zip((4 * past[:-1]).tolist(), (4 * past[1:]).tolist(), strict=True):
                yield data[a:b]


def gathered(flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ranges of ``flat`` that ``which`` names, one after another."""
    size = sizes[which]
    past = np.cumsum(size)
    return flat[np.repeat(starts[which] - past + size, size) + np.arange(past[-1] if len(past) else 0)]


_ENCODERS: dict[str, WordIds] = {}


def tokenise(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType(), False) for n in ("start", "length")), T.StructField("ids", T.BinaryType(), False), T.StructField("doc_tokens", T.LongType(), False)])
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(path, WordIds(path)) if path not in _ENCODERS else _ENCODERS[path]
        for batch in batches:
            take, starts, lengths, ids, totals = [], [], [], [], []
            for row, got in enumerate(encoder.encode(batch.column(1))):
                got += end
                n = len(got) // 4
                for s in range(0, n, capacity):
                    take.append(row)
                    starts.append(s)
                    lengths.append(min(capacity, n - s))
                    ids.append(got[4 * s : 4 * (s + capacity)])
                    totals.append(n)
            columns = [batch.column(0).take(pa.array(take, pa.int32())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(frugal(run), schema)


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, taken in the order given; every piece goes to the leftmost bin with room.

    The tournament tree holds in each inner node the most room below it; bins not begun have all of it.
    """
    width = 1
    while width < max(1, len(lengths)):
        width *= 2
    room = [capacity] * (2 * width)
    bins, offsets = [], []
    for n in lengths:
        if not 0 < n <= capacity:
            raise ValueError(f"a piece has {n} ids; 1 to {capacity} fit")
        k = 1
        while k < width:
            k *= 2
            if room[k] < n:
                k += 1
        bins.append(k - width)
        offsets.append(capacity - room[k])
        room[k] -= n
        k //= 2
        while k:
            left, right = room[2 * k], room[2 * k + 1]
            most = left if left >= right else right
            if room[k] == most:
                break
            room[k] = most
            k //= 2
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "start"), group_pieces: int = GROUP_PIECES, seed: int = 17) -> DataFrame:
    """``pieces`` with sequence_id and offset; all other columns stay.  ``pieces`` must be a written table, whose
    rows have the same numbers each time it is read."""
    groups = max(1, -(-pieces.count() // group_pieces))
    g = fresh(pieces, "group")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])
    keys = [(length, "descending"), *((c, "ascending") for c in order)]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.drop_columns([g]).sort_by(keys).combine_chunks()
        bins, offsets = first_fit(group.column(length).to_pylist(), capacity)
        first = key[0].as_py() << 32
        return group.append_column("sequence_id", pa.array([first + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = pieces.withColumn(g, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    return dealt.groupBy(g).applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Packed pieces with their ids (binary, little-endian unsigned 32-bit) and the CRC-32 of them, or that alone."""
    pieces = tokenise(docs, path, doc_id, text).withColumn("ids_crc32", F.crc32("ids"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if ids else [])]
    return pack(keep(pieces.select(*columns), "pieces"))


def first_fit_plain(lengths: list[int], capacity: int) -> list[int]:
    """What ``first_fit`` must give, by trying the bins one after another; for tests."""
    rooms: list[int] = []
    bins = []
    for n in lengths:
        k = next((k for k, r in enumerate(rooms) if r >= n), len(rooms))
        if k == len(rooms):
            rooms.append(capacity)
        rooms[k] -= n
        bins.append(k)
    return bins


def padding(lengths_by_sequence: list[int], capacity: int = CAPACITY) -> int:
    """Ids of padding: none for a sequence as long as a power of two, else up to ``capacity``."""
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths_by_sequence)
