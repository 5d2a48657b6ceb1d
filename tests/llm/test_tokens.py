import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from data import documents, frame

from loomfield.llm import byte_bpe, packing, token_counts
from loomfield.llm.common import keep

WORDS, RANKS, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
ALPHABET = " \n\t\r  　\x1c\x1f▁aaébß漢字🙂'sT0123,.<|endoftext|>́​\x00<s>  "


def odd_texts(n=300, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [r[1] or "" for r in documents()]


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    texts = odd_texts()
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordIds(WORDS).encode([t.encode() for t in texts])]
    assert got == want


def test_counts_equal_the_library():
    from sentencepiece import SentencePieceProcessor

    texts = odd_texts()
    model, prefix = token_counts.bare_model(PIECES)
    counter = token_counts.Counter(model, prefix, token_counts.whole_tokens(model))
    assert [counter.count(t) for t in texts] == [len(x) for x in SentencePieceProcessor(model_file=PIECES).encode(texts, num_threads=1)]


def test_count_tokens_on_awkward_rows(spark):
    got = token_counts.count_tokens(frame(spark), PIECES).collect()
    assert len(got) == len(documents())
    assert all(r.n_tokens == 0 and r.n_bytes == 0 for r in got if r.doc_id == 60)
    assert any(r.over_limit for r in got)
    assert token_counts.count_tokens(frame(spark, []), PIECES).count() == 0


def test_bytes_round_trip_and_equal_the_library(spark):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rows = [(k, t, *[None] * 8) for k, t in enumerate(odd_texts())] + [(None, None, *[None] * 8)]
    rows += rows[:3]
    got = byte_bpe.decode(byte_bpe.encode(frame(spark, rows), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert r.ids == library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode()
    assert byte_bpe.encode(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_several_blocks(monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 500)
    batch = pa.RecordBatch.from_pydict({"a": [1, 2, 3], "b": ["x " * 300, "y", None]})
    blocks = list(byte_bpe._blocks(iter([batch])))
    assert [len(b.rows) for b in blocks] == [1, 2]
    assert blocks[0].close()[1] == [b" x", b"x", b" "]


def test_blocks_without_words(spark, monkeypatch):
    for texts in ([None, "", None], ["x " * 300, "", None]):
        rows = [(k, t, *[None] * 8) for k, t in enumerate(texts)]
        with monkeypatch.context() as m:
            m.setattr(byte_bpe, "BLOCK_BYTES", 500)
            docs = frame(spark, rows).coalesce(1)
            got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
        assert {r.doc_id: bytes(r.decoded) for r in got} == {k: (t or "").encode() for k, t in enumerate(texts)}


def test_shuffled_input_and_copies_keep_their_ids(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 200)
    rows = [(k if k % 3 else None, "the same text of many copies" if k % 2 else f"own text {k}", *[None] * 8) for k in range(300)]
    docs = frame(spark, rows).repartition(5).orderBy("lang")
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in got) == Counter((r[0], r[1]) for r in rows)
    # blocks of equal words have names of their own
    batch = pa.RecordBatch.from_pydict({"a": [1] * 60, "b": ["same words here"] * 60, "place": [1] * 30 + [2] * 30})
    names = [b.close()[0] for b in byte_bpe._blocks(iter([batch]))]
    assert len(set(names)) == len(names) > 2


def test_sources_of_plain_reads_are_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(byte_bpe, "keep", lambda df, name: written.append(name) or keep(df, name))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    byte_bpe.source_of(docs, "doc_id", "text")
    byte_bpe.source_of(docs.where("n_chars > 5"), "doc_id", "text")
    assert not written
    byte_bpe.source_of(docs.orderBy("lang"), "doc_id", "text")
    assert written == ["texts"]


def test_tokenizers_and_patterns_of_another_kind_raise():
    with pytest.raises(ValueError):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    byte_bpe.check_pattern(public_tokenizers.PATTERN)
    with pytest.raises(ValueError):
        byte_bpe.check_pattern(r"\S+\s*|\s+")


def test_groups_of_pieces_without_ids(spark):
    rows = [(None, 0, 1 + k % 7, "x") for k in range(3000)]
    pieces = keep(spark.createDataFrame(rows, "doc_id long, start long, length long, sequence_id2 string").repartition(3))
    got = packing.pack(pieces, capacity=16, group_pieces=100).select("sequence_id", "length").toPandas()
    sizes = (got["sequence_id"] // (1 << 32)).value_counts()
    assert len(sizes) == 30 and sizes.max() < 200 and len(got) == 3000
    assert got.groupby("sequence_id")["length"].sum().max() <= 16


def test_packed_ids_are_those_of_the_crc(spark):
    for r in packing.pack_documents(frame(spark), WORDS).collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_decoding_of_odd_ids(spark, monkeypatch):
    ranks = byte_bpe.read_ranks(RANKS)
    token = {v: k for k, v in ranks.items()}
    rows = [(1, [5, 1, 5]), (2, None), (3, []), (4, [-1, 10**9, 7]), (5, list(range(300)) * 3)]
    for together in (200_000, 4):
        monkeypatch.setattr(byte_bpe, "_JOINED", together)
        got = {r.k: r.decoded for r in byte_bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1), RANKS).collect()}
        assert {k: x if x is None else bytes(x) for k, x in got.items()} == {k: x if x is None else b"".join(token.get(i, b"") for i in x) for k, x in rows}


def test_integers_round_trip():
    rng = np.random.default_rng(1)
    for values in (np.empty(0, np.int64), np.asarray([0, 127, 128, 16383, 16384, 1 << 21, (1 << 28) - 1]), rng.integers(0, 1 << 27, 1000)):
        assert byte_bpe.unpack_integers(byte_bpe.pack_integers(values)).tolist() == values.tolist()


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_equals_plain_first_fit(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, 100) for _ in range(rng.randint(0, 300))), reverse=True)
    bins, offsets = packing.first_fit(lengths, 100)
    assert bins == packing.first_fit_plain(lengths, 100)
    ends = Counter()
    for b, o, n in zip(bins, offsets, lengths, strict=True):
        assert o == ends[b]
        ends[b] += n
    assert all(v <= 100 for v in ends.values())
    with pytest.raises(ValueError):
        packing.first_fit([101], 100)


def test_packing_is_whole(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = documents()
    got = packing.pack_documents(frame(spark), WORDS).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    times = Counter(r[0] for r in rows)
    for doc_id, text in {r[0]: r[1] for r in rows}.items():
        if doc_id is None:
            continue
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(pieces[doc_id], key=lambda r: r.start)[:: times[doc_id]]
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert all(p.ids_crc32 == zlib.crc32(np.asarray(ids[p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids) for p in parts)
        assert sum(p.length for p in parts) == len(ids)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 2048
    assert packing.pack_documents(frame(spark, []), WORDS).count() == 0


def test_padding_leaves_powers_of_two():
    assert packing.padding([2048, 1024, 1, 2047]) == 1
