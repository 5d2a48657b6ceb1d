"""Exact token counts of a sentence-piece model with a whole-token shortcut.

A model's pieces are looked through once: where no piece has a space mark behind another character, and
none holds a line break, merges never cross the start of a run of spaces or a line break, so a text's
count is the sum of its pre-tokens' counts.  Vocabulary strings that encode alone as themselves are proven
offline and count one token without the merge procedure; all other pre-tokens are merged by the library.

Defined results: a null text counts as empty and has no tokens; space marks in a text equal spaces, as the
library has it; control and unknown piece names in a text are ordinary text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm.common import frugal, utf8

LIMIT = 4096
MARK = "▁"
_NORMAL = 1
_CACHE = 1_000_000
_RUNS = re.compile(" *[^ ]+| +")


def bare_model(path: str) -> tuple[bytes, bool]:
    """The model without its dummy prefix, and whether the model adds one to texts."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, pieces = model.normalizer_spec, [p.piece for p in model.pieces if p.type == _NORMAL]
    if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("pre-tokens are only exact for models that leave texts as they are")
    if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces):
        raise ValueError("a piece crosses a pre-token's border")
    prefix = spec.add_dummy_prefix
    spec.add_dummy_prefix = False
    return model.SerializeToString(), prefix


def whole_tokens(model: bytes) -> list[str]:
    """Vocabulary strings, with spaces for marks, that encode alone as exactly their own piece."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    processor = SentencePieceProcessor(model_proto=model)
    own = [(i, p.piece.replace(MARK, " ")) for i, p in enumerate(proto.pieces) if p.type == _NORMAL]
    found = processor.encode([s for _, s in own], num_threads=1)
    return [s for (i, s), ids in zip(own, found, strict=True) if ids == [i]]


class _Counts(dict):
    """Counts of pre-tokens; those not proven are merged by the library and remembered."""

    def __init__(self, processor, proven: dict[str, int], lead: str):
        super().__init__(proven)
        self.processor, self.proven, self.lead = processor, proven, lead

    def __missing__(self, word: str) -> int:
        n = len(self.processor.encode(self.lead + word))
        if len(self) > _CACHE:
            self.clear()
            self.update(self.proven)
        self[word] = n
        return n


class Counter:
    def __init__(self, model: bytes, prefix: bool, proven: list[str]):
        from sentencepiece import SentencePieceProcessor

        processor = SentencePieceProcessor(model_proto=model)
        self.prefix = " " if prefix else ""
        self.bare = _Counts(processor, dict.fromkeys(proven, 1) | {"": 0}, "")
        spaced = {s[1:]: 1 for s in proven if s.startswith(" ") and len(s) > 1 and s[1] != " "}
        self.spaced = _Counts(processor, spaced, " ")

    def count(self, text: str) -> int:
        if not text:
            return 0
        lines = (self.prefix + text.replace(MARK, " ")).split("\n")
        total, bare, spaced = len(lines) - 1, self.bare.__getitem__, self.spaced.__getitem__
        for line in lines:
            if "  " in line or line.endswith(" "):
                total += sum(map(bare, _RUNS.findall(line)))
            else:
                words = line.split(" ")
                total += bare(words[0]) + sum(map(spaced, words[1:]))
        return total


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    model, prefix = bare_model(path)
    # bounded by the vocabulary, whatever the size of the input
    sent = docs.sparkSession.sparkContext.broadcast((model, prefix, whole_tokens(model)))
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("over_limit", T.BooleanType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*sent.value)
        for batch in batches:
            texts = [x or b"" for x in utf8(batch.column(1))]
            counts = [counter.count(x.decode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=schema.names)

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(frugal(run), schema)
