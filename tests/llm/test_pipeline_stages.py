"""Every stage against a plain-Python version of its definition, over whole tables, and all stages on awkward rows."""

import importlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from data import frame
from test_documents import plain_components, plain_kept, plain_print, plain_shingles, plain_spans, plain_terms

from loomfield.llm.common import keep

pytest.importorskip("corpus_pipeline")
SF_DIR = "/root/testdata/sf0.001"


def cleaned(text, terms):
    """The text with its spans replaced by their kinds; terms of the whole corpus are given."""
    spans = plain_spans(text)
    marks = [(a, -b, kind.upper()) for kind, a, b in spans]
    for term, gone in terms:
        marks += [(m.start(), -m.end(), None if gone else "TERM") for m in re.finditer(rf"(?<![^\W\d_]){re.escape(term)}(?![^\W\d_])", text)]
    out, at = [], 0
    for a, b, kind in sorted(marks, key=lambda x: x[:2]):
        if a >= at:
            out += [text[at:a], f"[{kind}]" if kind else ""]
        at = max(at, -b)
    return "".join(out) + text[at:]


def test_stages_by_plain_versions(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(pipeline.STAGES)

    kept = stages["language"](spark, docs, SF_DIR)
    alive = {r.doc_id for r in kept.collect()}
    assert alive == {k for k, r in rows.items() if re.search(r"[^\W\d_]", r.text)}

    kept = stages["quality rules"](spark, kept, SF_DIR)
    alive = sorted(r.doc_id for r in kept.collect())
    assert alive == sorted(k for k, r in rows.items() if plain_kept(r.text) and re.search(r"[^\W\d_]", r.text))

    prints, sets = {k: plain_print(rows[k].text) for k in alive}, {k: plain_shingles(rows[k].text) for k in alive}

    def linked(a, b):
        return (prints[a] ^ prints[b]).bit_count() <= 2 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0

    kept = stages["near-duplicates"](spark, kept, SF_DIR)
    assert kept.columns == docs.columns
    alive = sorted(r.doc_id for r in kept.collect())
    assert alive == sorted(set(plain_components(sorted(prints), linked).values()))

    texts = [rows[k].text for k in alive]
    found = plain_terms(texts)
    words = [set(re.findall(r"[^\W\d_]+", t)) for t in texts]
    held = [bool(plain_spans(t)) for t in texts]
    clean = {r.doc_id: r.text for r in stages["personal data"](spark, kept, SF_DIR).collect()}
    for k, text, terms, spots in zip(alive, texts, found, held, strict=True):
        # a term goes where every text that has it holds the entity too
        told = [(t, all(h for h, w in zip(held, words, strict=True) if t in w)) for t in terms]
        assert clean[k] == (cleaned(text, told) if spots else text)
        assert not plain_spans(clean[k])

    kept = spark.createDataFrame([(k, clean[k], "en", "s", 0) for k in alive], docs.schema)
    packed = stages["packing"](spark, kept, SF_DIR).collect()
    assert {r.doc_id for r in packed} == set(alive)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in packed)
    whole = {(r.doc_id, r.start, r.length, bytes(r.ids)) for r in packed}
    assert {(r.doc_id, r.start, r.length, bytes(r.ids)) for r in pipeline.run(spark, SF_DIR).collect()} == whole


def test_stages_on_awkward_and_no_rows(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for rows in (None, []):
        docs = frame(spark, rows)
        docs = keep(docs)
        for name, stage in pipeline.STAGES:
            before, columns = docs, docs.columns
            docs = keep(stage(spark, docs, SF_DIR))  # stages are written and read again
            if name != "packing":
                assert docs.columns == columns
            if name != "personal data" and name != "packing":
                assert not Counter(map(str, docs.collect())) - Counter(map(str, before.collect()))
        texts = {r.doc_id: r.text for r in before.collect()}
        found = docs.collect()
        assert (rows is None) == bool(found)
        for doc_id in texts:
            own = sorted((r for r in found if r.doc_id == doc_id), key=lambda r: r.start)
            ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1]
            assert b"".join(bytes(r.ids) for r in own) == np.asarray(ids, "<u4").tobytes()
