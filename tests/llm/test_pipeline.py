"""The pipeline against a plain-Python version of each stage's decision, on documents of the smallest scale."""

import importlib
import re

import pytest
from test_documents import plain_components, plain_print, plain_quality, plain_spans

pytest.importorskip("corpus_pipeline")


def test_stages_take_effect_and_are_whole(spark, monkeypatch):
    pipeline = importlib.import_module("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language", "quality rules", "near-duplicates", "personal data", "packing"]

    kept = stages["language"](spark, docs, sf_dir)
    assert kept.columns == columns
    letters = {k for k, r in before.items() if re.search(r"[^\W\d_]", r.text)}
    assert {r.doc_id for r in kept.collect()} == letters

    kept = stages["quality rules"](spark, kept, sf_dir)
    found = {r.doc_id for r in kept.collect()}
    for k in letters:
        n, chars, symbols, _, repeats = plain_quality(before[k].text)
        if n < 20 or 100 * repeats > 30 * n or 10 * symbols > n:
            assert k not in found
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    assert all(k in found for k in clean & letters if plain_quality(before[k].text)[0] >= 20)

    prints = {k: plain_print(before[k].text) for k in found}
    roots = plain_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    firsts = {}
    for k in sorted(found):
        firsts.setdefault(roots[prints[k]], k)
    kept = stages["near-duplicates"](spark, kept, sf_dir)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == set(firsts.values())

    cleaned = stages["personal data"](spark, kept, sf_dir)
    assert cleaned.columns == columns
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert texts.keys() == set(firsts.values())
    for k, text in texts.items():
        spans = plain_spans(before[k].text)
        assert (text != before[k].text) == bool(spans)
        assert not plain_spans(text)

    packed = stages["packing"](spark, cleaned, sf_dir).collect()
    assert {r.doc_id for r in packed} == texts.keys()
    whole = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in packed}
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in pipeline.run(spark, sf_dir).collect()} == whole
