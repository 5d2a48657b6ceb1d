"""Content blocks, chains and settings, tracing, the registry, column mappings, tables, mail and the evaluation command."""

import io
import json

import pytest
from pyspark.sql import functions as F

from loomfield.__main__ import main
from loomfield.operators import coerce as co
from loomfield.operators import content, fluent, mapping, sources, tracing
from loomfield.plans import schema as s
from loomfield.sources import delimited, images, mail, pdf, transcripts, writers

SOURCES = "item_id long, pos int, kind string, label string, text string, media_type string, max_chars int"


def test_blocks_of_text_alone_equal_the_rendered_input(spark):
    rows = spark.createDataFrame([(1, 0, "text", "A", "one </source> two", None, None), (1, 1, "text", None, "three", None, None), (2, 0, "image", None, None, None, None), (2, 1, "image", 'x"y', None, "image/png", None)], SOURCES)
    blocks = content.content_blocks(rows).orderBy("item_id", "block").collect()
    rendered = {r.item_id: r.user_input for r in sources.render_sources(rows).collect()}
    assert [(b.type, b.text) for b in blocks if b.item_id == 1] == [("text", rendered[1])]
    assert [(b.type, b.text, b.pos) for b in blocks if b.item_id == 2] == [
        ("text", '<source type="image">\n', None),
        ("image", None, 0),
        ("text", '\n</source>\n\n<source label="x&quot;y" type="image/png">\n', None),
        ("image", None, 1),
        ("text", "\n</source>", None),
    ]
    assert content.source_rules(["text"]) == content.SOURCE_RULES and content.source_rules(["image", "text"]).endswith(content.BINARY_RULES)
    assert content.content_blocks(rows.limit(0)).count() == 0
    sent = rows.select(content.sendable(F.col("kind"), F.col("media_type")).alias("s")).collect()
    assert [r.s for r in sent] == [True, True, None, True]


FULL = s.Schema("Full", "All", {"name": s.string(), "key": s.number()})
SHORT = s.Schema("Short", "Some", {"key": s.number(), "other": s.string()})


def test_chains_settings_and_spans(spark):
    fluent.reset()
    with pytest.raises(ValueError):
        fluent.of_values(spark, ["name: a"])
    spans = tracing.MemorySink()
    fluent.configure(provider=co.ScriptedProvider(("name", "key")), sinks=(spans,))
    try:
        first = fluent.of_values(spark, ["name: a\nkey: 3", "name: b"]).coerce_to(FULL)
        assert {r.item_id: r.status for r in first.answers.collect()} == {0: "ok", 1: "failed"}
        both = first.partial_to(SHORT, provider=co.ScriptedProvider(("key",)))
        found = {r.item_id: (r.status, r.data_json) for r in both.answers.collect()}
        assert found[0][0] == "ok" and json.loads(found[0][1])["key"] == 3 and found[1][0] == "failed"
        assert [x.attributes["schema"] for x in spans] == ["Full", "Short"] and both.steps == ("Full", "Short")
    finally:
        fluent.reset()


def test_answers_are_kept(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    where = str(calls)

    class Counting(co.ScriptedProvider):  # local, so that executors get it by value
        def extract(self, request):
            open(f"{where}/{len(__import__('os').listdir(where))}", "w").close()
            return super().extract(request)

    rows = spark.createDataFrame([(1, 0, "text", None, "name: a\nkey: 1", None, None)], SOURCES)
    found = co.coerce(rows, FULL, Counting(("name", "key")), answers_path=f"file://{tmp_path}/answers")
    assert [found.count() for _ in range(3)] == [1, 1, 1] and len(list(calls.iterdir())) == 1
    assert found.first().status == "ok"


def test_tracing(spark):
    kept, out = tracing.MemorySink(), io.StringIO()
    tracer = tracing.Tracer((kept, lambda x: tracing.console_sink(x, out)), {"item": 7})
    with pytest.raises(RuntimeError), tracer.span("outer", mode="x") as outer:
        with tracer.span("inner", outer) as inner:
            inner.event("call", tokens=3)
        raise RuntimeError("no")
    rows = {r.name: r for r in kept.table(spark).collect()}
    assert rows["inner"].parent_id == rows["outer"].id and rows["inner"].events[0].attributes == {"tokens": "3"}
    assert rows["outer"].attributes == {"item": "7", "mode": "x"} and rows["outer"].events[0].name == "error" and rows["outer"].ended >= rows["outer"].started
    assert out.getvalue().count("\n") == 4


def test_registry_priming_and_stripping(spark):
    inner = s.Schema("Inner", "In", {"x": s.string()})
    registry = s.Registry(s.Schema("Outer", "Out", {"in": s.nested(inner)}))
    assert registry.ids() == ["Outer", "Inner"] and registry.get("none") is None and registry.require("Inner") == inner
    with pytest.raises(KeyError):
        registry.require("none")
    assert co.prime(co.ScriptedProvider(("name",)), FULL)["completion_tokens"] == 8
    rows = spark.createDataFrame([('{"name":null,"key":2}',), ('{"name":"a"}',), (None,)], "data_json string")
    assert [r.data_json for r in co.strip_nulls(rows, FULL).collect()] == ['{"key":2.0}', '{"name":"a"}', None]


def test_mapping_schema_and_text(spark):
    target = s.Schema("Place", "A place", {"name": s.string("Its name"), "at": s.nested(s.Schema("Address", "Where", {"city": s.string("Town")}))})
    made = mapping.mapping_schema(target)
    shape = json.dumps(made.json_schema())
    assert made.id == "PlaceColumnMapping" and '"at.city"' in shape and "Town" in shape
    assert mapping.mapping_of({"columns": [{"column": "Ort", "field": "at.city"}, {"column": "x"}]}) == [("Ort", "at.city"), ("x", None)]
    with pytest.raises(ValueError):
        mapping.mapping_schema(s.Schema("Empty", "None", {}))
    rows = spark.createDataFrame([(1, k, ["Key", "A"], [str(k), None if k == 2 else "b\nc"]) for k in range(1, 8)], "t int, row_number int, headers array<string>, cells array<string>")
    assert mapping.mapping_texts(rows, "t", sample_rows=2).first().text == "Columns (2):\n1. Key\n2. A\n\nSample rows (2 of 7):\nKey | A\n1   | b c\n2   |"


def test_tables_sheets_and_broken_files(spark, tmp_path):
    book = writers.xlsx("Data", [["a", "b"], [1, "x"]])
    rows = spark.createDataFrame([(1, book), (2, b"PK\x03\x04broken"), (3, b"a;b\n1;2\n"), (4, None)], "k int, content binary")
    found = {r.k: r for r in delimited.read_table_column(rows, "k", "content").collect()}
    assert found[1].cells == {"a": "1", "b": "x"} and found[2].error and found[3].cells == {"a": "1", "b": "2"} and 4 not in found
    picked = delimited.read_table_column(rows.where("k = 1"), "k", "content", sheet="dAtA").first()
    assert picked.sheet == "Data" and delimited.read_table_column(rows.where("k = 1"), "k", "content", sheet=3).first().error
    (tmp_path / "one.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "two.xlsx").write_bytes(b"PK\x03\x04broken")
    files = {r.path.rsplit("/", 1)[-1]: r for r in delimited.read_tables(spark, str(tmp_path)).collect()}
    assert files["one.csv"].cells == {"a": "1", "b": "2"} and files["two.xlsx"].error


def test_forwards_and_replies():
    assert mail.strip_quotes("New\n\nOn Mon, Ann wrote:\n> old\n\nLast") == "New\n\nLast"
    assert mail.strip_quotes("New\n\n-----Original Message-----\nFrom: a\nold") == "New"
    assert mail.strip_quotes("New\n\nFrom: Ann\nSent: Monday\nSubject: x\n\nold") == "New"
    forward = "Look\n\n-----Original Message-----\nFrom: Ann\nSubject: x\n\nfirst\n> quoted inside\n\n-----Original Message-----\nolder"
    assert mail.strip_quotes(forward, True) == "Look\n\n-----Original Message-----\nFrom: Ann\nSubject: x\n\nfirst\nquoted inside"
    assert mail.strip_quotes("Hi\n---------- Forwarded message ---------\n> kept\n>> history").endswith("kept")


def test_turns_by_a_loop(spark):
    rows = [(k % 3, float(k), float(k + 1), "AB"[k // 9 % 2] if k % 7 else None, f"t{k}" if k % 5 else None) for k in range(200)]
    want = []
    for item in range(3):
        block = None
        for row in sorted((r for r in rows if r[0] == item), key=lambda r: r[1]):
            if block and block[3] == row[3] and row[2] - block[1] <= 20:
                block[2], block[4] = max(block[2], row[2]), block[4] + ([row[4]] if row[4] else [])
            else:
                want += [block] if block else []
                block = [*row[:4], [row[4]] if row[4] else []]
        want.append(block)
    got = transcripts.coalesce_segments(spark.createDataFrame(rows, "item int, start double, end double, speaker string, text string").repartition(5), "item", 20.0).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((*w[:4], " ".join(w[4]))) for w in want)


def test_exif_and_pdf_facts(spark):
    photo = writers.with_exif(writers.jpeg(4, 3, writers.exif_block(camera="old")), writers.exif_block(camera="Cam", place=(-1.5, 2.25)))
    rows = spark.createDataFrame([(1, photo)], "k int, content binary")
    r = images.read_images(rows, "k", "content").first()
    assert (r.width, r.height) == (4, 3) and r.facts["camera"] == "Cam" and float(r.facts["latitude"]) == -1.5
    assert [str(pdf.parse_date(x)) for x in ("D:2026", "D:20260102030405-0130", "x")] == ["2026-01-01 00:00:00+00:00", "2026-01-02 04:34:05+00:00", "None"]
    xmp = writers.pdf(["a"]).replace(b"<< /Title () >>", b"<< >>") + b"<x:xmpmeta><dc:title><rdf:Alt><rdf:li>From XMP</rdf:li></rdf:Alt></dc:title></x:xmpmeta>"
    assert pdf.info(xmp)["title"] == "From XMP"


def scripted():
    return co.ScriptedProvider(("name", "key"))


def test_evaluation_command(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "f.json").write_text(json.dumps([{"name": "one", "input": "name: a\nkey: 1", "expected": {"name": "a", "key": 1}}, {"name": "two", "input": "name: b\nkey: 2", "expected": {"name": "b", "key": 9}}]))
    base = ["eval", str(tmp_path / "f.json"), "--schema", f"{__name__}:FULL", "--provider", f"{__name__}:scripted"]
    assert main([*base, "--report", str(tmp_path / "report")]) == 0
    assert "2 fixtures, 1 exact, 0 failed" in capsys.readouterr().out
    assert main([*base, "--min-precision", "0.9"]) == 1
    assert "below its gate: key" in capsys.readouterr().err
