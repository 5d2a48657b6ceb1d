import json

import pytest
from pyspark.sql import functions as F

from loomfield.operators import coerce as co
from loomfield.operators import provenance, providers, repair, report
from loomfield.plans import extract
from loomfield.plans import schema as s

PERSON = s.Schema("Person", "A person", {"name": s.string().constrain(max_length=10), "age": s.number().constrain(minimum=0).optional()})


def stubborn():
    class Stubborn:  # local, so that executors get it by value
        """Wrong at first; right once told of it."""

        def extract(self, request):
            told = "Earlier answer" in request.user_input
            return co.Response({"name": "Al" if told else "A name too long", "age": 3}, {"prompt_tokens": 10, "completion_tokens": 2})

    return Stubborn()


def sources(spark, texts):
    rows = [(k, 0, "text", None, t, None, None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "item_id long, pos int, kind string, label string, text string, media_type string, max_chars int")


def test_repair_rounds(spark, tmp_path):
    got = repair.coerce_with_repair(sources(spark, ["a", "b"]), PERSON, stubborn(), f"file://{tmp_path}/r", rounds=2).collect()
    assert [(r.status, r.rounds, json.loads(r.data_json)["name"], r.usage.calls, r.attempts) for r in got] == [("ok", 1, "Al", 2, 2)] * 2
    none = repair.coerce_with_repair(sources(spark, ["a"]), PERSON, stubborn(), f"file://{tmp_path}/n", rounds=0).first()
    assert none.status == "failed" and none.error == "validation"


def test_correction_text(spark):
    issues = [("name", "too long", '"' + "x" * 300 + '"'), ("", "Expected a JSON object", None)]
    row = spark.createDataFrame([(issues,)], "i array<struct<path:string,message:string,received:string>>").select(repair.correction(F.col("i")).alias("t")).first()
    lines = row.t.split("\n")
    assert lines[1].startswith('- name: too long (received "xxx') and len(lines[1]) < 240 and lines[2] == "- answer: Expected a JSON object"


def test_provenance_schema_and_split(spark):
    wrapped = provenance.wrapped(PERSON, ["name"], several_sources=True)
    shape = wrapped.json_schema()
    assert set(shape["properties"]["name"]["properties"]) == {"value", "confidence", "evidence", "source"} and shape["properties"]["age"]["type"] == "number"
    with pytest.raises(ValueError):
        provenance.wrapped(PERSON, ["nope"])
    answers = ['{"name":{"value":"Al","confidence":"high","evidence":" ","source":"S"},"age":{"value":4,"confidence":"sure"},"x":1}', '{"name":"bare"}', "nonsense"]
    got = provenance.split(spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, data_json string"), PERSON).orderBy("k").collect()
    assert json.loads(got[0].data_json) == {"name": "Al", "age": 4}
    assert got[0].provenance["name"].asDict() == {"confidence": "high", "evidence": None, "source": "S"} and got[0].provenance["age"]["confidence"] is None
    assert json.loads(got[1].data_json) == {"name": "bare", "age": None} and got[1].provenance == {}
    assert got[2].data_json == "nonsense"


def test_eval_run(spark, tmp_path):
    folder = tmp_path / "fixtures"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps({"name": "first", "input": "name: Al\nage: 3", "expected": {"name": "Al", "age": 3}}))
    (folder / "more.json").write_text(json.dumps([{"input": "name: Bo", "expected": {"name": "Bo", "age": 5}}, {"name": "third", "input": "name: Cy\nage: 7", "expected": {"name": "Di", "age": 7}}]))
    fixtures = report.load_fixtures(spark, str(folder))
    assert sorted(r.name for r in fixtures.collect()) == ["first", "more#0", "third"]
    items, _, stats = report.run_eval(fixtures, PERSON, co.ScriptedProvider(("name", "age")), strict=False)
    assert {r.path: (r.tp, r.fp, r.fn) for r in stats.collect()} == {"name": (2, 1, 1), "age": (2, 0, 1)}
    total = report.totals(items, {"input": 3.0, "output": 15.0}).first()
    assert (total["items"], total["exact"]) == (3, 1) and total["cost"] > 0
    report.save_report(stats, f"file://{tmp_path}/report")
    again = report.load_report(spark, f"file://{tmp_path}/report")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, stats.collect()))
    assert [r.path for r in report.below(stats, least_precision=0.9).collect()] == ["name"]
    assert report.format_report(stats).split("\n")[1].split() == ["age", "100", "%", "67", "%", "2", "0", "1"]


def test_adapters():
    seen = {}

    def post(status, body):
        def run(url, headers, sent, timeout):
            seen["body"] = sent
            return status, body

        return run

    ask = co.Request("sys", "text", {"type": "object"})
    tool = providers.ToolCallProvider("http://x", "m", post=post(200, {"content": [{"type": "tool_use", "input": {"a": 1}}], "usage": {"input_tokens": 5, "output_tokens": 2}}))
    got = tool.extract(ask)
    assert got.data == {"a": 1} and got.usage["prompt_tokens"] == 5 and seen["body"]["tool_choice"]["name"] == "extract"
    text = providers.StructuredOutputProvider("http://x", "m", post=post(200, {"choices": [{"message": {"content": '{"a": 2}'}}], "usage": {"prompt_tokens": 9, "prompt_tokens_details": {"cached_tokens": 4}}}))
    assert text.extract(ask).usage == {"prompt_tokens": 5, "completion_tokens": 0, "cache_read_tokens": 4, "cache_write_tokens": 0}
    for status, body, kind, again in ((429, {}, "api", True), (500, {}, "api", True), (400, {}, "api", False), (200, {"stop_reason": "max_tokens"}, "truncated", False), (200, {"content": []}, "no_output", False)):
        with pytest.raises(co.ProviderError) as e:
            providers.ToolCallProvider("http://x", "m", post=post(status, body)).extract(ask)
        assert (e.value.kind, e.value.retryable) == (kind, again)
    for choice, kind in (({"finish_reason": "length"}, "truncated"), ({"message": {"refusal": "no"}}, "no_output"), ({"message": {"content": "x"}}, "no_output")):
        with pytest.raises(co.ProviderError) as e:
            providers.StructuredOutputProvider("http://x", "m", post=post(200, {"choices": [choice]})).extract(ask)
        assert e.value.kind == kind
    assert providers.tool_name("a b/c" + "x" * 80).startswith("extract_a_b_c") and len(providers.tool_name("x" * 80)) == 64


SOURCE = '''
from typing import Annotated, Literal

@schema("A person")
class Person:
    name: str
    friend: "Person | None"

@schema("A listing")
class Listing:
    name: Annotated[str, describe("Shown name"), constrain(max_length=60, pattern="(")]
    kind: Literal["house", "flat"] | None
    tags: Annotated[list[str], values_from("tags")]
    owner: Person
    odd: dict[str, int]
    stars: Literal[1, 2]

class Plain:
    x: int
'''


def test_extract_schemas(tmp_path):
    (tmp_path / "a.py").write_text(SOURCE)
    found, warnings = extract.extract([tmp_path / "a.py"])
    listing = found["Listing"]
    assert set(found) == {"Person", "Listing"} and len(warnings) == 3
    assert listing.fields["name"].constraints.max_length == 60 and listing.fields["name"].constraints.pattern is None and listing.fields["name"].description == "Shown name"
    assert listing.fields["kind"].type == s.EnumType(("house", "flat")) and not listing.fields["kind"].required
    assert listing.fields["tags"].type == s.ArrayType(s.SourcedEnumType("tags")) and isinstance(listing.fields["stars"].type, s.NumberType)
    assert listing.fields["owner"].type == s.ObjectType("Person")
    from loomfield.__main__ import main

    assert main(["extract", str(tmp_path / "a.py"), "--out", str(tmp_path / "out")]) == 0 and main(["extract", str(tmp_path / "a.py"), "--out", str(tmp_path / "no"), "--strict"]) == 1
    assert json.loads((tmp_path / "out" / "Listing.schema.json").read_text())["properties"]["name"]["maxLength"] == 60
    assert not (tmp_path / "no").exists()
