"""Validation of extracted objects against a schema, and repair by clamping and dropping.

Objects arrive as JSON text.  Issues are (path, message, received JSON).  A repair takes the deepest issue
first: a value beyond a bound is clamped where asked for, else the nearest optional field, or array element,
around it goes; then the whole object is looked at again, until nothing is left that a policy covers.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.plans.codes import COUNTRIES, CURRENCIES, US_STATES
from loomfield.plans.schema import ArrayType, BooleanType, Constraints, EnumType, FieldType, NumberType, ObjectType, Schema, SourcedEnumType

ISSUES = "array<struct<path:string,message:string,received:string>>"
MAX_LISTED = 10
_EMAIL = re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]+")
_DATE = re.compile(r"(\d{4})-(\d{2})-(\d{2})")
_DATETIME = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?")


def _units(s: str) -> int:
    """Length in UTF-16 units."""
    return len(s.encode("utf-16-le", "surrogatepass")) // 2


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "string" if isinstance(value, str) else "number" if isinstance(value, (int, float)) else "object"


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _show(x: float) -> str:
    return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


def format_problem(value: str, name: str) -> str | None:
    got = f"got {_json(value)}"
    if name == "url":
        try:
            fine = urlsplit(value).scheme in ("http", "https") and bool(urlsplit(value).hostname)
        except ValueError:
            fine = False
        return None if fine else f"Expected an absolute http(s) URL, {got}"
    if name == "email":
        return None if _EMAIL.fullmatch(value) else f"Expected an email address, {got}"
    if name in ("date", "datetime"):
        m = _DATE.fullmatch(value[:10])
        try:
            fine = bool(m) and bool(datetime.date(*map(int, m.groups())))
            if name == "date":
                fine = fine and len(value) == 10
            else:
                fine = fine and bool(_DATETIME.fullmatch(value)) and bool(datetime.datetime.fromisoformat(value.replace("Z", "+00:00")))
        except ValueError:
            fine = False
        return None if fine else f"Expected {'a calendar date as YYYY-MM-DD' if name == 'date' else 'an ISO 8601 timestamp'}, {got}"
    known, what = {
        "iso-country": (COUNTRIES, "an ISO 3166-1 alpha-2 country code such as US or DE"),
        "us-state": (US_STATES.keys(), "a two-letter USPS state code such as CA or NY"),
        "us-state-name": (US_STATES.values(), "a US state's full name such as California"),
        "currency": (CURRENCIES, "an ISO 4217 currency code such as USD or EUR"),
    }[name]
    return None if value in known else f"Expected {what}, {got}"


class Validator:
    def __init__(self, schema: Schema, strict: bool = True, enums: dict[str, list[str]] | None = None):
        self.schema, self.bundle, self.strict, self.enums = schema, schema.bundle(), strict, enums or {}

    def issues(self, data: dict) -> list[tuple[str, str, object]]:
        return list(self._fields(data, self.schema, "", self.strict))

    def _fields(self, data: dict, schema: Schema, prefix: str, strict: bool) -> Iterator[tuple[str, str, object]]:
        for name, f in schema.fields.items():
            path, value = f"{prefix}{name}", data.get(name)
            if value is None:
                if strict and f.required:
                    yield path, "Required field is missing", None
                continue
            yield from self._type(value, f.type, path)
            if f.constraints:
                yield from self._limits(value, f.constraints, path, True)

    def _type(self, value, kind: FieldType, path: str) -> Iterator[tuple[str, str, object]]:
        if value is None:
            return
        got = _kind(value)
        if isinstance(kind, ArrayType):
            if isinstance(value, list):
                for k, x in enumerate(value):
                    yield from self._type(x, kind.items, f"{path}[{k}]")
            else:
                yield path, f"Expected array, got {got}", value
        elif isinstance(kind, ObjectType):
            if not isinstance(value, dict):
                yield path, f"Expected object, got {'array' if isinstance(value, list) else got}", value
            elif kind.schema_id in self.bundle:
                yield from self._fields(value, self.bundle[kind.schema_id], f"{path}.", True)
        elif isinstance(kind, EnumType):
            if value not in kind.values:
                yield path, f"Expected one of [{', '.join(kind.values)}], got {_json(value)}", value
        elif isinstance(kind, SourcedEnumType) and self.enums.get(kind.source):
            values = self.enums[kind.source]
            if not isinstance(value, str) or value not in values:
                listed = ", ".join(values[:MAX_LISTED]) + (f", … (+{len(values) - MAX_LISTED} more)" if len(values) > MAX_LISTED else "")
                yield path, f'Expected one of the {len(values)} allowed "{kind.source}" values [{listed}], got {_json(value)}', value
        else:
            want = "number" if isinstance(kind, NumberType) else "boolean" if isinstance(kind, BooleanType) else "string"
            if got != want or isinstance(value, (list, dict)):
                yield path, f"Expected {want}, got {got}", value

    def _limits(self, value, c: Constraints, path: str, counted: bool) -> Iterator[tuple[str, str, object]]:
        if isinstance(value, list):
            for bound, low in ((c.min_items, True), (c.max_items, False)):
                if counted and bound is not None and (len(value) < bound if low else len(value) > bound):
                    yield path, f"Expected at {'least' if low else 'most'} {bound} {'entry' if bound == 1 else 'entries'}, got {len(value)}", value
            for k, x in enumerate(value):
                yield from self._limits(x, c, f"{path}[{k}]", False)
        elif isinstance(value, str):
            n = _units(value)
            if c.min_length is not None and n < c.min_length:
                yield path, f"Expected at least {c.min_length} characters, got {n}", value
            if c.max_length is not None and n > c.max_length:
                yield path, f"Expected at most {c.max_length} characters, got {n}", value
            if c.pattern is not None and not re.search(c.pattern, value):
                yield path, f"Expected a value matching /{c.pattern}/, got {_json(value)}", value
            if c.format and (problem := format_problem(value, c.format)):
                yield path, problem, value
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            if c.minimum is not None and value < c.minimum:
                yield path, f"Expected a value >= {_show(c.minimum)}, got {_show(value)}", value
            if c.maximum is not None and value > c.maximum:
                yield path, f"Expected a value <= {_show(c.maximum)}, got {_show(value)}", value


def steps(path: str) -> list[str | int]:
    return [int(x[1:-1]) if x[0] == "[" else x for x in re.findall(r"\[\d+\]|[^.\[\]]+", path)]


def _described(schema: Schema, where: list[str | int]) -> list[tuple[FieldType, bool, Constraints | None]] | None:
    """For each step its type, whether it may be dropped, and the limits that hold there."""
    bundle, out, kind, limits = schema.bundle(), [], None, None
    for k, step in enumerate(where):
        if isinstance(step, int):
            if not isinstance(kind, ArrayType):
                return None
            kind = kind.items
            out.append((kind, True, limits))
        else:
            owner = schema if k == 0 else bundle.get(kind.schema_id) if isinstance(kind, ObjectType) else None
            f = owner.fields.get(step) if owner else None
            if f is None:
                return None
            kind, limits = f.type, f.constraints
            out.append((kind, not f.required, limits))
    return out


def clamped(value, limits: Constraints | None, element: bool):
    """The nearest value within bounds, or None where no bound applies."""
    if limits is None:
        return None
    if isinstance(value, list) and not element and limits.max_items is not None and len(value) > limits.max_items:
        return value[: limits.max_items]
    if isinstance(value, str) and limits.max_length is not None and _units(value) > limits.max_length:
        return value.encode("utf-16-le", "surrogatepass")[: 2 * limits.max_length].decode("utf-16-le", "ignore")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if limits.minimum is not None and value < limits.minimum:
            return limits.minimum
        if limits.maximum is not None and value > limits.maximum:
            return limits.maximum
    return None


def resolve(data: dict, validator: Validator, clamp: bool = True, drop: bool = True) -> tuple[dict, list[dict], list[tuple[str, str, object]]]:
    """The repaired object, what was done, and the issues left."""
    data, done = json.loads(json.dumps(data)), []
    passed: set[str] = set()
    while True:
        open_ = sorted((i for i in validator.issues(data) if i[0] not in passed), key=lambda i: -len(steps(i[0])))
        if not open_:
            return data, done, validator.issues(data)
        path, message, received = open_[0]
        where = steps(path)
        told = _described(validator.schema, where)
        if told is None:
            passed.add(path)
            continue
        note = {"path": path, "message": message, "received": received}
        parent = data
        for step in where[:-1]:
            parent = parent[step]
        value = parent[where[-1]] if isinstance(where[-1], int) or where[-1] in parent else None
        new = clamped(value, told[-1][2], isinstance(where[-1], int)) if clamp else None
        if new is not None and new != value:
            parent[where[-1]] = new
            done.append(note | {"resolution": "clamped", "resolved_path": path, "replacement": new})
            continue
        target = next((k for k in range(len(where) - 1, -1, -1) if told[k][1] or k == 0 and not validator.strict), None) if drop else None
        if target is None or (value is None and target == len(where) - 1):
            passed.add(path)
            continue
        node = data
        for step in where[:target]:
            node = node[step]
        del node[where[target]]
        gone = "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in where[: target + 1]).lstrip(".")
        done.append(note | {"resolution": "dropped", "resolved_path": gone, "replacement": None})


def validate(rows: DataFrame, schema: Schema, data: str = "data_json", strict: bool = True, enums: dict[str, list[str]] | None = None, repair: str = "none", out: str = "data_json") -> DataFrame:
    """``rows`` with ``issues`` (left), ``resolved`` and the object in ``out``; text that isn't an object is one issue.

    ``repair`` is none, drop, clamp or both.
    """
    if repair not in ("none", "drop", "clamp", "both"):
        raise ValueError(f"unknown repair {repair!r}")
    kept = [c for c in rows.columns if c not in (out, "issues", "resolved")]
    base = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{data}`").alias("__data"))
    resolved = "array<struct<path:string,message:string,received:string,resolution:string,resolved_path:string,replacement:string>>"
    added = T.StructType.fromDDL(f"{out} string, issues {ISSUES}, resolved {resolved}")
    schema_out = T.StructType([*base.schema.fields[:-1], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, validator = to_arrow_schema(schema_out), Validator(schema, strict, enums)
        for batch in batches:
            texts, left, fixed = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    value = json.loads(text) if text is not None else None
                except ValueError:
                    value = None
                done: list[dict] = []
                if not isinstance(value, dict):
                    found = [("", "Expected a JSON object", value)]
                elif repair == "none":
                    found = validator.issues(value)
                else:
                    value, done, found = resolve(value, validator, repair in ("clamp", "both"), repair in ("drop", "both"))
                texts.append(_json(value) if isinstance(value, dict) else text)
                left.append([{"path": p, "message": m, "received": _json(r)} for p, m, r in found])
                fixed.append([d | {"received": _json(d["received"]), "replacement": None if d["replacement"] is None else _json(d["replacement"])} for d in done])
            columns = [*batch.columns[:-1], *(pa.array(x, f.type) for x, f in zip((texts, left, fixed), list(arrow)[-3:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return base.mapInArrow(run, schema_out)


def typed(rows: DataFrame, schema: Schema, data: str = "data_json", out: str = "data") -> DataFrame:
    """``rows`` with the valid object as a struct of the schema's Spark type."""
    return rows.withColumn(out, F.from_json(data, schema.struct_type()))
