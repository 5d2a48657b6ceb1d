"""Declared schemas: fields, constraints, nested schemas by id, JSON Schema, prompts, and Spark types."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FORMATS = ("url", "email", "date", "datetime", "iso-country", "us-state", "us-state-name", "currency")
_PHRASES = {
    "url": "an absolute http(s) URL",
    "email": "an email address",
    "date": "a calendar date, YYYY-MM-DD",
    "datetime": "an ISO 8601 date and time",
    "iso-country": "a two-letter ISO 3166-1 country code",
    "us-state": "a two-letter USPS state code",
    "us-state-name": "the full name of a US state",
    "currency": "a three-letter ISO 4217 currency code",
}
_KEYWORDS = {"url": {"format": "uri"}, "email": {"format": "email"}, "date": {"format": "date"}, "datetime": {"format": "date-time"}, "iso-country": {"pattern": "^[A-Z]{2}$"}, "us-state": {"pattern": "^[A-Z]{2}$"}, "us-state-name": {}, "currency": {"pattern": "^[A-Z]{3}$"}}


@dataclass(frozen=True)
class FieldType:
    """A string, unless a subclass says otherwise."""

    def spark(self, bundle: Bundle) -> T.DataType:
        return T.StringType()

    def json(self, bundle: Bundle, dialect: str, seen: tuple[str, ...], enums: dict[str, list[str]]) -> dict:
        return {"type": "string"}


@dataclass(frozen=True)
class NumberType(FieldType):
    def spark(self, bundle):
        return T.DoubleType()

    def json(self, bundle, dialect, seen, enums):
        return {"type": "number"}


@dataclass(frozen=True)
class BooleanType(FieldType):
    def spark(self, bundle):
        return T.BooleanType()

    def json(self, bundle, dialect, seen, enums):
        return {"type": "boolean"}


@dataclass(frozen=True)
class EnumType(FieldType):
    values: tuple[str, ...] = ()

    def json(self, bundle, dialect, seen, enums):
        return {"type": "string", "enum": list(self.values)}


@dataclass(frozen=True)
class SourcedEnumType(FieldType):
    """Values come from a resolver when a plan is made."""

    source: str = ""

    def json(self, bundle, dialect, seen, enums):
        return {"type": "string"} | ({"enum": list(enums[self.source])} if enums.get(self.source) else {})


@dataclass(frozen=True)
class ArrayType(FieldType):
    items: FieldType = FieldType()

    def spark(self, bundle):
        return T.ArrayType(self.items.spark(bundle))

    def json(self, bundle, dialect, seen, enums):
        return {"type": "array", "items": self.items.json(bundle, dialect, seen, enums)}


@dataclass(frozen=True)
class ObjectType(FieldType):
    schema_id: str = ""

    def spark(self, bundle):
        nested = bundle.get(self.schema_id)
        return nested.struct_type(bundle) if nested else T.StringType()

    def json(self, bundle, dialect, seen, enums):
        nested = bundle.get(self.schema_id)
        if nested is None or self.schema_id in seen:
            return {"type": "object"}
        return nested.object_schema(bundle, dialect, (*seen, self.schema_id), enums)


@dataclass(frozen=True)
class Constraints:
    format: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    minimum: float | None = None
    maximum: float | None = None
    min_items: int | None = None
    max_items: int | None = None
    pattern: str | None = None

    def __post_init__(self):
        if self.format is not None and self.format not in FORMATS:
            raise ValueError(f"unknown format {self.format!r}")
        if self.pattern is not None:
            re.compile(self.pattern)

    def phrases(self) -> Iterator[str]:
        if self.format:
            yield _PHRASES[self.format]
        for low, high, what in ((self.min_length, self.max_length, "characters"), (self.minimum, self.maximum, ""), (self.min_items, self.max_items, "entries")):
            unit = f" {what}" if what else ""
            if low is not None and high is not None:
                yield f"{low} to {high}{unit}"
            elif low is not None:
                yield f"at least {low}{unit}"
            elif high is not None:
                yield f"at most {high}{unit}"
        if self.pattern:
            yield f"matching {self.pattern}"

    def keywords(self, kind: FieldType) -> dict:
        def on(*pairs):
            return {k: v for k, v in pairs if v is not None}

        text = on(("minLength", self.min_length), ("maxLength", self.max_length), ("pattern", self.pattern)) | (_KEYWORDS[self.format] if self.format else {})
        number = on(("minimum", self.minimum), ("maximum", self.maximum))
        inner = kind.items if isinstance(kind, ArrayType) else kind
        scalar = number if isinstance(inner, NumberType) else text if type(inner) in (FieldType, EnumType, SourcedEnumType) else {}
        if isinstance(kind, ArrayType):
            return on(("minItems", self.min_items), ("maxItems", self.max_items)) | ({"items": scalar} if scalar else {})
        return scalar


@dataclass(frozen=True)
class Field:
    """Immutable: each method gives a changed copy."""

    type: FieldType = FieldType()
    description: str = ""
    required: bool = True
    constraints: Constraints | None = None
    nested: tuple[Schema, ...] = ()

    def optional(self) -> Field:
        return replace(self, required=False)

    def array(self) -> Field:
        return replace(self, type=ArrayType(self.type))

    def describe(self, text: str) -> Field:
        return replace(self, description=text)

    def constrain(self, **limits) -> Field:
        return replace(self, constraints=replace(self.constraints or Constraints(), **limits))


def string(description: str = "") -> Field:
    return Field(description=description)


def number(description: str = "") -> Field:
    return Field(NumberType(), description)


def boolean(description: str = "") -> Field:
    return Field(BooleanType(), description)


def enum(*values: str) -> Field:
    return Field(EnumType(tuple(values)))


def values_from(source: str) -> Field:
    return Field(SourcedEnumType(source))


def nested(schema: Schema) -> Field:
    return Field(ObjectType(schema.id), nested=(schema,))


def array(items: Field) -> Field:
    return items.array()


@dataclass(frozen=True)
class Leaf:
    path: str
    type: FieldType
    field: Field


@dataclass(frozen=True)
class Schema:
    id: str
    description: str
    fields: dict[str, Field] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if not self.id.strip():
            raise ValueError("a schema needs an id")
        self.bundle()  # rejects different schemas under one id

    def bundle(self) -> Bundle:
        found: Bundle = {self.id: self}
        todo = [self]
        while todo:
            for f in todo.pop().fields.values():
                for s in f.nested:
                    if s.id not in found:
                        found[s.id] = s
                        todo.append(s)
                    elif found[s.id] != s:
                        raise ValueError(f"two different schemas have the id {s.id!r}")
        return found

    def struct_type(self, bundle: Bundle | None = None) -> T.StructType:
        bundle = bundle or self.bundle()
        return T.StructType([T.StructField(n, f.type.spark(bundle), True, {"description": f.description, "required": f.required}) for n, f in self.fields.items()])

    def leaves(self, prefix: str = "", seen: tuple[str, ...] = ()) -> list[Leaf]:
        """Dotted paths of scalars and arrays; nested objects are walked, arrays of objects are not."""
        bundle, out = self.bundle(), []
        for n, f in self.fields.items():
            nested = bundle.get(f.type.schema_id) if isinstance(f.type, ObjectType) else None
            if nested and nested.id not in (*seen, self.id):
                out += nested.leaves(f"{prefix}{n}.", (*seen, self.id))
            else:
                out.append(Leaf(prefix + n, f.type, f))
        return out

    def object_schema(self, bundle: Bundle, dialect: str, seen: tuple[str, ...], enums: dict[str, list[str]]) -> dict:
        properties, required = {}, []
        for n, f in self.fields.items():
            s = f.type.json(bundle, dialect, seen, enums)
            if dialect == "standard" and f.constraints:
                limits = f.constraints.keywords(f.type)
                items = limits.pop("items", None)
                s = s | limits
                if items:
                    s["items"] = s["items"] | items
            if f.description:
                s = s | {"description": f.description}
            if dialect == "strict":
                required.append(n)
                s = s if f.required else {"anyOf": [s, {"type": "null"}]}
            elif f.required:
                required.append(n)
            properties[n] = s
        return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}

    def json_schema(self, dialect: str = "standard", enums: dict[str, list[str]] | None = None) -> dict:
        """``strict``: all fields required, optional ones nullable, no constraints; ``standard``: constraints kept."""
        if dialect not in ("strict", "standard"):
            raise ValueError(f"unknown dialect {dialect!r}")
        return self.object_schema(self.bundle(), dialect, (self.id,), enums or {}) | ({"description": self.description} if self.description else {})

    def prompt(self) -> str:
        """What a model is told of the fields."""
        bundle = self.bundle()
        lines = [f"Extract one {self.id}: {self.description}" if self.description else f"Extract one {self.id}.", "", "Fields:"]

        def tell(schema: Schema, depth: int, seen: tuple[str, ...]) -> None:
            for n, f in schema.fields.items():
                inner = f.type
                many = isinstance(inner, ArrayType)
                while isinstance(inner, ArrayType):
                    inner = inner.items
                what = {NumberType: "number", BooleanType: "boolean", ObjectType: "object"}.get(type(inner), "string")
                if isinstance(inner, EnumType):
                    what = "one of " + ", ".join(inner.values)
                elif isinstance(inner, SourcedEnumType):
                    what = f"one of the {inner.source} values listed in the output schema"
                notes = [*([] if f.required else ["optional"]), *(f.constraints.phrases() if f.constraints else ())]
                lines.append("  " * depth + f"- {n} ({'list of ' * many}{what}{'; ' if notes else ''}{', '.join(notes)}){': ' * bool(f.description)}{f.description}")
                if isinstance(inner, ObjectType) and inner.schema_id in bundle and inner.schema_id not in seen:
                    tell(bundle[inner.schema_id], depth + 1, (*seen, inner.schema_id))

        tell(self, 0, (self.id,))
        return "\n".join(lines)

    def enum_sources(self) -> dict[str, dict]:
        """Source id to whether a required field needs it, by an unbroken chain, and the paths that use it."""
        bundle, found = self.bundle(), {}

        def walk(schema: Schema, prefix: str, needed: bool, seen: tuple[str, ...]) -> None:
            for n, f in schema.fields.items():
                kind, path = f.type, f"{prefix}{n}"
                while isinstance(kind, ArrayType):
                    kind, path = kind.items, f"{path}[]"
                if isinstance(kind, SourcedEnumType):
                    use = found.setdefault(kind.source, {"required": False, "paths": []})
                    use["required"] |= needed and f.required
                    use["paths"].append(path)
                elif isinstance(kind, ObjectType) and kind.schema_id in bundle and kind.schema_id not in seen:
                    walk(bundle[kind.schema_id], f"{path}.", needed and f.required, (*seen, kind.schema_id))

        walk(self, "", True, (self.id,))
        return found


Bundle = dict[str, Schema]


def resolve_enums(schema: Schema, resolver: Callable[[str], list[str] | DataFrame]) -> dict[str, list[str]]:
    """Values by source, each asked for once; a one-column frame will do.  A required source must have some."""
    found: dict[str, list[str]] = {}
    failed = []
    for source, use in schema.enum_sources().items():
        try:
            got = resolver(source)
            values = [r[0] for r in got.distinct().orderBy(got.columns[0]).collect()] if isinstance(got, DataFrame) else list(got)
            why = "" if values else "no values"
        except Exception as e:  # a resolver is the caller's code
            values, why = [], f"{type(e).__name__}: {e}"
        if values:
            found[source] = values
        elif use["required"]:
            failed.append(f"{source} ({', '.join(use['paths'])}): {why}")
    if failed:
        raise ValueError("required values can't be resolved: " + "; ".join(sorted(failed)))
    return found


class Registry:
    """Schemas by id, with all that they nest."""

    def __init__(self, *schemas: Schema):
        self.found: Bundle = {}
        for schema in schemas:
            self.register(schema)

    def register(self, schema: Schema) -> None:
        """Add or replace a schema and those it nests."""
        self.found |= schema.bundle()

    def get(self, schema_id: str) -> Schema | None:
        return self.found.get(schema_id)

    def require(self, schema_id: str) -> Schema:
        if schema_id not in self.found:
            raise KeyError(f"no schema {schema_id!r}; there are {', '.join(self.found)}")
        return self.found[schema_id]

    def ids(self) -> list[str]:
        return list(self.found)

    def bundle(self) -> Bundle:
        return dict(self.found)
