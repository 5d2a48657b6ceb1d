"""Provenance of extracted fields: the wrapped schema a model fills in, and the split of its answers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.plans import schema as s

CONFIDENCES = ("high", "medium", "low")
RULES = (
    "Give each annotated field as an object: its value, how sure you are of it, and the words it rests on.",
    "high: the input says so; medium: it follows from the input; low: it is a guess.",
    "Quote evidence word for word and briefly; leave it out where there is none.",
)


def field_names(schema: s.Schema, fields: list[str] | None = None) -> list[str]:
    """The top-level fields to annotate, all by default; unknown names are an error."""
    if unknown := [f for f in fields or () if f not in schema.fields]:
        raise ValueError(f"{schema.id} has no field {', '.join(map(repr, unknown))}")
    return [f for f in schema.fields if fields is None or f in fields]


def instructions(several_sources: bool = False) -> str:
    return "\n".join([*RULES, *(["Name the label of the source that the value comes from."] if several_sources else [])])


def wrapped(schema: s.Schema, fields: list[str] | None = None, several_sources: bool = False) -> s.Schema:
    """The schema with each chosen field as an object of value, confidence, evidence and, with several sources, source."""
    chosen = set(field_names(schema, fields))

    def around(name: str, own: s.Field) -> s.Field:
        inner = {"value": replace(own, required=True, description=""), "confidence": s.enum(*CONFIDENCES), "evidence": s.string().optional()}
        if several_sources:
            inner["source"] = s.string().optional()
        return replace(s.nested(s.Schema(f"{schema.id}.{name}", "", inner)), description=own.description, required=own.required)

    return s.Schema(f"{schema.id}WithProvenance", schema.description, {n: around(n, f) if n in chosen else f for n, f in schema.fields.items()})


def split(rows: DataFrame, schema: s.Schema, fields: list[str] | None = None, data: str = "data_json") -> DataFrame:
    """``rows`` with the bare object in ``data`` and ``provenance``: field to confidence, evidence and source.

    Fields that the schema doesn't have go; missing ones become null.  An unknown confidence, and blank
    evidence or source, become null; an answer that isn't wrapped stays as the value without provenance.
    """
    chosen = set(field_names(schema, fields))
    v = F.try_parse_json(F.col(f"`{data}`"))
    values, told = [], []
    for n in schema.fields:
        path = "$['" + n.replace("'", "\\'") + "']"
        whole = F.try_variant_get(v, path, "variant")
        text = lambda part, whole=whole: F.nullif(F.trim(F.try_variant_get(whole, f"$.{part}", "string")), F.lit(""))
        is_wrapped = F.coalesce(F.schema_of_variant(whole).contains("value:"), F.lit(False)) if n in chosen else F.lit(False)
        values.append(F.when(is_wrapped, F.try_variant_get(whole, "$.value", "variant")).otherwise(whole).alias(n))
        if n in chosen:
            sure = text("confidence")
            one = F.struct(F.when(sure.isin(*CONFIDENCES), sure).alias("confidence"), text("evidence").alias("evidence"), text("source").alias("source"))
            told.append(F.struct(F.lit(n).alias("key"), F.when(is_wrapped, one).alias("value")))
    entries = F.filter(F.array(*told), lambda e: e["value"].isNotNull()) if told else F.array().cast("array<struct<key:string,value:struct<confidence:string,evidence:string,source:string>>>")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (data, "provenance")]
    bare = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    return rows.select(*kept, F.when(v.isNotNull(), bare).otherwise(F.col(f"`{data}`")).alias(data), F.map_from_entries(entries).alias("provenance"))
