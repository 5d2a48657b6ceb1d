"""Settings that hold for all coercions or one, and chains in which an answer is the next step's source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.operators.coerce import Provider, coerce
from loomfield.operators.tracing import Sink, Tracer
from loomfield.plans.schema import Schema


@dataclass(frozen=True)
class Settings:
    """Null means not set; what a call sets replaces what is set for all."""

    provider: Provider | None = None
    recordings: DataFrame | None = None
    repair: str | None = None
    enums: dict | None = None
    max_chars: int | None = None
    policy: str | None = None
    concurrency: int | None = None
    retries: int | None = None
    base_delay: float | None = None
    preprocess: Callable[[DataFrame], DataFrame] | None = None
    sinks: tuple[Sink, ...] | None = None

    def over(self, base: Settings) -> Settings:
        return replace(base, **{f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None})


_GLOBAL = Settings()


def configure(**settings) -> Settings:
    """Set defaults for all later coercions; names that aren't given keep theirs."""
    global _GLOBAL
    _GLOBAL = Settings(**settings).over(_GLOBAL)
    return _GLOBAL


def reset() -> None:
    global _GLOBAL
    _GLOBAL = Settings()


def resolved(**settings) -> Settings:
    found = Settings(**settings).over(_GLOBAL)
    if found.provider is None and found.recordings is None:
        raise ValueError("a provider or recordings must be set, for all coercions or for this one")
    return found


@dataclass(frozen=True)
class Chain:
    """Sources, or the answers of the step before, on their way through schemas."""

    rows: DataFrame
    settings: Settings
    steps: tuple[str, ...] = field(default=())

    def coerce_to(self, schema: Schema, **settings) -> Chain:
        """Each item's answer by ``schema``; a failed item stops here and keeps its error."""
        return self._step(schema, True, settings)

    def partial_to(self, schema: Schema, **settings) -> Chain:
        """As ``coerce_to``, but fields may be missing."""
        return self._step(schema, False, settings)

    def _step(self, schema: Schema, strict: bool, settings: dict) -> Chain:
        own = Settings(**settings).over(self.settings)
        failed = self.rows.where("status <> 'ok'") if self.steps else None
        sources = _as_sources(self.rows.where("status = 'ok'")) if self.steps else self.rows
        if own.preprocess is not None:
            sources = own.preprocess(sources)
        with Tracer(own.sinks or ()).span("coerce", schema=schema.id, strict=strict):
            options = {k: v for k in ("repair", "enums", "max_chars", "policy", "concurrency", "retries", "base_delay") if (v := getattr(own, k)) is not None}
            found = coerce(sources, schema, own.provider, own.recordings, strict=strict, **options).select("item_id", "data_json", "status", "error")
        return replace(self, rows=found if failed is None else found.unionByName(failed), steps=(*self.steps, schema.id))

    @property
    def answers(self) -> DataFrame:
        """(item_id, data_json, status, error) of the last step."""
        return self.rows


def _as_sources(answers: DataFrame) -> DataFrame:
    """Answers as text sources of the next step, a line for each field."""
    lines = F.array_join(F.transform(F.map_entries(F.from_json("data_json", "map<string,string>")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null")))), "\n")
    return answers.select("item_id", F.lit(0).alias("pos"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("label"), lines.alias("text"), F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("int").alias("max_chars"))


def chain(sources: DataFrame, **settings) -> Chain:
    """Begin with sources (item_id, pos, kind, label, text, media_type, max_chars)."""
    return Chain(sources, resolved(**settings))


def of_values(spark: SparkSession, values: list[str], **settings) -> Chain:
    """Begin with a few texts, numbered from 0; for trying things out."""
    rows = [(k, 0, "text", None, v, None, None) for k, v in enumerate(values)]
    return chain(spark.createDataFrame(rows, "item_id long, pos int, kind string, label string, text string, media_type string, max_chars int"), **settings)
