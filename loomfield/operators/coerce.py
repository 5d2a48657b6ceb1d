"""Extraction by a provider as one physical operator: requests, replay, batched calls with retries, validation.

Everything that is the same for all items (prompt, JSON Schema, enum values) is made once on the driver.
Requests are rows; recorded answers come from a join on the request's key, so only misses are sent; misses
go to the provider in one ``mapInArrow`` with a few calls in flight for each task.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.operators.sources import budget_sources, cap_binary, label_sources, render_sources
from loomfield.operators.validate import validate
from loomfield.plans.schema import Schema

CONCURRENCY, RETRIES, BASE_DELAY, MAX_DELAY = 4, 2, 1.0, 30.0
USAGE = "struct<calls:long,prompt_tokens:long,completion_tokens:long,cache_read_tokens:long,cache_write_tokens:long>"


class ProviderError(Exception):
    """``kind`` is api, truncated or no_output; only retryable api errors are tried again."""

    def __init__(self, message: str, kind: str = "api", retryable: bool = False):
        super().__init__(message)
        self.kind, self.retryable = kind, retryable and kind == "api"


@dataclass(frozen=True)
class Request:
    system_prompt: str
    user_input: str
    json_schema: dict
    history: tuple = ()


@dataclass
class Response:
    data: dict
    usage: dict = field(default_factory=dict)


class Provider(Protocol):
    def extract(self, request: Request) -> Response: ...


@dataclass
class Backoff:
    """A pause that a task's calls share: doubles with each failure in a row, any success ends it."""

    base: float = BASE_DELAY
    most: float = MAX_DELAY
    streak: int = 0
    until: float = 0.0
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def wait(self) -> None:
        with self.lock:
            left = self.until - time.monotonic()
        if left > 0:
            time.sleep(left)

    def failed(self) -> None:
        with self.lock:
            self.streak += 1
            self.until = time.monotonic() + min(self.most, self.base * 2 ** (self.streak - 1))

    def succeeded(self) -> None:
        with self.lock:
            self.streak, self.until = 0, 0.0


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def request_key(system_prompt: str, json_schema: dict, user_input: Column) -> Column:
    """The first 24 hex digits of the hash of a request's canonical JSON; the constant parts are made on the driver."""
    head = f'{{"jsonSchema":{canonical(json_schema)},"systemPrompt":{canonical(system_prompt)},"userInput":'
    quoted = F.to_json(F.to_variant_object(F.array(user_input)))
    return F.substring(F.sha2(F.concat(F.lit(head), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("}")).cast("binary"), 256), 1, 24)


def request_key_of(request: Request) -> str:
    parts = {"systemPrompt": request.system_prompt, "userInput": request.user_input, "jsonSchema": request.json_schema}
    if request.history:
        parts["history"] = list(request.history)
    return hashlib.sha256(canonical(parts).encode()).hexdigest()[:24]


def requests(sources: DataFrame, schema: Schema, max_chars: int | None = None, policy: str = "tail", max_images: int | None = None, max_documents: int | None = None, enums: dict | None = None, dialect: str = "standard") -> DataFrame:
    """(item_id, user_input, request_key) of shaped sources: labels, caps, budget, then one rendered input."""
    shaped = cap_binary(label_sources(sources), max_images, max_documents).where("not capped").drop("capped")
    rendered = render_sources(budget_sources(shaped, max_chars, policy))
    return rendered.withColumn("request_key", request_key(schema.prompt(), schema.json_schema(dialect, enums), F.col("user_input")))


ANSWER = f"item_id_ string, data_json string, usage {USAGE}, attempts int, status string, error string"


def call(rows: DataFrame, provider: Provider, schema: Schema, enums: dict | None = None, dialect: str = "standard", concurrency: int = CONCURRENCY, retries: int = RETRIES, empty_retries: int = 0, base_delay: float = BASE_DELAY) -> DataFrame:
    """``rows`` with the provider's answer for ``user_input``: data_json, usage, attempts, status and error.

    A failed item has status ``failed`` and doesn't stop the others.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    prompt, shape = schema.prompt(), schema.json_schema(dialect, enums)
    out = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(ANSWER).fields[1:]])
    at, width = rows.columns.index("user_input"), len(rows.columns)

    def one(text: str, gate: Backoff) -> tuple:
        usage = dict.fromkeys(("calls", "prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens"), 0)
        tries = 0
        empties = empty_retries
        while True:
            gate.wait()
            tries += 1
            try:
                got = provider.extract(Request(prompt, text or "", shape))
                gate.succeeded()
                usage["calls"] += 1
                for k, v in got.usage.items():
                    usage[k] += v
                if empties and all(v is None for v in got.data.values()):
                    empties -= 1
                    continue
                return json.dumps(got.data, ensure_ascii=False, separators=(",", ":")), usage, tries, "ok", None
            except Exception as e:  # a provider is the caller's code; its failure is the item's result
                if getattr(e, "retryable", False) and tries <= retries:
                    gate.failed()
                    continue
                return None, usage, tries, "failed", f"{getattr(e, 'kind', type(e).__name__)}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, gate = to_arrow_schema(out), Backoff(base_delay)
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                found = list(pool.map(lambda text: one(text, gate), batch.column(at).to_pylist()))
                columns = [pa.array([r[k] for r in found], arrow.field(width + k).type) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=arrow)

    return rows.mapInArrow(run, out)


def replay(rows: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with data_json and zero calls, misses): answers recorded under the request's key."""
    recorded = recordings.groupBy("request_key").agg(F.max_by("data_json", F.struct("recorded_at", "data_json")).alias("data_json"))
    hits = rows.join(recorded, "request_key").select(*rows.columns, "data_json", F.from_json(F.lit('{"calls":0,"prompt_tokens":0,"completion_tokens":0,"cache_read_tokens":0,"cache_write_tokens":0}'), USAGE).alias("usage"), F.lit(0).alias("attempts"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    return hits, rows.join(recorded, "request_key", "left_anti")


def record(answers: DataFrame, path: str, schema: Schema) -> None:
    """Append successful answers to a table of recordings."""
    answers.where("status = 'ok'").select("request_key", F.lit(schema.id).alias("schema_id"), "user_input", "data_json", F.current_timestamp().alias("recorded_at")).write.mode("append").partitionBy("schema_id").parquet(path)


def coerce(sources: DataFrame, schema: Schema, provider: Provider | None = None, recordings: DataFrame | None = None, strict: bool = True, repair: str = "none", enums: dict | None = None, max_chars: int | None = None, policy: str = "tail", concurrency: int = CONCURRENCY, retries: int = RETRIES, base_delay: float = BASE_DELAY, answers_path: str | None = None) -> DataFrame:
    """Sources to one result row for each item: data_json, issues, resolved, usage, attempts, status, error.

    With recordings, only misses reach the provider; without a provider a miss is a failed item.  With
    ``answers_path``, a folder all executors share, answers are written there at once and read from there, so that
    results that are computed again call nobody again.
    """
    rows = requests(sources, schema, max_chars, policy, enums=enums)
    hits, misses = replay(rows, recordings) if recordings is not None else (None, rows)
    if provider is not None:
        live = call(misses, provider, schema, enums, concurrency=concurrency, retries=retries, base_delay=base_delay)
        if answers_path is not None:
            live.write.mode("overwrite").parquet(answers_path)
            live = live.sparkSession.read.schema(live.schema).parquet(answers_path)
    else:
        live = misses.select("*", F.lit(None).cast("string").alias("data_json"), F.lit(None).cast(USAGE).alias("usage"), F.lit(0).alias("attempts"), F.lit("failed").alias("status"), F.lit("replay_miss: no recording").alias("error"))
    answers = hits.unionByName(live) if hits is not None else live
    checked = validate(answers, schema, strict=strict, enums=enums, repair=repair)
    bad = (F.col("status") == "ok") & (F.size("issues") > 0)
    fine = checked.withColumn("issues", F.when(F.col("status") == "ok", F.col("issues")).otherwise(F.array().cast(checked.schema["issues"].dataType)))
    return fine.withColumn("error", F.when(bad, F.concat(F.lit("validation: "), F.array_join(F.transform("issues", lambda i: F.concat(i["path"], F.lit(": "), i["message"])), "; "))).otherwise(F.col("error"))).withColumn("status", F.when(bad, "failed").otherwise(F.col("status")))


@dataclass
class ScriptedProvider:
    """A deterministic provider: the first line of each ``Name: value`` pair that the schema knows."""

    names: tuple[str, ...]

    def extract(self, request: Request) -> Response:
        found: dict = dict.fromkeys(self.names)
        for line in request.user_input.split("\n"):
            key, colon, value = line.partition(":")
            key = key.strip()
            if colon and key in found and found[key] is None:
                text = value.strip()
                try:
                    found[key] = json.loads(text)
                except ValueError:
                    found[key] = text
        return Response(found, {"prompt_tokens": len(request.user_input) // 4, "completion_tokens": 8})


def strip_nulls(rows: DataFrame, schema: Schema, column: str = "data_json") -> DataFrame:
    """``rows`` whose answers have no null fields, as partial answers are given."""
    return rows.withColumn(column, F.to_json(F.from_json(column, schema.struct_type())))


def prime(provider: Provider, schema: Schema, enums: dict | None = None, dialect: str = "standard") -> dict[str, int]:
    """Send a schema's prompt once with a minimal input, so that a provider's cache holds it before a batch; the usage of that call."""
    return provider.extract(Request(schema.prompt(), "<source>\n-\n</source>", schema.json_schema(dialect, enums))).usage
