"""Scoring of extractions against expectations: leaves, outcomes, precision and recall, cost, latency, change."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaves_of(value, prefix: str = "") -> Iterator[tuple[str, object]]:
    if value is None:
        return
    if isinstance(value, dict):
        for key, child in value.items():
            yield from leaves_of(child, f"{prefix}.{key}" if prefix else key)
    else:
        yield prefix, value


def comparable(value) -> str:
    """Equal leaves have equal text: lists of scalars as multisets, objects by sorted keys."""
    if isinstance(value, list) and not any(isinstance(x, (list, dict)) for x in value):
        return "set:" + json.dumps(sorted(_plain(x) for x in value), ensure_ascii=False)
    return json.dumps(_numbers(value), sort_keys=True, ensure_ascii=False)


def _numbers(value):
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, dict):
        return {k: _numbers(v) for k, v in value.items()}
    return [_numbers(v) for v in value] if isinstance(value, list) else value


def _plain(x) -> str:
    x = _numbers(x)
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def flatten_leaves(rows: DataFrame, item: str, data: str) -> DataFrame:
    """(item, path, value, key): a row for each leaf of a JSON object; arrays are leaves, nulls are none."""
    at = rows.select(F.col(item).alias("item"), F.col(data).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, paths, values, keys = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for path, value in leaves_of(json.loads(text) if text else None):
                    take.append(k)
                    paths.append(path)
                    values.append(json.dumps(value, ensure_ascii=False))
                    keys.append(comparable(value))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(x, pa.string()) for x in (paths, values, keys))], names=["item", "path", "value", "key"])

    from pyspark.sql import types as T

    schema = T.StructType([at.schema["item"], *(T.StructField(n, T.StringType()) for n in ("path", "value", "key"))])
    return at.mapInArrow(run, schema)


def compare_leaves(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(item, path, expected, actual, outcome): a full outer join of two frames of leaves."""
    want = expected.select("item", "path", F.col("value").alias("expected"), F.col("key").alias("want"))
    got = actual.select("item", "path", F.col("value").alias("actual"), F.col("key").alias("got"))
    outcome = F.when(F.col("want").isNull(), "extra").when(F.col("got").isNull(), "missing").when(F.col("want") == F.col("got"), "match").otherwise("wrong")
    return want.join(got, ["item", "path"], "full_outer").select("item", "path", "expected", "actual", outcome.alias("outcome"))


def field_stats(outcomes: DataFrame) -> DataFrame:
    """(path, tp, fp, fn, precision, recall); a wrong leaf counts as false positive and false negative."""
    is_ = F.col("outcome")
    stats = outcomes.groupBy("path").agg(F.count_if(is_ == "match").alias("tp"), F.count_if(is_.isin("wrong", "extra")).alias("fp"), F.count_if(is_.isin("wrong", "missing")).alias("fn"))
    return stats.select("*", (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"))


def latency(items: DataFrame, milliseconds: str = "ms") -> DataFrame:
    """Nearest-rank percentiles; zero where there is nothing."""
    p = lambda q: F.coalesce(F.expr(f"percentile_disc({q}) within group (order by {milliseconds})"), F.lit(0))
    return items.agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


def cost(prompt, completion, cache_read, cache_write, prices: dict[str, float]):
    """Price of tokens, given per million; cached ones cost as input where no price is named."""
    inputs = prices["input"]
    each = ((prompt, inputs), (completion, prices["output"]), (cache_read, prices.get("cache_read", inputs)), (cache_write, prices.get("cache_write", inputs)))
    return sum((F.coalesce(tokens, F.lit(0)) / 1_000_000 * price for tokens, price in each), F.lit(0.0))


def diff_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, precision_change, recall_change) of fields that changed, worst first."""
    old = before.select("path", F.col("precision").alias("old_p"), F.col("recall").alias("old_r"))
    both = after.join(old, "path", "left").select("path", (F.col("precision") - F.col("old_p")).alias("precision_change"), (F.col("recall") - F.col("old_r")).alias("recall_change"))
    p, r = F.coalesce("precision_change", F.lit(0.0)), F.coalesce("recall_change", F.lit(0.0))
    return both.where((p != 0) | (r != 0)).orderBy(F.least(p, r), "path")
