"""Evaluation runs: fixtures as rows, a provider's answers scored against them, reports kept as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.operators.coerce import Provider, coerce
from loomfield.operators.evaluate import compare_leaves, cost, field_stats, flatten_leaves
from loomfield.plans.schema import Schema

FIXTURE = "name string, input string, expected string"


def load_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(name, input, expected): JSON files of one fixture or a list; unnamed ones are named after file and place."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+?)(?:\\.json)?$", 1).alias("file"), F.try_parse_json("value").alias("v"))
    one = files.withColumn("v", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(F.try_parse_json(F.concat(F.lit("["), F.to_json("v"), F.lit("]")))))
    rows = one.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()).alias("e")).select("file", "e.pos", "e.value")
    text = lambda p: F.try_variant_get("value", p, "string")
    name = F.coalesce(text("$.name"), F.concat("file", F.lit("#"), F.coalesce(F.col("pos"), F.lit(0)).cast("string")))
    return rows.select(name.alias("name"), text("$.input").alias("input"), F.to_json(F.try_variant_get("value", "$.expected", "variant")).alias("expected"))


def run_eval(fixtures: DataFrame, schema: Schema, provider: Provider, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items with exact and usage, outcomes by leaf, statistics by path); a failed item has every leaf missing."""
    shaped = fixtures.select(F.col("name").alias("item_id"), F.lit(0).alias("pos"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("label"), F.col("input").alias("text"), F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("int").alias("max_chars"))
    answers = coerce(shaped, schema, provider, **options)
    got = answers.select("item_id", F.when(F.col("status") == "ok", F.col("data_json")).alias("data"))
    outcomes = compare_leaves(flatten_leaves(fixtures, "name", "expected"), flatten_leaves(got, "item_id", "data"))
    wrong = outcomes.groupBy(F.col("item").alias("item_id")).agg(F.count_if(F.col("outcome") != "match").alias("n_wrong"))
    exact = (F.col("status") == "ok") & (F.coalesce("n_wrong", F.lit(0)) == 0)
    return answers.join(wrong, "item_id", "left").select("item_id", "status", "error", exact.alias("exact"), "usage"), outcomes, field_stats(outcomes)


def totals(items: DataFrame, prices: dict[str, float]) -> DataFrame:
    """One row: items, exact and failed ones, and the price of all calls."""
    u = lambda k: F.col(f"usage.{k}")
    price = cost(u("prompt_tokens"), u("completion_tokens"), u("cache_read_tokens"), u("cache_write_tokens"), prices)
    return items.agg(F.count("*").alias("items"), F.count_if("exact").alias("exact"), F.count_if(F.col("status") != "ok").alias("failed"), F.coalesce(F.sum(price), F.lit(0.0)).alias("cost"))


def save_report(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)


def load_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, tp long, fp long, fn long, precision double, recall double").json(path)


def below(stats: DataFrame, least_precision: float | None = None, least_recall: float | None = None) -> DataFrame:
    """The fields that miss a gate; an undefined ratio misses none."""
    low = F.lit(False)
    for name, least in (("precision", least_precision), ("recall", least_recall)):
        if least is not None:
            low = low | F.coalesce(F.col(name) < least, F.lit(False))
    return stats.where(low)


def format_report(stats: DataFrame) -> str:
    """The statistics as a text table; they have a row for each field of a schema."""
    share = lambda x: "-" if x is None else f"{100 * x:.0f} %"
    rows = [("field", "precision", "recall", "tp", "fp", "fn"), *((r["path"], share(r["precision"]), share(r["recall"]), *(str(r[k]) for k in ("tp", "fp", "fn"))) for r in stats.orderBy("path").toLocalIterator())]
    widths = [max(map(len, c)) for c in zip(*rows, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in rows)
