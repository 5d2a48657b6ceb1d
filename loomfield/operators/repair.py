"""Repair rounds: items whose answer fails validation go back to the provider with what was wrong.

Every round is written below one folder before the next begins, so a lost executor costs no second call for
items that are done, and a provider is never asked again by a recomputed plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.operators.coerce import Provider, call, requests
from loomfield.operators.validate import validate
from loomfield.plans.schema import Schema

SHOWN = 200


def correction(issues: Column) -> Column:
    """A line for each issue; what was received is cut after ``SHOWN`` characters."""
    got = lambda i: F.when(F.length(i["received"]) > SHOWN, F.concat(F.left(i["received"], F.lit(SHOWN)), F.lit("…"))).otherwise(i["received"])
    where = lambda i: F.when(i["path"] == "", "answer").otherwise(i["path"])
    lines = F.transform(issues, lambda i: F.concat(F.lit("- "), where(i), F.lit(": "), i["message"], F.coalesce(F.concat(F.lit(" (received "), got(i), F.lit(")")), F.lit(""))))
    return F.concat(F.lit("The answer doesn't fit the schema:\n"), F.array_join(lines, "\n"), F.lit("\nGive the whole answer again with these corrected."))


def repair_input(original: Column, rejected: Column, issues: Column) -> Column:
    return F.concat_ws("\n\n", original, F.concat(F.lit("Earlier answer:\n"), F.coalesce(rejected, F.lit("none"))), correction(issues))


def coerce_with_repair(sources: DataFrame, schema: Schema, provider: Provider, path: str, rounds: int = 1, strict: bool = True, repair: str = "none", enums: dict | None = None, max_chars: int | None = None, **calling) -> DataFrame:
    """One row for each item: item_id, data_json, issues, resolved, usage, attempts, rounds, status, error.

    ``path`` is a folder all executors share.  Usage and attempts are summed over rounds.  A failed call
    ends its item; an answer that still has issues after the last round is failed.
    """
    spark = sources.sparkSession
    asked = requests(sources, schema, max_chars, enums=enums).select("item_id", "user_input")
    done: list[DataFrame] = []
    for n in range(rounds + 1):
        answers = call(asked, provider, schema, enums, **calling)
        validate(answers, schema, strict=strict, enums=enums, repair=repair).write.mode("overwrite").parquet(f"{path}/round={n}")
        found = spark.read.parquet(f"{path}/round={n}").withColumn("rounds", F.lit(n))
        again = (F.col("status") == "ok") & (F.size("issues") > 0)
        done.append(found)
        rest = found.where(again)
        if n == rounds or rest.isEmpty():
            break
        asked = rest.select("item_id", repair_input(F.col("user_input"), F.col("data_json"), F.col("issues")).alias("user_input"))
    every = reduce(DataFrame.unionByName, done)
    usage = [k for k in every.schema["usage"].dataType.fieldNames()]
    last = F.struct("rounds", "data_json", "issues", "resolved", "status", "error")
    summed = every.groupBy("item_id").agg(F.max_by(last, "rounds").alias("l"), F.struct(*[F.sum(f"usage.{k}").alias(k) for k in usage]).alias("usage"), F.sum("attempts").alias("attempts"))
    bad = (F.col("l.status") == "ok") & (F.size("l.issues") > 0)
    return summed.select("item_id", F.col("l.data_json").alias("data_json"), F.col("l.issues").alias("issues"), F.col("l.resolved").alias("resolved"), "usage", "attempts", F.col("l.rounds").alias("rounds"), F.when(bad, "failed").otherwise(F.col("l.status")).alias("status"), F.when(bad, "validation").otherwise(F.col("l.error")).alias("error"))
