"""Ranges and windows over event time, on tables and on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_ranges(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, n): overlapping and touching ranges of a key become one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = (before.isNull() | (F.col(start) > before)).cast("int")
    islands = rows.withColumn("__begins", begins).withColumn("__island", F.sum("__begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__island")


def overlapping(rows: DataFrame, start: str, end: str, since, until) -> DataFrame:
    """Rows whose range meets [since, until); an empty range counts at its instant."""
    meets = (F.col(start) < until) & ((F.col(end) > since) | ((F.col(start) == F.col(end)) & (F.col(start) >= since)))
    return rows.where(meets)


def tumbling_counts(events: DataFrame, time: str, size: str, keys: list[str], late: str | None = None) -> DataFrame:
    """(keys, window_start, window_end, n); with ``late`` a stream forgets windows that far behind."""
    seen = events.withWatermark(time, late) if late else events
    return seen.groupBy(*keys, F.window(time, size).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    seen = events.withWatermark(time, late) if late else events
    return seen.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Run ``work`` on every micro-batch and append its rows below ``path``, one folder for each batch.

    A batch that runs again replaces its own folder, so results are whole and not doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
