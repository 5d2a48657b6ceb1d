"""Windows, sessions and micro-batches on streams of files, against the same functions on tables."""

from pyspark.sql import functions as F

from loomfield.functions import text
from loomfield.streaming import windows

EVENTS = "ts timestamp, kind string"


def write(spark, folder, rows):
    spark.createDataFrame(rows, "at long, kind string").select(F.timestamp_seconds("at").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(folder)


def finished(query):
    query.processAllAvailable()
    query.stop()


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    folder = str(tmp_path / "events")
    write(spark, folder, [(10, "a"), (50, "a"), (3700, "b")])
    stream = spark.readStream.schema(EVENTS).parquet(folder)
    counted = windows.tumbling_counts(stream, "ts", "1 hour", ["kind"], late="2 hours")
    query = counted.writeStream.format("memory").queryName("hours").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    write(spark, folder, [(20, "a"), (7300, "b")])
    finished(query)
    latest = spark.table("hours").groupBy("kind", "window_start", "window_end").agg(F.max("n").alias("n"))
    table = windows.tumbling_counts(spark.read.parquet(folder), "ts", "1 hour", ["kind"])
    assert sorted(map(str, latest.select("kind", "window_start", "window_end", "n").collect())) == sorted(map(str, table.select("kind", "window_start", "window_end", "n").collect()))


def test_sessions_of_a_stream_end_behind_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "events")
    write(spark, folder, [(0, "a"), (100, "a"), (5000, "a")])
    stream = windows.sessions(spark.readStream.schema(EVENTS).parquet(folder), "ts", "10 minutes", ["kind"], late="1 minute")
    query = stream.writeStream.format("memory").queryName("visits").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    write(spark, folder, [(20_000, "z")])
    finished(query)
    found = spark.table("visits").select(F.col("session_start").cast("long").alias("s"), "n").orderBy("s").collect()
    assert [(r.s, r.n) for r in found] == [(0, 2), (5000, 1)]


def test_batches_that_run_again_replace_their_rows(spark, tmp_path):
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    write(spark, folder, [(k, "a") for k in range(5)])
    stream = spark.readStream.schema(EVENTS).parquet(folder)
    for checkpoint in ("c3", "c4"):  # a lost checkpoint: the same batch comes again
        finished(windows.each_batch(stream, lambda b: b.withColumn("kind", F.upper("kind")), out, str(tmp_path / checkpoint)).start())
    found = spark.read.parquet(out)
    assert found.count() == 5 and {r.kind for r in found.collect()} == {"A"}


def test_small_text_functions(spark):
    row = spark.createDataFrame([("﻿a", 3_000_000)], "t string, n long").select(text.strip_bom(F.col("t")).alias("t"), text.format_size(F.col("n")).alias("n")).first()
    assert (row.t, row.n) == ("a", "2.9 MB")
