"""Transcript segments as rows: time chunks, joined turns, headers, clocks, and where a quote was said."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomfield.functions.text import format_clock


def coalesce_segments(segments: DataFrame, item: str, seconds: float) -> DataFrame:
    """(item, start, end, speaker, text): a segment joins the block before it while the speaker stays and the
    block stays within ``seconds``.  The block's own start decides, so it is a fold: items' segments are brought
    together in order and go through one block at a time, however many there are."""
    schema = T.StructType([segments.schema[item], *T.StructType.fromDDL("start double, end double, speaker string, text string").fields])
    ordered = segments.select(item, "start", "end", "speaker", "text").repartition(item).sortWithinPartitions(item, "start", "end", "speaker", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list | None = None  # item, start, end, speaker, texts

        def told(blocks: list[list]) -> pa.RecordBatch:
            arrow = to_arrow_schema(schema)
            columns = [[b[k] for b in blocks] for k in range(4)] + [[" ".join(b[4]) for b in blocks]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, start, end, speaker, text = row
                joins = block is not None and block[0] == own and block[3] == speaker and None not in (end, block[1]) and end - block[1] <= seconds
                if joins:
                    block[2] = end if block[2] is None else max(block[2], end)
                    block[4] += [text] if text is not None else []
                else:
                    done += [block] if block else []
                    block = [own, start, end, speaker, [text] if text is not None else []]
            if done:
                yield told(done)
        if block:
            yield told([block])

    return ordered.mapInArrow(run, schema)


def chunks(segments: DataFrame, item: str, seconds: float) -> DataFrame:
    """(item, chunk, chunk_start, chunk_end, n): a segment belongs to the grid cell it starts in; the last cell ends with the speech."""
    cells = segments.withColumn("chunk", F.floor(F.col("start") / seconds)).groupBy(item, "chunk").agg(F.max("end").alias("spoken"), F.count("*").alias("n"))
    last = F.max("chunk").over(Window.partitionBy(item))
    end = F.when(F.col("chunk") == last, F.col("spoken")).otherwise((F.col("chunk") + 1) * seconds)
    return cells.select(item, "chunk", (F.col("chunk") * seconds).alias("chunk_start"), end.cast("double").alias("chunk_end"), "n")


def segment_line(start: Column, speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("["), format_clock(start), F.lit("] "), F.coalesce(F.concat(speaker, F.lit(": ")), F.lit("")), text)


def speakers(segments: DataFrame, item: str) -> DataFrame:
    """(item, speakers) in the order they first speak."""
    first = segments.where("speaker is not null").groupBy(item, "speaker").agg(F.min("start").alias("at"))
    return first.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "speaker"))), lambda x: x["speaker"]).alias("speakers"))


def wav_seconds(data: bytes) -> float | None:
    """Length of a RIFF/WAVE file by its header."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, rate = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16:
            rate = struct.unpack_from("<I", data, at + 16)[0]
        elif name == b"data":
            return size / rate if rate else None
        at += 8 + size + size % 2
    return None
