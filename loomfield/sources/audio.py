"""Audio as transcripts: a transcriber behind a protocol, its cache as a table, rendered text, where a quote was said."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions.text import format_clock
from loomfield.sources.rows import explode_text
from loomfield.sources.transcripts import segment_line, wav_seconds

SEGMENT = "pos int, start double, end double, speaker string, text string, language string, seconds double"


class AudioError(ValueError):
    """``kind`` is api, unsupported or too_long."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


class Transcriber(Protocol):
    def transcribe(self, audio: bytes) -> dict:
        """``segments`` of start, end, speaker and text; ``language`` and ``seconds`` where known."""
        ...


def cache_key(content: Column, language: str = "", prompt: str = "") -> Column:
    """The name of a transcript: a hash of the audio and of what the transcriber is told."""
    return F.substring(F.sha2(F.concat(content, F.lit(f"\0{language}\0{prompt}".encode())), 256), 1, 32)


def transcribe(rows: DataFrame, key: str, content: str, transcriber: Transcriber, most_seconds: float | None = None) -> DataFrame:
    """(key, segment fields, error) for each segment; audio that is too long by its header is never sent."""

    def gate(seconds: float | None) -> None:
        if most_seconds is not None and seconds is not None and seconds > most_seconds:
            raise AudioError("too_long", f"{seconds:.1f} s, {most_seconds:g} allowed")

    def kernel(data) -> Iterator[dict]:
        data = bytes(data)
        gate(known := wav_seconds(data))
        got = transcriber.transcribe(data)
        segments = got.get("segments") or []
        seconds = got.get("seconds") or known or max((x["end"] for x in segments), default=None)
        gate(seconds)
        yield from ({"pos": n, "language": got.get("language"), "seconds": seconds} | {k: x.get(k) for k in ("start", "end", "speaker", "text")} for n, x in enumerate(segments, 1))

    return explode_text(rows, key, content, kernel, SEGMENT)


def with_cache(rows: DataFrame, content: str, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached transcript rows, rows to transcribe) by ``cache_key`` of the audio; ``transcripts`` has a ``cache_key``."""
    keyed = rows.withColumn("cache_key", cache_key(F.col(content)))
    return keyed.drop(content).join(transcripts, "cache_key"), keyed.join(transcripts.select("cache_key").distinct(), "cache_key", "left_anti")


def transcript_text(segments: DataFrame, key: str) -> DataFrame:
    """(key, text): duration, language and speakers, a blank line, then a stamped line for each segment."""
    row = F.struct("start", "end", "speaker", "text")
    whole = segments.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("s"), F.max("seconds").alias("seconds"), F.max("language").alias("language"))
    who = F.array_distinct(F.filter(F.transform("s", lambda x: x["speaker"]), lambda x: x.isNotNull()))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws("\n", line("Duration", format_clock(F.col("seconds"))), line("Language", F.col("language")), F.when(F.size(who) > 0, line("Speakers", F.array_join(who, ", "))))
    body = F.array_join(F.transform("s", lambda x: segment_line(x["start"], x["speaker"], x["text"])), "\n")
    return whole.select(key, F.concat_ws("\n\n", F.nullif(head, F.lit("")), body).alias("text"))


_STAMPED = re.compile(r"^\[(\d+):(\d{2}):(\d{2})\] ?(.*)$", re.M)


def _bare(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", text.lower()).split())


def said_at(text: str, quote: str | None) -> float | None:
    """Seconds of the stamped line that holds a quote, or ends with the quote's opening words."""
    wanted = _bare(quote or "")
    if not wanted:
        return None
    lines = [(int(h) * 3600 + int(m) * 60 + int(s), _bare(rest)) for h, m, s, rest in _STAMPED.findall(text)]
    for at, line in lines:
        if wanted in line:
            return float(at)
    words = wanted.split()
    for n in range(len(words) - 1, 2, -1):
        for at, line in lines:
            if line.endswith(" ".join(words[:n])):
                return float(at)
    return None
