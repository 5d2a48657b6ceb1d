"""Images by their addresses: fetched with limits, resized by a caller's function, told in words from their headers."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.functions.text import image_type
from loomfield.sources.images import ACCEPTED, MAX_BYTES, read_images
from loomfield.sources.rows import explode_text

MOST, CONCURRENCY, TIMEOUT = 10, 4, 15.0
LABEL_SUFFIX = " (photo metadata)"
#: Longest side and quality that resizers are asked for.
MAX_EDGE, QUALITY = 1568, 85
Answer = tuple[int, str | None, bytes]


class Resizer(Protocol):
    """An image's bytes within a longest side; it must be picklable, as it runs in the executors."""

    def __call__(self, data: bytes, max_edge: int, quality: int) -> bytes: ...


def unchanged(data: bytes, max_edge: int, quality: int) -> bytes:
    return data


def get(url: str, timeout: float, most: int) -> Answer:
    """(status, content type, body up to one byte over ``most``) over HTTP; redirects are followed."""
    request = urllib.request.Request(url, headers={"Accept": "image/*"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as found:
            return found.status, found.headers.get_content_type(), found.read(most + 1)
    except urllib.error.HTTPError as e:
        return e.code, None, b""


def fetch_images(rows: DataFrame, item: str, url: str = "url", alt: str = "alt", pos: str = "pos", fetch: Callable[[str, float, int], Answer] = get, most: int = MOST, max_bytes: int = MAX_BYTES, timeout: float = TIMEOUT, concurrency: int = CONCURRENCY) -> DataFrame:
    """(item, pos, url, label, content, media_type, reason): each address's image, or why there is none.

    Of an item the first ``most`` are fetched, ``concurrency`` at once in a task.  A reason is ``count``, ``status``,
    ``content_type``, ``too_large``, ``unsupported``, ``timeout`` or ``network``, with its details.
    """
    rank = F.row_number().over(Window.partitionBy(item).orderBy(pos))
    label = F.coalesce(F.nullif(F.trim(F.col(alt)), F.lit("")), F.concat(F.lit("Image "), rank.cast("string")))
    asked = rows.select(item, pos, url, label.alias("label"), rank.alias("__rank"))
    schema = T.StructType([*asked.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("reason", T.StringType())])

    def one(address: str, rank: int) -> tuple[bytes | None, str | None]:
        if rank > most:
            return None, f"count: only {most} are fetched"
        try:
            status, kind, data = fetch(address, timeout, max_bytes)
        except TimeoutError:
            return None, f"timeout: after {timeout:g} s"
        except Exception as e:  # a fetcher is the caller's code; its failure is the row's result
            late = isinstance(getattr(e, "reason", None), TimeoutError)
            return None, f"timeout: after {timeout:g} s" if late else f"network: {type(e).__name__}: {e}"
        if not 200 <= status < 300:
            return None, f"status: {status}"
        if kind and not kind.startswith("image/") and kind != "application/octet-stream":
            return None, f"content_type: {kind}"
        return (data, None) if len(data) <= max_bytes else (None, f"too_large: over {max_bytes} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                for k in range(0, batch.num_rows, 4 * concurrency):  # so that few images are held at once
                    part = batch.slice(k, 4 * concurrency)
                    found = list(pool.map(one, part.column(url).to_pylist(), part.column("__rank").to_pylist()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.string())], names=schema.names)

    found = asked.mapInArrow(run, schema).withColumn("media_type", image_type(F.col("content")))
    bad = F.col("content").isNotNull() & ~F.coalesce(F.col("media_type").isin(*ACCEPTED), F.lit(False))
    reason = F.when(bad, F.concat(F.lit("unsupported: "), F.coalesce("media_type", F.lit("unknown format")))).otherwise(F.col("reason"))
    return found.select(item, pos, url, "label", F.when(~bad, F.col("content")).alias("content"), F.when(~bad, F.col("media_type")).alias("media_type"), reason.alias("reason"))


def prepare_images(rows: DataFrame, key: str, content: str, resize: Resizer = unchanged, max_edge: int = MAX_EDGE, quality: int = QUALITY) -> DataFrame:
    """(key, content, error): images as the resizer gives them; a failing image is a row with its error."""
    return explode_text(rows, key, content, lambda data: [{"content": resize(bytes(data), max_edge, quality)}], "content binary")


def metadata_text(width: Column, height: Column, facts: Column) -> Column:
    """What the headers say, a fact a line; the first line says where facts come from."""
    fact = lambda name, key: F.when(facts[key].isNotNull(), F.concat(F.lit(f"{name}: "), facts[key]))
    place = F.when(facts["latitude"].isNotNull(), F.format_string("Camera's place: %.6f, %.6f (latitude, longitude)", facts["latitude"].cast("double"), facts["longitude"].cast("double")))
    size = F.when(width.isNotNull() & height.isNotNull(), F.concat(F.lit("Dimensions: "), width.cast("string"), F.lit("×"), height.cast("string"), F.lit(" pixels")))
    turned = F.when(facts["orientation"] != "upright", F.concat(F.lit("Orientation: "), facts["orientation"]))
    none = F.when(facts["taken"].isNull() & facts["latitude"].isNull(), F.lit("Neither a time nor a place is recorded."))
    return F.concat_ws("\n", F.lit("From the image file's headers, not from the picture:"), fact("Taken", "taken"), place, turned, fact("Camera", "camera"), fact("Software", "software"), size, fact("Description", "caption"), none)


def metadata_sources(rows: DataFrame, key: str, content: str, label: str) -> DataFrame:
    """(key, label, text): a text source beside each image that can be read."""
    named = rows.select(F.col(key), F.concat(F.coalesce(F.col(label), F.lit("Image")), F.lit(LABEL_SUFFIX)).alias("label"))
    told = read_images(rows, key, content).where("error is null").select(key, metadata_text(F.col("width"), F.col("height"), F.col("facts")).alias("text"))
    return told.join(named, key)


def is_metadata_source(label: Column) -> Column:
    return F.coalesce(label.endswith(LABEL_SUFFIX), F.lit(False))
