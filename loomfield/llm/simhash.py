"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within ``radius`` bits of each other share a variant within half the radius of both, so
every distinct fingerprint emits all variants of its small ball (itself and 64 single-bit flips at
radius 2), variants are shuffled, and neighbours on one variant are verified.  Members of one variant
are all within the radius of each other, so linking each to its predecessor loses nothing, and no
group holds more than 65 distinct fingerprints, however many copies of a text there are.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like
any other; fewer words than ``width`` make one shingle; null ids keep their row and never become a
component id unless the whole component has none; repeated rows and ids are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm import shingles
from loomfield.llm.common import fresh, frugal, keep, utf8
from loomfield.llm.graph import connected_components

WIDTH, SEED, RADIUS = 3, 42, 2
_CHUNK = 1 << 16


def fingerprint_of(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(joined[s : e - 1], seed) for s, e in zip(starts, ends[width - 1 :], strict=False)), np.uint64, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), _CHUNK):
        part = np.ascontiguousarray(h[k : k + _CHUNK].astype("<u8")).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``docs`` with a signed long fingerprint beside all its columns."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_of(x, width, seed) if x else 0 for x in utf8(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(frugal(run), schema)


def ball_edges(prints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """(a, b) links of distinct fingerprints within two bits; their transitive closure holds every such pair."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    variants = prints.select(F.col(column).alias("fp")).select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("variant"))
    pairs = variants.select("fp", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("a"))
    return pairs.where("a is not null").where(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= RADIUS).select("a", F.col("fp").alias("b"))


def groups(prints: DataFrame, doc_id: str = "doc_id", column: str = "fingerprint", texts: DataFrame | None = None) -> DataFrame:
    """(fingerprint, root, component_id): each distinct fingerprint's component and the smallest id in it.

    With ``texts`` (fingerprint, text), those with similar five-word shingles link too.
    """
    classes = keep(prints.groupBy(F.col(column).alias("fp")).agg(F.min(doc_id).alias("least")), "classes")
    links = ball_edges(classes, "fp")
    if texts is not None:
        links = keep(links, "links")
        links = links.unionByName(shingles.edges(texts.select(F.col(column).alias("c"), F.xxhash64("text").alias("t"), "text"), links))
    roots = connected_components(links)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return keep(rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias(column), "root", "component_id"), "groups")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the fingerprint (signed long) and the component id."""
    prints = keep(with_fingerprint(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).select("doc_id", "fingerprint"), "prints")
    return prints.join(groups(prints), "fingerprint").select("doc_id", "fingerprint", "component_id")


def _hashable(field: T.StructField) -> Column:
    """A column, or for those that have no hash (with maps or variants inside) their JSON."""
    kind = field.dataType.simpleString()
    column = F.col(f"`{field.name}`")
    return F.to_json(F.struct(column.alias("x"))) if "map<" in kind or "variant" in kind else column


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: bool = False) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (nulls last), ties by the rows' hash.

    ``similar`` links texts of five-word shingles at 0.8 or more as well as those within two bits.
    """
    h, names = fresh(docs, "hash"), docs.columns
    hashed = docs.withColumn(h, F.xxhash64(*map(_hashable, docs.schema.fields)))
    slim = hashed.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(h).alias("h"))
    printed = keep(with_fingerprint(slim), "prints")
    prints = printed.select("doc_id", "h", "fingerprint")
    texts = printed.where("text is not null").select("fingerprint", "text") if similar else None
    joined = prints.join(groups(prints, texts=texts), "fingerprint")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("h").alias("h"))
    best = joined.groupBy("root").agg(F.min(rank).alias("b"))
    best = keep(best.select(F.col("b.i").alias("__i"), F.col("b.h").alias("__h")).distinct(), "best")
    same = hashed[f"`{doc_id}`"].eqNullSafe(best["__i"]) & (hashed[h] == best["__h"])
    # repeated rows are combined before the shuffle
    return hashed.join(best, same, "left_semi").dropDuplicates([doc_id, h]).select(*[F.col(f"`{c}`") for c in names])
