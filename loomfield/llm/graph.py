"""Connected components over edges of long ids, by alternating large-star and small-star rounds.

Groups may hold a third of all nodes: minima are taken by ``groupBy().min`` (combined before the
shuffle) and handed back by joins, which adaptive execution splits where a key is hot.  A first
union-find inside every partition turns dense groups into stars, so that few rounds remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import drop, keep

#: So many edges at most are finished by one task; more go through further rounds.
ONE_TASK_EDGES = 10_000


def forest(pairs) -> dict[int, int]:
    """Node to smallest node of its group, for nodes that aren't the smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent) if find(x) != x}


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # folding each batch into the forest so far keeps memory at the nodes of one partition
    stars: dict[int, int] = {}
    for batch in batches:
        stars = forest([*stars.items(), *zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
    if stars:
        yield pa.RecordBatch.from_arrays([pa.array(list(stars), pa.int64()), pa.array(list(stars.values()), pa.int64())], names=["hi", "lo"])


def _stars(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_local, "hi long, lo long")


def _size(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star; edges run from the larger node ``hi`` to the smaller ``lo``."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo"), F.col("hi")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lo"), F.least("u", "m").alias("m"))
    large = edges.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct()
    down = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(down, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
    return small.select("e.*").where("hi <> lo").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge whose component, the smallest node reachable, isn't itself.

    Null ends and loops link nothing; repeated edges count once; no edges give an empty frame.
    """
    pairs = edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo"))
    pairs = keep(_stars(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))), "edges")
    before = _size(pairs)
    while before[0] > ONE_TASK_EDGES:
        pairs, last = keep(_round(pairs), "edges"), pairs
        drop(last)
        after = _size(pairs)
        if after == before:
            break
        before = after
    else:
        pairs = keep(_stars(pairs.coalesce(1)), "edges")
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
