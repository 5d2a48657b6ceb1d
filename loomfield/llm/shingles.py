"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Every distinct text is sketched by ``BANDS`` bands of ``ROWS`` least hashes; a pair at 0.8 shares none with a
chance of (1 - 0.8^4)^20, three in 100,000.  Texts that share a band are candidates, and every link is verified
on the whole shingle sets.

A band's texts are compared with its head first, the text that shares most bands with others, which is the
original in a group of near copies.  After components are known, only texts that aren't in the head's component
meet the others, in every pair that would join two components: directly in bands of up to ``MOST`` texts.  In
larger ones, where that would grow with the square of the group, candidates come from the texts' rarest shingles
(prefix and positional filter): two sets at 0.8 must share one of the rarest fifth of each, so passages that
many texts share make no pairs, and no link is left out by size.

Defined results: words as in ``simhash``; fewer than five words make one shingle; texts without words link nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import few, frugal, keep, utf8
from loomfield.llm.graph import connected_components

WIDTH, BANDS, ROWS = 5, 20, 4
#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Texts of a band whose pairs are compared directly.
MOST = 64
#: Shingles of a chunk of sets, as expected.
CHUNK_SHINGLES = 200_000
_CACHE = 300_000
_CHUNK = 4096
_ODD = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Word to its hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def shingles(self, text: bytes) -> np.ndarray:
        """Distinct hashes of the text's shingles, in order."""
        words = text.lower().split()
        h = np.fromiter((self[w] for w in words), np.uint64, len(words))
        if not len(h):
            return h
        width = min(WIDTH, len(h))
        out = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            out = _mixed(out + h[k : k + len(out)])
        return np.unique(out)


def bands_of(shingles: np.ndarray) -> list[int]:
    """Signed band keys of a set, none for the empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), _CHUNK):
        # the hashes are mixed already, so multiplying by odd numbers orders them anew
        least = np.minimum(least, (shingles[a : a + _CHUNK, None] * _ODD).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = _mixed(out * _ODD[0] + row)
    return out.view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def with_bands(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with an array of band keys instead of the text."""
    at, names = docs.columns.index(text), [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            found = [bands_of(hashes.shingles(x or b"")) for x in utf8(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.int64()))], names=[*names, "bands"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.mapInArrow(frugal(run), f"{kinds}, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` (ta, tb, a, b) that are similar, by ``texts`` (t, text)."""
    left, right = texts.select(F.col("t").alias("ta"), F.col("text").alias("xa")), texts.select(F.col("t").alias("tb"), F.col("text").alias("xb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, own = Hashes(), None, None
        for whole in batches:
            for k in range(0, whole.num_rows, 256):  # so that few texts are Python objects at once
                batch, keep_ = whole.slice(k, 256), []
                for t, x, y in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), utf8(batch.column(2)), strict=True):
                    if t != last:
                        last, own = t, hashes.shingles(x)
                    keep_.append(similar(own, hashes.shingles(y)))
                yield batch.filter(pa.array(keep_, pa.bool_())).select([3, 4])

    return pairs.join(left, "ta").join(right, "tb").select("ta", "xa", "xb", "a", "b").mapInArrow(frugal(run), "a long, b long")


def rare_shingles(texts: DataFrame) -> DataFrame:
    """(key, t, c, size, at) of ``texts`` (t, c, text): of each set the rarest shingles that two texts hold, up to
    a fifth of the set and one, with the size of the set and the shingle's place from the rarest on.

    Sets are dealt into chunks of bounded expected size.  A chunk sends each of its shingles once, with the number
    of its texts that hold it, and gets the totals back, so that copies weigh no more than one text of a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [hashes.shingles(x or b"").view(np.int64) for x in utf8(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("t"), part.column("c"), pa.array(sets, pa.list_(pa.int64()))], names=["t", "c", "s"])

    sets = keep(texts.select("t", "c", "text").mapInArrow(frugal(run), "t long, c long, s array<long>"), "sets")
    chunks = max(1, -(-(sets.agg(F.sum(F.size("s"))).first()[0] or 0) // CHUNK_SHINGLES))
    dealt = sets.withColumn("chunk", F.pmod(F.xxhash64("t"), F.lit(chunks)))

    def own(key: tuple, group: pa.Table) -> pa.Table:
        found, n = np.unique(group.column("s").combine_chunks().flatten().to_numpy(), return_counts=True)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(found), pa.int64()), "key": pa.array(found, pa.int64()), "n": pa.array(n, pa.int64())})

    each = keep(dealt.groupBy("chunk").applyInArrow(own, "chunk long, key long, n long"), "dictionaries")
    shared = keep(each.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "shared")
    totals = each.select("chunk", "key").join(few(shared), "key")

    def pick(sets: pa.Table, totals: pa.Table) -> pa.Table:
        keys, n = totals.column("key").to_numpy(), totals.column("n").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        out: list[tuple] = []
        for t, c, s in zip(sets.column("t").to_pylist(), sets.column("c").to_pylist(), sets.column("s").combine_chunks(), strict=True):
            s = s.values.to_numpy()
            where = np.searchsorted(keys, s)
            there = (where < len(keys)) & (keys[np.minimum(where, len(keys) - 1)] == s) if len(keys) else np.zeros(len(s), bool)
            s, count = s[there], n[where[there]]
            first = len(there) - len(s)  # shingles of one text come before all others
            length = len(there) - -(-len(there) * OVER // UNDER) + 1 - first
            best = np.lexsort((s, count))[: max(0, length)]
            out += [(k, t, c, len(there), first + at) for at, k in enumerate(s[best].tolist())]
        columns = zip(*out, strict=True) if out else ((),) * 5
        return pa.table(dict(zip(("key", "t", "c", "size", "at"), (pa.array(x, pa.int64()) for x in columns), strict=True)))

    return dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(pick, "key long, t long, c long, size long, at long")


def _near(x: str, y: str) -> Column:
    """Whether sets that have no common shingle before the places of this one can be similar."""
    most = F.least(F.col(f"{x}.size") - F.col(f"{x}.at"), F.col(f"{y}.size") - F.col(f"{y}.at"))
    return most * (OVER + UNDER) >= (F.col(f"{x}.size") + F.col(f"{y}.size")) * OVER


def edges(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b) links of classes that, with the ``known`` ones, keep the components of similar texts together.

    ``docs`` has (c, t, text): a class of rows that are one anyway, the hash of the text, and the text.
    """

    def checked(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        pairs = keep(pairs.distinct(), f"{name}-pairs")
        wanted = keep(pairs.select(F.col("ta").alias("t")).unionAll(pairs.select("tb")).distinct(), f"{name}-wanted")
        return keep(verified(pairs, keep(texts.join(few(wanted), "t", "left_semi"), f"{name}-texts")), name)

    def shared(rows: DataFrame, name: str) -> DataFrame:
        """``rows`` (key, m), m being (t, c, size, at), of keys that several texts have, with their number."""
        several = keep(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-keys")
        return keep(rows.join(few(several), "key"), f"{name}-members")

    def meet(members: DataFrame, texts: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """``links`` with those to the heads of groups, and the groups' rows with their components."""
        weights = members.groupBy(F.col("m.t").alias("t")).agg(F.sum("n").alias("w"))
        weighted = members.join(weights, members.m.t == weights.t).select("key", "n", "m", "w")
        heads = weighted.groupBy("key").agg(F.max_by("m", F.struct("w", F.col("m.t"))).alias("head"))
        headed = keep(members.join(heads, "key"), f"{name}-headed")
        pairs = headed.where("m.c <> head.c").where(_near("m", "head"))
        links = keep(links.unionByName(checked(pairs.select(F.col("head.t").alias("ta"), F.col("m.t").alias("tb"), F.col("head.c").alias("a"), F.col("m.c").alias("b")), texts, f"{name}-heads")), f"{name}-links")
        roots = keep(connected_components(links), f"{name}-roots")
        mine, its = roots.select(F.col("node").alias("mc"), F.col("component").alias("mr")), roots.select(F.col("node").alias("hc"), F.col("component").alias("hr"))
        rooted = headed.join(mine, F.col("m.c") == F.col("mc"), "left").join(its, F.col("head.c") == F.col("hc"), "left")
        r = F.coalesce("mr", "m.c")
        return links, keep(rooted.select("key", "n", "m", r.alias("r"), (r != F.coalesce("hr", "head.c")).alias("apart")), f"{name}-rooted")

    def rest(rooted: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        """The links between texts of one group that join components; those within the head's component aren't looked at."""
        x = rooted.where("apart").select("key", F.col("m").alias("x"), F.col("r").alias("rx"))
        y = rooted.select("key", F.col("m").alias("y"), F.col("r").alias("ry"), F.col("apart").alias("also"))
        pairs = x.join(y, "key").where("rx <> ry and (not also or x.t < y.t)").where(_near("x", "y"))
        return checked(pairs.select(F.col("x.t").alias("ta"), F.col("y.t").alias("tb"), F.col("x.c").alias("a"), F.col("y.c").alias("b")), texts, name)

    sketched = keep(with_bands(docs).groupBy("t").agg(F.min("c").alias("c"), F.first("bands").alias("bands")), "sketches")
    whole = F.struct("t", "c", F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("at"))  # bands tell nothing of places
    members = shared(sketched.select(whole.alias("m"), F.explode("bands").alias("key")), "bands")
    # only texts that share a band are looked at again
    mine = keep(members.select("m.t").distinct(), "mine")
    texts = keep(docs.select("t", "text").join(few(mine), "t", "left_semi").groupBy("t").agg(F.min("text").alias("text")), "texts")
    links, rooted = meet(members, texts, known, "bands")
    out = links.unionByName(rest(rooted.where(F.col("n") <= MOST), texts, "pairs"))
    large = rooted.where(F.col("n") > MOST)
    left = keep(large.join(large.where("apart").select("key").distinct(), "key", "left_semi").select("m.t", "m.c").distinct(), "left")
    if left.isEmpty():
        return out
    rows = keep(rare_shingles(texts.join(few(left), "t")), "rare").select("key", F.struct("t", "c", "size", "at").alias("m"))
    links, rooted = meet(shared(rows, "rare"), texts, keep(out, "out"), "rare")
    return links.unionByName(rest(rooted, texts, "rare-pairs"))
