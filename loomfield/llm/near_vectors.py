"""Near-duplicate vectors by a robust-pruned flat graph on overlapping cluster shards.

1. Valid vectors are grouped into classes of equal vectors, so copies never meet each other as rows.
2. Centroids are fitted on a bounded sample; every class goes to its home cluster and the next nearest ones.
   Many centroids are fitted in two levels, the second inside each cluster of the first by a task of its own, and
   a class looks for its clusters below the nearest ones of the first level.
   A cluster of more than ``SHARD`` members is dealt into blocks, and all its members are queries to each.
3. Every block builds a robust-pruned graph of its members; the adjacency lists of a class are united.
4. In every block the queries search the united graph greedily from the block's medoid, then expand from all
   that lie in range until no further neighbour does.  A found pair is verified in double precision and
   counted in the block where its other end is at home and a member, thus once.
5. Recall is audited before a result is given.  For ``AUDIT`` classes a neighbour is planted at a cosine a little
   over the threshold, in a random direction; planted vectors are searched like all others, count for nothing,
   and tell the share of known links that was found.  The true links of as many classes, by brute force over all
   rows, are audited as well.  Where either share is below the target the search is repeated with more overlap
   and a wider beam; where that doesn't reach it, too much is missing or it would cost more, all pairs of tiles whose clusters'
   radii allow a link are compared in full, which is exact.  The share is the column ``recall``.

Defined results: a null, empty or zero vector, and one with null or non-finite components, links with
nothing and is its own component, as does a row without an id (whose component is null).  Repeated rows are
vectors of their own.  Vectors of different lengths have no cosine and never link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm.common import keep
from loomfield.llm.graph import connected_components, forest

THRESHOLD = 0.9
#: Rows that centroids are fitted on, most clusters, members of a block, and queries audited.
SAMPLE, CLUSTERS, SHARD, AUDIT = 20_000, 65_536, 2048, 512
#: Most clusters of one level, rows of the sample for each cluster of the second, clusters of the first looked below.
LEVEL, PER_CLUSTER, BELOW = 1024, 16, 4
#: Planted cosines lie between the threshold and this share of the way from it to 1; fewest true links that tell a share.
PLANTED_SPAN, LINKS_TOLD = 0.3, 100
#: Clusters a class goes to, neighbours kept by pruning, candidates pruned from, beam width, pruning factor.
OVERLAP, DEGREE, CANDIDATES, BEAM, ALPHA = 3, 20, 48, 32, 1.2
RECALL, TRIES = 0.99, 3
#: Recall below which a group lies over more clusters than a wider search would reach, and classes up to which
#: comparing all of them costs less than a wider search.
WIDEN, ALL_COMPARED = 0.9, 100_000
#: Rows and bytes of vectors of a tile of the full comparison.
TILE, TILE_BYTES = 8192, 64 << 20
_QUERIES = 256
_DENSE = 50_000


def classes_of(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(all rows with id, the vector's key and validity; kept classes with cid, key, v, n, least).

    A key is 128 bits of two hashes, so that joins needn't carry vectors.
    """
    v = F.transform(F.col(f"`{embedding}`").cast("array<double>"), lambda x: x + F.lit(0.0))  # one zero only
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("v"), (F.coalesce(fine, F.lit(False)) & F.col(f"`{vec_id}`").isNotNull()).alias("valid"))
    rows = rows.select("vec_id", "valid", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit("v"), "v").alias("b")).alias("key"), "v")
    found = rows.where("valid").groupBy("key").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # ids are fixed by writing them
    return rows.drop("v"), keep(found.select(F.monotonically_increasing_id().alias("cid"), "key", "v", "n", "least"), "classes")


def unit(x: np.ndarray) -> np.ndarray:
    # dividing by the largest component first keeps squares in range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def centroids(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([np.argmax(sample[i : i + 2048] @ centres.T, axis=1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Centres:
    """Centroids of all clusters, and where there are two levels those of the first and which clusters lie below each."""

    flat: np.ndarray
    top: np.ndarray | None = None
    stops: np.ndarray | None = None  # clusters below the k-th of the first level are stops[k] to stops[k + 1]

    def nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        """The nearest clusters of each row, -1 where fewer lie below those looked at; the first is its home."""
        if self.top is None:
            return np.argsort(-(x @ self.flat.T), axis=1, kind="stable")[:, :m]
        first = np.argsort(-(x @ self.top.T), axis=1, kind="stable")[:, :BELOW]
        near, best = np.full((len(x), m), -1), np.full((len(x), m), -np.inf)
        for k in np.unique(first).tolist():
            rows = np.flatnonzero((first == k).any(axis=1))
            a, b = self.stops[k], self.stops[k + 1]
            if a == b:
                continue
            sims = np.concatenate([best[rows], x[rows] @ self.flat[a:b].T], axis=1)
            ids = np.concatenate([near[rows], np.broadcast_to(np.arange(a, b), (len(rows), b - a))], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :m]
            best[rows], near[rows] = np.take_along_axis(sims, order, axis=1), np.take_along_axis(ids, order, axis=1)
        return near


def fit_centres(classes: DataFrame, total: int, dimension: int, k: int) -> Centres:
    """About ``k`` centroids; beyond ``LEVEL`` in two levels, of which the driver fits the first and collects the second."""
    sample = classes.select("v").sample(min(1.0, 1.2 * SAMPLE / max(total, 1)), seed=5).limit(SAMPLE).toArrow()
    if not sample.num_rows:
        sample = classes.select("v").limit(1).toArrow()
    first = centroids(unit(matrix(sample.column("v"), dimension)), k if k <= LEVEL else math.ceil(math.sqrt(k)))
    if k <= LEVEL:
        return Centres(first)
    share = min(1.0, PER_CLUSTER * k / max(total, 1))
    sent = classes.sparkSession.sparkContext.broadcast(first)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.argmax(unit(matrix(batch.column("v"), dimension)) @ sent.value.T, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), batch.column("v")], names=["top", "v"])

    def fit(key: tuple, group: pa.Table) -> pa.Table:
        x = unit(matrix(group.column("v"), dimension))
        found = centroids(x, max(1, round(len(x) / (PER_CLUSTER if share < 1 else max(1, total / k)))))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * dimension, pa.int32()), pa.array(found.ravel()))
        return pa.table({"top": pa.array([key[0].as_py()] * len(found), pa.int32()), "v": lists})

    dealt = keep(classes.select("v").sample(share, seed=6).mapInArrow(assign, "top int, v array<double>"), "sampled")
    # a first-level cluster that holds much of the sample is fitted in parts of bounded size
    parts = dealt.withColumn("part", F.pmod(F.xxhash64("v"), F.ceil(F.count("*").over(Window.partitionBy("top")) / SAMPLE)))
    found = parts.groupBy("top", "part").applyInArrow(lambda key, group: fit(key, group), "top int, v array<double>").toArrow().sort_by("top")
    tops = found.column("top").to_numpy()
    return Centres(matrix(found.column("v"), dimension), first, np.searchsorted(tops, np.arange(len(first) + 1)))


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency of unit vectors: of each one's nearest candidates, the nearest is taken again and again, and
    those that are ``alpha`` times nearer to it than to the vector itself go; links then hold both ways."""
    n = len(x)
    c = min(candidates, n - 1)
    if c < 1:
        return [np.empty(0, np.int64) for _ in range(n)]
    x32, out = x.astype(np.float32), []
    for a in range(0, n, 256):
        own = np.arange(a, min(a + 256, n))
        sims = x32[own] @ x32.T
        sims[np.arange(len(own)), own] = -2
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        s = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        near, s = np.take_along_axis(near, order, axis=1), np.take_along_axis(s, order, axis=1)
        alive, kept, row = np.ones_like(near, bool), np.zeros_like(near, bool), np.arange(len(own))
        vectors = x32[near]
        for _ in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = np.argmax(alive, axis=1)
            kept[row[some], pick[some]] = True
            alive[row, pick] = False
            between = np.einsum("nd,ncd->nc", vectors[row, pick], vectors)
            # distances of unit vectors are 2 - 2 cos, squared
            alive &= alpha * alpha * (1 - between) > 1 - s
        out += [near[k][kept[k]] for k in range(len(own))]
    back: list[list[int]] = [[] for _ in range(n)]
    for k, to in enumerate(out):
        for j in to.tolist():
            if len(back[j]) < degree:
                back[j].append(k)
    return [np.unique(np.concatenate([to, np.asarray(b, np.int64)])) for to, b in zip(out, back, strict=True)]


def padded(lists: list[np.ndarray]) -> np.ndarray:
    """Rows of neighbours, filled up with -1."""
    out = np.full((len(lists), max(1, max(map(len, lists), default=1))), -1, np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def range_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM, starts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query row, member row) in range, for some queries at a time."""
    n, x32 = len(x), x.astype(np.float32)
    centre = x32.mean(axis=0)
    medoid = int(np.argmax(x32 @ centre))
    slack = threshold - 1e-4
    for a in range(0, len(queries), _QUERIES):
        q = queries[a : a + _QUERIES].astype(np.float32)
        m = len(q)
        row = np.arange(m)
        seen = np.zeros((m, n), bool)
        ids = np.full((m, beam), -1, np.int64)
        sims = np.full((m, beam), -3, np.float32)
        done = np.ones((m, beam), bool)
        first = np.full((m, 2), medoid)
        if starts is not None:
            own = starts[a : a + m]
            first[:, 1] = np.where(own >= 0, own, medoid)
        for k in range(2):
            new = ~seen[row, first[:, k]]
            ids[new, k], done[new, k] = first[new, k], False
            sims[new, k] = np.einsum("nd,nd->n", q[new], x32[first[new, k]])
            seen[row, first[:, k]] = True
        hits_q, hits_x = [], []
        while True:
            open_ = np.where(done, -4, sims)
            best = np.argmax(open_, axis=1)
            live = np.flatnonzero(open_[row, best] > -3)
            if not len(live):
                break
            done[live, best[live]] = True
            to = links[ids[live, best[live]]]
            fresh = (to >= 0) & ~seen[live[:, None], to]
            seen[np.broadcast_to(live[:, None], to.shape)[fresh], to[fresh]] = True
            s = np.where(fresh, np.einsum("nd,ncd->nc", q[live], x32[np.maximum(to, 0)]), -3)
            lq, lc = np.nonzero(s >= slack)  # whatever falls off the beam stays found
            hits_q.append(live[lq])
            hits_x.append(to[lq, lc])
            all_s = np.concatenate([sims[live], s], axis=1)
            all_i = np.concatenate([ids[live], to], axis=1)
            all_d = np.concatenate([done[live], ~fresh], axis=1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[live], ids[live], done[live] = (np.take_along_axis(z, top, axis=1) for z in (all_s, all_i, all_d))
        bq, bk = np.nonzero(sims >= slack)
        pairs = np.unique(np.concatenate([*(h * n + y for h, y in zip(hits_q, hits_x, strict=True)), bq * n + ids[bq, bk]]).astype(np.int64))
        found, frontier = [pairs], pairs
        while len(frontier):
            more = []
            for b in range(0, len(frontier), 1 << 15):
                fq, fx = np.divmod(frontier[b : b + (1 << 15)], n)
                to = links[fx]
                new = (to >= 0) & ~seen[fq[:, None], to]
                keys = np.unique((np.broadcast_to(fq[:, None], to.shape)[new] * n + to[new]).astype(np.int64))
                nq, nx = np.divmod(keys, n)
                seen[nq, nx] = True
                more.append(keys[np.einsum("nd,nd->n", q[nq], x32[nx]) >= slack])
            frontier = np.concatenate(more)
            found.append(frontier)
        fq, fx = np.divmod(np.concatenate(found), n)
        # verified in double precision
        for b in range(0, len(fq), 1 << 18):
            pq, px = fq[b : b + (1 << 18)], fx[b : b + (1 << 18)]
            true = np.einsum("nd,nd->n", queries[a + pq], x[px]) >= threshold
            yield a + pq[true], px[true]


def deal(classes: DataFrame, centres: Centres, dimension: int, overlap: int) -> DataFrame:
    """(cluster, home, cid, v, n) for each class and each of its nearest clusters."""
    sent = classes.sparkSession.sparkContext.broadcast(centres)  # at most CLUSTERS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        m = min(overlap, len(c.flat))
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                near = c.nearest(unit(matrix(part.column("v"), dimension)), m)
                there = near.ravel() >= 0
                take = pa.array(np.repeat(np.arange(part.num_rows), m)[there])
                home = np.tile(np.arange(m) == 0, part.num_rows)[there]
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()[there].astype(np.int32)), pa.array(home), *(part.column(k).take(take) for k in ("cid", "v", "n"))], names=["cluster", "home", "cid", "v", "n"])

    return classes.mapInArrow(run, "cluster int, home boolean, cid long, v array<double>, n long")


def _blocks(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members by block, and queries by block: clusters of more than SHARD members have several blocks."""
    blocks = dealt.groupBy("cluster").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("blocks"))  # at most CLUSTERS rows
    sized = dealt.join(F.broadcast(keep(blocks, "blocks")), "cluster")
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    members = sized.withColumn("block", mine).drop("blocks")
    queries = sized.where("blocks > 1").select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).where("block <> mine").drop("mine", "blocks")
    return members, queries


def search(classes: DataFrame, centres: Centres, dimension: int, threshold: float, overlap: int, beam: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept (cid, links) and (a, b) edges over classes that keep components together."""
    dealt = keep(deal(classes, centres, dimension, overlap), "dealt")
    members, queries = _blocks(dealt)

    def build(key: tuple, group: pa.Table) -> pa.Table:
        ids = group.column("cid").to_numpy()
        lists = robust_prune(unit(matrix(group.column("v"), dimension)))
        return pa.table({"cid": pa.array(ids), "near": pa.array([ids[x] for x in lists], pa.list_(pa.int64()))})

    lists = members.select("cluster", "block", "cid", "v").groupBy("cluster", "block").applyInArrow(build, "cid long, near array<long>")
    united = keep(lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    rows = members.join(united, "cid").unionByName(queries.withColumn("near", F.lit(None).cast("array<long>")))

    def find(key: tuple, group: pa.Table) -> Iterator[pa.Table]:
        group = group.combine_chunks()
        is_member = ~group.column("near").is_null().to_numpy()
        mine = np.flatnonzero(is_member)
        ids, n = group.column("cid").to_numpy(), group.column("n").to_numpy()
        home = group.column("home").to_numpy(zero_copy_only=False)[mine]
        v = unit(matrix(group.column("v"), dimension))
        place = {c: k for k, c in enumerate(ids[mine].tolist())}
        links = padded([np.asarray([place[c] for c in x if c in place], np.int64) for x in group.column("near").take(pa.array(mine)).to_pylist()])
        starts = np.full(len(ids), -1)
        starts[mine] = np.arange(len(mine))
        count, stars = np.zeros(len(ids), np.int64), {}
        known = []
        for q, x in range_search(v[mine], links, v, threshold, beam, starts):
            fine = home[x] & (ids[q] != ids[mine][x])
            q, x = q[fine], x[fine]
            # of a planted vector only the link that it was planted for counts, and none to it
            known.append(ids[q][ids[mine][x] == -1 - ids[q]])
            fine = (ids[q] >= 0) & (ids[mine][x] >= 0)
            q, x = q[fine], x[fine]
            np.add.at(count, q, n[mine][x])
            if len(q) > _DENSE:
                (uq, r), (ux, c) = np.unique(q, return_inverse=True), np.unique(x, return_inverse=True)
                hits = np.zeros((len(uq), len(ux)), bool)
                hits[r, c] = True
                r, c = components(hits)
                q, x = uq[r], ux[c]
            stars = forest([*stars.items(), *zip(ids[q].tolist(), ids[mine][x].tolist(), strict=True)])
        some, planted = np.flatnonzero(count), np.unique(np.concatenate([*known, np.empty(0, np.int64)]))
        none = np.zeros(len(stars) + len(planted), np.int64)
        return pa.table({"cid": pa.array(np.concatenate([ids[some], np.fromiter(stars, np.int64, len(stars)), planted])), "links": pa.array(np.concatenate([count[some], none])), "to": pa.array([*([None] * len(some)), *stars.values(), *(-1 - planted).tolist()], pa.int64())})

    return _told(rows.groupBy("cluster", "block").applyInArrow(find, "cid long, links long, to long"))


def tiles(centres: np.ndarray, sizes: np.ndarray, radii: np.ndarray, threshold: float, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each cluster's first tile and number of tiles, and which tiles may link: clusters of more than ``rows``
    members have several, lesser ones share one with near clusters."""
    left, order, at = sizes > 0, [], int(np.argmax(sizes))
    while left.any():
        order.append(at)
        left[at] = False
        at = int(np.argmax(np.where(left, centres @ centres[at], -2)))
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    held, filled, owners = -1, rows + 1, []
    for c in order:
        if sizes[c] > rows or filled + sizes[c] > rows:
            parts[c] = -(-sizes[c] // rows)
            first[c], held = held + 1, held + parts[c]
            filled = sizes[c] if parts[c] == 1 else rows
            owners += [[c] for _ in range(parts[c])]
        else:
            first[c], filled = held, filled + sizes[c]
            owners[held].append(c)
    # the angle between centres is at most both radii and the angle of the threshold, with some room for rounding
    reach = np.arccos(np.clip(threshold, -1, 1)) + 1e-6
    near = np.arccos(np.clip(centres @ centres.T, -1, 1)) <= radii[:, None] + radii[None, :] + reach
    any_of = np.stack([near[own].any(axis=0) for own in owners])
    return first, parts, np.stack([any_of[:, own].any(axis=1) for own in owners], axis=1)


def components(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of a table of links that keep its components together, few where it is dense."""
    if np.count_nonzero(hits) <= _DENSE:
        return np.nonzero(hits)
    none = np.int32(hits.shape[1])
    label = np.arange(none, dtype=np.int32)
    while True:
        own = np.where(hits, label[None, :], none).min(axis=1)
        new = np.minimum(label, np.where(hits, own[:, None], none).min(axis=0))
        if (new == label).all():
            break
        label = new
    # a row stands with the least column of its component, and a column with a row of its own
    row, column = np.flatnonzero(own < none), np.flatnonzero(hits.any(axis=0))
    return np.concatenate([row, np.argmax(hits[:, column], axis=0)]), np.concatenate([own[row], column])


def compare(classes: DataFrame, centres: np.ndarray, dimension: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``search``, by comparing all classes of all tiles that may link: exact, with quadratic work in a hot group."""
    spark = classes.sparkSession
    sent = spark.sparkContext.broadcast(centres)  # at most LEVEL rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                sims = unit(matrix(part.column("v"), dimension)) @ sent.value.T
                yield pa.RecordBatch.from_arrays([pa.array(np.argmax(sims, axis=1).astype(np.int32)), pa.array(sims.max(axis=1)), *(part.column(k) for k in ("cid", "v", "n"))], names=["cluster", "cos", "cid", "v", "n"])

    homes = keep(classes.mapInArrow(place, "cluster int, cos double, cid long, v array<double>, n long"), "homes")
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in homes.groupBy("cluster").agg(F.count("*").alias("rows"), F.min("cos").alias("cos")).collect():
        sizes[r["cluster"]], radii[r["cluster"]] = r["rows"], np.arccos(np.clip(r["cos"], -1, 1)) + 1e-6
    first, parts, near = tiles(centres, sizes, radii, threshold, max(1, min(TILE, TILE_BYTES // (8 * dimension))))
    where = spark.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in np.flatnonzero(sizes)], "cluster int, first int, parts int")
    tiled = homes.join(F.broadcast(where), "cluster").select((F.col("first") + F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).alias("tile"), "cid", "v", "n")
    allowed = spark.sparkContext.broadcast(np.packbits(near, axis=1))  # a bit for each pair of tiles

    def pack(key: tuple, group: pa.Table) -> Iterator[pa.RecordBatch]:
        group, own = group.combine_chunks(), key[0].as_py()
        others = np.flatnonzero(np.unpackbits(allowed.value[own])[: len(allowed.value)])
        data = [group.column("cid").to_numpy().tobytes(), group.column("n").to_numpy().tobytes(), unit(matrix(group.column("v"), dimension)).tobytes()]
        for k in others.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([min(own, k)], pa.int32()), pa.array([max(own, k)], pa.int32()), pa.array([own], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["lo", "hi", "tile", "cids", "ns", "vs"])

    def packed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack(key, pa.Table.from_batches(batches))

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        found = {t: (np.frombuffer(i, np.int64), np.frombuffer(n, np.int64), np.frombuffer(v).reshape(-1, dimension)) for t, i, n, v in zip(*(group.column(c).to_pylist() for c in ("tile", "cids", "ns", "vs")), strict=True)}
        lo, hi = key[0].as_py(), key[1].as_py()
        links, stars = {}, {}
        if lo in found and hi in found:
            (ids, n, x), (to, m, y) = found[lo], found[hi]
            count, back = np.zeros(len(ids), np.int64), np.zeros(len(to), np.int64)
            for a in range(0, len(ids), 1024):
                hits = x[a : a + 1024] @ y.T >= threshold
                if lo == hi:
                    own = np.arange(len(hits))
                    hits[own, a + own] = False
                if hits.any():
                    dense = hits.astype(np.float64)  # sums are whole numbers, and matrix products fast
                    count[a : a + 1024] = np.rint(dense @ m.astype(np.float64)).astype(np.int64)
                    back += np.rint(n[a : a + 1024].astype(np.float64) @ dense).astype(np.int64)
                    r, c = components(hits)
                    stars = forest([*stars.items(), *zip(ids[a + r].tolist(), to[c].tolist(), strict=True)])
            links = dict(zip(ids[count > 0].tolist(), count[count > 0].tolist(), strict=True))
            if lo != hi:
                links |= dict(zip(to[back > 0].tolist(), back[back > 0].tolist(), strict=True))
        return pa.table({"cid": pa.array([*links, *stars], pa.int64()), "links": pa.array([*links.values(), *([0] * len(stars))], pa.int64()), "to": pa.array([*([None] * len(links)), *stars.values()], pa.int64())})

    sides = tiled.groupBy("tile").applyInArrow(packed, "lo int, hi int, tile int, cids binary, ns binary, vs binary")
    return _told(sides.groupBy("lo", "hi").applyInArrow(meet, "cid long, links long, to long"))


def _told(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links by class, edges, and the planted classes whose link was found."""
    found = keep(found, "found")
    counts = keep(found.where("to is null").groupBy("cid").agg(F.sum("links").alias("links")), "counts")
    return counts, found.where("to is not null and cid >= 0").select(F.col("cid").alias("a"), F.col("to").alias("b")), found.where("cid < 0").select("cid").distinct()


def plant(classes: DataFrame, dimension: int, threshold: float, rows: int = AUDIT, seed: int = 23) -> DataFrame:
    """Classes of no rows near some of ``classes``, with -1 - cid for their id; none in one dimension."""
    picked = classes.orderBy(F.xxhash64("cid")).limit(rows).select("cid", "v").toArrow()
    found = []
    if dimension > 1 and picked.num_rows and threshold < 1:
        rng, v = np.random.default_rng(seed), unit(matrix(picked.column("v"), dimension))
        w = rng.normal(size=v.shape)
        w -= (w * v).sum(axis=1, keepdims=True) * v
        cosine = rng.uniform(threshold, threshold + PLANTED_SPAN * (1 - threshold), (len(v), 1)) + 1e-9
        near = cosine * v + np.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w, axis=1, keepdims=True)
        found = [(-1 - cid, x, 0) for cid, x in zip(picked.column("cid").to_pylist(), near.tolist(), strict=True)]
    return classes.sparkSession.createDataFrame(found, "cid long, v array<double>, n long")


def audit(classes: DataFrame, counts: DataFrame, planted: int, met: int, dimension: int, threshold: float, rows: int = AUDIT) -> float:
    """The lesser of two shares: of the planted links, and of the true links of a bounded sample of classes.

    The second counts from ``LINKS_TOLD`` links on, or where nothing was planted.
    """
    share = met / planted if planted else 1.0
    picked = classes.orderBy(F.xxhash64("cid")).limit(rows).select("cid", "v").join(counts, "cid", "left").toArrow()
    if not picked.num_rows:
        return share
    ids, q = picked.column("cid").to_numpy(), unit(matrix(picked.column("v"), dimension))
    sent = classes.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = sent.value
        true = np.zeros(len(own), np.int64)
        for batch in batches:
            other, n = batch.column("cid").to_numpy(), batch.column("n").to_numpy()
            x = unit(matrix(batch.column("v"), dimension))
            for a in range(0, len(x), 2048):
                near = (q @ x[a : a + 2048].T >= threshold) & (own[:, None] != other[None, a : a + 2048])
                true += near @ n[a : a + 2048]
        yield pa.RecordBatch.from_arrays([pa.array([int(true.sum())])], names=["n"])

    true = classes.mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    have = sum(x or 0 for x in picked.column("links").to_pylist())
    return min(share, have / true) if true >= LINKS_TOLD or true and not planted else share


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, target: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for every row; the recall is that of the row's dimension."""
    spark = vectors.sparkSession
    rows, classes = classes_of(vectors, vec_id, embedding)
    links, labels, recalls = None, None, {}
    for (dimension,) in sorted(classes.select(F.size("v")).distinct().collect()):
        counts, edges, recalls[dimension] = _of_dimension(spark, classes.where(F.size("v") == dimension), dimension, threshold, target)
        links = counts if links is None else links.unionByName(counts)
        labels = edges if labels is None else labels.unionByName(edges)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"), F.lit(1.0).alias("recall"))
    roots = connected_components(labels)
    recall = F.element_at(F.create_map(*[F.lit(x) for pair in recalls.items() for x in pair]), F.size("v"))
    tagged = classes.join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    tagged = tagged.select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("root"), recall.alias("recall"))
    least = tagged.groupBy("root").agg(F.min("least").alias("component_id"))
    told = keep(tagged.join(least, "root").select("key", "n_links", "component_id", "recall", F.lit(True).alias("valid")), "told")
    joined = rows.join(told, ["key", "valid"], "left")
    own = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"), F.coalesce("recall", F.lit(1.0)).alias("recall"))


def _of_dimension(spark: SparkSession, classes: DataFrame, dimension: int, threshold: float, target: float) -> tuple[DataFrame, DataFrame, float]:
    classes = classes.select("cid", "v", "n")
    total = classes.count()
    k = min(CLUSTERS, -(-total * OVERLAP // (SHARD // 2))) if total > SHARD else 1
    centres = fit_centres(classes, total, dimension, k)
    planted = keep(plant(classes, dimension, threshold), "planted")
    n, both = planted.count(), classes.unionByName(planted)
    overlap, beam = OVERLAP, BEAM
    for _ in range(TRIES):
        counts, edges, met = search(both, centres, dimension, threshold, overlap, beam)
        recall = audit(classes, counts, n, met.count(), dimension, threshold)
        if recall >= target:
            return counts, edges, recall
        if recall < WIDEN or total <= ALL_COMPARED:
            break
        overlap, beam = 2 * overlap, 2 * beam
    return *compare(classes, centres.flat if centres.top is None else centres.top, dimension, threshold)[:2], 1.0
