"""Centroid clustering in whole numbers (Lloyd's rounds), filtered through kd-trees.

Every task packs its vectors into kd-trees of at most BLOCK vectors. A node holds the count, the integer sums and the bounding box
of the vectors under it; trees are written once to the shared folder, and every round reads them from there, so that a lost
executor costs its own tasks only. A round goes down each tree with the centroids that may still own something: the candidate
nearest to the middle of a node's box rules out every other one that is strictly farther from the whole box (it is enough to look at
the corner that favours the other most). With one candidate left the node's count and sums go to it as a whole; a leaf with more is
resolved vector by vector, exactly, ties to the smaller number. What leaves a task is a count and a sum for each centroid and
component; the driver holds only the centroids.

Vectors that are null, of another length or with null, NaN or infinite components take no part; extra columns don't matter. Repeated
rows count each; rows of one vec_id that differ are vectors of their own. A null vec_id comes after all others when the first
centroids are chosen (rows of one vec_id: by their components). With fewer vectors than centroids there are only so many centroids;
an empty table gives an empty result. Raises where a scaled component is beyond 2**27, as squared distances might not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import usable
from .common import removed, trimmed, written, written_in

#: Vectors of a tree, and of a leaf at most.
BLOCK, LEAF = 4096, 32
#: Scaled components are at most so large: squared distances over 64 components then fit a long.
LIMIT = 1 << 27
#: Below this, sums of products are exact in doubles.
EXACT = 1 << 53

TREE = "ids array<bigint>, points binary, low binary, high binary, sums binary, start binary, stop binary, left binary"


@dataclass
class Tree:
    """points: rows in tree order; node i owns points start[i] to stop[i]; its children are left[i] and left[i] + 1 (-1: a leaf)."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """A tree and the order in which it holds the points. Nodes are split in the middle of their widest component; one whose
        points are all equal is a leaf of any size."""
        order = np.arange(len(points))
        low, high, sums, start, stop, left = [], [], [], [], [], []
        waiting = [(0, len(points))]
        made = 0

        while made < len(waiting):
            a, b = waiting[made]
            p = points[order[a:b]]
            lo, hi = p.min(0), p.max(0)
            low.append(lo), high.append(hi), sums.append(p.sum(0)), start.append(a), stop.append(b)
            wide = int(np.argmax(hi - lo))
            if b - a <= LEAF or hi[wide] == lo[wide]:
                left.append(-1)
            else:
                m = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(p[:, wide], m)]
                left.append(len(waiting))
                waiting += [(a, a + m), (a + m, b)]
            made += 1
        return cls(points[order], *(np.array(x) for x in (low, high, sums, start, stop, left))), order

    def packed(self) -> dict[str, bytes]:
        return {k: narrow(v) for k, v in self.__dict__.items()}

    @classmethod
    def unpacked(cls, row: dict, d: int) -> Tree:
        wide = {k: widened(row[k]) for k in cls.__dataclass_fields__}
        return cls(*(v.reshape(-1, d) if k in ("points", "low", "high", "sums") else v for k, v in wide.items()))

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and sums of each centroid's vectors, and the owner of each point (in tree order)."""
        k, d = centroids.shape
        counts, sums, owner = np.zeros(k, np.int64), np.zeros((k, d), np.int64), np.empty(len(self.points), np.int32)
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
        while len(nodes):
            open_ = self.filtered(nodes, open_, centroids)
            one = open_.sum(1) == 1
            for node, c in zip(nodes[one], open_[one].argmax(1), strict=True):
                owner[self.start[node] : self.stop[node]] = c
                counts[c] += self.stop[node] - self.start[node]
                sums[c] += self.sums[node]
            leaf = ~one & (self.left[nodes] < 0)
            if leaf.any():
                size = self.stop[nodes[leaf]] - self.start[nodes[leaf]]
                at = np.repeat(self.start[nodes[leaf]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                own = nearest(self.points[at], centroids, np.repeat(open_[leaf], size, 0))
                owner[at] = own
                counts += np.bincount(own, minlength=k)
                for c in range(k):
                    sums[c] += self.points[at[own == c]].sum(0)
            down = ~one & ~leaf
            nodes, open_ = np.concatenate([self.left[nodes[down]], self.left[nodes[down]] + 1]), np.concatenate([open_[down]] * 2)
        return counts, sums, owner

    def filtered(self, nodes: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """The candidates that aren't strictly farther from a node's whole box than the one nearest to its middle."""
        low, high = self.low[nodes], self.high[nodes]
        middle = (low + high) >> 1
        far = np.square(middle[:, None, :] - centroids).sum(2)
        best = centroids[np.where(open_, far, np.iinfo(np.int64).max).argmin(1)][:, None, :]
        corner = np.where(centroids > best, high[:, None, :], low[:, None, :])
        return open_ & (np.square(corner - centroids).sum(2) <= np.square(corner - best).sum(2))


def narrow(a: np.ndarray) -> bytes:
    """Whole numbers as bytes of the narrowest type that holds them, named by the first byte."""
    most = max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0
    kind = "h" if most < 1 << 15 else "i" if most < 1 << 31 else "q"
    return kind.encode() + np.ascontiguousarray(a, f"<{dict(h='i2', i='i4', q='i8')[kind]}").tobytes()


def widened(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<{dict(h='i2', i='i4', q='i8')[chr(b[0])]}", offset=1).astype(np.int64)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: as products of doubles where all sums are whole numbers below 2**53, else of longs."""
    most = max((int(np.abs(x).max()) for x in (points, centroids) if x.size), default=0)
    if 4 * most * most * points.shape[1] < EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return (np.square(p).sum(1)[:, None] - 2 * (p @ c.T) + np.square(c).sum(1)).astype(np.int64)
    return np.stack([np.square(points - c).sum(1) for c in centroids], 1)


def nearest(points: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> np.ndarray:
    return np.where(open_, distances(points, centroids), np.iinfo(np.int64).max).argmin(1)


def scaled(vectors: pa.Array, length: int, scale: int) -> np.ndarray:
    x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(vectors), length)
    if x.size and np.abs(x).max() > LIMIT:
        raise OverflowError(f"a component times {scale} is beyond {LIMIT}: squared distances might not fit a long")
    return x.astype(np.int64)


def trees(vectors: DataFrame, length: int, scale: int) -> DataFrame:
    """Each task's vectors (vec_id, v) as kd-trees."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tree() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            made, order = Tree.build(scaled(t["v"].combine_chunks(), length, scale))
            row = {"ids": t["vec_id"].take(pa.array(order)).to_pylist()} | made.packed()
            return pa.RecordBatch.from_pylist([row], pa.schema([("ids", pa.list_(pa.int64())), *((k, pa.binary()) for k in made.packed())]))

        for batch in batches:
            while batch.num_rows:
                room = BLOCK - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == BLOCK:
                    yield tree()
                    held.clear()
        if held:
            yield tree()

    return vectors.mapInArrow(trimmed(work), TREE)


def chosen(vectors: DataFrame, k: int, length: int, scale: int, salt: str) -> np.ndarray:
    """The first centroids: the k vectors with the smallest sha256 of the salt and the id; k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("c"))
    first = rows.orderBy(F.asc_nulls_last("key"), "c").limit(k).collect()
    return np.array([r["c"] for r in first], np.int64).reshape(len(first), length)


def totals(trees_: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """(centroid, component) -> sum of its vectors; component -1 is their number."""
    k, d = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = np.zeros((k, d + 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                n, s, _ = Tree.unpacked(row, d).assign(centroids)
                all_[:, 0] += n
                all_[:, 1:] += s
        c, p = np.nonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(p.astype(np.int32) - 1), pa.array(all_[c, p])], ["cluster", "place", "total"])

    parts = trees_.drop("ids").mapInArrow(trimmed(work), "cluster int, place int, total bigint")
    rows = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return {(r["cluster"], r["place"]): int(r["total"]) for r in rows}


def moved(centroids: np.ndarray, sums: dict[tuple[int, int], int]) -> np.ndarray:
    """Componentwise floors of the exact means; a centroid without vectors stays."""
    out = centroids.copy()
    for c in range(len(out)):
        if n := sums.get((c, -1), 0):
            out[c] = [sums.get((c, j), 0) // n for j in range(out.shape[1])]
    return out


def placed(trees_: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    d = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                tree = Tree.unpacked(one.drop_columns(["ids"]).to_pylist()[0], d)
                owner = tree.assign(centroids)[2]
                distance = np.square(tree.points - centroids[owner]).sum(1)
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), pa.array(owner), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return trees_.mapInArrow(trimmed(work), "vec_id bigint, cluster int, distance bigint")


def clustered(embeddings: DataFrame, k: int = 8, rounds: int = 10, length: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of the length that takes part; the
    vectors' components times scale, rounded down, are what is clustered."""
    spark = embeddings.sparkSession
    fine = usable(F.col("embedding"), True) & (F.size("embedding") == length)
    vectors = embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    centroids = chosen(vectors, k, length, scale, salt)
    if not len(centroids):
        return placed(spark.createDataFrame([], TREE), centroids).selectExpr("*", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    held, folder = written_in(trees(vectors, length, scale))
    for _ in range(rounds):
        centroids = moved(centroids, totals(held, centroids))
    rows = written(placed(held, centroids))
    removed(spark, folder)
    each = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    few = spark.createDataFrame([(c, s, sum(each.values()), digests[c]) for c, s in each.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
