"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector x to the bucket floor((a_i x + b_i) / w), i = 1..M, with Gaussian a_i. For inner products vectors are
first put on the unit sphere: data divided by the largest norm with one more component that fills them up, queries by their
own norm. M follows from the rows, so that buckets hold many of them. A query visits its own bucket and then perturbed ones in
the order of estimated success, the sum of the squared distances from its projections to the bucket's sides, least first and
over all tables; empty buckets cost nothing. The visits are rows (query, bucket) that meet the buckets' vectors in an
equi-join, the candidates of all tables merge, and are ranked by their exact inner products.

How many buckets are visited follows from a bounded sample of queries that are searched exactly: so many that the target recall
is met on it. Every row is indexed and every bucket can be visited; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, k_of_each, matrix, prepared, top_of_rows
from .common import trimmed

TABLES, WIDTH = 2, 2.0
#: Rows of a bucket, about, and the most buckets of a table, about; with more rows buckets grow.
BUCKET, BUCKETS = 128, 4096
#: Rows that meet queries in one task; a larger bucket is split.
GROUP = 8192
#: Queries that are searched exactly to set the visits.
SAMPLE = 128
RECALL = 0.95
#: Queries that are compared at a time.
QUERIES = 256


class Hashes:
    """Plain data, so that it can be sent to workers."""

    def __init__(self, dimension: int, largest: float, hashes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.largest, self.m = largest or 1.0, hashes
        self.a = rng.standard_normal((TABLES, 64, dimension + 1))[:, :hashes].transpose(0, 2, 1)
        self.b = rng.random((TABLES, 64))[:, :hashes] * WIDTH

    def data(self, v: np.ndarray) -> np.ndarray:
        v = v / self.largest
        return np.c_[v, np.sqrt(np.maximum(0.0, 1 - (v * v).sum(1)))]

    def queries(self, v: np.ndarray) -> np.ndarray:
        return np.c_[v / np.sqrt((v * v).sum(1, keepdims=True)), np.zeros(len(v))]

    def places(self, unit: np.ndarray, t: int) -> np.ndarray:
        """Projections in widths; their floors are the bucket."""
        return (unit @ self.a[t] + self.b[t]) / WIDTH

    def buckets(self, v: np.ndarray, t: int) -> np.ndarray:
        return np.floor(self.places(self.data(v), t)).astype(np.int8)


def hashes_for(sample: np.ndarray, n: int, dimension: int, largest: float) -> Hashes:
    """As many hashes as make about n / BUCKET buckets, by the entropy of each on a sample of vectors."""
    most = Hashes(dimension, largest, 64)
    want, have, m = np.log2(max(2, min(BUCKETS, n / BUCKET))), 0.0, 0
    codes = most.buckets(sample, 0)
    while m < 64 and have < want:
        _, count = np.unique(codes[:, m], return_counts=True)
        p = count / count.sum()
        have -= (p * np.log2(p)).sum()
        m += 1
    return Hashes(dimension, largest, max(1, m))


class Directory:
    """The occupied buckets of all tables: codes, rows, and the groups of GROUP rows or less that tasks take."""

    def __init__(self, rows: list[tuple[int, bytes, int]], hashes: Hashes):
        rows = sorted(rows)
        self.number = {(t, code): i for i, (t, code, _) in enumerate(rows)}
        self.table = np.array([t for t, _, _ in rows], np.int64)
        self.code = np.frombuffer(b"".join(code for _, code, _ in rows), np.int8).reshape(len(rows), hashes.m).astype(np.float32)
        self.count = np.array([n for _, _, n in rows], np.int64)
        self.group, self.parts = np.zeros(len(rows), np.int64), -(-self.count // GROUP)
        group, filled = -1, GROUP
        for i, n in enumerate(self.count.tolist()):
            if n > GROUP or filled + n > GROUP or (i and self.table[i] != self.table[i - 1]):
                group, filled = group + 1, 0
            self.group[i] = group
            group, filled = group + int(self.parts[i]) - 1, min(GROUP, filled + n)

    def of(self, t: int, codes: np.ndarray) -> np.ndarray:
        """The numbers of the buckets of a table."""
        kinds, inverse = np.unique(codes, axis=0, return_inverse=True)
        return np.array([self.number[t, x.tobytes()] for x in kinds], np.int64)[inverse.ravel()]

    def order(self, v: np.ndarray, hashes: Hashes) -> np.ndarray:
        """For each query the buckets in the order of estimated success (ties: by number)."""
        unit = hashes.queries(v)
        score = np.empty((len(v), len(self.count)), np.float32)
        for t in range(TABLES):
            i = np.flatnonzero(self.table == t)
            p, total = hashes.places(unit, t).astype(np.float32), np.zeros((len(v), len(i)), np.float32)
            for k in range(hashes.m):
                c = self.code[i, k][None, :]
                total += np.maximum(np.maximum(c - p[:, k : k + 1], p[:, k : k + 1] - c - 1), 0) ** 2
            score[:, i] = total
        return np.argsort(score, axis=1, kind="stable")


def searched_exactly(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, directory: Directory, hashes: Hashes, k: int) -> list[np.ndarray]:
    """For each query of the sample the buckets (a row for each neighbour, a column for each table) of its k nearest rows."""
    spark, d = vectors.sparkSession, q.shape[1]
    sent = spark.sparkContext.broadcast((ids, q, directory, hashes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, directory, hashes = sent.value
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, TABLES), np.int64)]
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                v, row, vec_id = matrix(part.column("v"), d), part.column("row").to_numpy(), part.column("vec_id").to_numpy()
                score = q @ v.T
                score[ids[:, None] == row[None, :]] = -np.inf
                i, j = top_of_rows(score, k)
                buckets = np.stack([directory.of(t, hashes.buckets(v[j], t)) for t in range(TABLES)], 1)
                new = [i, score[i, j], vec_id[j], row[j], buckets]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)]
                kept = k_of_each(held[0], held[1], held[2], held[3], k)
                held = [x[kept] for x in held]
        yield pa.record_batch({"q": held[0], "score": held[1], "vec_id": held[2], "row": held[3], "buckets": pa.FixedSizeListArray.from_arrays(pa.array(held[4].ravel()), TABLES).cast(pa.list_(pa.int64()))})

    from pyspark.sql import Window

    found = vectors.select("row", "vec_id", "v").mapInArrow(trimmed(search), "q long, score double, vec_id long, row long, buckets array<long>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    rows = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "buckets").collect()
    return [np.array([r["buckets"] for r in rows if r["q"] == i], np.int64).reshape(-1, TABLES) for i in range(len(ids))]


def visits_for(near: list[np.ndarray], order: np.ndarray, recall: float) -> int:
    """How many buckets must be visited so that the share `recall` of the sample's neighbours lies in one of them."""
    places = []
    for buckets, visited in zip(near, order, strict=True):
        rank = np.empty(len(visited), np.int64)
        rank[visited] = np.arange(len(visited))
        places.append(rank[buckets].min(1))
    places = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1 if len(places) else 1


def near_top_k(embeddings: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among all other rows by inner product, in double precision on
    the original vectors, ties to the smaller vec_id; all other rows if they are no more than k.

    Vectors that are null, zero or hold null or non-finite components take no part; shorter ones are continued with zeros. Rows
    with one id are candidates of each other. Rerunning gives the same rows. The directory of buckets (some thousands for each
    table, whatever the input's size) and the sample of queries go through the driver."""
    v, d = prepared(embeddings, is_query, allow_zero=False)
    spark = v.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    about = v.agg(F.count("*").alias("n"), F.max(norm).alias("norm")).first()
    schema = "query_row long, query_id long, row long, vec_id long, score double"
    if not about["n"]:
        return best(spark.createDataFrame([], schema), k)

    def drawn(df: DataFrame, salt: str, most: int) -> list:
        return df.orderBy(F.xxhash64(F.lit(salt), "vec_id"), "row").limit(most).select("row", "v").collect()

    hashes = hashes_for(np.array([r["v"] for r in drawn(v, "vectors", 2048)], np.float64), about["n"], d, float(np.sqrt(about["norm"])))
    sent = spark.sparkContext.broadcast(hashes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, bytes], int] = {}
        for batch in batches:
            x = matrix(batch.column("v"), d)
            for t in range(TABLES):
                for code, n in zip(*np.unique(sent.value.buckets(x, t), axis=0, return_counts=True), strict=True):
                    counts[t, code.tobytes()] = counts.get((t, code.tobytes()), 0) + int(n)
        yield pa.record_batch({"t": pa.array([t for t, _ in counts], pa.int64()), "code": pa.array([c for _, c in counts], pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    occupied = v.select("v").mapInArrow(trimmed(hashed), "t long, code binary, n long").groupBy("t", "code").agg(F.sum("n").alias("n")).collect()
    directory = Directory([(r["t"], bytes(r["code"]), r["n"]) for r in occupied], hashes)
    sample = drawn(v.where("is_query"), "queries", SAMPLE)
    if not sample:
        return best(spark.createDataFrame([], schema), k)
    q = np.array([r["v"] for r in sample], np.float64)
    visits = visits_for(searched_exactly(v, np.array([r["row"] for r in sample]), q, directory, hashes, k), directory.order(q, hashes), recall)
    if about["n"] - 1 <= k:
        visits = len(directory.count)  # all other rows are wanted
    shared = spark.sparkContext.broadcast(directory)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once for each table: group, bucket."""
        hashes, directory = sent.value, shared.value
        for batch in batches:
            x, row = matrix(batch.column("v"), d), batch.column("row").to_numpy()
            for t in range(TABLES):
                b = directory.of(t, hashes.buckets(x, t))
                part = row % directory.parts[b]
                yield pa.record_batch([pa.array(directory.group[b] + part), pa.array(np.zeros(len(row), np.int32)), pa.array(b), *(batch.column(c) for c in ("row", "vec_id", "v")), pa.nulls(len(row), pa.list_(pa.int64()))], names)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each group in which it visits buckets."""
        hashes, directory = sent.value, shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                b = directory.order(matrix(part.column("v"), d), hashes)[:, :visits]
                who = np.repeat(np.arange(len(b)), b.shape[1])
                b = b.ravel()
                n = directory.parts[b]  # a split bucket is visited in all its parts
                who, g = np.repeat(who, n), np.repeat(directory.group[b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                b = np.repeat(b, n)
                order = np.lexsort((b, g, who))
                who, g, b = who[order], g[order], b[order]
                new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (g[1:] != g[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(b)].astype(np.int32)), pa.array(b))
                yield pa.record_batch([pa.array(g[new]), pa.array(np.ones(len(new), np.int32)), pa.nulls(len(new), pa.int64()), *(part.column(c).take(pa.array(who[new])) for c in ("row", "vec_id", "v")), lists], names)

    names = ["group", "is_query", "bucket", "row", "vec_id", "v", "buckets"]
    kind = f"group long, is_query int, bucket long, row long, vec_id long, v {dict(v.dtypes)['v']}, buckets array<long>"
    both = v.select("row", "vec_id", "v").mapInArrow(trimmed(place), kind).unionByName(v.where("is_query").select("row", "vec_id", "v").mapInArrow(trimmed(visit), kind))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's vectors come before its queries."""
        group, held, mine = None, [], None

        def gathered():
            t = pa.Table.from_batches(held)
            bucket = t.column("bucket").to_numpy()
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            return matrix(t.column("v"), d), t.column("row").to_numpy(), t.column("vec_id").to_numpy(), bucket[first], np.r_[first, len(bucket)]

        for batch in batches:
            key = batch.column("group").to_numpy() * 2 + batch.column("is_query").to_numpy()
            ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
            begin = 0
            for end in ends:
                if key[begin] // 2 != group:
                    group, held, mine = key[begin] // 2, [], None
                if key[begin] % 2 == 0:
                    held.append(batch.slice(begin, end - begin))
                elif held:
                    mine = mine or gathered()
                    for at in range(begin, end, QUERIES):
                        yield met(batch.slice(at, min(QUERIES, end - at)), *mine)
                begin = end

    def met(queries: pa.RecordBatch, x: np.ndarray, row: np.ndarray, vec_id: np.ndarray, buckets: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        q, me = matrix(queries.column("v"), d), queries.column("row").to_numpy()
        lists = queries.column("buckets")
        wanted = np.zeros((len(q), len(buckets)), bool)
        wanted[np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), np.searchsorted(buckets, lists.flatten().to_numpy())] = True
        score = np.full((len(q), len(x)), -np.inf)
        for b in range(len(buckets)):
            i = np.flatnonzero(wanted[:, b])
            if len(i):
                score[i, at[b] : at[b + 1]] = q[i] @ x[at[b] : at[b + 1]].T
        score[me[:, None] == row[None, :]] = -np.inf
        i, j = top_of_rows(score, k, 1e-12 * float(np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * d))
        exact = np.einsum("ij,ij->i", q[i], x[j])  # by row, so the same wherever the row is met
        kept = k_of_each(i, exact, vec_id[j], row[j], k)
        i, j, exact = i[kept], j[kept], exact[kept]
        return pa.record_batch({"query_row": me[i], "query_id": queries.column("vec_id").to_numpy()[i], "row": row[j], "vec_id": vec_id[j], "score": exact})

    groups = int(directory.group[-1] + directory.parts[-1])
    tasks = max(1, min(groups, 100_000))
    dealt = both.repartition(tasks, "group").sortWithinPartitions("group", "is_query", "bucket")
    return best(dealt.mapInArrow(trimmed(compare), schema), k)
