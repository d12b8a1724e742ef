"""Exact top-k search with vector-approximation files.

The vectors' whole numbers are written once, in files of a block each, and with every row goes its approximation: a cell of a
byte for each component. Only cells travel to the queries. A scan of a block's cells bounds every inner product from both
sides; the kth largest lower bound rules out most vectors, and the exact ones of the rest are read from the block's file in the
order of their upper bounds, until none that is left can be among the k best.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, k_of_each, matrix, prepared
from .common import cut, groups_of, shared_dir, trimmed, written
from .warc import delete_folder, store_of

CELLS = 256
#: Rows of a block of vectors, and of a block of queries.
VECTORS, QUERIES = 4096, 4096
#: Queries that scan a block at a time; exact vectors that a query asks for at a time.
SCAN, READ = 256, 64
#: Neighbouring rows of a file are read together if no more than so many rows lie between them.
GAP = 16


def whole_numbers(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, which hold every whole number that they can be."""
    return np.floor(scale * v)


class File:
    """A block's exact vectors, read by row number; a row that has been read is kept."""

    def __init__(self, uri: str, rows: int, d: int):
        store, path = store_of(uri)
        self.source, self.d = store.open_input_file(path), d
        self.rows, self.known = np.zeros((rows, d)), np.zeros(rows, bool)

    def get(self, wanted: np.ndarray) -> np.ndarray:
        new = np.unique(wanted[~self.known[wanted]])
        if len(new):
            at = np.flatnonzero(np.r_[True, np.diff(new) > GAP])
            for low, high in zip(new[at].tolist(), [*(new[at[1:] - 1] + 1).tolist(), int(new[-1]) + 1], strict=True):
                raw = self.source.read_at((high - low) * self.d * 8, low * self.d * 8)
                self.rows[low:high] = np.frombuffer(raw, np.float64).reshape(high - low, self.d)
                self.known[low:high] = True
        return self.rows[wanted]


def exact_scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs. Raises where one doesn't fit."""
    most = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * v.shape[1]
    if most < 2.0**53:
        return (v @ q).astype(np.int64)
    if most < 2.0**63:
        return v.astype(np.int64) @ q.astype(np.int64)
    scores = [sum(int(a) * int(b) for a, b in zip(x, q, strict=True)) for x in v]
    if any(not -(2**63) <= s < 2**63 for s in scores):
        raise OverflowError("a score doesn't fit a long")
    return np.array(scores, np.int64)


def scanned(cells: np.ndarray, low: float, width: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of the products of each query with each row, and how far the lower ones are below them for each query.

    A cell c stands for low + c * width up to one width more, less one. The scan runs in single precision; the bounds are wider
    by what its rounding can be at most. Components too large for it are scanned in double precision."""
    sums, total = q.sum(1), np.abs(q).sum(1)
    kind, unit = (np.float32, 2.0**-23) if total.max(initial=0) < 2.0**100 else (np.float64, 2.0**-52)
    about = (q.astype(kind) @ cells.astype(kind).T).astype(np.float64)
    error = (q.shape[1] + 2) * unit * total * CELLS * width
    half = (width - 1) / 2
    spread = half * total + error + 1e-9 * (np.abs(low + half) * total + 1)
    return about * width + ((low + half) * sums + spread)[:, None], 2 * spread


def search_block(cells: np.ndarray, low: float, width: float, row: np.ndarray, vec_id: np.ndarray, file: File, q: np.ndarray, me: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Query, place and score of each query's k best of the block."""
    out: list[tuple] = []
    for at in range(0, len(q), SCAN):
        some = slice(at, at + SCAN)
        upper, spread = scanned(cells, low, width, q[some])
        upper[me[some][:, None] == row[None, :]] = -np.inf
        for i, bound in enumerate(upper):
            m = min(k, int((bound > -np.inf).sum()))
            if not m:
                continue
            sure = np.partition(bound, len(bound) - m)[len(bound) - m] - spread[i]  # the kth largest lower bound
            maybe = np.flatnonzero(bound >= sure)
            maybe = maybe[np.argsort(-bound[maybe], kind="stable")]
            places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for b in range(0, len(maybe), READ):
                if len(scores) >= m and scores[m - 1] > bound[maybe[b]]:
                    break
                new = maybe[b : b + READ]
                places, scores = np.r_[places, new], np.r_[scores, exact_scores(file.get(new), q[at + i])]
                keep = k_of_each(np.zeros(len(places)), scores, vec_id[places], row[places], m)
                places, scores = places[keep], scores[keep]
            out.append((np.full(m, at + i), places, scores))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def write_blocks(v: DataFrame, d: int, blocks: int, scale: int, low: float, width: float, folder: str) -> DataFrame:
    """row, vec_id, block, file, place, cells: each vector's whole numbers go to its block's file, and this is what stays."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        store.create_dir(path, recursive=True)
        for t, at in groups_of(batches, ["block"]):
            for a, b in zip(at.tolist(), [*at[1:].tolist(), t.num_rows], strict=True):
                part = t.slice(a, b - a)
                x = whole_numbers(matrix(part.column("v"), d), scale)
                name = f"{uuid.uuid4().hex}.vectors"
                with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                    out.write(x.tobytes())
                cells = np.minimum((x - low) // width, CELLS - 1).astype(np.uint8)
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(d), b - a, [None, pa.py_buffer(cells.tobytes())]).cast(pa.binary())
                columns = [part.column(c).combine_chunks() for c in ("row", "vec_id", "block")]
                yield pa.record_batch([*columns, pa.array([f"{folder}/{name}"] * (b - a)), pa.array(np.arange(b - a, dtype=np.int32)), fixed], ["row", "vec_id", "block", "file", "place", "cells"])

    dealt = v.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long")).repartition(blocks, "block").sortWithinPartitions("block", "row")
    return written(dealt.select("row", "vec_id", "block", "v").mapInArrow(trimmed(write), "row long, vec_id long, block long, file string, place int, cells binary"))


def exact_top_k(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(scale * x) with all other rows, ties to the smaller
    vec_id. Fewer than k other rows: all of them. Null vectors and those with null or non-finite components take no part; zero
    vectors do, and shorter ones are continued with zeros. Rows with one id are candidates of each other. Raises if a score that
    is among the best doesn't fit a long. All queries meet all blocks, so cells are copied once for each block of queries."""
    v, d = prepared(embeddings, is_query, allow_zero=True)
    spark = v.sparkSession
    lowest, highest = F.array_min("v").cast("double"), F.array_max("v").cast("double")
    about = v.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"), F.min(lowest).alias("low"), F.max(highest).alias("high")).first()
    schema = "query_row long, query_id long, row long, vec_id long, score long"
    if not about["n"] or not about["q"]:
        return best(spark.createDataFrame([], schema), k)
    nv, nq = -(-about["n"] // VECTORS), -(-about["q"] // QUERIES)
    low, high = (float(whole_numbers(np.float64(about[c]), scale)) for c in ("low", "high"))
    if not np.isfinite(high - low):
        raise OverflowError("a component times the scale isn't finite")
    width = max(1.0, float(np.ceil((high - low + 1) / CELLS)))
    folder = f"{shared_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    index = write_blocks(v, d, nv, scale, low, width, folder)

    def counted(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    empty = F.lit(None).cast(dict(v.dtypes)["v"])
    cells = index.select("block", counted(nq).alias("queries"), F.lit(0).alias("is_query"), "row", "vec_id", "file", "place", "cells", empty.alias("v"))
    asked = v.where("is_query").select(counted(nv).alias("block"), F.pmod(F.xxhash64("row"), F.lit(nq)).cast("long").alias("queries"), F.lit(1).alias("is_query"), "row", "vec_id", F.lit(None).cast("string").alias("file"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("cells"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups_of(batches, ["block", "queries"]):
            for a, b in zip(at.tolist(), [*at[1:].tolist(), t.num_rows], strict=True):
                part = t.slice(a, b - a)
                n = int((part.column("is_query").to_numpy() == 0).sum())
                if not 0 < n < b - a:
                    continue
                block, queries = part.slice(0, n), part.slice(n)
                row, vec_id = block.column("row").to_numpy(), block.column("vec_id").to_numpy()
                cells = np.frombuffer(b"".join(block.column("cells").to_pylist()), np.uint8).reshape(n, d)
                me = queries.column("row").to_numpy()
                file = File(block.column("file")[0].as_py(), n, d)
                i, j, score = search_block(cells, low, width, row, vec_id, file, whole_numbers(matrix(queries.column("v"), d), scale), me, k)
                yield pa.record_batch({"query_row": me[i], "query_id": queries.column("vec_id").to_numpy()[i], "row": row[j], "vec_id": vec_id[j], "score": score})

    both = cells.unionByName(asked).repartition(min(nv * nq, 100_000), "block", "queries").sortWithinPartitions("block", "queries", "is_query", "place")
    found = cut(best(both.mapInArrow(trimmed(run), schema), k))
    delete_folder(spark, folder)
    return found
