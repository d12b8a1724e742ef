"""What both vector searches share: which vectors take part, the k best of what was found, and ties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

NO_ID = np.iinfo(np.int64).max


def usable(vector: Column, allow_zero: bool) -> Column:
    """Not null, without null, NaN or infinite components (and not all zero)."""
    fine = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fine if allow_zero else fine & F.exists(vector, lambda x: x != 0)


def prepared(embeddings: DataFrame, is_query: Column, allow_zero: bool) -> tuple[DataFrame, int]:
    """row, vec_id (null as the largest long), is_query, v of the rows that take part, written once, and the vectors' length.

    Vectors of several lengths are continued with zeros up to the longest, so that all take part in all products."""
    kept = embeddings.where(usable(F.col("embedding"), allow_zero))
    d = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    v = F.col("embedding").cast("array<double>")
    v = F.when(F.size(v) == d, v).otherwise(F.concat(v, F.array_repeat(F.lit(0.0), F.lit(d) - F.size(v))))
    if embeddings.schema["embedding"].dataType.elementType.simpleString() == "float":
        v = v.cast("array<float>")  # exact: they came from floats
    return written(kept.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), v.alias("v"))), d


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Vectors as rows of a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def top_of_rows(score: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest finite values, and of all within the slack of the kth."""
    n = score.shape[1]
    least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), -np.inf)
    return np.nonzero((score >= (least - slack)[:, None]) & (score > -np.inf))


def k_of_each(query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to the smaller id, then row."""
    order = np.lexsort((row, vec_id, -score, query))
    q = query[order]
    at = np.flatnonzero(np.r_[len(q) > 0, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(at, np.diff(np.r_[at, len(q)]))
    return order[place < k]


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query row; ties to the smaller vec_id, null ids last. A row that was
    found twice counts once."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["query_row", "rank"])
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
