"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges for a task.
TASK_ROWS = 200_000
#: A node with more edges than this, or than a HOT_SHARE of all, is a hub: hubs are HOT_SHARE at most, and their minima are sent
#: to the edges instead of the edges to them.
HUB, HOT_SHARE = 128, 50_000


def _state(edges: DataFrame) -> tuple:
    """How many edges there are, and a sum that changes with them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _with_least(pairs: DataFrame, edges: int) -> DataFrame:
    """u, v, m: the least of u and all its v. A hub's edges stay where they are, so that none gathers them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    hub = F.col("c") > max(HUB, edges // HOT_SHARE)
    hubs = F.broadcast(least.where(hub).select("u", "m"))
    found = pairs.join(hubs, "u").unionByName(pairs.join(hubs.select("u"), "u", "left_anti").join(least.where(~hub).select("u", "m"), "u"))
    return found.withColumn("m", F.least("u", "m"))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, by repeated minima."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: of a task's edges (u, v) each node and the least one that it is connected to by them."""
    held = [b for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        nodes, code = np.unique(np.r_[u, v], return_inverse=True)
        label = forest(len(nodes), code[: len(u)], code[len(u) :])
        i = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.record_batch({"u": nodes[i], "v": nodes[label[i]]})


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least node) for every node of the edges (a, b); both long. Loops and repeated edges do no harm.

    In each round every task, of TASK_ROWS edges, first reduces its own edges to a forest. What is left for a single task is done
    then; else large and small stars follow, two aggregations and joins over the edges that are left, written to the shared
    folder. The number of rounds grows with the logarithm of the longest path. No component and no hub's edges are gathered
    anywhere. Raises if `rounds` don't suffice."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    n, state = now.count(), None
    for _ in range(rounds):
        tasks = 1 + n // TASK_ROWS
        now = cut(now.coalesce(tasks).mapInArrow(local_forests, "u long, v long"))
        if tasks == 1:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct())
        stars = _with_least(large, 2 * n)
        small = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v"))).where("u <> v")
        now = cut(small.distinct())
        was, state = state, _state(now)
        if was == state:
            break
        n = state[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return cut(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
