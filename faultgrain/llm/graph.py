"""Connected components of an edge table, as joins and aggregates; of a small one in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut

TASK_EDGES = 1 << 20  # of two numbers each


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the edges of all batches."""
    edges = [np.zeros((2, 0), np.int64), *(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches)]
    nodes, ends = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    low = np.arange(len(nodes))  # the root of each node, never a larger one
    while len(open_ := np.flatnonzero(low[a] != low[b])):
        a, b = a[open_], b[open_]
        np.minimum.at(low, np.maximum(low[a], low[b]), np.minimum(low[a], low[b]))
        while (low != (up := low[low])).any():
            low = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[low])], names=["node", "component"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    ).collect()[0]
    return row["n"], row["sum"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of ``edges(a, b)``, which is read twice, with the smallest node it reaches.

    Up to ``TASK_EDGES`` edges are followed in one task, without a shuffle. More
    are followed by joins, where each round shuffles all edges several times:
    alternates two rewirings until nothing changes: each node's larger
    neighbours are moved to its smallest neighbour, then its smaller ones are.
    Both keep components and shorten paths, so the rounds grow with the
    logarithm of the longest path. Each round is written to the shared folder.
    """
    edges = edges.where("a <> b")
    if edges.count() <= TASK_EDGES:
        return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(_labelled, "node long, component long")
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(now)
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        low = low.select(F.col("a").alias("hub"), F.least("a", "low").alias("low"))
        # now(a, b) has a > b: the larger neighbours of b go to b's smallest neighbour
        large = now.join(low, now.b == low.hub).select("a", F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        now = cut(moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
