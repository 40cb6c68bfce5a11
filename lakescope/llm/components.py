"""Connected components by alternating star operations on an edge table, distributed throughout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, stored

#: Edges that one task finishes by union-find (16 MB); more are contracted first.
LOCAL = 1 << 20


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (u, v of one type, null-free) -> (node, component): the smallest node each linked node reaches.

    A round joins every edge to its upper end's smallest neighbour, first over larger and then over smaller
    neighbours; hubs are aggregated before the exchange. It ends when no edge changes. As soon as at most LOCAL
    edges are left, as counted, one task finishes them.
    """
    edges = held(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = _size(edges)
    while seen[0] > LOCAL:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = _size(edges)
        if now == seen:
            break
        seen = now
    if seen[0] <= LOCAL:
        edges = edges.coalesce(1).mapInArrow(_finish, "u long, v long")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _finish(batches) -> Iterator[pa.RecordBatch]:
    """Edges to one edge from each node to the smallest it reaches, by union-find; the smallest itself has none."""
    parts = [np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches]
    pairs = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
    nodes, at = np.unique(pairs, return_inverse=True)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in at.reshape(-1, 2).tolist():
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    ends = np.array([find(i) for i in range(len(nodes))], np.int64)
    moved = np.flatnonzero(ends != np.arange(len(nodes)))
    yield pa.record_batch([pa.array(nodes[moved], pa.int64()), pa.array(nodes[ends[moved]], pa.int64())], names=["u", "v"])
