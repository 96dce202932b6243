"""Connected components of a graph given as edges, by alternating large and small stars.

Before the first star, each partition of edges is contracted to the stars of its own components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


#: Edges of a partition that is contracted at once, about.
CONTRACTED = 1 << 18


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node to the smallest node that the edges of this partition let it reach."""
    table = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    names, ends = np.unique(np.concatenate([table.column(x).to_numpy() for x in ("a", "b")]), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(names))
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    hung = np.flatnonzero(root != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[hung]), pa.array(names[root[hung]])], names=["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, component): the smallest node that each node reaches.

    Each step hangs nodes on smaller neighbours; paths halve, so a few steps suffice.  Neighbour minima
    combine before their shuffle, and a hub's edges are joined to its one minimum, which Spark can split.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = 1 + edges.count() // CONTRACTED
    edges = materialize(edges.coalesce(parts).mapInArrow(_contract, "a long, b long").distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.withColumnRenamed("m", "b"))
        edges = materialize(small.distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
