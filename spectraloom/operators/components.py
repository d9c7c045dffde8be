"""Connected components of an undirected graph by rounds of contraction, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialise

#: Edges that one task may hold, where a caller lets the last rounds end in one.
FEW = 1 << 17


def _ranked(c: str) -> Column:
    return F.struct(F.xxhash64(F.lit("rank"), F.col(c)).alias("rank"), F.col(c).alias("node"))


def _contracted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to) of the edges (a, b) of one task: the smallest node that each one reaches."""
    edges = [np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()]) for x in parts if x.num_rows]
    if not edges:
        return
    nodes, ends = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    labels = np.arange(len(nodes))
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[labels])], names=["node", "to"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node reachable.

    Edges with a null end and loops say nothing; repeated edges count once; without edges there are no rows. In each
    round every node points to the one of the least hashed rank among itself and its neighbours, and edges move to what
    their ends point to, until none is left: the rounds grow with the logarithm of the nodes. Once not more than few edges are left, of
    integer nodes, one task ends them. All tables are written to the shared folder, so that both sides of each join are shuffled tables whose large partitions Spark can split.
    """
    pair = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    left, pointers = materialise(pair, "edges"), []
    while n := left.count():
        if n <= few:
            kind = left.schema["a"].dataType.simpleString()
            pointers.append(materialise(left.repartition(1).mapInArrow(_contracted, f"node {kind}, to {kind}"), "pointers"))
            break
        both = left.select(F.col("a").alias("node"), _ranked("b").alias("best")).unionByName(left.select(F.col("b").alias("node"), _ranked("a").alias("best")))
        best = both.groupBy("node").agg(F.min("best").alias("best"))
        pointer = materialise(best.select("node", F.least("best", _ranked("node")).getField("node").alias("to")), "pointers")
        pointers.append(pointer)
        moved = left.join(pointer.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a").join(pointer.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
        left = materialise(moved.where(F.col("to_a") != F.col("to_b")).select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    if not pointers:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    root = pointers[0]
    if n and len(pointers) == 1:
        return root.withColumnRenamed("to", "component")
    for later in pointers[1:]:
        root = root.join(later.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    root = materialise(root, "roots")
    least = materialise(root.groupBy("to").agg(F.min("node").alias("component")), "least")
    return root.join(least, "to").select("node", "component")
