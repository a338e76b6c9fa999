"""Connected components of a graph given by edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import cut, tidy_map

#: Edges that one task finishes (16 bytes each); above, star rounds contract the graph first.
ONE_TASK = 4_000_000


def lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, lowest node of each one's component) of the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while len(x):
        p, q = low[x], low[y]
        differ = p != q
        if not differ.any():
            break
        x, y, p, q = x[differ], y[differ], p[differ], q[differ]
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while True:
            jumped = low[low]
            if (jumped == low).all():
                break
            low = jumped
    return nodes, nodes[low]


def contract(batches, one_task: int, whole: bool = False):
    """Edges of a partition -> a star for each of its components. Stars and an eighth of
    one_task of other edges are held; where the stars are over a quarter of it, they flow on,
    unless the partition is the `whole` graph."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = more = 0

    def stars():
        n, m = lowest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        other = n != m
        return n[other], m[other]

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        more += batch.num_rows
        if more > max(one_task // 8, size // 4):
            held[:] = [stars()]
            size, more = len(held[0][0]), 0
            if size > one_task // 4 and not whole:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                held.clear()
                size = 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars()], names=["a", "b"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is the lowest
    node reachable. Each partition contracts its own edges to stars; while more than
    one_task are left, rounds of large and small stars (minima with partial aggregation,
    joins that AQE splits where a node is hot) halve the depth of what is left."""
    shrink = tidy_map(lambda batches: contract(batches, one_task))
    edges = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(shrink, "a long, b long"))
    while edges.count() > one_task:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        again = cut(small)
        if again.exceptAll(edges).isEmpty() and edges.exceptAll(again).isEmpty():
            return again.select(F.col("a").alias("node"), F.col("b").alias("component")).union(again.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        edges = again
    stars = edges.repartition(1).mapInArrow(tidy_map(lambda batches: contract(batches, one_task, whole=True)), "a long, b long")
    return cut(stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
