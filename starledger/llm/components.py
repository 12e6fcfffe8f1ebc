"""Connected components of a link table, by rounds of joins; no link reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.session import cut_lineage

MAX_ROUNDS = 60
TASK_LINKS = 1 << 16        # links that one task settles among themselves: a megabyte


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of the links: equal marks mean that a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of every node of one task's links, the smallest of its component as its root."""
    held = list(batches)
    if not held:
        return
    ends = [np.concatenate([batch.column(c).to_numpy() for batch in held]) for c in ("u", "v")]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = at[:len(ends[0])], at[len(ends[0]):]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), bigint ids -> (node, root): root is the smallest id that node reaches.

    Tasks of at most ``TASK_LINKS`` links first settle theirs among themselves.  What one task held is
    done; of more, the tasks' stars are joined in large-star and small-star rounds: every node's links
    move to its smallest neighbour until each component is a star.  Minima are aggregated before the
    join, so a node with very many links costs one partial row per task.  Nodes without links do not appear.
    """
    edges = cut_lineage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "links")
    tasks = -(-edges.count() // TASK_LINKS)
    settled = cut_lineage(edges.repartition(max(tasks, 1)).mapInArrow(_settled, "node bigint, root bigint"), "links")
    if tasks <= 1:
        return settled
    edges = _joined(settled.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return (roots.select(F.col("u").alias("node"), "root")
            .unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))


def _joined(edges: DataFrame) -> DataFrame:
    """The star (u, v) of each component of the links (u, v)."""
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        large = (both.filter("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.least("low", "u").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        edges = cut_lineage(
            small.select("u", F.col("low").alias("v"))
            .unionByName(small.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")))
            .filter("u <> v").distinct(), "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges
