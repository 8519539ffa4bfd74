"""Connected components of a graph of links, by hooking and contraction.

Every round a task first replaces its edges by a spanning forest whose trees
point at their smallest node, which needs no more memory than the edges.  Then
each node takes the smallest neighbour below it, follows two such steps, and
the edges are drawn anew between what they lead to.  Rounds shrink the edges
and are written to the shared folder.  Once at most ONE_TASK edges are left
(16 bytes each), a single task labels them and no further round is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.session import cut_lineage

ONE_TASK = 1 << 20


def _follow(rows: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    up = hooks.select(F.col("node").alias(column), "parent")
    return rows.join(up, column, "left").withColumn(column, F.coalesce("parent", column)).drop("parent")


def _roots(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's tree, for edges between positions of ``nodes`` (sorted)."""
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        if np.array_equal(root[a], root[b]):
            return root
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]


def _rooted_nodes(batches) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a task's edges and the smallest node of each one's tree."""
    ends = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    a = np.concatenate([e[0] for e in ends]) if ends else np.empty(0, np.int64)
    b = np.concatenate([e[1] for e in ends]) if ends else np.empty(0, np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes, nodes[_roots(nodes, at[: len(a)], at[len(a) :])]


def _forest(batches):
    nodes, root = _rooted_nodes(batches)
    tree = root != nodes
    yield pa.RecordBatch.from_arrays([pa.array(root[tree]), pa.array(nodes[tree])], ["a", "b"])


def _labels(batches):
    nodes, root = _rooted_nodes(batches)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``), written; the root is the smallest node of the component."""
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    edges = cut_lineage(edges.mapInArrow(_forest, "a long, b long"), "edges")
    roots = None
    while (left := edges.count()) > ONE_TASK:
        if roots is None:
            roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        twice = _follow(hooks.withColumnRenamed("parent", "up"), "up", hooks)
        hooks = cut_lineage(twice.select("node", F.col("up").alias("parent")), "hooks")
        roots = cut_lineage(_follow(roots, "root", hooks), "roots")
        moved = _follow(_follow(edges, "a", hooks), "b", hooks)
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
        edges = cut_lineage(moved.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    if roots is not None and not left:
        return roots
    labels = cut_lineage(edges.coalesce(1).mapInArrow(_labels, "node long, root long"), "labels")
    if roots is None:
        return labels
    return cut_lineage(_follow(roots, "root", labels.withColumnsRenamed({"root": "parent"})), "roots")
