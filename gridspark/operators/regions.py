"""Connected regions of a grid.

Cells are labelled block by block first (a block holds at most ``block`` x
``block`` cells), so only block-local labels that touch across a block border
enter the iterative part.  That part hooks and contracts the border graph; it
shrinks every round and its lineage is cut in shared storage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridspark.session import cut_lineage

BLOCK = 128
JUMPS = 3
ROW_STRIDE, X_OFFSET = 1 << 32, 1 << 31


def cell_id(x: Column, y: Column) -> Column:
    """One long per cell, ordered by y, then x (32-bit coordinates)."""
    return y.cast("long") * ROW_STRIDE + x.cast("long") + X_OFFSET


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if np.array_equal(a, b):
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped


def _label_block(pdf: pd.DataFrame) -> pd.DataFrame:
    x, y = pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64)
    x0, y0 = x.min(), y.min()
    w, h = int(x.max() - x0 + 1), int(y.max() - y0 + 1)
    flat = (y - y0) * w + (x - x0)
    grid = np.full(w * h, -1, dtype=np.int64)
    grid[flat] = pd.factorize(pdf["value"])[0]
    g, idx = grid.reshape(h, w), np.arange(w * h).reshape(h, w)
    right = (g[:, 1:] == g[:, :-1]) & (g[:, 1:] >= 0)
    down = (g[1:] == g[:-1]) & (g[1:] >= 0)
    i = np.concatenate([idx[:, :-1][right], idx[:-1][down]])
    j = np.concatenate([idx[:, 1:][right], idx[1:][down]])
    root = _roots(w * h, i, j)[flat]
    label = (root // w + y0) * ROW_STRIDE + (root % w + x0) + X_OFFSET
    return pdf.drop(columns=["__bx", "__by"]).assign(label=label)


def _block_labels(cells: DataFrame, keys: list[str], block: int) -> DataFrame:
    blocked = cells.select(
        *keys,
        "x",
        "y",
        "value",
        F.floor(F.col("x") / block).alias("__bx"),
        F.floor(F.col("y") / block).alias("__by"),
    )
    kept = [f for f in blocked.schema.fields if not f.name.startswith("__b")]
    schema = StructType([*kept, StructField("label", LongType())])
    return blocked.groupBy(*keys, "__bx", "__by").applyInPandas(_label_block, schema)


def _border_edges(labelled: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Pairs of block labels that touch across a block border."""

    def across(axis):
        here = labelled.where(F.pmod(axis, F.lit(block)) == block - 1)
        there = labelled.where(F.pmod(axis, F.lit(block)) == 0)
        return here, there

    cx, cy = F.col("x"), F.col("y")
    here, there = across(cx)
    right = here.withColumn("x", cx + 1)
    pairs = right.select(*keys, "x", "y", "value", F.col("label").alias("a")).join(
        there.select(*keys, "x", "y", "value", F.col("label").alias("b")), [*keys, "x", "y", "value"]
    )
    here, there = across(cy)
    below = here.withColumn("y", cy + 1)
    pairs = pairs.union(
        below.select(*keys, "x", "y", "value", F.col("label").alias("a")).join(
            there.select(*keys, "x", "y", "value", F.col("label").alias("b")), [*keys, "x", "y", "value"]
        )
    )
    return pairs.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _contract(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, node, root)`` for every node of the graph.

    Each round every node hooks onto its smallest smaller neighbour, jumps
    along those hooks, and the edges are redrawn between the new roots.  Only
    the rounds' hooks and the shrinking edges are written out.
    """
    edges = cut_lineage(edges, "edges")
    roots = (
        edges.select(*keys, F.col("a").alias("node"))
        .union(edges.select(*keys, F.col("b").alias("node")))
        .distinct()
        .withColumn("root", F.col("node"))
    )
    while not edges.isEmpty():
        hooks = edges.groupBy(*keys, F.col("b").alias("r")).agg(F.min("a").alias("p"))
        for _ in range(JUMPS):
            up = hooks.select(*keys, F.col("r").alias("p"), F.col("p").alias("pp"))
            hooks = hooks.join(up, [*keys, "p"], "left").select(*keys, "r", F.coalesce("pp", "p").alias("p"))
        hooks = cut_lineage(hooks, "hooks")
        moved = roots.join(hooks.withColumnRenamed("r", "root"), [*keys, "root"], "left")
        roots = moved.select(*keys, "node", F.coalesce("p", "root").alias("root"))
        ha = hooks.select(*keys, F.col("r").alias("a"), F.col("p").alias("pa"))
        hb = hooks.select(*keys, F.col("r").alias("b"), F.col("p").alias("pb"))
        lifted = edges.join(ha, [*keys, "a"], "left").join(hb, [*keys, "b"], "left")
        na, nb = F.coalesce("pa", "a"), F.coalesce("pb", "b")
        edges = cut_lineage(
            lifted.select(*keys, F.least(na, nb).alias("a"), F.greatest(na, nb).alias("b"))
            .where(F.col("a") != F.col("b"))
            .distinct(),
            "edges",
        )
    return roots


def components(cells: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """4-connected cells of equal ``value``; ``label`` is the id of the component's first cell.

    ``cells`` has ``(keys, x, y, value)``, one row per cell.
    """
    labelled = cut_lineage(_block_labels(cells, keys, block), "labels")
    roots = _contract(_border_edges(labelled, keys, block), keys)
    found = labelled.join(roots.withColumnRenamed("node", "label"), [*keys, "label"], "left")
    return found.select(*keys, "x", "y", "value", F.coalesce("root", "label").alias("label"))


def flood_region(
    cells: DataFrame, keys: list[str], seed: tuple[int, int], near_seed: Column, block: int = BLOCK
) -> DataFrame:
    """The region around ``seed`` whose cells all pass ``near_seed``.

    The test compares each cell with the seed, not with its neighbour.
    """
    open_cells = cells.where(near_seed).select(*keys, "x", "y", F.lit(1).alias("value"))
    found = components(open_cells, keys, block)
    start = found.where((F.col("x") == seed[0]) & (F.col("y") == seed[1])).select(*keys, "label")
    return found.join(start, [*keys, "label"], "left_semi").select(*keys, "x", "y")


def grid_coords(cells: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Column and row of each cell inside its component, counted from the component's corner."""
    found = components(cells, keys, block)
    corner = found.groupBy(*keys, "label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    return found.join(corner, [*keys, "label"]).select(
        *keys, "x", "y", "label", (F.col("x") - F.col("x0")).alias("col"), (F.col("y") - F.col("y0")).alias("row")
    )
