"""Selections as sets of cells ``(keys, x, y)``."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b.select(*a.columns)).distinct()


def mask_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti")


def mask_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_semi")


def mask_invert(universe: DataFrame, mask: DataFrame) -> DataFrame:
    """Every cell of the grid that is not selected; no row at all when everything was."""
    return universe.select(*mask.columns).join(mask, mask.columns, "left_anti")


def _ball(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(dx, dy) for dx in span for dy in span if abs(dx) + abs(dy) <= radius]


def _spread(mask: DataFrame, keys: list[str], radius: int) -> DataFrame:
    offsets = F.array(
        *(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _ball(radius))
    )
    moved = mask.select(*keys, "x", "y", F.explode(offsets).alias("o"))
    return moved.select(*keys, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))


MAX_STEP = 4


def dilate(mask: DataFrame, keys: list[str], width: int, height: int, amount: int = 1) -> DataFrame:
    """Grow by ``amount`` 4-neighbour passes inside a ``width`` x ``height`` grid.

    Several passes are one spread over the diamond they reach, in one shuffle.
    """
    out = mask.select(*keys, "x", "y").distinct()
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    while amount > 0:
        step = min(amount, MAX_STEP)
        out = _spread(out, keys, step).where(inside).distinct()
        amount -= step
    return out


def erode(mask: DataFrame, keys: list[str], amount: int = 1) -> DataFrame:
    """Shrink by ``amount`` passes; cells beyond the border count as unselected.

    A cell stays when all cells of the diamond around it vote for it.
    """
    out = mask.select(*keys, "x", "y").distinct()
    while amount > 0:
        step = min(amount, MAX_STEP)
        votes = _spread(out, keys, step).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("votes"))
        out = votes.where(F.col("votes") == len(_ball(step))).drop("votes")
        amount -= step
    return out


def mask_apply(old: DataFrame, new: DataFrame, mask: DataFrame, keys: list[str], value: str = "c") -> DataFrame:
    """Take ``new`` where the mask is set and keep ``old`` elsewhere."""
    fresh = new.join(mask, keys, "left_semi").select(*keys, F.col(value).alias("__new"))
    return old.join(fresh, keys, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def mask_clear_color(mask: DataFrame, pixels: DataFrame, color: int, c: str = "c") -> DataFrame:
    """Drop every selected cell that shows ``color``."""
    return mask.join(pixels.where(F.col(c) == color), mask.columns, "left_anti")


def remap(
    pixels: DataFrame, mapping: DataFrame, c: str = "c", scope: Column | None = None, mask: DataFrame | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Replace ``c`` by ``mapping(id, to)``; unmapped rows, and rows out of scope, keep it.

    Ids are bytes, so the mapping has at most 256 rows and is broadcast.  An id
    beyond that, or one with two targets, is an error.
    """
    in_range = F.coalesce(F.col("id").between(0, 255), F.lit(False))
    byte = F.when(in_range, F.col("id")).otherwise(F.raise_error("a mapped id lies in 0..255"))
    single = F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("lo")).otherwise(F.raise_error("an id is mapped twice"))
    targets = mapping.withColumn("id", byte).groupBy("id").agg(F.min("to").alias("lo"), F.max("to").alias("hi"))
    bounded = targets.select("id", single.alias("__to"))
    hit = pixels[c] == bounded["id"]
    if scope is not None:
        hit = hit & scope
    marked = pixels
    if mask is not None:
        marked = pixels.join(mask.select(*keys).distinct().withColumn("__in", F.lit(True)), keys, "left")
        hit = (marked[c] == bounded["id"]) & F.col("__in")
        if scope is not None:
            hit = hit & scope
    out = marked.join(F.broadcast(bounded), hit, "left")
    return out.select(*(F.coalesce("__to", c).alias(n) if n == c else marked[n] for n in pixels.columns))


def opaque_filter(pixels: DataFrame, alpha: str | None = None, c: str = "c") -> DataFrame:
    return pixels.where(F.col(alpha) >= 128 if alpha else F.col(c) != 0)


def rect_select(cells: DataFrame, x0, y0, x1, y1, x: str = "x", y: str = "y") -> DataFrame:
    """Cells in the inclusive rectangle; corners in any order."""
    return cells.where(
        F.col(x).between(min(x0, x1), max(x0, x1)) & F.col(y).between(min(y0, y1), max(y0, y1))
    )


def box_range(cells: DataFrame, centre: dict[str, float], radius: float) -> DataFrame:
    """Rows within ``radius`` of the centre along every named axis."""
    for axis, at in centre.items():
        cells = cells.where(F.col(axis).between(at - radius, at + radius))
    return cells


def polygon_select(cells: DataFrame, points: list[tuple[int, int]], x: str = "x", y: str = "y") -> DataFrame:
    """Cells inside a polygon under the non-zero winding rule, its outline included.

    Fewer than three points select nothing.  Everything is integer arithmetic
    on the cell's own row, after a bounding-box filter.
    """
    if len(points) < 3:
        return cells.where(F.lit(False))
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    px, py = F.col(x).cast("long"), F.col(y).cast("long")
    winding, on_edge = [], []
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]]):
        side = (bx - ax) * (py - ay) - (px - ax) * (by - ay)
        if ay < by:
            winding.append(F.when(py.between(ay, by - 1) & (side < 0), 1).otherwise(0))
        elif ay > by:
            winding.append(F.when(py.between(by, ay - 1) & (side > 0), -1).otherwise(0))
        on_edge.append(
            (side == 0) & px.between(min(ax, bx), max(ax, bx)) & py.between(min(ay, by), max(ay, by))
        )
    box = rect_select(cells, min(xs), min(ys), max(xs), max(ys), x, y)
    inside = reduce(add, winding) != 0 if winding else F.lit(False)
    return box.where(inside | reduce(or_, on_edge))
