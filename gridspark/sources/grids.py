"""Dense arrays to one row per cell, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_from_arrays(df: DataFrame, keys: list[str], array: str, width: Column | int | None = None) -> DataFrame:
    """``(keys, x, v)`` per element, or ``(keys, y, x, v)`` when a row width is given."""
    cells = df.select(*keys, F.posexplode(array).alias("pos", "v"))
    v = F.col("v").cast("double").alias("v")
    if width is None:
        return cells.select(*keys, F.col("pos").alias("x"), v)
    w = width if isinstance(width, Column) else F.lit(width)
    y = ((F.col("pos") - F.col("pos") % w) / w).cast("int")
    return cells.select(*keys, y.alias("y"), (F.col("pos") % w).alias("x"), v)


def arrays_from_grid(cells: DataFrame, keys: list[str], x: str = "x", v: str = "v") -> DataFrame:
    """One array per ``keys`` ordered by ``x``; ``keys`` must name a scan line or a tile, so it stays bounded."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(v).alias("v"))))
    return cells.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias("vs"))
