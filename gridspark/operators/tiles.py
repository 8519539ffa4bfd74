"""Tiles of a composition and the pixel filters that work through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.match import RGB_KEYS, nearest_match
from gridspark.operators.neighbours import gaussian_blur, median_filter, unsharp

SIDE = 128


def to_tile(pixels: DataFrame, cols: int, side: int = SIDE) -> DataFrame:
    """Append the tile index and the position inside the tile."""
    x, y = F.col("x"), F.col("y")
    col, row = F.floor(x / side).cast("int"), F.floor(y / side).cast("int")
    return pixels.withColumns({"tile": row * cols + col, "lx": x % side, "ly": y % side})


def to_global(pixels: DataFrame, cols: int, side: int = SIDE) -> DataFrame:
    """Append the position on the whole grid as ``gx, gy``."""
    t = F.col("tile")
    return pixels.withColumns(
        {"gx": (t % cols) * side + F.col("lx"), "gy": F.floor(t / cols).cast("int") * side + F.col("ly")}
    )


def stitch(tiles: DataFrame, cols: int, side: int = SIDE) -> DataFrame:
    """Tiles to one composition grid."""
    placed = to_global(tiles, cols, side)
    return placed.withColumnsRenamed({"gx": "x", "gy": "y"}).drop("tile", "lx", "ly")


def crop(pixels: DataFrame, col: int, row: int, side: int = SIDE) -> DataFrame:
    """One tile's window, with positions counted from its corner."""
    x, y = F.col("x"), F.col("y")
    inside = x.between(col * side, col * side + side - 1) & y.between(row * side, row * side + side - 1)
    return pixels.where(inside).withColumns({"lx": x - col * side, "ly": y - row * side})


def apply_filter(pixels: DataFrame, group: list[str], kind: str, strength: float) -> DataFrame:
    """``smooth``, ``median`` or ``sharpen`` the ``r, g, b`` channels (``smooth`` blurs alpha too)."""
    if kind == "smooth":
        return gaussian_blur(pixels, group, strength, [*RGB_KEYS, "alpha"])
    if kind == "median":
        return median_filter(pixels, group, max(1, round(strength)), RGB_KEYS)
    if kind == "sharpen":
        return unsharp(pixels, group, strength, RGB_KEYS)
    raise ValueError(f"unknown filter {kind!r}")


def filter_requantize(
    pixels: DataFrame,
    palette: DataFrame,
    group: list[str],
    strength: float,
    mask: DataFrame | None = None,
    kind: str = "smooth",
    c: str = "c",
) -> DataFrame:
    """Filter palette pixels and match them to the entries already in use.

    Transparent cells stay; with a mask only selected cells change, and only
    colours of the selection are candidates.
    """
    cell = [*group, "y", "x"]
    shown = pixels.join(palette.select(F.col("id").alias(c), *RGB_KEYS), c, "left").select(
        *pixels.columns,
        *(F.coalesce(ch, F.lit(0)).alias(ch) for ch in RGB_KEYS),
        F.when(F.col(c) == 0, 0).otherwise(255).alias("alpha"),
    )
    soft = apply_filter(shown, group, kind, strength)
    if mask is None:
        marked, chosen = soft.withColumn("__in", F.lit(True)), pixels
    else:
        marked = soft.join(mask.select(*cell).withColumn("__in", F.lit(True)), cell, "left")
        chosen = pixels.join(mask, cell, "left_semi")
    in_use = palette.join(chosen.select(F.col(c).alias("id")).where("id > 0").distinct(), "id", "left_semi")
    new = (
        F.when((F.col(c) == 0) | F.col("__in").isNull(), F.col(c))
        .when(F.col("alpha") < 128, F.lit(0))
        .otherwise(F.col("match_id"))
    )
    out = nearest_match(marked, in_use).withColumn("__new", new)
    return out.select(*(F.col("__new").alias(n) if n == c else F.col(n) for n in pixels.columns))

