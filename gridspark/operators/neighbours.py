"""Neighbourhood operators on dense grids.

Horizontal neighbours are windows over one scan line ``(group, y)``, vertical
ones over one column ``(group, x)``: a huge image spreads over as many tasks as
it has lines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.color import Lab, half_up, oklab_dist_sq, to_byte
from gridspark.operators.histogram import otsu_threshold
from gridspark.operators.scan import join_on


def _line(group: list[str], other: str, along: str):
    return Window.partitionBy(*group, other).orderBy(along)


def _shift(col: str, k: int, w) -> Column:
    """The value ``k`` steps away, null past the border."""
    return F.lag(col, -k).over(w) if k < 0 else F.lead(col, k).over(w)


def _clamped(col: str, k: int, w) -> Column:
    """The value ``k`` steps away, the border cell past the border."""
    if k == 0:
        return F.col(col)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = F.first(col).over(full) if k < 0 else F.last(col).over(full)
    return F.coalesce(_shift(col, k, w), edge)


def edge_count(pixels: DataFrame, group: list[str], tile: int = 128, c: str = "c") -> DataFrame:
    """How many 4-neighbours differ, never looking across a tile edge.

    Both directions stay inside a tile, so one shuffle by tile serves both.
    """
    cut = pixels.withColumns({"__tx": F.floor(F.col("x") / tile), "__ty": F.floor(F.col("y") / tile)})
    by_tile = [*group, "__tx", "__ty"]
    cut = cut.repartition(*by_tile)
    across = _line(by_tile, "y", "x")
    down = _line(by_tile, "x", "y")

    def differs(k, w):
        return F.when(_shift(c, k, w) != F.col(c), 1).otherwise(0)

    rows = cut.withColumn("__h", differs(-1, across) + differs(1, across))
    both = rows.withColumn("edges", F.col("__h") + differs(-1, down) + differs(1, down))
    return both.drop("__tx", "__ty", "__h")


BLUR_RADIUS = 8


def detail_map(
    pixels: DataFrame, group: list[str], tile: int = 128, c: str = "c", seed_overlap: bool = False
) -> DataFrame:
    """Box mean of the edge counts, radius 8 on both axes, as a 0-255 ``detail``.

    The window shrinks at the borders.  ``seed_overlap`` counts the value at
    position 8 of each line once more, the way a running sum does that is
    seeded with its first window and then adds that window's last cell again.
    """
    r = BLUR_RADIUS

    def box(df, value, other, along, out):
        w = _line(group, other, along)
        near = w.rowsBetween(-r, r)
        total, size = F.sum(value).over(near), F.count(F.lit(1)).over(near)
        if seed_overlap:
            whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            total = total + F.coalesce(F.nth_value(value, r + 1).over(whole), F.lit(0))
        return df.withColumn(out, total / size)

    edges = edge_count(pixels, group, tile, c)
    blurred = box(box(edges, "edges", "y", "x", "__h"), "__h", "x", "y", "__m")
    scaled = half_up(F.sqrt(F.col("__m") / 2.5) * 255)
    return blurred.withColumn("detail", F.least(F.lit(255), scaled)).drop("__h", "__m")


def local_contrast(pixels: DataFrame, group: list[str], opaque: Column) -> DataFrame:
    """Root mean square OKLab distance to the opaque 4-neighbours, 0 if there are none.

    ``pixels`` has ``L, a, lab_b``; transparent cells get 0 too.
    """
    lab = F.when(opaque, F.struct("L", "a", F.col("lab_b").alias("b")))
    here = Lab(F.col("L"), F.col("a"), F.col("lab_b"))

    def add(df, w, first):
        ns = [_shift("__lab", -1, w), _shift("__lab", 1, w)]
        d = [oklab_dist_sq(here, Lab(n["L"], n["a"], n["b"])) for n in ns]
        sq = F.coalesce(d[0], F.lit(0.0)) + F.coalesce(d[1], F.lit(0.0))
        cnt = F.when(ns[0].isNotNull(), 1).otherwise(0) + F.when(ns[1].isNotNull(), 1).otherwise(0)
        if first:
            return df.withColumns({"__sq": sq, "__n": cnt})
        return df.withColumns({"__sq": F.col("__sq") + sq, "__n": F.col("__n") + cnt})

    base = pixels.withColumn("__lab", lab)
    both = add(add(base, _line(group, "y", "x"), True), _line(group, "x", "y"), False)
    rms = F.sqrt(F.col("__sq") / F.greatest(F.col("__n"), F.lit(1)))
    contrast = F.when(F.col("__lab").isNotNull() & (F.col("__n") > 0), rms).otherwise(F.lit(0.0))
    return both.withColumn("contrast", contrast).drop("__lab", "__sq", "__n")


def dither_strength(contrast: DataFrame, thresholds: DataFrame, group: list[str], opaque: Column) -> DataFrame:
    """1 in flat areas falling to 0 in busy ones, around each group's threshold."""
    t = F.col("threshold")
    lower, reach = t * 0.5, t * 1.5 - t * 0.5
    ramp = 1.0 - F.least(
        F.lit(1.0),
        F.greatest(F.lit(0.0), (F.col("contrast") - lower) / F.when(reach > 1e-6, reach).otherwise(F.lit(1.0))),
    )
    step = F.when(F.col("contrast") <= t, F.lit(1.0)).otherwise(F.lit(0.0))
    value = F.when(opaque, F.when(reach > 1e-6, ramp).otherwise(step)).otherwise(F.lit(0.0))
    return join_on(contrast, thresholds, group).withColumn("strength", value).drop("threshold")


def adaptive_strength(pixels: DataFrame, group: list[str], opaque: Column) -> DataFrame:
    """Contrast, Otsu threshold and dither strength of ``L, a, lab_b`` pixels in one go.

    Two passes over the pixels: the first counts contrasts and keeps only their
    histogram, the second computes the contrast again and meets the thresholds.
    """
    contrast = local_contrast(pixels, group, opaque)
    if group:
        return dither_strength(contrast, otsu_threshold(contrast, group, "contrast"), group, opaque)
    one = contrast.withColumn("__all", F.lit(0))
    return dither_strength(one, otsu_threshold(one, ["__all"], "contrast"), ["__all"], opaque).drop("__all")


def gaussian_kernel(radius: float) -> list[float]:
    sigma = max(0.01, radius * 0.5)
    size = max(3, int(radius * 2 + 1) | 1)
    half = size >> 1
    raw = [math.exp(-((i - half) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    total = sum(raw)
    return [w / total for w in raw]


def gaussian_blur(pixels: DataFrame, group: list[str], radius: float, channels: list[str]) -> DataFrame:
    """Separable blur with clamped borders; channels come back as 0-255 integers."""
    kernel = gaussian_kernel(radius)
    half = len(kernel) >> 1

    def blend(col, w):
        out = None
        for i, weight in enumerate(kernel):
            term = _clamped(col, i - half, w) * F.lit(weight)
            out = term if out is None else out + term
        return out

    across, down = _line(group, "y", "x"), _line(group, "x", "y")
    rows = pixels.withColumns({f"__{c}": blend(c, across) for c in channels})
    cols = rows.withColumns({c: to_byte(blend(f"__{c}", down)) for c in channels})
    return cols.drop(*(f"__{c}" for c in channels))


def median_filter(pixels: DataFrame, group: list[str], radius: int, channels: list[str]) -> DataFrame:
    """Median per channel over (2r+1)^2 clamped neighbours.

    A line window gathers each cell's row, a column window gathers those rows.
    """
    span = range(-radius, radius + 1)
    across, down = _line(group, "y", "x"), _line(group, "x", "y")
    rows = pixels.withColumns({f"__{c}": F.array(*(_clamped(c, k, across) for k in span)) for c in channels})
    middle = (2 * radius + 1) ** 2 >> 1
    out = rows.withColumns(
        {
            c: F.sort_array(F.flatten(F.array(*(_clamped(f"__{c}", k, down) for k in span))))[middle]
            for c in channels
        }
    )
    return out.drop(*(f"__{c}" for c in channels))


def unsharp(pixels: DataFrame, group: list[str], amount: float, channels: list[str]) -> DataFrame:
    """Push each value away from its radius-1 blur."""
    kept = pixels.withColumns({f"__s{c}": F.col(c) for c in channels})
    soft = gaussian_blur(kept, group, 1.0, channels)
    sharp = {c: to_byte(F.col(f"__s{c}") + (F.col(f"__s{c}") - F.col(c)) * F.lit(float(amount))) for c in channels}
    return soft.withColumns(sharp).drop(*(f"__s{c}" for c in channels))
