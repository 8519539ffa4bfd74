"""Colour arithmetic as column expressions (0-255 channels, OKLab as doubles)."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Lab(NamedTuple):
    L: Column
    a: Column
    b: Column


class Rgb(NamedTuple):
    r: Column
    g: Column
    b: Column


# The published OKLab matrices.
LMS_FROM_RGB = (
    (0.4122214708, 0.5363325363, 0.0514459929),
    (0.2119034982, 0.6806995451, 0.1073969566),
    (0.0883024619, 0.2817188376, 0.6299787005),
)
LAB_FROM_LMS = (
    (0.2104542553, 0.7936177850, -0.0040720468),
    (1.9779984951, -2.4285922050, 0.4505937099),
    (0.0259040371, 0.7827717662, -0.8086757660),
)
LMS_FROM_LAB = (
    (0.3963377774, 0.2158037573),
    (-0.1055613458, -0.0638541728),
    (-0.0894841775, -1.2914855480),
)
RGB_FROM_LMS = (
    (4.0767416621, -3.3077115913, 0.2309699292),
    (-1.2684380046, 2.6097574011, -0.3413193965),
    (-0.0041960863, -0.7034186147, 1.7076147010),
)


def half_up(x: Column) -> Column:
    """Round to the nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5).cast("int")


def to_byte(x: Column) -> Column:
    """Clamp to 0-255, then round half up."""
    return half_up(F.greatest(F.least(x, F.lit(255.0)), F.lit(0.0)))


def unit_to_byte(x: Column) -> Column:
    """[0, 1] (clamped) to 0-255."""
    return half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * 255)


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return (
        F.when(c <= 0, F.lit(0.0))
        .when(c >= 1, F.lit(1.0))
        .when(c <= 0.0031308, c * 12.92)
        .otherwise(F.pow(c, F.lit(1.0 / 2.4)) * 1.055 - 0.055)
    )


def _mix(weights, values):
    out = values[0] * weights[0]
    for weight, value in zip(weights[1:], values[1:]):
        out = out + value * weight
    return out


def rgb_to_linear(rgb: Rgb) -> Rgb:
    return Rgb(*(srgb_to_linear(c / 255) for c in rgb))


def rgb_to_oklab(rgb: Rgb) -> Lab:
    linear = rgb_to_linear(rgb)
    roots = [F.cbrt(_mix(row, linear)) for row in LMS_FROM_RGB]
    return Lab(*(_mix(row, roots) for row in LAB_FROM_LMS))


def oklab_to_linear(lab: Lab) -> Rgb:
    """Linear RGB; components may leave [0, 1]."""
    cubes = []
    for wa, wb in LMS_FROM_LAB:
        root = lab.L + lab.a * wa + lab.b * wb
        cubes.append(root * root * root)
    return Rgb(*(_mix(row, cubes) for row in RGB_FROM_LMS))


def linear_bytes(linear: Rgb) -> Rgb:
    """Linear RGB to clamped 0-255 channels."""
    return Rgb(*(unit_to_byte(linear_to_srgb(c)) for c in linear))


def oklab_to_rgb(lab: Lab) -> Rgb:
    """0-255 channels; pass plain columns, every term uses each of them several times."""
    return linear_bytes(oklab_to_linear(lab))


def oklab_dist_sq(p: Lab, q: Lab) -> Column:
    dl, da, db = p.L - q.L, p.a - q.a, p.b - q.b
    return dl * dl + da * da + db * db


def hue(lab: Lab) -> Column:
    return F.atan2(lab.b, lab.a)


def chroma(lab: Lab) -> Column:
    return F.sqrt(lab.a * lab.a + lab.b * lab.b)


def rgb_pack(rgb: Rgb) -> Column:
    return F.shiftleft(rgb.r, 16).bitwiseOR(F.shiftleft(rgb.g, 8)).bitwiseOR(rgb.b)


def rgb_unpack(packed: Column) -> Rgb:
    def byte(shift):
        return F.shiftright(packed, shift).bitwiseAND(F.lit(255))

    return Rgb(byte(16), byte(8), byte(0))


def rgb_hex(packed: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(packed), 6, "0"))


def rgb_to_hsv(rgb: Rgb) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value in [0, 1]."""
    r, g, b = (c / 255 for c in rgb)
    top = F.greatest(r, g, b)
    span = top - F.least(r, g, b)
    sector = (
        F.when(span <= 0, F.lit(0.0))
        .when(top == r, 60 * (((g - b) / span) % 6))
        .when(top == g, 60 * ((b - r) / span + 2))
        .otherwise(60 * ((r - g) / span + 4))
    )
    h = F.when(sector < 0, sector + 360).otherwise(sector)
    s = F.when(top == 0, F.lit(0.0)).otherwise(span / F.when(top == 0, F.lit(1.0)).otherwise(top))
    return h, s, top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Rgb:
    c = v * s
    x = c * (1 - F.abs(((h / 60) % 2) - 1))
    m = v - c
    zero = F.lit(0.0)
    # one (r, g, b) triple per 60 degree sector
    sectors = ((c, x, zero), (x, c, zero), (zero, c, x), (zero, x, c), (x, zero, c), (c, zero, x))

    def channel(k):
        out = F.when(h < 60, sectors[0][k])
        for i in range(1, 5):
            out = out.when(h < 60 * (i + 1), sectors[i][k])
        return half_up((out.otherwise(sectors[5][k]) + m) * 255)

    return Rgb(channel(0), channel(1), channel(2))


def adjust_tone(rgb: Rgb, alpha: Column, brightness=1.0, contrast=1.0, saturation=1.0) -> Rgb:
    """Contrast about 0.5, then brightness, then saturation against Rec.601 luma.

    Rows with alpha below 128 keep their channels.
    """
    unit = [c / 255 for c in rgb]
    if contrast != 1:
        unit = [(c - 0.5) * contrast + 0.5 for c in unit]
    if brightness != 1:
        unit = [c * brightness for c in unit]
    if saturation != 1:
        luma = _mix((0.299, 0.587, 0.114), unit)
        unit = [luma + (c - luma) * saturation for c in unit]
    return Rgb(*(F.when(alpha < 128, old).otherwise(unit_to_byte(c)) for old, c in zip(rgb, unit)))


def posterize(rgb: Rgb, levels: int) -> Rgb:
    step = 255 / (max(2, levels) - 1)
    return Rgb(*(to_byte(half_up(c / step) * step) for c in rgb))


def bayer_offset(x: Column, y: Column, size: int, scale: float) -> Column:
    """Threshold offset of an ordered dither of side ``size`` (a power of two).

    The matrix value is read off the bits of the position: bit ``j`` of x and y
    selects one of four sub-squares, the lowest bit weighing most.
    """
    depth = int(math.log2(size))
    if 2**depth != size:
        raise ValueError("size must be a power of two")
    value = F.lit(0)
    for j in range(depth):
        xb = F.shiftright(x, j).bitwiseAND(F.lit(1))
        yb = F.shiftright(y, j).bitwiseAND(F.lit(1))
        value = value + (xb.bitwiseXOR(yb) * 2 + yb) * (4 ** (depth - 1 - j))
    return ((value + 0.5) / (size * size) - 0.5) * scale
