"""Palette tables keyed by an 8-bit id: ``id = base * 4 + shade``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.color import Lab, Rgb, chroma, hue, linear_bytes, oklab_to_linear, rgb_to_linear, rgb_to_oklab

PALETTE_SIZE = 256

# The 61 base colours at full brightness, in base order from 1.
BASE_COLOURS = (
    (127, 178, 56), (247, 233, 163), (199, 199, 199), (255, 0, 0), (160, 160, 255),
    (167, 167, 167), (0, 124, 0), (255, 255, 255), (164, 168, 184), (151, 109, 77),
    (112, 112, 112), (64, 64, 255), (143, 119, 72), (255, 252, 245), (216, 127, 51),
    (178, 76, 216), (102, 153, 216), (229, 229, 51), (127, 204, 25), (242, 127, 165),
    (76, 76, 76), (153, 153, 153), (76, 127, 153), (127, 63, 178), (51, 76, 178),
    (102, 76, 51), (102, 127, 51), (153, 51, 51), (25, 25, 25), (250, 238, 77),
    (92, 219, 213), (74, 128, 255), (0, 217, 58), (129, 86, 49), (112, 2, 0),
    (209, 177, 161), (159, 82, 36), (149, 87, 108), (112, 108, 138), (186, 133, 36),
    (103, 117, 53), (160, 77, 78), (57, 41, 35), (135, 107, 98), (87, 92, 92),
    (122, 73, 88), (76, 62, 92), (76, 50, 35), (76, 82, 42), (142, 60, 46),
    (37, 22, 16), (189, 48, 49), (148, 63, 97), (92, 25, 29), (22, 126, 134),
    (58, 142, 140), (86, 44, 62), (20, 180, 133), (100, 100, 100), (216, 175, 147),
    (127, 167, 150),
)
# Brightness of shades 0-3 in 255ths, and the 16 dyes' ids at shade 1.
SHADE_FACTORS = (180, 220, 255, 135)
DYE_IDS = (33, 61, 65, 69, 73, 77, 81, 85, 89, 93, 97, 101, 105, 109, 113, 117)

RESTRICTIONS = ("flat", "legal", "all", "greyscale", "dyes", "dye_shades")


def base_of(c: Column) -> Column:
    return F.shiftright(c, 2)


def shade_of(c: Column) -> Column:
    return c.bitwiseAND(F.lit(3))


def is_legal(c: Column) -> Column:
    """Shade 3 cannot be produced, so it is not legal."""
    return shade_of(c) != 3


def map_palette(spark: SparkSession) -> DataFrame:
    """The built-in palette: 61 base colours in four shades, 244 rows."""
    bases = spark.createDataFrame(
        [(i + 1, *rgb) for i, rgb in enumerate(BASE_COLOURS)], "base int, r int, g int, b int"
    )
    shades = F.explode(
        F.array(*(F.struct(F.lit(i).alias("shade"), F.lit(f).alias("f")) for i, f in enumerate(SHADE_FACTORS)))
    )
    lit = bases.select("base", "r", "g", "b", shades.alias("s"))
    scaled = [F.floor(F.col(c) * F.col("s.f") / 255).cast("int").alias(c) for c in "rgb"]
    return palette_dim(lit.select((F.col("base") * 4 + F.col("s.shade")).alias("id"), *scaled))


def palette_dim(rows: DataFrame) -> DataFrame:
    """``(id, r, g, b)`` rows as a palette with a derived ``legal`` flag.

    One row per id in 1..255 bounds the result at 255 rows, which lets other
    operators carry a palette as one array value.  Another id, or one id with
    two colours, is an error.
    """
    entry = F.struct("r", "g", "b")
    in_range = F.coalesce(F.col("id").between(1, PALETTE_SIZE - 1), F.lit(False))
    known = F.when(in_range, F.col("id")).otherwise(F.raise_error("a palette id lies in 1..255"))
    single = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error("a palette id has two colours"))
    return (
        rows.withColumn("id", known)
        .groupBy("id")
        .agg(F.min(entry).alias("lo"), F.max(entry).alias("hi"))
        .select("id", single.alias("e"))
        .select("id", "e.r", "e.g", "e.b", is_legal(F.col("id")).alias("legal"))
    )


def palette_override(palette: DataFrame, dump: DataFrame) -> DataFrame:
    """Upsert ``(id, r, g, b)`` rows of ``dump`` into ``palette``."""
    new = palette_dim(dump).select("id", F.struct("r", "g", "b").alias("new"))
    old = palette.select("id", F.struct("r", "g", "b").alias("old"))
    merged = old.join(new, "id", "full_outer").withColumn("e", F.coalesce("new", "old"))
    return merged.select("id", "e.r", "e.g", "e.b", is_legal(F.col("id")).alias("legal"))


def restrict(palette: DataFrame, rule: str, grey_threshold: int = 40) -> DataFrame:
    """Palette rows allowed by one of :data:`RESTRICTIONS`."""
    c = F.col("id")
    if rule == "flat":
        return palette.where(shade_of(c) == 1)
    if rule == "legal":
        return palette.where(is_legal(c))
    if rule == "all":
        return palette
    if rule == "greyscale":
        spread = F.greatest("r", "g", "b") - F.least("r", "g", "b")
        return palette.where(is_legal(c) & (spread < grey_threshold))
    if rule == "dyes":
        return palette.where(c.isin(*DYE_IDS))
    if rule == "dye_shades":
        return palette.where(is_legal(c) & base_of(c).isin(*(i >> 2 for i in DYE_IDS)))
    raise ValueError(f"unknown restriction {rule!r}")


def with_oklab(df: DataFrame) -> DataFrame:
    """Append ``L``, ``a``, ``lab_b`` to rows holding ``r, g, b``."""
    lab = rgb_to_oklab(Rgb(F.col("r"), F.col("g"), F.col("b")))
    return df.withColumns({"L": lab.L, "a": lab.a, "lab_b": lab.b})


def with_rgb(df: DataFrame) -> DataFrame:
    """Replace ``r, g, b`` by what the row's ``L``, ``a``, ``lab_b`` columns convert to."""
    lin = oklab_to_linear(Lab(F.col("L"), F.col("a"), F.col("lab_b")))
    staged = df.withColumns({"__lr": lin.r, "__lg": lin.g, "__lb": lin.b})
    out = linear_bytes(Rgb(F.col("__lr"), F.col("__lg"), F.col("__lb")))
    return staged.withColumns({"r": out.r, "g": out.g, "b": out.b}).drop("__lr", "__lg", "__lb")


def chroma_boost(df: DataFrame, boost: float, alpha: str = "alpha") -> DataFrame:
    """Scale OKLab a and b of ``r, g, b`` rows and clamp; rows with alpha below 128 stay."""
    if boost == 1:
        return df
    kept = df.withColumn("__old", F.struct("r", "g", "b"))
    lab = with_oklab(kept).withColumns({"a": F.col("a") * boost, "lab_b": F.col("lab_b") * boost})
    clear = F.col(alpha) < 128
    out = with_rgb(lab)
    return out.select(
        *(F.when(clear, F.col(f"__old.{n}")).otherwise(F.col(n)).alias(n) if n in ("r", "g", "b") else F.col(n) for n in df.columns)
    )


def palette_array(palette: DataFrame, *group: str) -> DataFrame:
    """One row (per ``group``) holding the palette as an array ordered by id.

    Each element has the id, the OKLab value, the linear RGB value and the hue.
    """
    linear = rgb_to_linear(Rgb(F.col("r"), F.col("g"), F.col("b")))
    lab = Lab(F.col("L"), F.col("a"), F.col("lab_b"))
    entry = F.struct(
        F.col("id"),
        F.col("L"),
        F.col("a"),
        F.col("lab_b").alias("b"),
        linear.r.alias("lr"),
        linear.g.alias("lg"),
        linear.b.alias("lb"),
        hue(lab).alias("hue"),
        (lab.a * lab.a + lab.b * lab.b).alias("chroma_sq"),
    )
    rows = with_oklab(palette).select(*group, entry.alias("e"))
    return rows.groupBy(*group).agg(F.array_sort(F.collect_list("e")).alias("palette"))


def sort_keys(palette: DataFrame) -> DataFrame:
    """Palette rows with ``hue``, ``chroma`` and ``lightness``."""
    lab = Lab(F.col("L"), F.col("a"), F.col("lab_b"))
    return with_oklab(palette).select(
        *palette.columns, hue(lab).alias("hue"), chroma(lab).alias("chroma"), F.col("L").alias("lightness")
    )
