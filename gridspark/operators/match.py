"""Nearest palette entry per colour, where the rows are.

Matching is one narrow stage: every Arrow batch of rows looks at its own
distinct colours only (an image repeats them), compares those with the palette
as a whole and hands the answers back in place.  Nothing is shuffled, written
or paired up.  A palette has at most 255 rows; the first row of each partition
brings it along, so no job runs before the result is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gridspark.functions.color import (
    LAB_FROM_LMS,
    LMS_FROM_LAB,
    LMS_FROM_RGB,
    RGB_FROM_LMS,
    Lab,
    bayer_offset,
    oklab_dist_sq,
)
from gridspark.functions.palette import PALETTE_SIZE, palette_array, palette_dim, with_oklab
from gridspark.operators.scan import join_on

METRICS = ("OKLAB", "CHROMA_FIRST", "LUMA_FIRST", "HUE_ONLY", "RGB")
ACHROMATIC_SQ = 0.04 * 0.04
GREY_PENALTY = 2.01
RGB_KEYS = ["r", "g", "b"]


ENTRY = ["id", "L", "a", "b", "lr", "lg", "lb", "hue", "chroma_sq"]
AT_ONCE = 2048  # colours compared with the palette together

Palette = dict[str, np.ndarray]


def _entries(palette: DataFrame, *group: str) -> DataFrame:
    """One row (per ``group``) with the palette's entries, in id order, as one flat array of numbers."""
    flat = F.flatten(F.transform("palette", lambda e: F.array(*(e[name].cast("double") for name in ENTRY))))
    small = F.when(F.size("palette") < PALETTE_SIZE, flat)
    checked = F.coalesce(small, F.raise_error(F.lit(f"a palette has at most {PALETTE_SIZE - 1} rows")).cast("array<double>"))
    return palette_array(palette, *group).select(*group, checked.alias("entries"))


def _bounded(palette: DataFrame) -> DataFrame:
    return palette if "legal" in palette.columns else palette_dim(palette)


def _loaded(flat: np.ndarray) -> Palette:
    table = np.asarray(flat, np.float64).reshape(-1, len(ENTRY))
    return {name: table[:, k] for k, name in enumerate(ENTRY)}


def _weighted(weights, values):
    out = values[0] * weights[0]
    for weight, value in zip(weights[1:], values[1:]):
        out = out + value * weight
    return out


def _oklab(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    unit = [c / 255 for c in (r, g, b)]
    linear = [np.where(c <= 0.04045, c / 12.92, ((np.maximum(c, 0) + 0.055) / 1.055) ** 2.4) for c in unit]
    roots = [np.cbrt(_weighted(row, linear)) for row in LMS_FROM_RGB]
    return [_weighted(row, roots) for row in LAB_FROM_LMS]


def _gaps(pal: Palette, L, a, b, metric: str) -> np.ndarray:
    """Distance of every colour (rows) to every entry (columns)."""

    def sq(x, y):
        d = np.subtract.outer(x, y)
        return d * d

    if metric == "RGB":
        cubes = [(L + a * wa + b * wb) ** 3 for wa, wb in LMS_FROM_LAB]
        lin = [sum(w * c for w, c in zip(row, cubes)) for row in RGB_FROM_LMS]
        return sq(lin[0], pal["lr"]) + sq(lin[1], pal["lg"]) + sq(lin[2], pal["lb"])
    dl, da, db = sq(L, pal["L"]), sq(a, pal["a"]), sq(b, pal["b"])
    if metric == "CHROMA_FIRST":
        return dl + da * 4 + db * 4
    if metric == "LUMA_FIRST":
        return dl * 4 + da + db
    plain = dl + da + db
    if metric == "HUE_ONLY":
        turned = 1.0 - np.cos(np.subtract.outer(np.arctan2(b, a), pal["hue"]))
        coloured = np.where(pal["chroma_sq"][None, :] < ACHROMATIC_SQ, GREY_PENALTY, turned)
        return np.where((a * a + b * b < ACHROMATIC_SQ)[:, None], plain, coloured)
    return plain


def _answers(pal: Palette, lab: list[np.ndarray], metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Position (in id order) and distance of the nearest entry; the first one wins a tie."""
    at, dist = np.zeros(len(lab[0]), np.int64), np.full(len(lab[0]), np.nan)
    if len(pal["id"]):
        for lo in range(0, len(at), AT_ONCE):
            gaps = _gaps(pal, *(v[lo : lo + AT_ONCE] for v in lab), metric)
            at[lo : lo + AT_ONCE] = gaps.argmin(axis=1)
            dist[lo : lo + AT_ONCE] = gaps[np.arange(len(gaps)), at[lo : lo + AT_ONCE]]
    return at, dist


def _dictionary(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct combination of the columns, and the combination of each row."""
    code, kinds = np.zeros(len(columns[0]), np.int64), 1
    for values in columns:
        own, distinct = pd.factorize(values)
        code, every = pd.factorize(code * len(distinct) + own)
        kinds = len(every)
    first = np.zeros(kinds if len(code) else 0, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]  # the earliest row of a combination is written last
    return first, code


def _matched(pal: Palette, rgb: list[np.ndarray], wanted: list[tuple[str, np.ndarray | None]]):
    """Per metric and shift the ids (0 where the palette is empty, -1 for a row without a colour) and distances of a batch."""
    known = ~np.isnan(rgb[0] + rgb[1] + rgb[2])
    channels = [c[known] for c in rgb]
    first, code = _dictionary(channels)
    lab = _oklab(*(c[first] for c in channels))
    for metric, shift in wanted:
        if shift is None:
            colours, own = lab, code
        else:
            offsets = shift[known]
            some, own = _dictionary([code, offsets])
            colours = [v[code[some]] + offsets[some] for v in lab]
        at, dist = _answers(pal, colours, metric)
        found = pal["id"][at] if len(pal["id"]) else np.zeros(len(at))
        ids, dists = np.full(len(known), -1.0), np.full(len(known), np.nan)
        ids[known], dists[known] = found[own], dist[own]
        yield ids.astype(np.int32), dists


#: Position of a row inside its partition, as ``monotonically_increasing_id`` numbers them.
IN_PARTITION = (1 << 33) - 1


Wanted = dict[str, tuple[str, Column | None]]


def with_nearest(df: DataFrame, palette: DataFrame, wanted: Wanted) -> DataFrame:
    """Append ``id_<name>`` and ``dist_<name>`` of the nearest entry to rows holding ``r, g, b``, all in one pass.

    ``wanted`` names metrics, each with a shift that is added to L, a and b, or
    None.  The lowest id wins a tie; an empty palette gives id 0 and no
    distance, a row without a colour gets neither.
    """
    for metric, _ in wanted.values():
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
    shifts = {f"__t_{name}": shift for name, (_, shift) in wanted.items() if shift is not None}
    plan = [(name, metric, list(shifts).index(f"__t_{name}") if shift is not None else None) for name, (metric, shift) in wanted.items()]

    def match(batches):
        pal = None
        for first, r, g, b, *rest in batches:
            if pal is None:
                pal = _loaded(first.iloc[0])
            rgb, offsets = ([c.to_numpy(np.float64, na_value=np.nan) for c in cs] for cs in ((r, g, b), rest))
            asked = [(metric, None if at is None else offsets[at]) for _, metric, at in plan]
            out = {}
            for (name, *_), (ids, dists) in zip(plan, _matched(pal, rgb, asked)):
                out[f"id_{name}"] = pd.Series(ids, dtype="Int32").mask(ids < 0)
                out[f"dist_{name}"] = dists
            yield pd.DataFrame(out)

    series = tuple[(pd.Series,) * (4 + len(shifts))]
    match.__annotations__ = {"batches": Iterator[series], "return": Iterator[pd.DataFrame]}
    # not deterministic, so that no filter is moved between the palette's row and the stage that reads it
    nearest = F.pandas_udf(match, ", ".join(f"id_{n} int, dist_{n} double" for n in wanted)).asNondeterministic()
    first_row = F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION)) == 0
    rows = df.withColumns({"__pal": F.when(first_row, _entries(_bounded(palette)).scalar()), **shifts})
    found = rows.withColumn("__m", nearest("__pal", *RGB_KEYS, *shifts))
    answers = [c for n in wanted for c in (F.col(f"__m.id_{n}"), F.nanvl(f"__m.dist_{n}", F.lit(None)).alias(f"dist_{n}"))]
    return found.select(*df.columns, *answers)


def nearest_match(df: DataFrame, palette: DataFrame, metric: str = "OKLAB", shift: Column | None = None) -> DataFrame:
    """Append ``match_id`` and ``dist`` (squared) of the nearest entry to rows holding ``r, g, b``."""
    found = with_nearest(df, palette, {"m": (metric, shift)})
    return found.withColumnsRenamed({"id_m": "match_id", "dist_m": "dist"})


def match_by_metric(df: DataFrame, palette: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per row and metric: ``metric, match_id, dist``, all metrics from one pass over the rows."""
    each = F.array(
        *(F.struct(F.lit(m).alias("metric"), F.col(f"id_{m}").alias("match_id"), F.col(f"dist_{m}").alias("dist")) for m in metrics)
    )
    return with_nearest(df, palette, {m: (m, None) for m in metrics}).select(*df.columns, F.inline(each))


def used_entries(palette: DataFrame, colours: DataFrame, metric: str = "OKLAB") -> DataFrame:
    """Palette rows that are the nearest match of at least one colour."""
    hits = nearest_match(colours.select(*RGB_KEYS), palette, metric)
    return palette.join(hits.select(F.col("match_id").alias("id")).distinct(), "id", "left_semi")


def ordered_dither(
    df: DataFrame, palette: DataFrame, size: int = 4, scale: float = 0.1, metric: str = "OKLAB"
) -> DataFrame:
    """Shift L, a and b by a position-dependent threshold, then match."""
    return nearest_match(df, palette, metric, bayer_offset(F.col("x"), F.col("y"), size, scale)).drop("dist")


def dither_sizes(
    df: DataFrame, palette: DataFrame, sizes: tuple[int, ...], scale: float = 0.1, metric: str = "OKLAB"
) -> DataFrame:
    """``ordered_dither`` with several matrix sizes in one pass: one row per row and ``size``."""
    wanted = {str(n): (metric, bayer_offset(F.col("x"), F.col("y"), n, scale)) for n in sizes}
    each = F.array(*(F.struct(F.lit(n).alias("size"), F.col(f"id_{n}").alias("match_id")) for n in sizes))
    return with_nearest(df, palette, wanted).select(*df.columns, F.inline(each))


TILE_ROWS = 1 << 18


def tile_palette_match(
    pixels: DataFrame, present: DataFrame, palette: DataFrame, tile: list[str], metric: str = "OKLAB", tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Match each pixel only to entries its own tile already shows.

    ``present`` has one row per ``(tile, id)``; a tile without any entry falls
    back to the whole palette.  Pixels meet their palette in one shuffle by
    tile.  A tile of more than ``tile_rows`` pixels is dealt over several
    groups, each with a copy of the (at most 255) entries.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    key = F.struct(*tile)
    sizes = pixels.groupBy(key.alias("__tile")).agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > tile_rows).select("__tile", F.ceil(F.col("n") / tile_rows).cast("int").alias("parts"))
    colour = F.xxhash64(*(c for c in pixels.columns if c not in tile))
    part = F.coalesce(F.pmod(colour, F.col("parts")).cast("int"), F.lit(0))
    dealt = pixels.withColumn("__tile", key).join(large, "__tile", "left").withColumn("part", part).drop("parts")
    own = _entries(present.where(F.col("id") > 0).select(*tile, "id").distinct().join(_bounded(palette), "id"), *tile)
    local = own.select(key.alias("__tile"), "entries")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
    # a tile without entries still needs the group that brings the whole palette
    known = sizes.select("__tile").join(local, "__tile", "left").join(large, "__tile", "left")
    armed = known.select("__tile", F.coalesce("entries", _entries(_bounded(palette)).scalar()).alias("entries"), copies.alias("part"))
    names = pixels.columns

    def match(group: pa.Table, entries: pa.Table) -> pa.Table:
        pal = _loaded(entries.column("entries")[0].values.to_numpy(zero_copy_only=False))
        rgb = [group.column(c).cast(pa.float64()).to_numpy() for c in RGB_KEYS]
        ((ids, _),) = _matched(pal, rgb, [(metric, None)])
        return group.select(names).append_column("match_id", pa.array(ids, mask=ids < 0))

    groups = dealt.groupBy("__tile", "part").cogroup(armed.groupBy("__tile", "part"))
    return groups.applyInArrow(match, StructType([*pixels.schema.fields, StructField("match_id", IntegerType())]))


def nearest_other(palette: DataFrame) -> DataFrame:
    """For each palette row, the nearest other row as ``other_id`` and ``dist``."""
    here = Lab(F.col("L"), F.col("a"), F.col("lab_b"))
    armed = with_oklab(palette).withColumn("__pal", palette_array(palette).scalar())
    others = F.filter("__pal", lambda e: e["id"] != F.col("id"))
    gaps = F.transform(others, lambda e: F.struct(oklab_dist_sq(here, Lab(e["L"], e["a"], e["b"])).alias("d"), e["id"].alias("i")))
    found = armed.select("*", F.inline(F.array(F.array_min(gaps))))
    return found.select(*palette.columns, F.col("i").alias("other_id"), F.col("d").alias("dist"))


def closest_pair(counts: DataFrame, palette: DataFrame, group: list[str], weighted: bool = False) -> DataFrame:
    """Per group the pair of present entries to merge: ``victim`` into ``survivor``.

    ``counts`` has ``(group, id, n)``.  At most 255 entries exist per group, so
    both sides of the pair sit in one array value.  The first pair in id order
    wins a tie; the rarer entry of the pair is the victim, the lower id if even.
    """
    entry = F.struct(
        F.col("id"), F.col("L"), F.col("a"), F.col("lab_b").alias("b"), F.col("n")
    )
    rows = with_oklab(counts.where((F.col("id") > 0) & (F.col("n") > 0)).join(palette, "id"))
    arrays = rows.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("es"))

    def score(p, q):
        d = oklab_dist_sq(Lab(p["L"], p["a"], p["b"]), Lab(q["L"], q["a"], q["b"]))
        return d / (p["n"] + q["n"]) if weighted else d

    def best_from(p):
        later = F.filter("es", lambda q: q["id"] > p["id"])
        return F.array_min(
            F.transform(
                later,
                lambda q: F.struct(
                    score(p, q).alias("score"),
                    p["id"].alias("a"),
                    q["id"].alias("b"),
                    p["n"].alias("na"),
                    q["n"].alias("nb"),
                ),
            )
        )

    m = F.array_min(F.filter(F.transform("es", best_from), lambda s: s.isNotNull()))
    first_loses = F.col("m.na") <= F.col("m.nb")
    return (
        arrays.select(*group, m.alias("m"))
        .where(F.col("m").isNotNull())
        .select(
            *group,
            F.when(first_loses, F.col("m.a")).otherwise(F.col("m.b")).alias("victim"),
            F.when(first_loses, F.col("m.b")).otherwise(F.col("m.a")).alias("survivor"),
            F.least("m.na", "m.nb").alias("touched"),
            F.col("m.score").alias("score"),
        )
    )


def match_quality(df: DataFrame, palette: DataFrame, good: float = 0.05) -> DataFrame:
    """Share of rows whose best match is within ``good``, and the mean best distance.

    No rows give (0, 0); an empty palette gives (0, 1).
    """
    colours = df.groupBy(*RGB_KEYS).agg(F.count(F.lit(1)).alias("n"))
    return quality(nearest_match(colours, palette), palette, good)


def quality(weighted: DataFrame, palette: DataFrame | None = None, good: float = 0.05) -> DataFrame:
    """Quality over rows with a squared ``dist`` and a weight ``n``; partial sums merge in the shuffle."""
    totals = weighted.agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("dist") <= good * good, F.col("n")).otherwise(F.lit(0))).alias("hits"),
        F.sum(F.sqrt("dist") * F.col("n")).alias("delta"),
    )
    empty_palette = F.lit(False)
    if palette is not None:
        totals = totals.withColumn("__k", palette.agg(F.count(F.lit(1))).scalar())
        empty_palette = F.col("__k") == 0
    no_rows = F.coalesce(F.col("total"), F.lit(0)) == 0
    return totals.select(
        F.when(empty_palette | no_rows, F.lit(0.0))
        .otherwise(F.col("hits") / F.col("total") * 100)
        .alias("accurate_pct"),
        F.when(empty_palette, F.lit(1.0))
        .when(no_rows, F.lit(0.0))
        .otherwise(F.col("delta") / F.col("total"))
        .alias("avg_delta"),
    )


def assigned_quality(df: DataFrame, palette: DataFrame, assigned: str = "c", good: float = 0.05) -> DataFrame:
    """Quality of the entry each row was given, not of the best one; id 0 rows are left out."""
    pairs = df.where(F.col(assigned) != 0).groupBy(*RGB_KEYS, assigned).agg(F.count(F.lit(1)).alias("n"))
    entries = with_oklab(palette).select(
        F.col("id").alias(assigned), F.struct("L", "a", F.col("lab_b").alias("b")).alias("q")
    )
    q = F.col("q")
    d = oklab_dist_sq(Lab(F.col("L"), F.col("a"), F.col("lab_b")), Lab(q["L"], q["a"], q["b"]))
    return quality(with_oklab(pairs).join(entries, assigned).withColumn("dist", d), None, good)


def fidelity(original: DataFrame, decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Mean OKLab distance and PSNR between two versions of the same pixels."""
    left = with_oklab(original.select(*keys, *RGB_KEYS))
    right = with_oklab(decoded.select(*keys, *RGB_KEYS))
    o = left.select(*keys, F.struct("r", "g", "b", "L", "a", F.col("lab_b").alias("lb")).alias("o"))
    d = right.select(*keys, F.struct("r", "g", "b", "L", "a", F.col("lab_b").alias("lb")).alias("d"))
    both = o.join(d, keys)
    delta = oklab_dist_sq(
        Lab(F.col("o.L"), F.col("o.a"), F.col("o.lb")), Lab(F.col("d.L"), F.col("d.a"), F.col("d.lb"))
    )
    sq = sum(((F.col(f"o.{c}") - F.col(f"d.{c}")) * (F.col(f"o.{c}") - F.col(f"d.{c}")) for c in "gb"),
             (F.col("o.r") - F.col("d.r")) * (F.col("o.r") - F.col("d.r")))
    totals = both.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.sqrt(delta)).alias("delta"),
        F.sum(sq.cast("long")).alias("sq"),
    )
    mse = F.coalesce(F.col("sq"), F.lit(0)) / F.greatest(F.col("n") * 3, F.lit(1))
    psnr = F.when(mse > 0, 10 * F.log10((255 * 255) / F.when(mse > 0, mse).otherwise(F.lit(1.0)))).otherwise(F.lit(99.0))
    mean = F.coalesce(F.col("delta"), F.lit(0.0)) / F.greatest(F.col("n"), F.lit(1))
    return totals.select("n", mean.alias("mean_delta"), mse.alias("mse"), psnr.alias("psnr_db"))
