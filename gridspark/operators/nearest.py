"""Nearest place by branch and bound over a grid, for any number of query points.

Places fall into small cells, cells into cells of four times the side, up to a
few that hold everything; each keeps the box its places really span.  Points
start at the top and go down: the box that reaches least far bounds the answer
from above, and children whose box begins beyond that bound are left out.  So
a point meets a handful of cells per level and the places of a few cells at the
bottom, wherever it stands and however the places are spread.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import cut_lineage

FAN = 4  # sides of a cell's children in its own side


def _sum(columns) -> Column:
    return reduce(Column.__add__, columns)


def _key(n: int) -> list[str]:
    return [f"__k{i}" for i in range(n)]


def _celled(rows: DataFrame, axes: list[str], side: float) -> DataFrame:
    return rows.withColumns({k: F.floor(F.col(a) / side).cast("long") for k, a in zip(_key(len(axes)), axes)})


def _parent(key: str) -> Column:
    return F.floor(F.col(key) / FAN).cast("long")


def _boxes(cells: DataFrame, n: int) -> DataFrame:
    """The next level: cells by their parents, with the boxes of what they hold."""
    keys = [_parent(k).alias(k) for k in _key(n)]
    spans = [f(f"{edge}{i}").alias(f"{edge}{i}") for i in range(n) for f, edge in ((F.min, "lo"), (F.max, "hi"))]
    return cells.groupBy(*keys).agg(*spans)


def _gap(point: Column, lo: Column, hi: Column) -> Column:
    """Squared distance along one axis to the nearest and to the farthest point of a range."""
    near = F.greatest(lo - point, point - hi, F.lit(0.0))
    far = F.greatest(point - lo, hi - point)
    return near * near, far * far


def _bounded(pairs: DataFrame, axes: list[str]) -> DataFrame:
    """Cells that can hold a point's nearest place: those that begin no farther than the nearest one ends."""
    gaps = [_gap(F.col(f"__p{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(len(axes))]
    bounded = pairs.withColumns({"__near": _sum(g[0] for g in gaps), "__far": _sum(g[1] for g in gaps)})
    best = F.min("__far").over(Window.partitionBy("__q"))
    kept = bounded.withColumn("__best", best).where(F.col("__near") <= F.col("__best"))
    return kept.drop("__near", "__far", "__best", *(f"{e}{i}" for i in range(len(axes)) for e in ("lo", "hi")))


def _offset(row: str, axes: list[str]) -> Column:
    """Squared distance between a point and the place in ``row``."""
    gaps = [F.col(f"__p{i}") - F.col(f"{row}.{a}") for i, a in enumerate(axes)]
    return _sum(g * g for g in gaps)


def nearest_known(points: DataFrame, places: DataFrame, axes: list[str], side: float) -> DataFrame:
    """``__q, d, loc``: the nearest of ``places`` (``loc`` and axes) to each point (``__q``, ``__p0`` ...), ties to the least loc.

    The number of levels is read off the spread of the places, which starts a job.
    """
    n, keys = len(axes), _key(len(axes))
    spots = places.groupBy(*axes).agg(F.min("loc").alias("loc"))  # one place per position is enough
    leaves = cut_lineage(_celled(spots, axes, side), "places")
    level0 = leaves.groupBy(*keys).agg(
        *(f(a).alias(f"{edge}{i}") for i, a in enumerate(axes) for f, edge in ((F.min, "lo"), (F.max, "hi")))
    )
    spans = leaves.agg(*(F.max(k) - F.min(k) for k in keys)).first()
    levels = [level0]
    wide = max((s for s in spans if s is not None), default=0)
    while wide >= 1:
        levels.append(_boxes(levels[-1], n))
        wide /= FAN
    # at most two cells an axis are left at the top
    top = F.collect_list(F.struct(*keys, *(f"{e}{i}" for i in range(n) for e in ("lo", "hi"))))
    pairs = points.select("__q", *(f"__p{i}" for i in range(n)), F.inline(levels[-1].agg(top).scalar()))
    held = _bounded(pairs, axes)
    for cells in reversed(levels[:-1]):
        children = cells.withColumns({f"__up{k}": _parent(k) for k in keys})
        ups = [f"__up{k}" for k in keys]
        held = _bounded(held.withColumnsRenamed(dict(zip(keys, ups))).join(children, ups).drop(*ups), axes)
    met = held.join(leaves.select(*keys, "loc", F.struct(*axes).alias("at")), keys)
    return met.groupBy("__q").agg(F.min(F.struct(_offset("at", axes).alias("d"), "loc")).alias("m")).select("__q", "m.d", "m.loc")


def nearest_within(points: DataFrame, places: DataFrame, axes: list[str], reach: float) -> DataFrame:
    """As ``nearest_known``, among the places at most ``reach`` away: those of the cells around a point, of side ``reach``."""
    n, keys = len(axes), _key(len(axes))
    spots = places.groupBy(*axes).agg(F.min("loc").alias("loc"))
    celled = _celled(spots, axes, reach).select(*keys, "loc", F.struct(*axes).alias("at"))
    here = _celled(points.withColumnsRenamed({f"__p{i}": f"__a{i}" for i in range(n)}), [f"__a{i}" for i in range(n)], reach)
    around = F.array(*(F.struct(*((F.col(k) + step).alias(k) for k, step in zip(keys, steps))) for steps in product((-1, 0, 1), repeat=n)))
    looked = here.select("__q", *(F.col(f"__a{i}").alias(f"__p{i}") for i in range(n)), F.inline(around))
    met = looked.join(celled, keys).withColumn("__d", _offset("at", axes)).where(F.col("__d") <= reach * reach)
    return met.groupBy("__q").agg(F.min(F.struct(F.col("__d").alias("d"), "loc")).alias("m")).select("__q", "m.d", "m.loc")


def nearest_source(
    places: DataFrame,
    points: DataFrame,
    needed: list[str] | DataFrame,
    visited: list[int] | DataFrame = (),
    reach: float = 4.5,
    axes: tuple[str, ...] = ("x", "y", "z"),
    side: float = 4.0,
) -> DataFrame:
    """``q, loc, dist_sq``: for each query point, the nearest place that may hold a needed item.

    ``places`` has ``loc``, the axes, ``item`` and ``n``; ``points`` has ``q``
    and the axes.  A place counts at any distance if it holds some of a needed
    item; a null item marks a place whose contents are unknown, which counts
    only within ``reach`` and loses a tie against a known one.  ``needed`` and
    ``visited`` are lists or tables (``item``, ``loc``).  A point without any
    such place gets no row; a place or point without a coordinate is none.
    """
    axes = list(axes)
    there = places.dropna(subset=axes).withColumns({a: F.col(a).cast("double") for a in axes})
    if isinstance(visited, DataFrame):
        there = there.join(visited.select("loc").distinct(), "loc", "left_anti")
    elif visited:
        there = there.where(~F.col("loc").isin(*visited))
    asked = points.dropna(subset=axes).select(F.struct("q").alias("__q"), *(F.col(a).cast("double").alias(f"__p{i}") for i, a in enumerate(axes)))
    stocked = there.where(F.col("n") > 0)
    if isinstance(needed, DataFrame):
        known = stocked.join(needed.select("item").distinct(), "item", "left_semi")
    else:
        known = stocked.where(F.col("item").isin(*needed))
    # each place is known or unknown, whatever rows it has
    closed = there.groupBy("loc", *axes).agg(F.bool_and(F.col("item").isNull()).alias("none")).where("none")
    near = nearest_known(asked, known.select("loc", *axes), axes, side).withColumn("u", F.lit(False))
    beside = nearest_within(asked, closed, axes, reach).withColumn("u", F.lit(True))
    best = near.unionByName(beside).groupBy("__q").agg(F.min(F.struct("d", "u", "loc")).alias("m"))
    return best.select("__q.q", "m.loc", F.col("m.d").alias("dist_sq"))
