"""Nested stock maps to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NESTED = "map<string,map<string,map<string,int>>>"


def stock_explode(rows: DataFrame, nested: Column, *keep: str) -> DataFrame:
    """``(world, pos, item, n)`` from a world -> position -> item -> count map.

    Places whose map is empty have no row: an empty reading counts as unknown.
    """
    worlds = rows.select(*keep, F.explode(nested).alias("world", "__w"))
    places = worlds.select(*keep, "world", F.explode("__w").alias("pos", "__p"))
    return places.select(*keep, "world", "pos", F.explode("__p").alias("item", "n"))


def parse_pos(pos: Column) -> Column:
    """``x,y,z`` text as a struct of integers, null if it is not three integers."""
    parts = F.split(pos, ",", -1)
    xyz = [F.try_element_at(parts, F.lit(i + 1)).try_cast("int") for i in range(3)]
    ok = (F.size(parts) == 3) & xyz[0].isNotNull() & xyz[1].isNotNull() & xyz[2].isNotNull()
    return F.when(ok, F.struct(xyz[0].alias("x"), xyz[1].alias("y"), xyz[2].alias("z")))


def stock_collapse(stock: DataFrame) -> DataFrame:
    """One row per place with its item map; an item keeps its greatest count.

    Items are a fixed catalogue, so the map of a place stays small; places and
    worlds remain rows.
    """
    once = stock.groupBy("world", "pos", "item").agg(F.max("n").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("item", "n")))
    return once.groupBy("world", "pos").agg(F.map_from_entries(entries).alias("items"))
