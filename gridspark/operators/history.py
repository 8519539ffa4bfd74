"""Newest sessions, pages and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.payload import save_stem, save_suffix
from gridspark.operators.scan import rows_between

KEEP, PAGE_SIZE = 30, 10
FIRST_VERSION, LAST_VERSION = 2, 4


def history_top(sessions: DataFrame, owner: str, saved: str, keep: int = KEEP, version: str | None = None) -> DataFrame:
    """The newest ``keep`` sessions per owner, newest first in ``rank``.

    The rank filter leaves at most ``keep`` rows per owner and task to shuffle.
    """
    listed = sessions
    newest = Window.partitionBy(owner).orderBy(F.desc(saved))
    top = listed.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= keep)
    if version is not None:
        top = top.where(F.col(version).between(FIRST_VERSION, LAST_VERSION))
    return top


def session_totals(sessions: DataFrame) -> DataFrame:
    """Tiles and frames of each session from its grid and its per-tile frame counts."""
    frames = F.aggregate("frame_counts", F.lit(0), lambda acc, n: acc + n)
    return sessions.withColumns({"total_tiles": F.col("grid_cols") * F.col("grid_rows"), "total_frames": frames})


def page(rows: DataFrame, keys: list[str], order: str, page_no: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``page_no`` (clamped to the pages there are) with the row's overall number."""
    pages = F.floor((F.col("total") + size - 1) / size)
    at = F.greatest(F.lit(1), F.least(F.lit(page_no), pages))
    numbered = rows_between(rows, keys, order, (at - 1) * size + 1, at * size)
    return numbered.withColumn("pages", pages.cast("long")).drop("total")


def next_counter(names: DataFrame, name: str) -> DataFrame:
    """Next free number per stem of ``stem_NNN.json`` names."""
    rows = names.select(save_stem(F.col(name)).alias("stem"), save_suffix(F.col(name)).alias("digits"))
    rows = rows.where(F.col("digits") != "")
    return rows.groupBy("stem").agg((F.max(F.expr("try_cast(digits as int)")) + 1).alias("next"))
