"""Connected regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import regions as G
from gridspark.plans.registry import query
from gridspark.sources import views as V

# two kinds of item make one value, so regions are large enough to matter
_VALUE = "CASE WHEN item IN ('click', 'view') THEN 0 WHEN item = 'error' THEN 1 ELSE 2 END"
_GRID = f"(SELECT x, z AS y, {_VALUE} AS value, CAST(z AS BIGINT)*4294967296 + x + 2147483648 AS id FROM cell)"


def _values(spark, d):
    item = F.col("item")
    value = F.when(item.isin("click", "view"), 0).when(item == "error", 1).otherwise(2)
    return V.cell(spark, d).select("x", F.col("z").alias("y"), value.alias("value"))


_REACH = """reach(id, label) AS (SELECT id, id FROM nodes UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.id WHERE e.b > r.label)"""
_COMPONENTS = f"""WITH RECURSIVE g AS MATERIALIZED {_GRID}, nodes AS MATERIALIZED (SELECT id FROM g),
  edges AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM g p JOIN g q ON q.x = p.x + 1 AND q.y = p.y AND q.value = p.value
    UNION ALL SELECT q.id, p.id FROM g p JOIN g q ON q.x = p.x + 1 AND q.y = p.y AND q.value = p.value
    UNION ALL SELECT p.id, q.id FROM g p JOIN g q ON q.y = p.y + 1 AND q.x = p.x AND q.value = p.value
    UNION ALL SELECT q.id, p.id FROM g p JOIN g q ON q.y = p.y + 1 AND q.x = p.x AND q.value = p.value),
  {_REACH}, comp AS MATERIALIZED (SELECT id, min(label) AS label FROM reach GROUP BY id)"""


@query("components_equal", f"{_COMPONENTS} SELECT g.x, g.y, g.value, comp.label FROM g JOIN comp ON comp.id = g.id")
def _(spark, d):
    return G.components(_values(spark, d), [], block=64)


@query(
    "grid_coords",
    f"""{_COMPONENTS} SELECT g.x, g.y, comp.label, g.x - min(g.x) OVER (PARTITION BY comp.label) AS col,
        g.y - min(g.y) OVER (PARTITION BY comp.label) AS row FROM g JOIN comp ON comp.id = g.id""",
)
def _(spark, d):
    return G.grid_coords(_values(spark, d), [], block=64).select("x", "y", "label", "col", "row")


SEED = (46, 4)
_FLOOD = """WITH RECURSIVE lv AS MATERIALIZED (SELECT x, z AS y, length(item) AS n FROM cell),
  open_cells AS MATERIALIZED (SELECT x, y FROM lv WHERE abs(n - (SELECT n FROM lv WHERE x = 46 AND y = 4)) <= 1),
  fill(x, y) AS (SELECT x, y FROM open_cells WHERE x = 46 AND y = 4
    UNION SELECT o.x, o.y FROM fill f, (VALUES (1,0),(-1,0),(0,1),(0,-1)) s(dx, dy), open_cells o WHERE o.x = f.x + dx AND o.y = f.y + dy)
  SELECT x, y FROM fill"""


@query("flood_region", _FLOOD)
def _(spark, d):
    cells = V.cell(spark, d).select("x", F.col("z").alias("y"), F.length("item").alias("n"))
    seed = cells.where((F.col("x") == SEED[0]) & (F.col("y") == SEED[1])).agg(F.max("n")).scalar()
    near = cells.withColumn("near", F.abs(F.col("n") - seed) <= 1)
    return G.flood_region(near, [], SEED, F.col("near"), block=64)
