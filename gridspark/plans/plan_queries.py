"""Verification, demand, stock, work order and slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import nearest as N
from gridspark.operators import plan as B
from gridspark.plans.registry import query
from gridspark.sources import views as V


@query("plan_vs_actual", "SELECT k, real_top, wanted_top, finding FROM verdict")
def _(spark, d):
    return B.plan_vs_actual(V.planned(spark, d), V.actual(spark, d), ["k"], 1)


@query(
    "samples_per_class",
    """SELECT finding, k, sample_no, class_count FROM (SELECT finding, k, CAST(row_number() OVER (PARTITION BY finding ORDER BY k) AS INT) AS sample_no,
       count(*) OVER (PARTITION BY finding) AS class_count FROM verdict) WHERE sample_no <= 3""",
)
def _(spark, d):
    findings = B.plan_vs_actual(V.planned(spark, d), V.actual(spark, d), ["k"], 1).select("k", "finding")
    return B.samples_per_class(findings, "finding", ["k"]).select("finding", "k", "sample_no", "class_count")


@query(
    "unbuilt",
    """SELECT p.k, p.top, p.item FROM planned p LEFT JOIN top_real a ON p.k = a.k
       WHERE p.item IS NOT NULL AND p.item IS DISTINCT FROM a.real_item""",
)
def _(spark, d):
    return B.unbuilt(V.planned(spark, d), V.actual(spark, d), ["k"])


_DEMAND = """SELECT l_partkey % 500 AS item, CAST(sum(n) AS BIGINT) AS need FROM
  (SELECT l_partkey, CAST(l_quantity AS INT) - 5 AS n, l_returnflag <> 'R' AS ours FROM lineitem) WHERE ours AND n > 0 GROUP BY 1"""


def _demand(spark, d):
    rows = V.table(spark, d, "lineitem").withColumn("item", F.col("l_partkey") % 500)
    return B.demand(rows, "item", F.col("l_quantity").cast("int") - 5, F.col("l_returnflag") != "R")


@query("demand", _DEMAND)
def _(spark, d):
    return _demand(spark, d)


@query("stack_demand", f"SELECT CAST(sum(ceil(need/64::DOUBLE)) AS BIGINT) AS stacks FROM ({_DEMAND})")
def _(spark, d):
    return B.stack_demand(_demand(spark, d))


@query("bounds", "SELECT item, min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z FROM cell GROUP BY item")
def _(spark, d):
    return B.bounds(V.cell(spark, d), ["item"], "x", "z").withColumnsRenamed({"min_y": "min_z", "max_y": "max_z"})


@query(
    "latest_stock",
    "SELECT loc, m.item AS item, m.n AS n FROM (SELECT loc, arg_max(struct_pack(item := item, n := n), seq) AS m FROM stock GROUP BY loc) WHERE m.n > 0",
)
def _(spark, d):
    return B.latest_stock(V.stock(spark, d))


# demand per site of ten rows
_NEEDS = "SELECT CAST(floor(z/10) AS INT) AS site, item, count(*) AS need FROM cell GROUP BY 1, 2"


def _needs(spark, d):
    site = F.floor(F.col("z") / 10).cast("int").alias("site")
    return V.cell(spark, d).groupBy(site, "item").agg(F.count(F.lit(1)).alias("need"))


# an item in a grade: cells want the grade of their row, a place holds the grade of its amount
@query(
    "stock_has_all",
    """SELECT CAST(floor(z/10) AS INT) AS site, bool_and(item || ':' || z IN (SELECT item || ':' || n FROM stock WHERE n > 0)) AS covered
       FROM cell GROUP BY 1""",
)
def _(spark, d):
    def graded(n: str):
        return F.concat("item", F.lit(":"), F.col(n).cast("string")).alias("item")

    needs = V.cell(spark, d).select(F.floor(F.col("z") / 10).cast("int").alias("site"), graded("z"))
    return B.stock_has_all(needs, V.stock(spark, d).select(graded("n"), "n"), ["site"])


@query(
    "stock_covers_qty",
    f"""SELECT site, bool_and(coalesce(h.n, 0) >= need) AS covered FROM (SELECT site, item, need*(4 + site*100) AS need FROM ({_NEEDS})) q
        LEFT JOIN (SELECT item, sum(n) AS n FROM stock GROUP BY item) h ON h.item = q.item GROUP BY site""",
)
def _(spark, d):
    needs = _needs(spark, d).withColumn("need", F.col("need") * (4 + F.col("site") * 100))
    return B.stock_covers_qty(needs, V.stock(spark, d), ["site"])


VISITED = [1, 15, 40]

_PLACES = """(SELECT DISTINCT loc, CAST(loc % 12 AS DOUBLE) AS x, CAST(loc % 5 AS DOUBLE) AS y, CAST((loc - loc % 12)/12 AS DOUBLE) AS z,
  loc % 5 = 0 AS unknown, item, n FROM stock)"""


@query(
    "nearest_source",
    f"""SELECT q, m.l AS loc, CAST(m.d AS BIGINT) AS dist_sq FROM (SELECT q, min(struct_pack(d := d, u := unknown, l := loc)) AS m FROM (
       SELECT q, loc, unknown, item, n, (x - px)*(x - px) + (y - py)*(y - py) + (z - pz)*(z - pz) AS d FROM {_PLACES},
       (SELECT s_suppkey AS q, CAST(s_suppkey * 3 % 12 AS DOUBLE) AS px, CAST(s_suppkey % 40 - 20 AS DOUBLE) AS py, CAST(s_suppkey % 97 AS DOUBLE) AS pz FROM supplier))
       WHERE ((unknown AND d <= 9) OR (NOT unknown AND item IN ('click', 'error') AND n > 20)) AND loc NOT IN (1, 15, 40) GROUP BY q)""",
)
def _(spark, d):
    # places whose number is a multiple of five have never been opened
    loc, key = F.col("loc"), F.col("s_suppkey")
    places = V.stock(spark, d).select(
        "loc",
        (loc % 12).alias("x"),
        (loc % 5).alias("y"),
        ((loc - loc % 12) / 12).alias("z"),
        F.when(loc % 5 != 0, F.col("item")).alias("item"),
        (F.col("n") - 20).alias("n"),
    )
    points = V.table(spark, d, "supplier").select(key.alias("q"), (key * 3 % 12).alias("x"), (key % 40 - 20).alias("y"), (key % 97).alias("z"))
    out = N.nearest_source(places, points, ["click", "error"], VISITED, reach=3.0)
    return out.select("q", "loc", F.col("dist_sq").cast("long").alias("dist_sq"))


# ── work order ──────────────────────────────────────────────────────────────

_SITES = "(SELECT x, z, item, CAST(x % 2 AS INT) AS site FROM cell)"


def _sites(spark, d):
    return V.cell(spark, d).withColumn("site", (F.col("x") % 2).cast("int"))


def _walk_sql(width: int, east: bool, south_first: bool) -> str:
    step = "mx - x" if east else "x - nx"
    south = f"band % 2 = {0 if south_first else 1}"
    return f"""(SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY band, CASE WHEN {south} THEN z ELSE -z END, k) AS BIGINT) AS seq FROM (
      SELECT *, CAST(floor(({step})/{width}) AS INT) AS band, CAST(({step}) % {width} AS INT) AS k FROM (
      SELECT *, max(x) OVER (PARTITION BY site) AS mx, min(x) OVER (PARTITION BY site) AS nx FROM {_SITES})))"""


@query(
    "serpentine_order",
    f"""SELECT 'east' AS side, site, x, z, item, band, seq FROM {_walk_sql(5, True, True)}
    UNION ALL SELECT 'west', site, x, z, item, band, seq FROM {_walk_sql(7, False, False)}""",
)
def _(spark, d):
    cells = _sites(spark, d)
    east = B.serpentine_order(cells, ["site"], 5, True, True).withColumn("side", F.lit("east"))
    west = B.serpentine_order(cells, ["site"], 7, False, False).withColumn("side", F.lit("west"))
    return east.union(west).select("side", "site", "x", "z", "item", "band", "seq")


_LOAD = f"""(SELECT site, x, z, item, band, seq, CAST(sum(opens) OVER (PARTITION BY site ORDER BY seq) AS BIGINT) AS stacks FROM (
  SELECT *, CASE WHEN (row_number() OVER (PARTITION BY site, item ORDER BY seq) - 1) % 64 = 0 THEN 1 ELSE 0 END AS opens FROM {_walk_sql(5, True, True)}))"""


@query("capped_load", f"SELECT site, x, z, item, band, seq, stacks FROM {_LOAD} WHERE stacks <= 36")
def _(spark, d):
    return B.capped_load(_sites(spark, d), ["site"], 36, 5)


@query(
    "band_coverage",
    f"""WITH taken AS (SELECT * FROM {_LOAD} WHERE stacks <= 36),
    b AS (SELECT t.site, t.band, count(*) AS n, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1,
      (SELECT count(*) FROM {_LOAD} a WHERE a.site = t.site AND a.band = t.band) AS total FROM taken t GROUP BY t.site, t.band)
    SELECT site, n >= total AS "full", count(*) AS bands, CAST(sum(n) AS BIGINT) AS cells, min(x0) AS min_x, max(x1) AS max_x, min(z0) AS min_z, max(z1) AS max_z
    FROM b GROUP BY 1, 2""",
)
def _(spark, d):
    cells = _sites(spark, d)
    taken = B.capped_load(cells, ["site"], 36, 5)
    return B.band_coverage(cells, taken, ["site"], 5)


def _slots_check(n: int) -> str:
    """The best ``target`` of all (item, j) slots; items left empty take the highest levels of the others."""
    return f"""SELECT CAST({n} AS INT) AS n_slots, grp, item, need, slots FROM (
    WITH nd AS (SELECT CAST(user_id % 6 AS INT) AS grp, event_type AS item,
        CAST(sum(CASE WHEN event_type = 'view' AND user_id % 6 = 1 THEN 0 WHEN event_type = 'click' THEN k*k ELSE k END) AS BIGINT) AS need
        FROM (SELECT user_id, event_type, CAST(floor(value/40) AS INT) AS k FROM events) GROUP BY 1, 2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY need DESC, item) AS i, CAST(ceil(need/64::DOUBLE) AS BIGINT) AS cap,
        sum(need) OVER (PARTITION BY grp) AS total, count(*) OVER (PARTITION BY grp) AS items FROM nd WHERE need > 0),
    tg AS (SELECT *, CAST(least({n}, sum(cap) OVER (PARTITION BY grp)) AS BIGINT) AS target FROM rk),
    slot AS (SELECT grp, i, target, target::DOUBLE*need/total - j AS score FROM (SELECT *, unnest(range(least(cap, {n}))) AS j FROM tg WHERE target >= items)),
    won AS (SELECT grp, i FROM slot QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, i) <= target),
    got AS (SELECT tg.grp, tg.i, count(won.i) AS got FROM tg LEFT JOIN won USING (grp, i) WHERE target >= items GROUP BY ALL),
    short AS (SELECT grp, count(*) FILTER (got = 0) AS empty FROM got GROUP BY grp),
    lost AS (SELECT grp, i FROM (SELECT grp, i, empty, unnest(range(2, got + 1)) AS level FROM got JOIN short USING (grp))
      QUALIFY row_number() OVER (PARTITION BY grp ORDER BY level DESC, i) <= empty)
    SELECT tg.grp, item, need, CAST(CASE WHEN target < items THEN CASE WHEN tg.i <= target THEN 1 ELSE 0 END WHEN got = 0 THEN 1
      ELSE got - (SELECT count(*) FROM lost WHERE lost.grp = tg.grp AND lost.i = tg.i) END AS BIGINT) AS slots
    FROM tg LEFT JOIN got ON got.grp = tg.grp AND got.i = tg.i
    UNION ALL SELECT grp, item, need, CAST(0 AS BIGINT) FROM nd WHERE need <= 0)"""


@query("proportional_slots", " UNION ALL ".join(_slots_check(n) for n in (3, 12, 36)))
def _(spark, d):
    k = F.floor(F.col("value") / 40).cast("int")
    kind = F.col("event_type")
    grp = (F.col("user_id") % 6).cast("int")
    weight = F.when((kind == "view") & (grp == 1), 0).when(kind == "click", k * k).otherwise(k)
    needs = V.table(spark, d, "events").groupBy(grp.alias("grp"), kind.alias("item")).agg(F.sum(weight).alias("need"))
    return B.proportional_slots(needs, ["grp"], [3, 12, 36])
