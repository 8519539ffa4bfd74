"""Grid, selection, histogram and neighbourhood queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import color as C
from gridspark.functions import palette as P
from gridspark.operators import histogram as H
from gridspark.operators import masks as K
from gridspark.operators import match as M
from gridspark.operators import neighbours as N
from gridspark.operators import reduce as R
from gridspark.operators import tiles as T
from gridspark.plans import check_views as S
from gridspark.plans.registry import query
from gridspark.session import fresh_path
from gridspark.sources import grids as G
from gridspark.sources import images as I
from gridspark.sources import views as V

CELL = ["image", "y", "x"]
W, HGT = 64, 50


def r6(c):
    return F.round(c, 6)


def px_id(spark, d) -> DataFrame:
    """Pixels whose colours are ids of the example palette (0 stays transparent)."""
    c = F.col("c")
    return V.px(spark, d).select(*CELL, F.when(c == 0, 0).otherwise(1 + c % 50).alias("c"))


def px_rgb(spark, d) -> DataFrame:
    c = F.col("c")
    return V.px(spark, d).select(
        *CELL,
        "c",
        ((c * 5) % 256).alias("r"),
        ((c * 11) % 256).alias("g"),
        ((c * 23) % 256).alias("b"),
        F.when(c == 0, 0).otherwise(255).alias("alpha"),
    )


def mask_a(spark, d) -> DataFrame:
    return V.px(spark, d).where(F.col("c").between(120, 135)).select(*CELL)


def mask_b(spark, d) -> DataFrame:
    return V.px(spark, d).where(F.col("c").between(128, 150)).select(*CELL)


# ── image files ─────────────────────────────────────────────────────────────


@query(
    "read_images",
    """SELECT CAST(image % 16384 AS INT) AS image, y, x, CAST(c % 128 AS INT) AS r, FALSE AS bad FROM px
    UNION ALL SELECT NULL, NULL, NULL, NULL, TRUE FROM region""",
)
def _(spark, d):
    """Every grid written as a bitmap file and read back; one undecodable file per row of ``region``."""
    path = fresh_path(spark, "images")
    image = F.col("image")
    shown = V.px(spark, d).select(*CELL, (F.col("c") % 128).alias("r"), (image % 128).alias("g"), F.floor(image / 128).cast("int").alias("b"))
    I.write_bitmaps(shown.withColumn("b", F.col("b") % 128), ["image"], path)
    V.table(spark, d, "region").select(F.col("r_name").alias("value")).write.mode("append").option("maxRecordsPerFile", 1).text(path)
    found = I.read_images(spark, path)
    return found.select((F.col("b") * 128 + F.col("g")).alias("image"), "y", "x", "r", "bad")


# ── arrays and addresses ────────────────────────────────────────────────────


@query(
    "grid_from_arrays",
    """SELECT vec_id, CAST(floor(p/8) AS INT) AS y, CAST(p % 8 AS INT) AS x, v FROM
       (SELECT vec_id, unnest(range(len(embedding))) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)""",
)
def _(spark, d):
    return G.grid_from_arrays(V.table(spark, d, "embeddings"), ["vec_id"], "embedding", width=8)


@query(
    "arrays_from_grid",
    """SELECT image, y, array_to_string(list(c ORDER BY x), ',') AS line, CAST(count(*) AS INT) AS n
       FROM px GROUP BY image, y""",
)
def _(spark, d):
    lines = G.arrays_from_grid(V.px(spark, d), ["image", "y"], "x", "c")
    return lines.select(
        "image", "y", F.array_join(F.col("vs").cast("array<string>"), ",").alias("line"), F.size("vs").alias("n")
    )


_ADDR = "CAST(floor(y/16) AS INT)*4 + CAST(floor(x/16) AS INT)"


@query(
    "tile_address",
    f"""SELECT image, y, x, {_ADDR} AS tile, CAST(x % 16 AS INT) AS lx, CAST(y % 16 AS INT) AS ly,
        x AS gx, y AS gy FROM px""",
)
def _(spark, d):
    local = T.to_tile(V.px(spark, d), cols=4, side=16)
    return T.to_global(local, cols=4, side=16).select(*CELL, "tile", "lx", "ly", "gx", "gy")


@query("stitch", "SELECT image, x, y, c FROM px")
def _(spark, d):
    tiles = T.to_tile(V.px(spark, d), 4, 16).select("image", "tile", "lx", "ly", "c")
    return T.stitch(tiles, cols=4, side=16).select("image", "x", "y", "c")


@query(
    "crop",
    f"SELECT image, CAST(x % 16 AS INT) AS lx, CAST(y % 16 AS INT) AS ly, c FROM px WHERE {_ADDR} = 6",
)
def _(spark, d):
    return T.crop(V.px(spark, d), col=2, row=1, side=16).select("image", "lx", "ly", "c")


# ── filters and selections ──────────────────────────────────────────────────


@query("opaque_filter", "SELECT image, y, x, c FROM px WHERE c <> 0")
def _(spark, d):
    return K.opaque_filter(V.px(spark, d)).select(*CELL, "c")


@query("rect_select", "SELECT image, y, x FROM px WHERE x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 30")
def _(spark, d):
    return K.rect_select(V.px(spark, d), 40, 5, 10, 30).select(*CELL)


@query("box_range", "SELECT x, z, item FROM cell WHERE x BETWEEN 18 AND 82 AND z BETWEEN 8 AND 72")
def _(spark, d):
    return K.box_range(V.cell(spark, d), {"x": 50, "z": 40}, 32)


POLYGON = [(5, 5), (50, 8), (30, 25), (58, 45), (10, 40), (25, 20)]


def _polygon_sql() -> str:
    wind, edge = [], []
    for (ax, ay), (bx, by) in zip(POLYGON, POLYGON[1:] + POLYGON[:1]):
        side = f"({bx - ax}*(y-({ay})) - (x-({ax}))*({by - ay}))"
        wind.append(
            f"CASE WHEN {ay} <= y AND y < {by} AND {side} < 0 THEN 1 WHEN {by} <= y AND y < {ay} AND {side} > 0 THEN -1 ELSE 0 END"
        )
        edge.append(
            f"({side} = 0 AND x BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND y BETWEEN {min(ay, by)} AND {max(ay, by)})"
        )
    return f"SELECT image, y, x FROM px WHERE {' + '.join(wind)} <> 0 OR {' OR '.join(edge)}"


@query("polygon_select", _polygon_sql())
def _(spark, d):
    return K.polygon_select(V.px(spark, d), POLYGON).select(*CELL)


@query("mask_union", "SELECT * FROM mask_a UNION SELECT * FROM mask_b")
def _(spark, d):
    return K.mask_union(mask_a(spark, d), mask_b(spark, d))


@query("mask_subtract", "SELECT * FROM mask_a EXCEPT SELECT * FROM mask_b")
def _(spark, d):
    return K.mask_subtract(mask_a(spark, d), mask_b(spark, d))


@query("mask_intersect", "SELECT * FROM mask_a INTERSECT SELECT * FROM mask_b")
def _(spark, d):
    return K.mask_intersect(mask_a(spark, d), mask_b(spark, d))


@query("mask_invert", "SELECT image, y, x FROM px EXCEPT SELECT * FROM mask_a")
def _(spark, d):
    return K.mask_invert(V.px(spark, d), mask_a(spark, d))


_GROW = """SELECT DISTINCT image, CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y FROM {m},
  (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx, dy) WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 49"""
_SHRINK = """SELECT image, x, y FROM (SELECT image, CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y, count(*) AS votes
  FROM {m}, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx, dy) GROUP BY ALL) WHERE votes = 5"""


@query("dilate", f"WITH g1 AS MATERIALIZED ({_GROW.format(m='mask_a')}) {_GROW.format(m='g1')}")
def _(spark, d):
    return K.dilate(mask_a(spark, d), ["image"], W, HGT, 2)


@query(
    "erode",
    f"""WITH big AS (SELECT image, y, x FROM px WHERE c BETWEEN 100 AND 150), s1 AS MATERIALIZED ({_SHRINK.format(m='big')})
    {_SHRINK.format(m='s1')}""",
)
def _(spark, d):
    big = V.px(spark, d).where(F.col("c").between(100, 150))
    return K.erode(big, ["image"], 2)


@query(
    "mask_apply",
    "SELECT image, y, x, CASE WHEN c BETWEEN 120 AND 135 THEN CAST(255 - c AS INT) ELSE c END AS c FROM px",
)
def _(spark, d):
    old = V.px(spark, d).select(*CELL, "c")
    new = old.withColumn("c", 255 - F.col("c"))
    return K.mask_apply(old, new, mask_a(spark, d), CELL)


@query("mask_clear_color", "SELECT image, y, x FROM px WHERE c BETWEEN 120 AND 135 AND c <> 130")
def _(spark, d):
    return K.mask_clear_color(mask_a(spark, d), V.px(spark, d), 130)


@query(
    "remap",
    """SELECT 'all' AS scope, image, y, x, CASE WHEN c IN (121, 123, 125, 127, 129) THEN 140 ELSE c END AS c FROM px
       UNION ALL SELECT 'frame', image, y, x, CASE WHEN c IN (121, 123, 125, 127, 129) AND image = 2 THEN 140 ELSE c END FROM px
       UNION ALL SELECT 'mask', image, y, x, CASE WHEN c IN (121, 123, 125, 127, 129) AND x % 2 = 0 THEN 140 ELSE c END FROM px
       UNION ALL SELECT 'bijection', image, y, x, CAST(255 - c AS INT) FROM px""",
)
def _(spark, d):
    px = V.px(spark, d).select(*CELL, "c")
    ids = px.select(F.col("c").alias("id")).distinct()
    merge = ids.where(F.col("id").isin(121, 123, 125, 127, 129)).withColumn("to", F.lit(140))
    even = px.where(F.col("x") % 2 == 0).select(*CELL)
    flip = ids.withColumn("to", 255 - F.col("id"))
    runs = {
        "all": K.remap(px, merge),
        "frame": K.remap(px, merge, scope=F.col("image") == 2),
        "mask": K.remap(px, merge, mask=even, keys=CELL),
        "bijection": K.remap(px, flip),
    }
    out = None
    for scope, rows in runs.items():
        named = rows.select(F.lit(scope).alias("scope"), *CELL, "c")
        out = named if out is None else out.union(named)
    return out


# ── histograms ──────────────────────────────────────────────────────────────

_HIST = """SELECT '{s}' AS scope, c, n, round(n*100::DOUBLE/t, 6) AS pct FROM (SELECT c, count(*) AS n, sum(count(*)) OVER () AS t
  FROM px {w} GROUP BY c) WHERE c <> 0"""


@query(
    "color_histogram",
    " UNION ALL ".join(
        _HIST.format(s=s, w=w)
        for s, w in (("all", ""), ("frame", "WHERE image = 2"), ("selection", "WHERE x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 30"))
    ),
)
def _(spark, d):
    px = V.px(spark, d)
    scopes = {"all": px, "frame": px.where(F.col("image") == 2), "selection": K.rect_select(px, 10, 5, 40, 30)}
    out = None
    for scope, rows in scopes.items():
        hist = H.color_histogram(rows, []).select(F.lit(scope).alias("scope"), "c", "n", r6("pct").alias("pct"))
        out = hist if out is None else out.union(hist)
    return out


@query("distinct_colors", "SELECT image, count(DISTINCT CASE WHEN c <> 0 THEN c END) AS n_colors FROM px GROUP BY image")
def _(spark, d):
    return H.distinct_colors(V.px(spark, d), ["image"])


@query("palette_of", "SELECT DISTINCT image, c FROM px WHERE c <> 0")
def _(spark, d):
    return H.palette_of(V.px(spark, d), ["image"])


@query(
    "heat_scale",
    """SELECT image, c, n, round(CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE (n - lo)/(hi - lo)::DOUBLE END, 6) AS heat FROM (
       SELECT *, min(n) OVER (PARTITION BY image) AS lo, max(n) OVER (PARTITION BY image) AS hi FROM (
       SELECT image, c, count(*) AS n FROM px WHERE c <> 0 GROUP BY image, c))""",
)
def _(spark, d):
    return H.heat_scale(V.px(spark, d), ["image"]).select("image", "c", "n", r6("heat").alias("heat"))


@query(
    "rarest",
    """SELECT image, m.c AS c, m.n AS n FROM (SELECT image, min(struct_pack(n := n, c := c)) AS m FROM
       (SELECT image, c, count(*) AS n FROM px WHERE c > 0 GROUP BY image, c) GROUP BY image)""",
)
def _(spark, d):
    return H.rarest(V.px(spark, d), ["image"])


def _otsu_sql(source: str) -> str:
    return f"""SELECT image, -m.nv AS threshold FROM (SELECT image, max(struct_pack(bv := bv, nv := -v)) AS m FROM (
      SELECT image, v, CASE WHEN k IS NULL THEN -1::DOUBLE ELSE (k/cnt)*(1-(k/cnt))*(low/k - (tot-low)/(cnt-k))*(low/k - (tot-low)/(cnt-k)) END AS bv FROM (
      SELECT image, v, CAST(sum(n) OVER w AS DOUBLE) AS k, sum(n*v) OVER w AS low,
        CAST(sum(n) OVER (PARTITION BY image) AS DOUBLE) AS cnt, sum(n*v) OVER (PARTITION BY image) AS tot
      FROM (SELECT image, v, count(*) AS n FROM {source} GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY image ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) GROUP BY image)"""


#: Every other image on a scale where values differ by less than a millionth.
@query("otsu_threshold", _otsu_sql("(SELECT image, CAST(c AS DOUBLE)/CASE WHEN image % 2 = 0 THEN 255::DOUBLE ELSE 1000000000::DOUBLE END AS v FROM px)"))
def _(spark, d):
    scale = F.when(F.col("image") % 2 == 0, F.lit(255.0)).otherwise(F.lit(1e9))
    values = V.px(spark, d).select("image", (F.col("c").cast("double") / scale).alias("v"))
    return H.otsu_threshold(values, ["image"], "v")


# ── neighbourhoods ──────────────────────────────────────────────────────────

_CON = f"""con_lab AS MATERIALIZED {S.lab('px_rgb', 'image, y, x, alpha')},
con AS MATERIALIZED (SELECT p.image, p.y, p.x, p.alpha, CASE WHEN p.alpha < 128 OR count(q.x) = 0 THEN 0::DOUBLE
    ELSE sqrt(sum({S.dist('p', 'q')})/count(q.x)) END AS contrast
  FROM con_lab p LEFT JOIN con_lab q ON q.image = p.image AND q.alpha >= 128
    AND ((abs(q.x - p.x) = 1 AND q.y = p.y) OR (q.x = p.x AND abs(q.y - p.y) = 1))
  GROUP BY p.image, p.y, p.x, p.alpha)"""


def _contrast(spark, d) -> DataFrame:
    opaque = F.col("alpha") >= 128
    return N.local_contrast(P.with_oklab(px_rgb(spark, d)), ["image"], opaque)


@query("local_contrast", f"WITH {_CON} SELECT image, y, x, round(contrast, 6) AS contrast FROM con")
def _(spark, d):
    return _contrast(spark, d).select(*CELL, r6("contrast").alias("contrast"))


@query(
    "dither_strength",
    f"""WITH {_CON}, thr AS ({_otsu_sql('(SELECT image, contrast AS v FROM con)')})
    SELECT image, y, x, round(CASE WHEN alpha < 128 THEN 0::DOUBLE
      WHEN t*1.5::DOUBLE - t*0.5::DOUBLE > 0.000001::DOUBLE THEN 1 - least(1, greatest(0, (contrast - t*0.5::DOUBLE)/(t*1.5::DOUBLE - t*0.5::DOUBLE)))
      WHEN contrast <= t THEN 1::DOUBLE ELSE 0::DOUBLE END, 5) AS strength
    FROM (SELECT con.*, thr.threshold AS t FROM con JOIN thr ON con.image = thr.image)""",
)
def _(spark, d):
    out = N.adaptive_strength(P.with_oklab(px_rgb(spark, d)), ["image"], F.col("alpha") >= 128)
    return out.select(*CELL, F.round("strength", 5).alias("strength"))


_EDGES = """edge_rows AS MATERIALIZED (SELECT p.image, p.y, p.x, CAST(count_if(q.c <> p.c) AS INT) AS edges FROM px p LEFT JOIN px q
  ON q.image = p.image AND ((abs(q.x - p.x) = 1 AND q.y = p.y) OR (q.x = p.x AND abs(q.y - p.y) = 1))
  AND floor(q.x/16) = floor(p.x/16) AND floor(q.y/16) = floor(p.y/16) GROUP BY p.image, p.y, p.x)"""


@query("edge_count", f"WITH {_EDGES} SELECT * FROM edge_rows")
def _(spark, d):
    return N.edge_count(V.px(spark, d), ["image"], tile=16).select(*CELL, "edges")


def _detail_sql(extra_h: str, extra_v: str) -> str:
    return f"""WITH {_EDGES},
    h AS (SELECT image, y, x, (sum(edges) OVER w + {extra_h})/CAST(count(*) OVER w AS DOUBLE) AS hm FROM edge_rows
      WINDOW w AS (PARTITION BY image, y ORDER BY x ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)),
    v AS (SELECT image, y, x, (sum(hm) OVER w + {extra_v})/CAST(count(*) OVER w AS DOUBLE) AS m FROM h
      WINDOW w AS (PARTITION BY image, x ORDER BY y ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING))
    SELECT image, y, x, least(255, CAST(floor(sqrt(m/2.5::DOUBLE)*255 + 0.5::DOUBLE) AS INT)) AS detail FROM v"""


@query("detail_map", _detail_sql("0", "0"))
def _(spark, d):
    return N.detail_map(V.px(spark, d), ["image"], tile=16).select(*CELL, "detail")


@query(
    "detail_map_seeded",
    _detail_sql(
        "coalesce(max(CASE WHEN x = 8 THEN edges END) OVER (PARTITION BY image, y), 0)",
        "coalesce(max(CASE WHEN y = 8 THEN hm END) OVER (PARTITION BY image, x), 0)",
    ),
)
def _(spark, d):
    return N.detail_map(V.px(spark, d), ["image"], tile=16, seed_overlap=True).select(*CELL, "detail")


def _blur_sql(source: str, radius: float, channels: tuple[str, ...]) -> str:
    """CTEs ``b0`` (source), ``b1`` (rows) and ``b2`` (blurred), borders clamped."""
    kernel = N.gaussian_kernel(radius)
    half = len(kernel) >> 1

    def at(c: str, k: int, w: str) -> str:
        if k == 0:
            return c
        if k < 0:
            return f"coalesce(lag({c}, {-k}) OVER {w}, first_value({c}) OVER {w})"
        return f"coalesce(lead({c}, {k}) OVER {w}, last_value({c}) OVER {w})"

    def blend(c: str, w: str) -> str:
        return " + ".join(f"{at(c, i - half, w)}*{S.num(weight)}" for i, weight in enumerate(kernel))

    one = ", ".join(f"{blend(c, 'w')} AS {c}" for c in channels)
    two = ", ".join(f"{S.clamp_byte(blend(c, 'w'))} AS {c}" for c in channels)
    whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    return f"""b0 AS MATERIALIZED (SELECT * FROM {source}),
    b1 AS MATERIALIZED (SELECT image, y, x, {one} FROM b0 WINDOW w AS (PARTITION BY image, y ORDER BY x {whole})),
    b2 AS MATERIALIZED (SELECT image, y, x, {two} FROM b1 WINDOW w AS (PARTITION BY image, x ORDER BY y {whole}))"""


@query(
    "gaussian_blur",
    f"WITH {_blur_sql('px_rgb', 2, ('r', 'g', 'b', 'alpha'))} SELECT * FROM b2",
)
def _(spark, d):
    out = N.gaussian_blur(px_rgb(spark, d), ["image"], 2, ["r", "g", "b", "alpha"])
    return out.select(*CELL, "r", "g", "b", "alpha")


@query(
    "median_filter",
    """WITH bh AS (SELECT image, max(y) AS ym FROM px GROUP BY image),
    n AS (SELECT p.image, p.y, p.x, q.r, q.g, q.b FROM px_rgb p JOIN bh ON bh.image = p.image,
      range(-1, 2) dx(i), range(-1, 2) dy(j) JOIN px_rgb q ON q.image = p.image
      AND q.x = least(63, greatest(0, p.x + i)) AND q.y = least(bh.ym, greatest(0, p.y + j)))
    SELECT image, y, x, list_sort(list(r))[5] AS r, list_sort(list(g))[5] AS g, list_sort(list(b))[5] AS b
    FROM n GROUP BY image, y, x""",
)
def _(spark, d):
    return N.median_filter(px_rgb(spark, d), ["image"], 1, ["r", "g", "b"]).select(*CELL, "r", "g", "b")


@query(
    "unsharp",
    f"""WITH {_blur_sql('px_rgb', 1.0, ('r', 'g', 'b'))}
    SELECT s.image, s.y, s.x, """
    + ", ".join(f"{S.clamp_byte(f's.{c} + (s.{c} - b2.{c})*1.5::DOUBLE')} AS {c}" for c in "rgb")
    + " FROM px_rgb s JOIN b2 ON s.image = b2.image AND s.y = b2.y AND s.x = b2.x",
)
def _(spark, d):
    return N.unsharp(px_rgb(spark, d), ["image"], 1.5, ["r", "g", "b"]).select(*CELL, "r", "g", "b")


_SEEN = "(SELECT image, y, x, i.c, coalesce(p.r, 0) AS r, coalesce(p.g, 0) AS g, coalesce(p.b, 0) AS b, CASE WHEN i.c = 0 THEN 0 ELSE 255 END AS alpha FROM px_id i LEFT JOIN pal p ON p.id = i.c)"
_IN_MASK = "(x BETWEEN 8 AND 55)"


@query(
    "filter_requantize",
    f"""WITH {_blur_sql(_SEEN, 1, ('r', 'g', 'b', 'alpha'))},
    used AS (SELECT * FROM pal_lab WHERE id IN (SELECT c FROM px_id WHERE {_IN_MASK})),
    bl AS MATERIALIZED {S.lab('(SELECT b2.*, i.c FROM b2 JOIN px_id i ON i.image = b2.image AND i.y = b2.y AND i.x = b2.x)', 'image, y, x, alpha, c')},
    hit AS (SELECT s.image, s.y, s.x, min(struct_pack(d := {S.dist('s', 'p')}, i := p.id)) AS m FROM bl s, used p GROUP BY s.image, s.y, s.x)
    SELECT bl.image, bl.y, bl.x, CASE WHEN c = 0 OR NOT (bl.x BETWEEN 8 AND 55) THEN c WHEN alpha < 128 THEN 0 ELSE m.i END AS c
    FROM bl JOIN hit ON hit.image = bl.image AND hit.y = bl.y AND hit.x = bl.x""",
)
def _(spark, d):
    pixels = px_id(spark, d)
    mask = pixels.where(F.col("x").between(8, 55)).select(*CELL)
    return T.filter_requantize(pixels, P.palette_dim(V.pal(spark, d)), ["image"], 1, mask).select(*CELL, "c")


# ── reduction ───────────────────────────────────────────────────────────────

_CNT = "cnt AS (SELECT image, c AS id, count(*) AS n FROM px_id WHERE c > 0 GROUP BY image, c), seen AS (SELECT image, count(*) AS k FROM cnt GROUP BY image)"


def _reduce_sql(strategy: str) -> str:
    if strategy == "RAREST":
        pick = f"""SELECT v.image, v.m.id AS victim, min(struct_pack(d := {S.dist('a', 'b')}, i := b.id)).i AS survivor, v.m.n AS touched
          FROM (SELECT image, min(struct_pack(n := n, id := id)) AS m FROM cnt GROUP BY image) v
          JOIN pal_lab a ON a.id = v.m.id JOIN cnt o ON o.image = v.image AND o.id <> v.m.id JOIN pal_lab b ON b.id = o.id
          GROUP BY v.image, v.m"""
    else:
        score = f"({S.dist('p', 'q')})" + ("/(a.n + b.n)" if strategy == "WEIGHTED" else "")
        pick = f"""SELECT image, CASE WHEN m.na <= m.nb THEN m.a ELSE m.b END AS victim, CASE WHEN m.na <= m.nb THEN m.b ELSE m.a END AS survivor,
          least(m.na, m.nb) AS touched FROM (SELECT a.image, min(struct_pack(s := {score}, a := a.id, b := b.id, na := a.n, nb := b.n)) AS m
          FROM cnt a JOIN cnt b ON a.image = b.image AND a.id < b.id JOIN pal_lab p ON p.id = a.id JOIN pal_lab q ON q.id = b.id GROUP BY a.image)"""
    return f"""SELECT '{strategy}' AS strategy, seen.image, victim, survivor, seen.k AS before,
        seen.k - CASE WHEN victim IS NULL THEN 0 ELSE 1 END AS after, coalesce(touched, 0) AS touched
        FROM seen LEFT JOIN ({pick}) s ON s.image = seen.image"""


@query("reduce_once", f"WITH {_CNT} " + " UNION ALL ".join(_reduce_sql(s) for s in R.STRATEGIES))
def _(spark, d):
    pixels, pal = px_id(spark, d), P.palette_dim(V.pal(spark, d))
    out = None
    for strategy in R.STRATEGIES:
        rows = R.reduce_once(pixels, pal, ["image"], strategy).select(
            F.lit(strategy).alias("strategy"), "image", "victim", "survivor", "before", "after", "touched"
        )
        out = rows if out is None else out.union(rows)
    return out


_TARGET = 12
_STATE_COUNTS = """(SELECT image, cur AS id, CAST(sum(n) AS BIGINT) AS n, count(*) OVER (PARTITION BY image) AS k FROM st_{s} GROUP BY image, cur)"""


def _merge_sql(strategy: str) -> str:
    """CTEs that replay the merges one by one: ``st_<strategy>`` holds every step."""
    s = strategy.lower()
    now = _STATE_COUNTS.format(s=s)
    if strategy == R.RAREST:
        pick = f"""SELECT v.image, v.m.id AS victim, min(struct_pack(d := {S.dist('a', 'b')}, i := b.id)).i AS survivor, v.m.n AS touched
          FROM (SELECT image, min(struct_pack(n := n, id := id)) AS m FROM {now} WHERE k > {_TARGET} GROUP BY image) v
          JOIN pal_lab a ON a.id = v.m.id JOIN {now} o ON o.image = v.image AND o.id <> v.m.id JOIN pal_lab b ON b.id = o.id GROUP BY v.image, v.m"""
    else:
        score = f"({S.dist('p', 'q')})" + ("/(a.n + b.n)" if strategy == R.WEIGHTED else "")
        pick = f"""SELECT image, CASE WHEN m.na <= m.nb THEN m.a ELSE m.b END AS victim, CASE WHEN m.na <= m.nb THEN m.b ELSE m.a END AS survivor,
          least(m.na, m.nb) AS touched FROM (SELECT a.image, min(struct_pack(s := {score}, a := a.id, b := b.id, na := a.n, nb := b.n)) AS m
          FROM {now} a JOIN {now} b ON a.image = b.image AND a.id < b.id JOIN pal_lab p ON p.id = a.id JOIN pal_lab q ON q.id = b.id
          WHERE a.k > {_TARGET} GROUP BY a.image)"""
    return f"""st_{s} AS (SELECT image, 0 AS removed, CAST(0 AS BIGINT) AS touched, orig, orig AS cur, n FROM n0 UNION ALL
      SELECT t.image, t.removed + 1, t.touched + m.touched, t.orig, CASE WHEN t.cur = m.victim THEN m.survivor ELSE t.cur END, t.n
      FROM st_{s} t JOIN ({pick}) m ON m.image = t.image),
    end_{s} AS (SELECT image, orig AS c, arg_max(cur, removed) AS "to", max(removed) AS removed, arg_max(touched, removed) AS touched FROM st_{s} GROUP BY image, orig)"""


_N0 = "n0 AS MATERIALIZED (SELECT image, c AS orig, count(*) AS n FROM px_id WHERE c > 0 GROUP BY image, c)"


@query(
    "reduce_palette",
    f"""WITH RECURSIVE {_N0}, {_merge_sql(R.WEIGHTED)} SELECT p.image, p.y, p.x, coalesce(e."to", p.c) AS c
        FROM px_id p LEFT JOIN end_weighted e ON e.image = p.image AND e.c = p.c""",
)
def _(spark, d):
    pixels, pal = px_id(spark, d), P.palette_dim(V.pal(spark, d))
    return R.reduce_palette(pixels, pal, ["image"], _TARGET, R.WEIGHTED)


@query(
    "reduction_map",
    f"WITH RECURSIVE {_N0}, {', '.join(_merge_sql(s) for s in R.STRATEGIES)} "
    + " UNION ALL ".join(f"SELECT '{s}' AS strategy, * FROM end_{s.lower()}" for s in R.STRATEGIES),
)
def _(spark, d):
    pixels, pal = px_id(spark, d), P.palette_dim(V.pal(spark, d))
    out = None
    for strategy in R.STRATEGIES:
        rows = R.reduction_map(pixels, pal, ["image"], _TARGET, strategy).withColumn("strategy", F.lit(strategy))
        out = rows if out is None else out.union(rows)
    return out
