"""Colour, palette and matching queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import color as C
from gridspark.functions import palette as P
from gridspark.operators import match as M
from gridspark.operators import reduce as R
from gridspark.plans import check_views as S
from gridspark.plans.registry import query
from gridspark.session import cut_lineage
from gridspark.sources import views as V

def _rgb() -> C.Rgb:
    return C.Rgb(F.col("r"), F.col("g"), F.col("b"))


def r6(c) -> F.Column:
    return F.round(c, 6)


@query("palette_dim", "SELECT id, r, g, b, legal FROM pal WHERE id BETWEEN 1 AND 255")
def _(spark, d):
    return P.palette_dim(V.pal(spark, d))


@query(
    "palette_override",
    """SELECT id, coalesce(n.r, o.r) AS r, coalesce(n.g, o.g) AS g, coalesce(n.b, o.b) AS b, id % 4 <> 3 AS legal
       FROM pal o FULL OUTER JOIN
       (SELECT CAST(id + 20 AS INT) AS id, CAST(255 - r AS INT) AS r, g, b FROM pal WHERE id % 2 = 0) n USING (id)""",
)
def _(spark, d):
    pal = V.pal(spark, d)
    dump = pal.where(F.col("id") % 2 == 0).select(
        (F.col("id") + 20).alias("id"), (255 - F.col("r")).alias("r"), "g", "b"
    )
    return P.palette_override(P.palette_dim(pal), dump)


@query(
    "rgb_unpack",
    """SELECT id, r*65536 + g*256 + b AS packed, r, g, b,
       '#' || upper(printf('%06x', r*65536 + g*256 + b)) AS hex FROM rgb""",
)
def _(spark, d):
    packed = V.rgb(spark, d).select("id", C.rgb_pack(_rgb()).alias("packed"))
    back = C.rgb_unpack(F.col("packed"))
    return packed.select(
        "id", "packed", back.r.alias("r"), back.g.alias("g"), back.b.alias("b"), C.rgb_hex(F.col("packed")).alias("hex")
    )


@query("id_split", "SELECT image, y, x, c >> 2 AS base, c & 3 AS shade FROM px")
def _(spark, d):
    c = F.col("c")
    return V.px(spark, d).select("image", "y", "x", P.base_of(c).alias("base"), P.shade_of(c).alias("shade"))


@query(
    "srgb_to_linear",
    f"SELECT id, round({S.lin('r')}, 6) AS lr, round({S.lin('g')}, 6) AS lg, round({S.lin('b')}, 6) AS lb FROM rgb",
)
def _(spark, d):
    lin = C.rgb_to_linear(_rgb())
    return V.rgb(spark, d).select("id", r6(lin.r).alias("lr"), r6(lin.g).alias("lg"), r6(lin.b).alias("lb"))


@query(
    "linear_to_srgb",
    f"""SELECT id, round({S.srgb('((r*1.5::DOUBLE)/255::DOUBLE)')}, 6) AS r,
        round({S.srgb('(g/255::DOUBLE - 0.1::DOUBLE)')}, 6) AS g, round({S.srgb('(b/25500::DOUBLE)')}, 6) AS b FROM rgb""",
)
def _(spark, d):
    return V.rgb(spark, d).select(
        "id",
        r6(C.linear_to_srgb(F.col("r") * 1.5 / 255)).alias("r"),
        r6(C.linear_to_srgb(F.col("g") / 255 - 0.1)).alias("g"),
        r6(C.linear_to_srgb(F.col("b") / 25500)).alias("b"),
    )


@query(
    "rgb_to_oklab",
    f"SELECT id, round(L, 6) AS ok_l, round(a, 6) AS ok_a, round(lb, 6) AS ok_b FROM {S.lab('rgb', 'id')}",
)
def _(spark, d):
    lab = C.rgb_to_oklab(_rgb())
    return V.rgb(spark, d).select("id", r6(lab.L).alias("ok_l"), r6(lab.a).alias("ok_a"), r6(lab.b).alias("ok_b"))


_SHIFTED = "(SELECT id, L + 0.01::DOUBLE AS L, a * 1.2::DOUBLE AS a, lb * 0.9::DOUBLE AS lb FROM " + S.lab("rgb", "id") + ")"


@query(
    "oklab_to_rgb",
    f"""SELECT id, {S.byte(S.srgb('lr'))} AS r, {S.byte(S.srgb('lg'))} AS g, {S.byte(S.srgb('lbl'))} AS b
        FROM {S.linear_from_lab(_SHIFTED, 'id')}""",
)
def _(spark, d):
    lab = P.with_oklab(V.rgb(spark, d)).select(
        "id", (F.col("L") + 0.01).alias("L"), (F.col("a") * 1.2).alias("a"), (F.col("lab_b") * 0.9).alias("lab_b")
    )
    return P.with_rgb(lab).select("id", "r", "g", "b")


@query(
    "oklab_dist_sq",
    f"""SELECT s.id, p.id AS pal_id, round({S.dist('s', 'p')}, 6) AS d
        FROM rgb_lab s JOIN pal_lab p ON p.id = 1 + s.id % 50""",
)
def _(spark, d):
    src = P.with_oklab(V.opaque_rgb(spark, d)).withColumn("pal_id", (1 + F.col("id") % 50).cast("int"))
    entry = F.struct("L", "a", F.col("lab_b").alias("b"))
    pal = P.with_oklab(P.palette_dim(V.pal(spark, d))).select(F.col("id").alias("pal_id"), entry.alias("p"))
    p = F.col("p")
    dist = C.oklab_dist_sq(C.Lab(F.col("L"), F.col("a"), F.col("lab_b")), C.Lab(p["L"], p["a"], p["b"]))
    return src.join(pal, "pal_id").select("id", "pal_id", r6(dist).alias("d"))


_HSV = """SELECT id, CASE WHEN h < 0 THEN h + 360 ELSE h END AS h, s, v FROM (
  SELECT id, CASE WHEN mx - mn <= 0 THEN 0::DOUBLE WHEN mx = rn THEN 60*fmod((gn-bn)/(mx-mn), 6)
    WHEN mx = gn THEN 60*((bn-rn)/(mx-mn) + 2) ELSE 60*((rn-gn)/(mx-mn) + 4) END AS h,
    CASE WHEN mx = 0 THEN 0::DOUBLE ELSE (mx-mn)/mx END AS s, mx AS v
  FROM (SELECT *, greatest(rn, gn, bn) AS mx, least(rn, gn, bn) AS mn
    FROM (SELECT id, r/255::DOUBLE AS rn, g/255::DOUBLE AS gn, b/255::DOUBLE AS bn FROM rgb)))"""


@query("rgb_to_hsv", f"SELECT id, round(h, 6) AS h, round(s, 6) AS s, round(v, 6) AS v FROM ({_HSV})")
def _(spark, d):
    h, s, v = C.rgb_to_hsv(_rgb())
    return V.rgb(spark, d).select("id", r6(h).alias("h"), r6(s).alias("s"), r6(v).alias("v"))


def _hsv_channel(which: str) -> str:
    order = {"r": "cxzzxc", "g": "xccxzz", "b": "zzxccx"}[which]
    terms = {"c": "c", "x": "x", "z": "0"}
    cases = " ".join(f"WHEN h < {60 * (i + 1)} THEN {terms[k]}" for i, k in enumerate(order[:5]))
    return f"CAST(floor(((CASE {cases} ELSE {terms[order[5]]} END) + m)*255 + 0.5::DOUBLE) AS INT) AS {which}"


@query(
    "hsv_to_rgb",
    f"""SELECT id, {_hsv_channel('r')}, {_hsv_channel('g')}, {_hsv_channel('b')} FROM (
        SELECT *, c*(1 - abs(fmod(h/60, 2) - 1)) AS x, v - c AS m FROM (
        SELECT *, v*s AS c FROM (SELECT id, CAST((id*37) % 360 AS DOUBLE) AS h, r/255::DOUBLE AS s, b/255::DOUBLE AS v FROM rgb)))""",
)
def _(spark, d):
    h = ((F.col("id") * 37) % 360).cast("double")
    out = C.hsv_to_rgb(h, F.col("r") / 255, F.col("b") / 255)
    return V.rgb(spark, d).select("id", out.r.alias("r"), out.g.alias("g"), out.b.alias("b"))


@query(
    "hue_chroma_keys",
    "SELECT id, round(atan2(lb, a), 6) AS hue, round(sqrt(a*a + lb*lb), 6) AS chroma, round(L, 6) AS lightness FROM pal_lab",
)
def _(spark, d):
    keys = P.sort_keys(P.palette_dim(V.pal(spark, d)))
    return keys.select("id", r6("hue").alias("hue"), r6("chroma").alias("chroma"), r6("lightness").alias("lightness"))


def _tone(c: str) -> str:
    return f"((({c}/255::DOUBLE) - 0.5::DOUBLE)*1.3::DOUBLE + 0.5::DOUBLE)*1.1::DOUBLE"


@query(
    "adjust_tone",
    "SELECT id, alpha, "
    + ", ".join(
        f"CASE WHEN alpha < 128 THEN {c} ELSE {S.byte(f'luma + (t{c} - luma)*0.7::DOUBLE')} END AS {c}" for c in "rgb"
    )
    + f""" FROM (SELECT *, tr*0.299::DOUBLE + tg*0.587::DOUBLE + tb*0.114::DOUBLE AS luma FROM
        (SELECT *, {_tone('r')} AS tr, {_tone('g')} AS tg, {_tone('b')} AS tb FROM rgb))""",
)
def _(spark, d):
    out = C.adjust_tone(_rgb(), F.col("alpha"), brightness=1.1, contrast=1.3, saturation=0.7)
    return V.rgb(spark, d).select("id", "alpha", out.r.alias("r"), out.g.alias("g"), out.b.alias("b"))


_BOOSTED = "(SELECT id, alpha, r, g, b, L, a * 1.4::DOUBLE AS a, lb * 1.4::DOUBLE AS lb FROM " + S.lab("rgb", "id, alpha, r, g, b") + ")"


@query(
    "chroma_boost",
    "SELECT id, "
    + ", ".join(
        f"CASE WHEN alpha < 128 THEN {c} ELSE {S.byte(S.srgb(l))} END AS {c}" for c, l in zip("rgb", ("lr", "lg", "lbl"))
    )
    + f" FROM {S.linear_from_lab(_BOOSTED, 'id, alpha, r, g, b')}",
)
def _(spark, d):
    return P.chroma_boost(V.rgb(spark, d), 1.4).select("id", "r", "g", "b")


_STEP = repr(255 / 5)


def _post(c: str) -> str:
    return S.clamp_byte(f"floor(floor({c}/{_STEP}::DOUBLE + 0.5::DOUBLE)*{_STEP}::DOUBLE + 0.5::DOUBLE)")


@query("posterize", f"SELECT id, {_post('r')} AS r, {_post('g')} AS g, {_post('b')} AS b FROM rgb")
def _(spark, d):
    out = C.posterize(_rgb(), 6)
    return V.rgb(spark, d).select("id", out.r.alias("r"), out.g.alias("g"), out.b.alias("b"))


# Fixed values, written out for the checks: the 16 dyes' ids at shade 1.
_DYES = (33, 61, 65, 69, 73, 77, 81, 85, 89, 93, 97, 101, 105, 109, 113, 117)
_RULES = {
    "flat": "id % 4 = 1",
    "legal": "id % 4 <> 3",
    "all": "TRUE",
    "greyscale": "id % 4 <> 3 AND greatest(r, g, b) - least(r, g, b) < 90",
    "dyes": f"id IN {_DYES}",
    "dye_shades": f"id % 4 <> 3 AND id >> 2 IN {tuple(i >> 2 for i in _DYES)}",
}


@query(
    "palette_restrict",
    " UNION ALL ".join(f"SELECT '{rule}' AS rule, id FROM pal WHERE {test}" for rule, test in _RULES.items()),
)
def _(spark, d):
    pal = P.palette_dim(V.pal(spark, d))
    out = None
    for rule in P.RESTRICTIONS:
        rows = P.restrict(pal, rule, grey_threshold=90).select(F.lit(rule).alias("rule"), "id")
        out = rows if out is None else out.union(rows)
    return out


@query("nearest_match", "SELECT id, m.i AS match_id, round(m.d, 6) AS dist FROM best")
def _(spark, d):
    out = M.nearest_match(V.opaque_rgb(spark, d), P.palette_dim(V.pal(spark, d)))
    return out.select("id", "match_id", r6("dist").alias("dist"))


_D = {n: f"(s.{n}-p.{n})*(s.{n}-p.{n})" for n in ("L", "a", "lb")}
_PLAIN = f"{_D['L']} + {_D['a']} + {_D['lb']}"
_METRIC_SQL = {
    "OKLAB": _PLAIN,
    "CHROMA_FIRST": f"{_D['L']} + {_D['a']}*4 + {_D['lb']}*4",
    "LUMA_FIRST": f"{_D['L']}*4 + {_D['a']} + {_D['lb']}",
    "HUE_ONLY": f"""CASE WHEN s.a*s.a + s.lb*s.lb < {S.num(0.04 * 0.04)} THEN {_PLAIN}
        WHEN p.a*p.a + p.lb*p.lb < {S.num(0.04 * 0.04)} THEN 2.01::DOUBLE ELSE 1 - cos(atan2(s.lb, s.a) - atan2(p.lb, p.a)) END""",
    "RGB": "(s.lr-p.lr)*(s.lr-p.lr) + (s.lg-p.lg)*(s.lg-p.lg) + (s.lbl-p.lbl)*(s.lbl-p.lbl)",
}
_S_LIN = S.linear_from_lab("rgb_lab", "id, L, a, lb")
_P_LIN = f"(SELECT id, L, a, lb, {S.lin('r')} AS lr, {S.lin('g')} AS lg, {S.lin('b')} AS lbl FROM {S.lab('pal', 'id, r, g, b')})"


@query(
    "nearest_match_metric",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, id, m.i AS match_id, round(m.d, 6) AS dist FROM (SELECT s.id,
        min(struct_pack(d := {sql}, i := p.id)) AS m FROM {_S_LIN} s, {_P_LIN} p GROUP BY s.id)"""
        for m, sql in _METRIC_SQL.items()
    ),
)
def _(spark, d):
    out = M.match_by_metric(V.opaque_rgb(spark, d), P.palette_dim(V.pal(spark, d)))
    return out.select("metric", "id", "match_id", r6("dist").alias("dist"))


# The ordered-dither matrices of side 2 and 4; 8 and 16 follow from the bits of the position.
_BAYER = {2: "0 2 3 1", 4: "0 8 2 10 12 4 14 6 3 11 1 9 15 7 13 5"}


def _bayer_sql(x: str, y: str, size: int) -> str:
    x, y = f"CAST({x} AS BIGINT)", f"CAST({y} AS BIGINT)"
    if size in _BAYER:
        return f"(list_value({', '.join(_BAYER[size].split())})[{y} % {size} * {size} + {x} % {size} + 1])"
    # the quarter a position falls in weighs least, its place in the smallest square most
    half = size // 2
    return f"({_bayer_sql(x, y, half)} * 4 + list_value(0, 2, 3, 1)[({y} // {half}) % 2 * 2 + ({x} // {half}) % 2 + 1])"


def _dithered(source: str, size: int, scale: float) -> str:
    t = f"((({_bayer_sql('(id % 100)', '((id - id % 100)/100)', size)} + 0.5::DOUBLE)/{size * size}::DOUBLE - 0.5::DOUBLE)*{S.num(scale)})"
    return f"(SELECT id, L + t AS L, a + t AS a, lb + t AS lb FROM (SELECT *, {t} AS t FROM {source}))"


def _placed(spark, d) -> DataFrame:
    i = F.col("id")
    return V.opaque_rgb(spark, d).withColumns(
        {"x": (i % 100).cast("int"), "y": ((i - i % 100) / 100).cast("int")}
    )


@query(
    "ordered_dither",
    " UNION ALL ".join(
        f"""SELECT {n} AS size, id, m.i AS match_id FROM (SELECT s.id, min(struct_pack(d := {S.dist('s', 'p')}, i := p.id)) AS m
        FROM {_dithered('rgb_lab', n, 0.12)} s, pal_lab p GROUP BY s.id)"""
        for n in (2, 4, 8, 16)
    ),
)
def _(spark, d):
    out = M.dither_sizes(_placed(spark, d), P.palette_dim(V.pal(spark, d)), (2, 4, 8, 16), 0.12)
    return out.select("size", "id", "match_id")


@query(
    "two_pass_match",
    f"""WITH used AS (SELECT * FROM pal_lab WHERE id IN (SELECT m.i FROM best))
    SELECT id, m.i AS match_id FROM (SELECT s.id, min(struct_pack(d := {S.dist('s', 'p')}, i := p.id)) AS m
    FROM {_dithered('rgb_lab', 4, 0.3)} s, used p GROUP BY s.id)""",
)
def _(spark, d):
    out = R.two_pass_match(_placed(spark, d), P.palette_dim(V.pal(spark, d)), dither_size=4, dither_scale=0.3)
    return out.select("id", "match_id")


def _px_id(spark, d) -> DataFrame:
    c = F.col("c")
    return V.px(spark, d).select("image", "y", "x", F.when(c == 0, 0).otherwise(1 + c % 50).alias("c"))


def _px_rgb(spark, d) -> DataFrame:
    c = F.col("c")
    return V.px(spark, d).select(
        "image", "y", "x", "c",
        ((c * 5) % 256).alias("r"), ((c * 11) % 256).alias("g"), ((c * 23) % 256).alias("b"),
        F.when(c == 0, 0).otherwise(255).alias("alpha"),
    )


@query(
    "tile_palette_match",
    f"""WITH here AS (SELECT DISTINCT image, c AS id FROM px_id WHERE c > 0 AND image % 3 <> 2),
    full_tiles AS (SELECT image, id FROM here UNION ALL
      SELECT i.image, p.id FROM (SELECT DISTINCT image FROM px WHERE image % 3 = 2) i, pal p),
    src AS {S.lab('(SELECT * FROM px_rgb WHERE alpha >= 128)', 'image, y, x')}
    SELECT image, y, x, m.i AS match_id FROM (SELECT s.image, s.y, s.x, min(struct_pack(d := {S.dist('s', 'p')}, i := p.id)) AS m
      FROM src s JOIN full_tiles t ON s.image = t.image JOIN pal_lab p ON p.id = t.id GROUP BY s.image, s.y, s.x)""",
)
def _(spark, d):
    pixels = _px_rgb(spark, d).where(F.col("alpha") >= 128).drop("c")
    # every third tile shows nothing yet and falls back to the whole palette
    present = _px_id(spark, d).where(F.col("image") % 3 != 2).select("image", F.col("c").alias("id")).distinct()
    out = M.tile_palette_match(pixels, present, P.palette_dim(V.pal(spark, d)), ["image"])
    return out.select("image", "y", "x", "match_id")


@query(
    "nearest_other",
    f"""SELECT id, m.i AS other_id, round(m.d, 6) AS dist FROM (SELECT s.id, min(struct_pack(d := {S.dist('s', 'p')}, i := p.id)) AS m
        FROM pal_lab s, pal_lab p WHERE s.id <> p.id GROUP BY s.id)""",
)
def _(spark, d):
    out = M.nearest_other(P.palette_dim(V.pal(spark, d)))
    return out.select("id", "other_id", r6("dist").alias("dist"))


_PAIR_COUNTS = "SELECT CAST(s.id % 7 AS INT) AS grp, s.m.i AS id, count(*) AS n FROM best s GROUP BY ALL"


def _pair_sql(weighted: bool) -> str:
    score = S.dist("p", "q")
    score = f"({score})/(a.n + b.n)" if weighted else score
    return f"""SELECT grp, {'TRUE' if weighted else 'FALSE'} AS weighted, CASE WHEN m.na <= m.nb THEN m.a ELSE m.b END AS victim,
      CASE WHEN m.na <= m.nb THEN m.b ELSE m.a END AS survivor, least(m.na, m.nb) AS touched, round(m.s, 9) AS score FROM (
      SELECT a.grp, min(struct_pack(s := {score}, a := a.id, b := b.id, na := a.n, nb := b.n)) AS m
      FROM cnt a JOIN cnt b ON a.grp = b.grp AND a.id < b.id JOIN pal_lab p ON p.id = a.id JOIN pal_lab q ON q.id = b.id GROUP BY a.grp)"""


@query("closest_pair", f"WITH cnt AS ({_PAIR_COUNTS}) {_pair_sql(False)} UNION ALL {_pair_sql(True)}")
def _(spark, d):
    pal = P.palette_dim(V.pal(spark, d))
    matched = M.nearest_match(V.opaque_rgb(spark, d), pal)
    counts = matched.groupBy((F.col("id") % 7).cast("int").alias("grp"), F.col("match_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = cut_lineage(counts, "counts")  # at most 255 rows a group, read for both scores
    out = None
    for weighted in (False, True):
        rows = M.closest_pair(counts, pal, ["grp"], weighted).select(
            "grp", F.lit(weighted).alias("weighted"), "victim", "survivor", "touched", F.round("score", 9).alias("score")
        )
        out = rows if out is None else out.union(rows)
    return out


@query(
    "match_quality",
    """SELECT round(avg(CASE WHEN m.d <= 0.0025::DOUBLE THEN 100::DOUBLE ELSE 0::DOUBLE END), 6) AS accurate_pct,
       round(avg(sqrt(m.d)), 6) AS avg_delta FROM best""",
)
def match_quality(spark, d):
    out = M.match_quality(V.opaque_rgb(spark, d), P.palette_dim(V.pal(spark, d)))
    return out.select(r6("accurate_pct").alias("accurate_pct"), r6("avg_delta").alias("avg_delta"))


@query(
    "assigned_quality",
    f"""SELECT round(avg(CASE WHEN d <= 0.0025::DOUBLE THEN 100::DOUBLE ELSE 0::DOUBLE END), 6) AS accurate_pct, round(avg(sqrt(d)), 6) AS avg_delta
    FROM (SELECT {S.dist('s', 'q')} AS d FROM
      (SELECT s.id, min(struct_pack(d := {_METRIC_SQL['LUMA_FIRST']}, i := p.id)) AS m FROM rgb_lab s, pal_lab p GROUP BY s.id) g
      JOIN rgb_lab s ON s.id = g.id JOIN pal_lab q ON q.id = g.m.i WHERE s.id % 13 <> 0)""",
)
def _(spark, d):
    pal = P.palette_dim(V.pal(spark, d))
    given = M.nearest_match(V.opaque_rgb(spark, d), pal, "LUMA_FIRST")
    shown = given.withColumn("c", F.when(F.col("id") % 13 == 0, F.lit(0)).otherwise(F.col("match_id")))
    out = M.assigned_quality(shown, pal)
    return out.select(r6("accurate_pct").alias("accurate_pct"), r6("avg_delta").alias("avg_delta"))


@query(
    "fidelity",
    f"""WITH dec AS (SELECT id, {_post('r')} AS r, {_post('g')} AS g, {_post('b')} AS b FROM rgb),
    both_sides AS (SELECT o.id, {S.dist('o', 'q')} AS d, (o.r-q.r)*(o.r-q.r) + (o.g-q.g)*(o.g-q.g) + (o.b-q.b)*(o.b-q.b) AS sq
      FROM {S.lab('rgb', 'id, r, g, b')} o JOIN {S.lab('dec', 'id, r, g, b')} q ON o.id = q.id)
    SELECT count(*) AS n, round(avg(sqrt(d)), 6) AS mean_delta, round(sum(sq)/(count(*)*3), 6) AS mse,
      round(10*log10(65025/(sum(sq)/(count(*)*3))), 6) AS psnr_db FROM both_sides""",
)
def _(spark, d):
    rgb = V.rgb(spark, d)
    p = C.posterize(_rgb(), 6)
    dec = rgb.select("id", p.r.alias("r"), p.g.alias("g"), p.b.alias("b"))
    out = M.fidelity(rgb, dec, ["id"])
    return out.select("n", *(r6(c).alias(c) for c in ("mean_delta", "mse", "psnr_db")))


def _palette_order(spark, d, by: str) -> DataFrame:
    pal = P.palette_dim(V.pal(spark, d))
    if by == "frequency":
        hits = M.nearest_match(V.opaque_rgb(spark, d), pal).groupBy(F.col("match_id").alias("id")).count()
        keyed = pal.join(hits, "id", "left").select("id", (-F.coalesce("count", F.lit(0))).cast("double").alias("key"))
    else:
        keyed = P.sort_keys(pal).select("id", F.col(by).cast("double").alias("key"))
    return keyed


_ORDERS = {
    "id": "SELECT id, CAST(id AS DOUBLE) AS key FROM pal_lab",
    "hue": "SELECT id, atan2(lb, a) AS key FROM pal_lab",
    "lightness": "SELECT id, L AS key FROM pal_lab",
    "chroma": "SELECT id, sqrt(a*a + lb*lb) AS key FROM pal_lab",
    "frequency": "SELECT p.id, CAST(-coalesce(h.n, 0) AS DOUBLE) AS key FROM pal p LEFT JOIN (SELECT m.i AS id, count(*) AS n FROM best GROUP BY 1) h ON p.id = h.id",
}


@query(
    "palette_sort",
    " UNION ALL ".join(
        f"SELECT '{by}' AS sort_by, id, CAST(row_number() OVER (ORDER BY key, id) AS INT) AS pos FROM ({sql})"
        for by, sql in _ORDERS.items()
    ),
)
def _(spark, d):
    from pyspark.sql import Window

    out = None
    for by in _ORDERS:
        rows = _palette_order(spark, d, by).select(F.lit(by).alias("sort_by"), "id", "key")
        out = rows if out is None else out.union(rows)
    place = Window.partitionBy("sort_by").orderBy("key", "id")
    return out.select("sort_by", "id", F.row_number().over(place).alias("pos"))
