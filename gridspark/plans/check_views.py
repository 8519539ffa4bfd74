"""DuckDB text of the example views, for the checks only."""

from __future__ import annotations

# The published OKLab matrices, written out so that the checks do not share them with what they check.
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
LMS_FROM_LAB = ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480))
RGB_FROM_LMS = (
    (4.0767416621, -3.3077115913, 0.2309699292),
    (-1.2684380046, 2.6097574011, -0.3413193965),
    (-0.0041960863, -0.7034186147, 1.7076147010),
)


def lin(c: str) -> str:
    """sRGB to linear of a 0-255 SQL expression."""
    u = f"(({c})/255::DOUBLE)"
    return f"(CASE WHEN {u} <= 0.04045::DOUBLE THEN {u}/12.92::DOUBLE ELSE pow(({u}+0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) END)"


def srgb(c: str) -> str:
    """Linear to sRGB of a SQL expression, clamped."""
    return (
        f"(CASE WHEN {c} <= 0 THEN 0::DOUBLE WHEN {c} >= 1 THEN 1::DOUBLE WHEN {c} <= 0.0031308::DOUBLE THEN "
        f"{c}*12.92::DOUBLE ELSE pow({c}, 1::DOUBLE/2.4::DOUBLE)*1.055::DOUBLE-0.055::DOUBLE END)"
    )


def num(x: float) -> str:
    return f"({x!r})::DOUBLE"


def mix(weights, values) -> str:
    return "(" + " + ".join(f"{v}*{num(w)}" for w, v in zip(weights, values)) + ")"


def lab(source: str, keep: str, r="r", g="g", b="b", names=("L", "a", "lb")) -> str:
    """Rows of ``source`` with OKLab columns."""
    lms = ", ".join(
        f"cbrt({mix(row, ('__lr', '__lg', '__lb'))}) AS __c{i}" for i, row in enumerate(LMS_FROM_RGB)
    )
    out = ", ".join(f"{mix(row, ('__c0', '__c1', '__c2'))} AS {n}" for row, n in zip(LAB_FROM_LMS, names))
    return (
        f"(SELECT {keep}, {out} FROM (SELECT *, {lms} FROM (SELECT *, {lin(r)} AS __lr, {lin(g)} AS __lg, "
        f"{lin(b)} AS __lb FROM {source})))"
    )


def linear_from_lab(source: str, keep: str, L="L", a="a", b="lb") -> str:
    """Rows of ``source`` with linear RGB columns ``lr, lg, lbl``."""
    roots = ", ".join(
        f"({L} + {a}*{num(wa)} + {b}*{num(wb)}) AS __q{i}" for i, (wa, wb) in enumerate(LMS_FROM_LAB)
    )
    cubes = [f"(__q{i}*__q{i}*__q{i})" for i in range(3)]
    out = ", ".join(f"{mix(row, cubes)} AS {n}" for row, n in zip(RGB_FROM_LMS, ("lr", "lg", "lbl")))
    return f"(SELECT {keep}, {out} FROM (SELECT *, {roots} FROM {source}))"


def byte(c: str) -> str:
    return f"CAST(floor(least(1::DOUBLE, greatest(0::DOUBLE, {c}))*255+0.5::DOUBLE) AS INT)"


def clamp_byte(c: str) -> str:
    return f"CAST(floor(greatest(least({c}, 255::DOUBLE), 0::DOUBLE)+0.5::DOUBLE) AS INT)"


def dist(p: str, q: str) -> str:
    """Squared distance between two aliases with L, a, lb."""
    return " + ".join(f"({p}.{n}-{q}.{n})*({p}.{n}-{q}.{n})" for n in ("L", "a", "lb"))


VIEWS = {
    "ex": "SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "px": "SELECT CAST((vec_id - vec_id % 50)/50 AS INT) AS image, CAST(vec_id % 50 AS INT) AS y, x, v, "
    "CASE WHEN (vec_id + x) % 17 = 0 THEN 0 ELSE greatest(1, least(255, CAST(floor(v*64) AS INT)+128)) END AS c FROM ex",
    "fr": "SELECT image AS anim, y AS frame, x AS pos, c FROM px",
    "rgb": "SELECT event_id AS id, CAST(event_id % 256 AS INT) AS r, CAST((event_id*7) % 256 AS INT) AS g, "
    "CAST((user_id*13) % 256 AS INT) AS b, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 255 END AS alpha FROM events",
    "pal": "SELECT DISTINCT p_size AS id, (p_size*5) % 256 AS r, (p_size*11) % 256 AS g, (p_size*23) % 256 AS b, "
    "p_size % 4 <> 3 AS legal FROM part",
    "cell": "SELECT CAST(event_id % 100 AS INT) AS x, CAST((event_id - event_id % 100)/100 AS INT) AS z, event_type AS item FROM events",
    "fdelay": "SELECT user_id AS anim, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS frame, "
    "greatest(10, CAST(floor(value) AS INT)) AS delay_ms FROM events",
    "sizes": "SELECT source AS comp, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS tile, "
    "n_chars AS n, doc_id, text FROM documents",
    "parts": "SELECT conv_id AS grp, turn AS idx, 1 + conv_id % 8 AS expected, text AS body FROM conversations",
    "planned": "SELECT o_orderkey AS k, CAST(1 + o_orderkey % 4 AS INT) AS top, CASE WHEN o_orderkey % 7 = 0 THEN NULL "
    "WHEN o_orderkey % 3 = 0 THEN 'A' WHEN o_orderkey % 3 = 1 THEN 'N' ELSE 'R' END AS item FROM orders",
    "actual": "SELECT l_orderkey AS k, l_linenumber AS y, l_returnflag AS item, l_linestatus = 'O' AS is_ours FROM lineitem",
    "stock": "SELECT user_id AS loc, event_type AS item, CAST(floor(value) AS INT) AS n, event_id AS seq FROM events",
    "sess": "SELECT event_id AS id, user_id AS owner, event_id AS saved_seq FROM events",
    # colours with OKLab values
    "rgb_lab": "SELECT * FROM " + lab("rgb", "id, r, g, b, alpha") + " WHERE alpha >= 128",
    "pal_lab": "SELECT * FROM " + lab("pal", "id, r, g, b, legal"),
    # best palette entry per opaque colour row; the lowest id wins a tie
    "best": "SELECT s.id, min(struct_pack(d := " + dist("s", "p") + ", i := p.id)) AS m FROM rgb_lab s, pal_lab p GROUP BY s.id",
    # pixels seen through the palette
    "px_id": "SELECT image, y, x, CASE WHEN c = 0 THEN 0 ELSE 1 + c % 50 END AS c FROM px",
    "px_rgb": "SELECT image, y, x, c, (c*5) % 256 AS r, (c*11) % 256 AS g, (c*23) % 256 AS b, CASE WHEN c = 0 THEN 0 ELSE 255 END AS alpha FROM px",
    "mask_a": "SELECT image, y, x FROM px WHERE c BETWEEN 120 AND 135",
    "mask_b": "SELECT image, y, x FROM px WHERE c BETWEEN 128 AND 150",
    "top_real": "SELECT k, m.y AS real_top, m.item AS real_item, m.o AS is_ours FROM (SELECT k, max(struct_pack(y := y, item := item, o := is_ours)) AS m FROM actual GROUP BY k)",
    "verdict": "SELECT k, real_top, wanted_top, CASE WHEN item IS NULL THEN CASE WHEN coalesce(is_ours AND real_top >= 1, FALSE) THEN 'ERRANT' ELSE 'OK' END "
    "WHEN real_top IS NULL THEN 'MISSING' WHEN real_top > wanted_top THEN CASE WHEN is_ours THEN 'ERRANT' ELSE 'OBSTRUCTION' END "
    "WHEN real_top = wanted_top AND real_item = item THEN 'OK' ELSE 'MISSING' END AS finding "
    "FROM (SELECT coalesce(p.k, a.k) AS k, p.top AS wanted_top, p.item, a.real_top, a.real_item, a.is_ours FROM planned p FULL OUTER JOIN top_real a ON p.k = a.k)",
}
