"""Operators against plain loops on small inputs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridspark.functions import palette as P
from gridspark.functions import payload as Y
from gridspark.functions.color import Rgb, rgb_to_oklab
from gridspark.operators import frames as A
from gridspark.operators import history as H
from gridspark.operators import masks as K
from gridspark.operators import match as M
from gridspark.operators import plan as B
from gridspark.operators import reduce as R
from gridspark.operators import regions as G
from gridspark.operators import scan as S
from gridspark.operators import stock as ST

rnd = random.Random(7)


# ── running values ──────────────────────────────────────────────────────────


def test_scan_spreads_a_hot_group(spark):
    # one key holds most rows; slices of 16 order values
    data = [("hot" if i % 5 else (f"k{i % 7}" if i % 7 else None), i - 300, rnd.randrange(100)) for i in range(1200)]
    df = spark.createDataFrame(data, "k string, o long, v int")
    out = S.scan(
        df,
        ["k"],
        "o",
        {"n": S.row_number(), "s": S.running_sum(F.col("v")), "x": S.running_xor(F.col("v"))},
        width=16,
    )
    got = {(r.k, r.o): (r.n, r.s, r.x) for r in out.collect()}
    n, s, x = Counter(), Counter(), Counter()
    for k, o, v in sorted(data, key=lambda r: r[1]):
        n[k] += 1
        s[k] += v
        x[k] ^= v
        assert got[(k, o)] == (n[k], s[k], x[k])
    assert len(got) == len(data)


def test_page_ranks_only_what_it_shows(spark):
    data = [("a", i * 3) for i in range(57)] + [("b", i) for i in range(4)]
    df = spark.createDataFrame(data, "k string, o long")
    last = H.page(df, ["k"], "o", 99).collect()
    assert sorted((r.k, r.row_no, r.pages) for r in last) == sorted(
        [("a", i, 6) for i in range(51, 58)] + [("b", i, 1) for i in range(1, 5)]
    )


# ── colour ──────────────────────────────────────────────────────────────────


def test_oklab_of_grey_axis(spark):
    df = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (128, 128, 128)], "r int, g int, b int")
    lab = rgb_to_oklab(Rgb(F.col("r"), F.col("g"), F.col("b")))
    black, white, grey = df.select(lab.L, lab.a, lab.b).collect()
    assert tuple(black) == pytest.approx((0, 0, 0), abs=1e-6)
    assert tuple(white) == pytest.approx((1, 0, 0), abs=1e-4)
    assert 0.5 < grey[0] < 0.7 and abs(grey[1]) < 1e-4 and abs(grey[2]) < 1e-4


def test_built_in_palette(spark):
    pal = P.map_palette(spark)
    assert pal.count() == 244
    sizes = {rule: P.restrict(pal, rule).count() for rule in P.RESTRICTIONS}
    assert (sizes["flat"], sizes["legal"], sizes["all"], sizes["dyes"], sizes["dye_shades"]) == (61, 183, 244, 16, 48)
    assert pal.where("id = 4").first()[1:4] == (89, 125, 39)
    assert pal.where("id = 247").first()[1:4] == (67, 88, 79)


def test_exact_colours_match_themselves(spark):
    pal = P.map_palette(spark).cache()
    out = M.nearest_match(pal.select("r", "g", "b").distinct(), pal)
    assert out.where("dist > 1e-12").count() == 0
    first = {}
    for r in pal.orderBy("id").collect():
        first.setdefault((r.r, r.g, r.b), r.id)
    assert {(r.r, r.g, r.b): r.match_id for r in out.collect()} == first


def test_match_without_palette_or_rows(spark):
    pal = P.map_palette(spark)
    colours = spark.createDataFrame([(1, 2, 3)], "r int, g int, b int")
    none = M.nearest_match(colours, pal.where("id = 3")).first()
    assert (none.match_id, none.dist) == (0, None)
    assert tuple(M.match_quality(colours, pal.where("id = 3")).first()) == (0.0, 1.0)
    assert tuple(M.match_quality(colours.where("r = 9"), pal).first()) == (0.0, 0.0)


@pytest.mark.parametrize("strategy", R.STRATEGIES)
def test_reduction_follows_the_loop(spark, strategy):
    pal = P.map_palette(spark).where("id < 60").cache()
    lab = {r.id: (r.L, r.a, r.lab_b) for r in P.with_oklab(pal).collect()}
    ids = sorted(lab)
    cells = [(img, x, rnd.choice([0, *ids[: 8 + 6 * img]])) for img in range(4) for x in range(300)]
    px = spark.createDataFrame(cells, "image int, x int, c int")
    out = R.reduce_palette(px, pal, ["image"], 5, strategy)
    got = {(r.image, r.x): r.c for r in out.collect()}

    def gap(a, b):
        return sum((p - q) ** 2 for p, q in zip(lab[a], lab[b]))

    for img in range(4):
        now = {x: c for i, x, c in cells if i == img}
        while True:
            n = Counter(c for c in now.values() if c)
            if len(n) <= 5:
                break
            if strategy == "RAREST":
                victim = min(n, key=lambda c: (n[c], c))
                keep = min((c for c in n if c != victim), key=lambda c: (gap(victim, c), c))
            else:
                pairs = ((a, b) for a in sorted(n) for b in sorted(n) if a < b)
                scale = (lambda a, b: n[a] + n[b]) if strategy == "WEIGHTED" else (lambda a, b: 1)
                a, b = min(pairs, key=lambda p: (gap(*p) / scale(*p), p))
                victim, keep = (a, b) if n[a] <= n[b] else (b, a)
            now = {x: keep if c == victim else c for x, c in now.items()}
        assert {x: got[(img, x)] for x in now} == now


# ── selections ──────────────────────────────────────────────────────────────


def test_erode_undoes_no_more_than_dilate_adds(spark):
    cells = {(rnd.randrange(20), rnd.randrange(15)) for _ in range(120)}
    mask = spark.createDataFrame([(0, x, y) for x, y in cells], "image int, x int, y int")
    grown = K.dilate(mask, ["image"], 20, 15, 6)
    want = set(cells)
    for _ in range(6):
        want |= {
            (x + dx, y + dy)
            for x, y in want
            for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))
            if 0 <= x + dx < 20 and 0 <= y + dy < 15
        }
    assert {(r.x, r.y) for r in grown.collect()} == want
    small = want
    for _ in range(5):
        small = {
            (x, y)
            for x, y in small
            if all((x + dx, y + dy) in small for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        }
    assert {(r.x, r.y) for r in K.erode(grown, ["image"], 5).collect()} == small


def test_short_polygon_selects_nothing(spark):
    cells = spark.createDataFrame([(1, 1)], "x int, y int")
    assert K.polygon_select(cells, [(0, 0), (5, 5)]).count() == 0
    assert K.polygon_select(cells, [(0, 0), (2, 2), (4, 0)]).count() == 1  # on the outline


# ── frames ──────────────────────────────────────────────────────────────────


@pytest.mark.parametrize("n", [2, 3, 5])
def test_thinning_follows_the_loops(spark, n):
    delays = {a: [rnd.randrange(10, 200) for _ in range(k)] for a, k in enumerate((1, 2, 3, 6, 7, 20))}
    frames = spark.createDataFrame(
        [(a, i, v) for a, vs in delays.items() for i, v in enumerate(vs)], "anim int, frame int, delay_ms int"
    )
    skipped, strided = defaultdict(list), defaultdict(list)
    for r in A.skip_thin(frames, "anim", n).orderBy("new_frame").collect():
        skipped[r.anim].append(r.delay_ms)
    for r in A.stride_thin(frames, "anim", n).orderBy("new_frame").collect():
        strided[r.anim].append(r.delay_ms)
    for a, vs in delays.items():
        kept, pending = [], 0
        for i, v in enumerate(vs):
            if (i + 1) % n == 0:
                pending += v
            else:
                kept.append(v + pending)
                pending = 0
        kept[-1] += pending
        assert skipped[a] == kept
        assert strided[a] == [sum(vs[i : i + n]) for i in range(0, len(vs), n)]


@pytest.mark.parametrize("at", [0, 99, 100, 101, 549, 550, 1649, 1650, 99999])
def test_clock_follows_the_schedule(spark, at):
    delays = [100, 50, 400]
    frames = spark.createDataFrame([(0, i, v) for i, v in enumerate(delays)], "anim int, frame int, delay_ms int")
    for loops in (0, 3):
        row = A.frame_clock(frames, "anim", at, loops, width=2).first()
        if loops and at >= 550 * loops:
            assert (row.frame, row.finished) == (0, True)
            continue
        t, frame = at % 550, 0
        while t >= delays[frame]:
            t -= delays[frame]
            frame += 1
        assert (row.frame, row.finished) == (frame, False)


# ── plans ───────────────────────────────────────────────────────────────────

NONE = None
CASES = [  # wanted top, wanted item, real top, real item, is ours -> finding, floor 64
    (64, "W", 64, "W", True, "OK"),
    (64, "W", 65, "W", True, "ERRANT"),
    (64, "W", 69, "stone", False, "OBSTRUCTION"),
    (64, "W", 64, "R", True, "MISSING"),
    (64, "W", NONE, NONE, False, "MISSING"),
    (66, "W", 66, "W", True, "OK"),
    (66, "W", 64, "W", True, "MISSING"),
    (NONE, NONE, 64, "W", True, "ERRANT"),
    (NONE, NONE, NONE, NONE, False, "OK"),
    (NONE, NONE, 63, "W", True, "OK"),
]


def test_findings(spark):
    planned = [(i, top, item) for i, (top, item, *_) in enumerate(CASES)]
    actual = [(i, c[2], c[3], c[4]) for i, c in enumerate(CASES) if c[2] is not None]
    out = B.plan_vs_actual(
        spark.createDataFrame(planned, "k int, top int, item string"),
        spark.createDataFrame(actual, "k int, y int, item string, is_ours boolean"),
        ["k"],
        64,
    )
    assert {r.k: r.finding for r in out.collect()} == {i: c[5] for i, c in enumerate(CASES)}


def shares(needs, n):
    """The best of all slots an item could hold, by how far it would still be below its share; then one for everybody."""
    cap, total = [-(-v // 64) for v in needs], sum(needs)
    target, served = min(n, sum(cap)), [i for i, v in enumerate(needs) if v]
    if target < len(served):
        return [int(i in served[:target]) for i in range(len(needs))]
    slots = sorted((j - target * needs[i] / total, i) for i in served for j in range(min(cap[i], n)))
    got = Counter(i for _, i in slots[:target])
    empty = [i for i in served if not got[i]]
    top = sorted((-level, i) for i in served for level in range(2, got[i] + 1))
    got.subtract(i for _, i in top[: len(empty)])
    got.update(empty)
    return [got[i] for i in range(len(needs))]


def test_slots_are_the_best_ones(spark):
    rows, want = [], {}
    n = 20
    for g in range(60):
        needs = sorted((rnd.choice([0, 1, 30, 64, 65, 500, rnd.randrange(5000)]) for _ in range(rnd.randrange(1, 26))), reverse=True)
        rows += [(g, f"i{i:02d}", v) for i, v in enumerate(needs)]
        want[g] = shares(needs, n)
    df = spark.createDataFrame(rows, "g int, item string, need long")
    got = defaultdict(dict)
    for r in B.proportional_slots(df, ["g"], n).collect():
        got[r.g][r.item] = r.slots
    for g, slots in want.items():
        assert [got[g][f"i{i:02d}"] for i in range(len(slots))] == slots
    several = B.proportional_slots(df, ["g"], [20, 1, 7, 900]).collect()
    assert len(several) == 4 * len(rows)
    for m in (1, 7, 20, 900):
        found = {(r.g, r.item): r.slots for r in several if r.n_slots == m}
        for g in want:
            mine = sorted(((item, v) for h, item, v in rows if h == g))
            assert [found[g, item] for item, _ in mine] == shares([v for _, v in mine], m), (g, m)


@pytest.mark.parametrize("parts,rows_a_batch", [(1, 7), (9, 10_000)])
def test_samples_per_class(spark, parts, rows_a_batch):
    rows = [(rnd.choice(["a", "b", None, "once"[: rnd.randrange(5)]]), rnd.choice([None, float("nan"), rnd.random()]), i) for i in range(300)] + [("single", 1.0, 300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        df = spark.createDataFrame(rows, "c string, o double, i int").repartition(parts)
        got = B.samples_per_class(df, "c", ["o", "i"], 4).collect()
        assert B.samples_per_class(df.limit(0), "c", ["o", "i"], 4).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] != r[1], r[1] if r[1] == r[1] and r[1] is not None else 0, r[2]))
        want |= {(c, r[2], k + 1, len(mine)) for k, r in enumerate(mine[:4])}
    assert {(r.c, r.i, r.sample_no, r.class_count) for r in got} == want and len(got) == len(want)


def test_slots_without_group_or_demand(spark):
    df = spark.createDataFrame([("a", 64), ("b", None), ("c", 0), (None, 200)], "item string, need long")
    assert {(r["item"], r.slots) for r in B.proportional_slots(df, [], 3).collect()} == {("a", 1), ("b", 0), ("c", 0), (None, 2)}
    assert B.proportional_slots(df.limit(0), [], [3, 4]).count() == 0


@pytest.mark.parametrize("east,south", [(True, True), (False, False)])
def test_load_follows_the_walk(spark, east, south):
    cells = {(rnd.randrange(-20, 40), rnd.randrange(-30, 30)): rnd.choice("abc") for _ in range(2500)}
    df = spark.createDataFrame([(x, z, i) for (x, z), i in cells.items()], "x int, z int, item string")
    xs, zs = [x for x, _ in cells], [z for _, z in cells]
    lo, hi, width, cap = min(xs), max(xs), 7, 9
    walk = []
    for b in range((hi - lo) // width + 1):
        down = (b % 2 == 0) == south
        for z in sorted(range(min(zs), max(zs) + 1), reverse=not down):
            for k in range(width):
                x = hi - b * width - k if east else lo + b * width + k
                if (x, z) in cells:
                    walk.append((x, z))
    seq = {(r.x, r.z): r.seq for r in B.serpentine_order(df, [], width, east, south).collect()}
    assert [c for c, _ in sorted(seq.items(), key=lambda kv: kv[1])] == walk
    taken, count, stacks = [], Counter(), 0
    for c in walk:
        item = cells[c]
        opens = int(count[item] % 64 == 0)
        if stacks + opens > cap:
            break
        stacks += opens
        count[item] += 1
        taken.append(c)
    load = B.capped_load(df, [], cap, width, east, south)
    assert {(r.x, r.z) for r in load.collect()} == set(taken)


# ── regions ─────────────────────────────────────────────────────────────────


@pytest.mark.parametrize("block", [4, 16])
def test_components_across_blocks(spark, block):
    cells = [(s, x, y, int(rnd.random() < 0.62)) for s in range(2) for x in range(-9, 21) for y in range(-7, 18)]
    cells += [(2, i, 0, 1) for i in range(60)]  # one long line through many blocks
    df = spark.createDataFrame(cells, "site int, x int, y int, value int")
    got = defaultdict(set)
    for r in G.components(df, ["site"], block).collect():
        got[(r.site, r.label)].add((r.x, r.y))
    value = {(s, x, y): v for s, x, y, v in cells}
    seen, want = set(), set()
    for start in value:
        if start in seen:
            continue
        stack, part = [start], set()
        seen.add(start)
        while stack:
            s, x, y = stack.pop()
            part.add((x, y))
            for nxt in ((s, x + 1, y), (s, x - 1, y), (s, x, y + 1), (s, x, y - 1)):
                if nxt in value and nxt not in seen and value[nxt] == value[(s, x, y)]:
                    seen.add(nxt)
                    stack.append(nxt)
        first_x, first_y = min(part, key=lambda p: (p[1], p[0]))
        want.add((start[0], first_y * G.ROW_STRIDE + first_x + G.X_OFFSET, frozenset(part)))
    assert {(s, label, frozenset(p)) for (s, label), p in got.items()} == want


# ── allocation ──────────────────────────────────────────────────────────────

def test_positions(spark):
    df = spark.createDataFrame([("1,-2,3",), ("1,2",), ("a,b,c",), ("1,2,3,4",)], "pos string")
    got = [r.p for r in df.select(ST.parse_pos(F.col("pos")).alias("p")).collect()]
    assert tuple(got[0]) == (1, -2, 3) and got[1:] == [None, None, None]
