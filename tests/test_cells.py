"""Joins by cell: their results by brute force, and that no pair is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import exprs
from gridloom.operators import composites, spatial
from gridloom.plans import queries as world

DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def gap(a, b):
    d = abs(a - b)
    return min(d, 3072 - d)


def crowd(n, seed):
    r = random.Random(seed)
    return [(i, r.choice([3060, 0, 60, 120]) + r.randrange(12), r.choice([3060, 0, 1500]) + r.randrange(12), r.randrange(16), r.randrange(3), r.random() < 0.3, r.random() < 0.3, r.random() < 0.7, r.random() < 0.1) for i in range(n)]


COLUMNS = "id long, tx long, ty long, tz long, strength long, taken boolean, fleeing boolean, able boolean, blocks boolean"


def test_opponents_by_brute_force(spark):
    things = crowd(400, 1) + [(900 + i, 5, 5, 3, 1, False, False, True, False) for i in range(4)]
    df = spark.createDataFrame(things, COLUMNS)
    got = {r.p_id: (r.weakest, r.strongest, r.nearest) for r in spatial.opponents(df.filter("id % 3 = 0 OR id >= 900"), df, 20).collect()}
    want = {}
    for p in (t for t in things if t[0] % 3 == 0 or t[0] >= 900):
        hits = [o for o in things if o[0] != p[0] and max(gap(p[1], o[1]), gap(p[2], o[2])) <= 20]
        order = lambda o: (-o[2], -o[1], -o[3], o[0])
        far = lambda o, p=p: max(gap(p[1], o[1]), gap(p[2], o[2])) + 16 * o[5] + 32 * (o[6] or not o[7])
        if hits:
            close = min(hits, key=lambda o: (far(o), order(o)))
            want[p[0]] = (min(hits, key=lambda o: (o[4], order(o)))[0], min(hits, key=lambda o: (-o[4], order(o)))[0], close[0] if far(close) < 64 else None)
    assert got == want


def way(a, b):
    wrap = lambda d: d - 3072 if d >= 1536 else d + 3072 if d <= -1536 else d
    dx, dy = wrap(b[1] - a[1]), wrap(b[2] - a[2])
    n = max(abs(dx), abs(dy), abs(b[3] - a[3]))
    sign = lambda d: (d > 0) - (d < 0)
    return {((a[1] + sign(dx) * (i * abs(dx) // n)) % 3072, (a[2] + sign(dy) * (i * abs(dy) // n)) % 3072) for i in range(1, n)}


@pytest.mark.parametrize("together", [1, 1 << 18])
def test_sight_by_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(spatial, "_PAIRS_SEEN", together)
    things = crowd(300, 2)
    df = spark.createDataFrame(things, COLUMNS)
    got = sorted(map(tuple, spatial.seen(df.filter("id % 4 = 0"), df, 40).collect()))
    large = {t[1:3] for t in things if t[8]}
    pairs = [(a, b) for a in things if a[0] % 4 == 0 for b in things if a[0] != b[0] and max(gap(a[1], b[1]), gap(a[2], b[2])) <= 40]
    assert got == sorted((a[0], b[0], not way(a, b) & large) for a, b in pairs)


@pytest.mark.parametrize("radius", [0, 24, 60, 1527])
def test_pairs_by_cell_are_those_by_chunk(spark, radius):
    df = spark.createDataFrame(crowd(60, 3) + [(70, None, 4, 0, 0, False, False, True, False)], COLUMNS)
    pairs = lambda f: sorted(map(tuple, f(df.filter("id % 3 = 0"), df, radius).select("p_id", "id", "dist").collect()))
    assert pairs(spatial.near_by_cell) == pairs(spatial.near)


@pytest.mark.parametrize("name", ["j1_find_nearby", "a7_opponents", "g4_line_of_sight"])
def test_pairs_are_not_shuffled(spark, name):
    plan = plan_of(world.QUERIES[name](spark, DIR))
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert dealt and not [line for line in dealt if "p_id" in line or "x#" in line and "hashpartitioning(x#" in line or "to_id" in line]


@pytest.mark.parametrize("radius, rows", [(0, 1 << 17), (24, 50), (60, 1), (1527, 1 << 17)])
def test_ids_nearby_are_those_of_find_nearby(spark, monkeypatch, radius, rows):
    monkeypatch.setattr(spatial, "_ROWS", rows)
    things = [(*t[:4], t[4], t[0] % 3, 0) for t in crowd(150, 4)] + [(200, None, 4, 0, 1, 0, 0), (201, 3, None, 0, 1, 0, 0), (202, 3, 3, None, 1, 0, 0), (None, 3, 3, None, 1, 0, 0), (204, 3, 3, 5, 1, 0, 0), (205, 3075, -2, 5, 1, 0, 0)]
    df = spark.createDataFrame(things, "id long, tx long, ty long, tz long, shape long, frame long, quality long")
    probes = df.filter("id % 3 = 0 OR id > 200")
    for wanted in ({}, {"shape": 1}, {"frame": 7}):
        got, want = (sorted(map(tuple, f(probes, df, radius, **wanted).select("p_id", "id", "dist", "place").collect()), key=lambda t: (t[0], t[3])) for f in (spatial.nearby_ids, spatial.find_nearby))
        assert got == want and bool(want) == ("frame" not in wanted)


def test_pairs_are_not_sorted(spark):
    """Before, all pairs of a cell were sorted to number them."""
    plan = plan_of(world.QUERIES["j1_find_nearby"](spark, DIR))
    assert "Window" not in plan and "Join" not in plan


KINDS = ["monster", "teleport", "jukebox", "missile", "fire_field", None]


def steps_and_eggs(spark, seed):
    r = random.Random(seed)
    place = lambda: (r.choice([3066, 0, 6]) + r.randrange(6)) % 3072
    flag = lambda: r.choice([True, False, None])
    steps = [(i, *(p := (place(), place())), r.randrange(6), (p[0] + r.randrange(-2, 3)) % 3072 if i % 9 else None, (p[1] + r.randrange(-2, 3)) % 3072, flag(), flag(), flag(), r.choice([3, 12, None])) for i in range(150)]
    eggs = [(i, place(), place(), r.randrange(6), r.choice([0, 1, 3, 9, 1535, 1600, None]), r.choice([*range(8), None]), r.choice(KINDS), flag(), flag(), flag(), flag()) for i in range(200)]
    columns = "id long, tx long, ty long, tz long, from_tx long, from_ty long, main boolean, in_party boolean, actor boolean, hour long"
    of_eggs = "id long, tx long, ty long, tz long, reach long, criteria long, kind string, nocturnal boolean, hatched boolean, auto_reset boolean, revocable boolean"
    return spark.createDataFrame(steps, columns), spark.createDataFrame(eggs, of_eggs)


IN = "(pmod({x} - e.tx + e.reach - {s}, 3072) < 2 * e.reach + 1 - 2 * {s} AND pmod({y} - e.ty + e.reach - {s}, 3072) < 2 * e.reach + 1 - 2 * {s})"
NOW, OLD, NOW1, OLD1 = (IN.format(x=x, y=y, s=s) for s in (0, 1) for x, y in (("m.tx", "m.ty"), ("from_tx", "from_ty")))
ON_LEVEL = "(abs(m.tz - e.tz) < 2 OR kind = 'missile' AND abs(m.tz - e.tz) < 5)"
NEAR = f"CASE WHEN kind = 'teleport' THEN m.tz = e.tz WHEN kind = 'jukebox' THEN true ELSE {ON_LEVEL} AND NOT {OLD} END"
FIRES = f"""{NOW} AND NOT (hatched AND NOT auto_reset) AND NOT (nocturnal AND hour > 4 AND hour < 21) AND CASE criteria WHEN 0 THEN main AND (NOT hatched OR NOT {OLD}) WHEN 1 THEN in_party AND {NEAR}
 WHEN 2 THEN main AND in_party AND {NEAR} WHEN 3 THEN main AND {OLD1} AND NOT {NOW1} WHEN 4 THEN main AND m.tz = e.tz WHEN 5 THEN m.tz = e.tz AND CASE WHEN kind = 'fire_field' THEN actor ELSE in_party END WHEN 6 THEN abs(m.tz - e.tz) < 4 AND NOT actor ELSE false END"""
CLOSE = f"CASE WHEN kind = 'teleport' THEN false WHEN kind = 'jukebox' THEN NOT {NOW} AND {OLD} ELSE NOT ({ON_LEVEL} AND {NOW} AND NOT {OLD}) END"
OFF = f"(NOT {NOW} OR m.tz <> e.tz)"
SETS_BACK = f"""({NOW} OR {OLD} AND NOT {NOW}) AND main AND revocable AND hatched AND (nocturnal AND hour > 4 AND hour < 21 OR CASE criteria WHEN 0 THEN {OLD} AND NOT {NOW} WHEN 1 THEN in_party AND {CLOSE} WHEN 2 THEN in_party AND {CLOSE}
 WHEN 3 THEN {OLD} AND NOT {OLD1} AND {NOW1} WHEN 4 THEN {OFF} WHEN 5 THEN {OFF} AND CASE WHEN kind = 'fire_field' THEN actor ELSE in_party END WHEN 6 THEN (NOT {NOW} OR abs(m.tz - e.tz) >= 4) AND NOT actor ELSE false END)"""


@pytest.mark.parametrize("operator, rule", [(spatial.triggered, FIRES), (spatial.untriggered, SETS_BACK)])
def test_triggers_by_all_pairs_with_nulls(spark, operator, rule):
    steps, eggs = steps_and_eggs(spark, 5)
    want = spark.sql(f"SELECT e.id AS egg, m.id AS step FROM {{m}} m CROSS JOIN {{e}} e WHERE {rule}", m=steps, e=eggs).collect()
    got = operator(steps, eggs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 50


@pytest.mark.parametrize("name", ["j3_w5_w6_triggers", "w7_untriggered"])
def test_triggers_are_merged_and_never_broadcast(spark, name):
    plan = plan_of(world.QUERIES[name](spark, DIR))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    conditions = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert max(map(len, conditions)) < 1500  # the method of a larger one is not compiled


def test_edges_are_sought_in_a_growing_square(spark, monkeypatch):
    r, seen = random.Random(3), []
    rows = [(i, i % 2, (3060 + r.randrange(40)) % 3072, (3060 + r.randrange(40)) % 3072, r.randrange(9), r.randrange(1, 4), r.randrange(1, 4), r.randrange(3)) for i in range(400)]
    rows += [(900, 0, 1500, 1500, 0, 1, 1, 1), (901, 0, 1513, 1490, 0, 3, 1, 1), (902, 1, 1500, 1501, 0, 1, 1, 1)]  # one with a far neighbour, one with none on its map
    things = spark.createDataFrame(rows, "id long, map long, tx long, ty long, tz long, xs long, ys long, zs long")
    monkeypatch.setattr(spatial, "near", lambda p, o, radius, *rest, near=spatial.near: seen.append((radius, p.count())) or near(p, o, radius, *rest))
    got = {x.p_id: (x.id, x.far) for x in composites.nearest_by_edges(things.filter("id % 4 = 0 OR id > 900"), things, 20).collect()}
    flat = "{{p}} p JOIN {{o}} o ON o.map = p.map AND o.id <> p.id AND {0} <= 20".format("greatest(least(abs(p.tx - o.tx), 3072 - abs(p.tx - o.tx)), least(abs(p.ty - o.ty), 3072 - abs(p.ty - o.ty)))")
    pairs = spark.sql(f"SELECT p.id AS p_id, o.*, p.tx AS p_tx, p.ty AS p_ty, p.tz AS p_tz, p.xs AS p_xs, p.ys AS p_ys, p.zs AS p_zs FROM {flat}", p=things.filter("id % 4 = 0 OR id > 900"), o=things)
    far = F.greatest(*[exprs.footprint_gap(F.col(f"p_t{c}"), F.col(f"t{c}"), F.col(f"p_{c}s"), F.col(f"{c}s")) for c in "xy"], exprs.height_gap(F.col("p_tz"), F.col("tz"), F.col("p_zs"), F.col("zs")))
    want = pairs.withColumn("far", far).groupBy("p_id").agg(F.min(F.struct("far", -F.col("ty"), -F.col("tx"), -F.col("tz"), "id")).alias("b")).select("p_id", "b.id", "b.far").collect()
    assert got == {x.p_id: (x.id, x.far) for x in want} and 900 in got and 902 not in got
    assert seen[-1][0] == 20 and seen[-1][1] < 10  # only what nothing is near to is sought that far
