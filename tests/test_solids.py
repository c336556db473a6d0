"""Solid things: falling against a step-by-step simulation, and odd inputs of all operators over tiles."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.operators import solids
from gridloom.plans import world

DIR = "/root/testdata/sf0.001"
THING = "id long, map long, tx long, ty long, tz long, xs long, ys long, zs long"
FALL = f"{THING}, movable boolean, gone boolean"


def simulate(things, max_drop=255, within=None, at_once=True):
    """Each time looking at all that is below; one thing after another, or all of a round at once."""
    by = {t["id"]: dict(t) for t in things}
    tiles = {i: {(t["map"], (t["tx"] - a) % 3072, (t["ty"] - b) % 3072) for a in range(t["xs"]) for b in range(t["ys"])} for i, t in by.items()}
    on = {}
    for i, cells in tiles.items():
        for c in cells:
            on.setdefault(c, set()).add(i)
    standing = {i for i, t in by.items() if not t["gone"]}

    def floors(i):
        tz = by[i]["tz"]
        return [max([0, *(by[o]["tz"] + by[o]["zs"] for o in on[c] & standing if o != i and by[o]["tz"] < tz)]) for c in tiles[i]]

    def falls(i):
        f, tz = floors(i), by[i]["tz"]
        return max(f) < tz and (within is None or tz - min(f) <= within) and tz - 1 - min(f) <= max_drop

    def gravity(cells, lift):
        for i in sorted({o for c in cells for o in on[c] & standing if by[o]["movable"] and by[o]["tz"] >= lift and falls(o)}):
            if falls(i):
                by[i]["tz"] = max(floors(i))
                gravity(tiles[i], by[i]["tz"] + by[i]["zs"])

    was = {i: t["tz"] for i, t in by.items()}
    freed = [(tiles[i], by[i]["tz"] + by[i]["zs"]) for i in sorted(set(by) - standing)]
    if not at_once:
        for cells, lift in freed:
            gravity(cells, lift)
    while at_once and freed:
        above = {o for cells, lift in freed for c in cells for o in on[c] & standing if by[o]["movable"] and by[o]["tz"] >= lift}
        down = {o: max(floors(o)) for o in above if falls(o)}
        for o, tz in down.items():
            by[o]["tz"] = tz
        freed = [(tiles[o], by[o]["tz"] + by[o]["zs"]) for o in down]
    return {(i, by[i]["tz"]) for i in standing if by[i]["tz"] != was[i]}


def stack():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{DIR}/orders.parquet'")
    rel = con.sql(world.VIEWS["stack"])
    return [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]


@pytest.mark.parametrize("within", [None, 17])
def test_falling_equals_a_simulation(spark, within):
    things = stack()
    want = simulate(things, 100, within)
    got = {tuple(r) for r in solids.fallen(world.view(spark, DIR, "stack"), within=within).collect()}
    assert got == want and len(want) > 20


def test_without_bounds_the_order_of_falling_does_not_matter(spark):
    want = simulate(stack(), at_once=False)
    got = {tuple(r) for r in solids.fallen(world.view(spark, DIR, "stack"), 255).collect()}
    assert got == want == simulate(stack()) and len(want) > 500


@pytest.mark.parametrize("seed", range(3))
def test_falling_of_random_towers(spark, seed):
    rng, rows, i = random.Random(seed), [], 0
    for x in range(6):  # towers of two tiles that share one with their neighbour, each level in a band of its own
        for level in range(9):
            i += 1
            rows.append((i, 0, x + 1, 5, level * 6 + (x % 2) * 3 + rng.randrange(2), 2, 1, rng.randrange(1, 3), rng.random() < 0.9, rng.random() < 0.2))
    names = [f.split()[0] for f in FALL.split(", ")]
    for max_drop, within in ((100, None), (9, None), (100, 4)):
        want = simulate([dict(zip(names, r, strict=True)) for r in rows], max_drop, within)
        got = {tuple(r) for r in solids.fallen(spark.createDataFrame(rows, FALL), max_drop, within).collect()}
        assert got == want


def shuffled(spark, since):
    """Records shuffled by the stages after one, and the last stage."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [stages.apply(k) for k in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in stages if s.stageId() > since), max(s.stageId() for s in stages)


@pytest.mark.parametrize("within", [None, 17])
def test_rounds_do_not_shuffle_what_stays(spark, within):
    tower = [(k, 0, 1, 1, 3 * k, 1, 1, 1, True, k % 3 == 0) for k in range(9)]  # gaps of two and five levels, several rounds
    still = [(100 + k, 0, 10 + k % 3000, 10 + k // 3000, 0, 1, 1, 1, True, False) for k in range(20_000)]
    things = spark.createDataFrame(tower + still, FALL)
    spark.range(1).repartition(2).collect()
    _, since = shuffled(spark, -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {tuple(r) for r in solids.fallen(things, 100, within).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    names = [f.split()[0] for f in FALL.split(", ")]
    assert got == simulate([dict(zip(names, r, strict=True)) for r in tower], 100, within) == {(1, 0), (2, 1), (4, 2), (5, 3), (7, 4), (8, 5)}
    assert shuffled(spark, since)[0] < 4 * len(still)  # three times at the start, whatever the number of rounds


def test_nothing_falls_without_a_gap_or_things(spark):
    rows = [(1, 0, 5, 5, 0, 1, 1, 3, True, False), (2, 0, 5, 5, 3, 1, 1, 1, True, False), (3, 0, 9, 9, 4, 1, 1, 1, False, False), (4, 0, 9, 9, 2, 1, 1, 2, True, True)]
    assert solids.fallen(spark.createDataFrame(rows, FALL)).count() == 0
    assert solids.fallen(spark.createDataFrame([], FALL)).count() == 0


def test_levels_by_hand(spark):
    things = spark.createDataFrame([(1, 0, 5, 5, 0, 2, 1, 3), (2, 0, 5, 5, 6, 1, 1, 2), (3, 0, 0, 0, 0, 1, 1, 1), (4, None, 7, 7, 0, 1, 1, 9), (1, 0, 5, 5, 0, 2, 1, 3), (9, 0, 3, 3, 0, 1, 1, 0)], THING)
    columns = solids.spans(things)
    assert {(r.x, r.y, tuple((s.low, s.high) for s in r.spans)) for r in columns.collect()} == {(4, 5, ((0, 3),)), (5, 5, ((0, 3), (6, 8))), (0, 0, ((0, 1),))}

    def lift(moves, drop, *probe, rise=None):
        return solids.landed(spark.createDataFrame([(1, 0, *probe)], THING), columns, moves, drop, rise).head().lift

    walk = solids.WALK
    assert lift(walk, 1, 5, 5, 3, 1, 1, 3) == 3  # between two things
    assert lift(walk, 1, 5, 5, 3, 1, 1, 4) is None  # not high enough
    assert lift(walk, 1, 5, 5, 2, 1, 1, 3) == 3 and lift(walk, 1, 5, 5, 1, 1, 1, 3) is None  # one step up, not two
    assert lift(solids.FLY, 9, 5, 5, 1, 1, 1, 9) == 8  # over everything
    assert lift(walk, 5, 4, 5, 8, 1, 1, 1) == 3 and lift(walk, 4, 4, 5, 8, 1, 1, 1) is None
    assert lift(solids.EDIT | solids.FLY, 4, 4, 5, 8, 1, 1, 1) == 4 and lift(walk | solids.LEVITATE, 0, 4, 5, 8, 1, 1, 1) == 8
    assert lift(solids.ETHEREAL, 0, 5, 5, 1, 1, 1, 1) == 1 and lift(0, 0, 9, 9, 0, 1, 1, 1) is None
    assert lift(walk, 9, 0, 0, 1, 2, 2, 1) == 1  # the highest of four tiles round the corner of the world
    assert lift(solids.FLY, 255, 5, 5, 255, 1, 1, 1) == 8


def test_odd_probes_and_empty_tables(spark):
    none = spark.createDataFrame([], THING)
    probes = spark.createDataFrame([(1, 0, 5, 5, 0, 1, 1, 1), (2, None, 5, 5, 0, 1, 1, 1), (3, 0, 5, 5, 0, None, 1, 1), (4, 0, 5, 5, 4, 1, 1, 1)], THING).withColumn("level", F.lit(7)).withColumn("spans", F.lit("x"))
    landed = {tuple(r) for r in solids.landed(probes, solids.spans(none), solids.WALK, 4).collect()}
    assert landed == {(1, 0), (2, 0), (4, 0)}  # no footprint, no row; no map, no things
    assert solids.landed(none, solids.spans(probes), solids.WALK, 4).count() == 0
    assert solids.free_places(none, solids.spans(probes), 2, 0, 1).count() == 0
    full = solids.spans(spark.createDataFrame([(i, 0, x, y, 0, 1, 1, 200) for i, (x, y) in enumerate((x, y) for x in range(3, 8) for y in range(3, 8))], THING))
    spot = spark.createDataFrame([(1, 0, 5, 5, 0, 1, 1, 1)], THING)
    assert solids.free_places(spot, full, 2, 0, 1).count() == 0
    assert solids.free_places(spot, full, 3, 0, 1).head()[1:] == (4, 2, 0, 3)  # where the range about north begins
    assert solids.roofs(none.withColumn("kind", F.lit(1)).withColumn("whole", F.lit(False)).withColumn("seq", F.lit(0))).count() == 0


def test_roofs_painted_last_stay(spark):
    tops = spark.createDataFrame([(1, 0, 20, 20, 5, 2, 1, 1, 1, False, 1), (2, 0, 20, 20, 9, 1, 1, 1, 2, False, 0), (3, 0, 40, 40, 0, 1, 1, 1, 1, True, 0), (4, 0, 90, 90, 3, 1, 1, 1, 0, True, 0)], f"{THING}, kind int, whole boolean, seq int")
    roofs = {(r.x, r.y): r.roof for r in solids.roofs(tops).collect()}
    assert roofs[20, 20] == roofs[19, 20] == 5 and len(roofs) == 2 + 256 and roofs[32, 47] == 0
    assert {r.roof for r in solids.roofs(tops, 5).collect()} == {5}
    at = spark.createDataFrame([(1, 0, 20, 20), (2, 0, 40, 40), (3, 1, 20, 20), (4, None, 20, 20)], "id long, map long, tx long, ty long")
    assert {tuple(r) for r in solids.lights(at, solids.roofs(tops)).collect()} == {(1, True), (2, False), (3, False), (4, False)}
    assert [tuple(r) for r in solids.ice_quarters(tops).collect()] == [(0, 1, 1, 1)]
