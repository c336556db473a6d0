"""Filling boxes, composites over footprints and names: odd tables by hand."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import composites, dims, hierarchy, spatial

THING = "id long, parent long, shape long, frame long, quantity long, weight long, closed boolean, limit long"
ASK = "req long, box long, delta long"


def test_filling_a_box_by_hand(spark):
    rows = [
        (1, None, 9, 0, 1, 10, False, 20),  # a box that bears 20: 200 tenths, of which 60 are used
        (2, 1, 5, 1, 6, 10, False, 0), (3, 1, 8, 0, 1, 10, False, 0), (4, 3, 5, 1, 1, 10, False, 0), (5, 1, 8, 0, 1, 10, True, 0), (6, 5, 5, 1, 1, 10, False, 0),
        (7, None, 8, 0, 1, 0, None, 0), (8, 7, 5, 2, 1, 0, False, 0), (9, 7, 5, 1, 10, 0, False, 0), (10, 77, 5, 1, 3, 0, False, 0), (None, 7, 5, 1, 1, 0, False, 0),
    ]
    things = spark.createDataFrame(rows, THING).withColumns({"path": F.lit("x"), "room": F.lit(1), "root": F.lit(2)})
    asked = spark.createDataFrame([(1, 1, 8), (2, 1, 50), (3, 5, 4), (4, 7, 3), (5, 99, 3), (6, 1, 0), (7, 1, None), (8, 3, 5), (9, 10, 2), (10, None, 4)], ASK)
    got = {r.req: (r.filled, r.created, r.remainder, [tuple(f) for f in r.fillings]) for r in hierarchy.added_within(asked, things, 5, 1, 100, 10).collect()}
    assert got[1] == (8, 0, 0, [(2, 4), (4, 4)])
    assert got[2] == (13, 1, 36, [(2, 4), (4, 9)])  # 140 tenths are left, ten for each
    assert got[3] == (0, 0, 4, []) and got[5] == (0, 0, 3, []) and got[10] == (0, 0, 4, [])  # closed, not there, null
    assert got[4] == (0, 3, 0, [])  # the null id is no stack, the full one takes none, the other frame does not count
    assert got[6] == got[7] == (0, 0, 0, []) and got[8] == (5, 0, 0, [(4, 5)]) and got[9] == (0, 0, 2, [])  # of the shape itself
    assert hierarchy.added_within(asked.filter("false"), things, 5, 1, 100, 10).count() == 0
    assert {r.remainder for r in hierarchy.added_within(asked, things.filter("false"), 5, 1, 100, 10).collect()} == {8, 50, 4, 3, 0, 5, 2}


PLACE = "id long, map long, tx long, ty long, tz long, xs long, ys long, zs long"


def test_beds_plates_and_edges_of_odd_things(spark):
    beds = spark.createDataFrame([(1, 0, 1, 1, 3, 3, 2, 1), (2, 0, 50, 50, 0, 1, 1, 1), (3, None, 1, 1, 3, 3, 2, 1), (4, 1, 1, 1, 3, 3, 2, 1)], PLACE).withColumns({"actor": F.when(F.col("id") == 2, 9), "dist": F.lit("x"), "_cx": F.lit(1)})
    actors = spark.createDataFrame([(9, 0, 50, 50, 1), (9, 0, 50, 50, 1), (8, 0, 3071, 0, 4), (7, 0, 1, 1, 5), (6, None, 1, 1, 3), (None, 0, 1, 1, 4)], "id long, map long, tx long, ty long, tz long")
    assert {tuple(r) for r in composites.beds_taken(beds, actors).collect()} == {(1, True), (2, False), (3, False), (4, False)}
    plates = spark.createDataFrame([(20, 0, 3, 1, 3, None), (21, 0, 9, 1, 4, False), (22, 0, 9, 1, 4, True), (23, 0, 9, 1, 9, False), (24, 0, 6, 1, 3, False)], "id long, map long, tx long, ty long, tz long, temporary boolean")
    assert [tuple(r) for r in composites.unattended(beds.filter("id = 1"), plates, actors).orderBy("place").collect()] == [(1, 24, 1), (1, 21, 2)]
    things = spark.createDataFrame([(30, 0, 4, 1, 3, 3, 1, 1), (31, 0, 3070, 1, 3, 1, 1, 1), (32, 0, None, 1, 3, 1, 1, 1)], PLACE)
    assert [tuple(r) for r in composites.nearest_by_edges(beds.filter("id = 1"), things, 10).collect()] == [(1, 31, 1)]  # as near as 30, and further east
    for f in (composites.beds_taken(beds.filter("false"), actors), composites.unattended(beds, plates.filter("false"), actors), composites.nearest_by_edges(beds, things.filter("false"), 10)):
        assert f.count() == 0


def test_searches_with_clashing_names(spark):
    a = spark.createDataFrame([(1, 5, 5, 5, "p")], "id long, tx long, ty long, tz long, cx string")
    b = spark.createDataFrame([(2, 6, 6, 5, "o", 9), (3, None, 6, 5, "o", 9)], "id long, tx long, ty long, tz long, cx string, cy int")
    got = spatial.near(a, b, 3).collect()
    assert [(r.p_id, r.id, r.p_cx, r.cx, r.cy, r.dist) for r in got] == [(1, 2, "p", "o", 9, 1)]
    assert spatial.near(a.filter("false"), b, 3).count() == spatial.near(a, b.filter("false"), 3).count() == 0


@pytest.mark.parametrize("quality,kind,want", [(3, 3, "Ann says"), (3, 4, "saysAnn"), (4, 3, "other"), (9, 3, "other"), (None, 3, "other")])
def test_names_of_actors(spark, quality, kind, want):
    things = spark.createDataFrame([(1, 7, 0, quality, None)], "id long, shape long, frame long, quality long, live_npc long")
    frames = spark.createDataFrame([(7, 0, kind, 0, 1)], "shape long, frame long, kind int, msg int, other int")
    messages = spark.createDataFrame([(0, " says" if kind == 3 else "says"), (1, "other")], "idx int, text string")
    shapes = spark.createDataFrame([(7, "a/b/c/d", True, False, False)], "shape long, name string, has_quality boolean, has_quantity boolean, body boolean")
    actors = spark.createDataFrame([(3, "Ann", False, False), (4, "Bob", True, True), (9, "", False, True)], "npc long, name string, unused boolean, met boolean")
    assert dims.display_names(things, frames, messages, shapes, actors).head().name == want
    assert dims.display_names(things, frames.filter("false"), messages, shapes, actors).head().name == "a bc"
    assert dims.display_names(things, frames.filter("false"), messages, shapes.filter("false"), actors.filter("false")).head().name == ""
    assert dims.display_names(things.filter("false"), frames, messages, shapes, actors).count() == 0
