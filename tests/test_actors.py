"""Records of actors and schedules: odd values, cut files, and files by hand."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom.sources import actors

SLOT = "npc long, time long, kind long, tx long, ty long, tz long, days long"


def test_fields_do_not_overlap():
    bits = [(8 * f.at + f.low + i) for f in actors.NPC for i in range(f.width())]
    assert len(bits) == len(set(bits)) and max(bits) < 8 * actors.NAME_AT
    assert all(f.low + f.width() <= 8 * f.size for f in actors.NPC)


def people(spark, rows):
    names = [f.name for f in actors.NPC]
    schema = "npc long, name string, " + ", ".join(f"`{n}` long" for n in names)
    return spark.createDataFrame([(npc, name, *[values.get(n) for n in names]) for npc, name, values in rows], schema)


def test_odd_actors(spark):
    rows = people(spark, [(0, None, {}), (1, "a name that is longer than there is room", {"health": -1, "food": -128, "polymorph16": -300, "experience": 2**32 - 1, "sid": 143, "x": 255, "y": 254}), (2, "é", {"shape": 5000, "health": 200}), (205, "far", {"lift": 15})])
    files = actors.write_npcs(rows)
    got = {r.npc: r for r in actors.npcs(files).collect()}
    assert sorted(got) == [0, 1, 2, 200]  # places in a file are counted, not kept
    assert got[0].name == "" and got[0].health == 0 and got[1].name == "a name that is longer"[:15]
    assert (got[1].health, got[1].food, got[1].polymorph16, got[1].experience, got[1].tx, got[1].ty) == (-1, -128, -300, 2**32 - 1, 11 * 256 + 255, 11 * 256 + 254)
    assert (got[2].name, got[2].shape, got[2].health, got[200].lift) == ("é", 5000 % 1024, 200 - 256, 15)
    cut = files.filter("file = 0").withColumn("content", F.substring("content", F.lit(1), F.lit(3 * actors.NPC_SIZE - 1)))
    assert actors.npcs(cut).count() == 2
    assert actors.npcs(files.withColumn("content", F.lit(None).cast("binary"))).count() == actors.npcs(actors.write_npcs(rows.filter("false"))).count() == 0


def test_schedules_by_hand(spark):
    content = bytes([3, 0, 0, 0, 0, 0, 1, 0, 2, 0, 2 | 5 << 3, 10, 20, 13, 7 | 31 << 3, 255, 255, 143])
    files = spark.createDataFrame([(0, bytearray(content)), (1, bytearray(content[:-1])), (2, None), (3, bytearray(b"")), (4, bytearray(content[:7]))], "file long, content binary")
    got = sorted(map(tuple, actors.schedules(files).collect()))
    assert got == [(1, 2, 5, 266, 276, 0, 127), (2, 7, 31, 3071, 3071, 0, 127), (4, 2, 5, 266, 276, 0, 127)]


@pytest.mark.parametrize("form,scripts", [(actors.LONG, ()), (actors.NAMED, ()), (actors.NAMED, ("a", "", "zwölf"))])
def test_wide_schedules(spark, form, scripts):
    slots = [(1, 7, 200, 3071, 0, 15, 1), (1, 0, 3, 5, 6, 7, 127), (9, 1, 1, 1, 1, 1, 1), (25, 2, 2, 2, 2, 2, 2)]
    files = actors.write_schedules(spark.createDataFrame(slots, SLOT).withColumn("size", F.lit("x")), 10, form, scripts)
    assert sorted(map(tuple, actors.schedules(files).collect())) == sorted(slots)
    assert sorted({(r.place, r.name) for r in actors.schedule_scripts(files).collect()}) == list(enumerate(scripts))
    assert actors.write_schedules(spark.createDataFrame([], SLOT), 10, form, scripts).count() == 0


def test_too_many_entries_are_an_error(spark):
    slots = spark.range(actors.MOST_ENTRIES + 1).select(F.lit(1).cast("long").alias("npc"), *[(F.col("id") % 8).alias(c) for c in ("time", "kind", "tx", "ty", "tz", "days")])
    with pytest.raises(PySparkException, match="65,535"):
        actors.write_schedules(slots, 10).collect()
