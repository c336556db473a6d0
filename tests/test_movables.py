"""Movable objects: records by hand, nesting, cut files, and which partitions a stored world reads."""

import pytest
from pyspark.sql import functions as F

from gridloom.plans import queries as world
from gridloom.sources import movables

DIR = "/root/testdata/sf0.001"
OBJECT = "id long, parent long, map long, tx long, ty long, lift int, shape int, frame int, quality int, flags int, slot int, kind string"
SIMPLE = bytes([6, 0x12, 0x34, 5, 0x08, 0x70, 9])  # shape 5, frame 2, lift 7


def rows(data, classes=None):
    names = [f.split()[0] for f in movables.FIELDS.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in movables.records(data, classes or {})]


def test_records_by_hand():
    (one,) = rows(SIMPLE)
    assert (one["kind"], one["x"], one["y"], one["shape"], one["frame"], one["lift"], one["quality"]) == ("simple", 0x12, 0x34, 5, 2, 7, 9)
    (wide,) = rows(bytes([254, 7, 1, 2, 0x10, 0x27, 77, 0xF1, 3]))
    assert (wide["shape"], wide["frame"], wide["lift"], wide["quality"]) == (10_000, 77, 31, 3)
    assert rows(bytes([253, 6, 1, 2, 5, 8, 0xF1, 3]))[0]["lift"] == 31 and rows(bytes([6, 1, 2, 5, 8, 0xF1, 3]))[0]["lift"] == 15
    assert rows(bytes([10, 1, 2, 5, 8, 0x10, 3, 1, 0, 0, 0]))[0]["flags"] == 1
    body = bytes([13, 1, 2, 5, 8, 0, 0, 0, 1, 44, 1, 0x20, 0, 9])
    assert (rows(body)[0]["kind"], rows(body)[0]["npc"], rows(body)[0]["lift"], rows(body)[0]["flags"]) == ("body", 300, 2, 9)
    assert rows(bytes([12, 1, 2, 5, 8, 0, 0, 0, 1, 130, 0x30, 0, 9]), {5: "body"})[0]["npc"] == 2
    egg = bytes([12, 1, 2, 5, 8, 3, 1, 7, 7, 7, 0x40, 0, 0])
    assert (rows(egg, {5: "egg"})[0]["kind"], rows(egg, {5: "egg"})[0]["type"], rows(egg, {5: "egg"})[0]["lift"]) == ("egg", 259, 4)
    book = bytes([18, 1, 2, 5, 8, *range(5), 0x50, *range(8)])
    assert (rows(book)[0]["kind"], rows(book)[0]["lift"], len(rows(book)[0]["entry"])) == ("spellbook", 5, 18)
    assert rows(bytes([14, *egg[1:], 0, 0]), {5: "egg"})[0]["kind"] == "egg"


def test_nesting_slots_and_marks():
    box = lambda inside: bytes([12, 1, 2, 6, 8, 1, 0, 0, 0, 0, 0x10, 0, 0]) + inside + b"\x01"
    data = box(bytes([2, 7, 0]) + SIMPLE + box(SIMPLE) + SIMPLE) + bytes([255, 1, 3, 0, 9, 9, 9]) + b"\x00" + bytes([9]) + b"x" * 9 + SIMPLE
    got = [(r["depth"], r["parent_seq"], r["slot"], r["special"]) for r in rows(data)]
    assert got == [(0, None, None, 0), (1, 0, 7, 0), (1, 0, 7, 0), (2, 2, None, 0), (1, 0, 7, 1), (0, None, None, 0)]


@pytest.mark.parametrize("cut", range(1, 40))
def test_a_cut_file_gives_its_whole_records(cut):
    data = bytes([12, 1, 2, 6, 8, 1, 0, 0, 0, 0, 0x10, 0, 0]) + SIMPLE + bytes([2, 7, 0]) + SIMPLE + bytes([255, 1, 2, 0, 9, 9])
    assert len(rows(data[:cut])) == sum(cut >= end for end in (13, 20, 30))


def objects(spark):
    data = [(1, None, 0, 10, 20, 3, 5, 1, 7, 0, None, "container"), (2, 1, 0, 300, 4, 1, 6, 2, 8, 8, None, "body"), (3, 2, 0, 5, 6, 200, 2000, 90, 9, 0, None, "simple"),
            (4, 3, 9, 0, 0, 0, 8, 0, 0, 0, 5, "simple"), (5, 99, 1, 700, 900, 2, 7, 3, 1, 0, None, "temporary"), (6, 7, 0, 1, 1, 1, 1, 1, 1, 1, None, "container"), (7, 6, 0, 1, 1, 1, 1, 1, 1, 1, None, "container")]
    return spark.createDataFrame([r if r[0] != 3 else (*r[:11], "container") for r in data], OBJECT).withColumns({"path": F.lit("x"), "root": F.lit(1), "x": F.lit(2)}).drop("path", "root", "x")


def test_written_and_read(spark):
    found = movables.movables(movables.write_movables(objects(spark))).orderBy("map_id", "seq").collect()
    got = [(r.map_id, r.sid, r.depth, r.kind, r.x, r.y, r.lift, r.shape, r.frame, r.quality, r.flags, r.slot) for r in found]
    assert got == [(0, 0, 0, "container", 10, 20, 3, 5, 1, 7, 0, None), (0, 0, 1, "body", 44, 4, 1, 6, 2, 8, 8, None), (0, 0, 2, "container", 5, 6, 200, 2000, 90, 9, 0, None),
                   (0, 0, 3, "simple", 0, 0, 0, 8, 0, 0, 0, 5), (1, 38, 0, "simple", 188, 132, 2, 7, 3, 1, 1, None)]  # those in a circle have no place
    assert movables.movables(movables.write_movables(objects(spark).filter("false"))).count() == 0
    files = spark.createDataFrame([(0, 1, 0, None), (0, 1, 1, b""), (0, 1, 0, SIMPLE), (0, 1, 0, SIMPLE)], "map_id long, sid int, part int, content binary")
    assert movables.movables(files).count() == 2


def partitions_read(df):
    """How many partitions and files the scan of a query that has run read."""
    def leaves(plan):
        while "AdaptiveSparkPlan" in plan.nodeName():
            plan = plan.executedPlan()
        if plan.nodeName().endswith("QueryStage"):
            yield from leaves(plan.plan())
        elif not plan.children().size():
            yield plan
        for i in range(plan.children().size()):
            yield from leaves(plan.children().apply(i))

    for leaf in leaves(df._jdf.queryExecution().executedPlan()):
        if leaf.nodeName().startswith("Scan parquet") and leaf.metrics().contains("numPartitions"):
            return leaf.metrics().apply("numPartitions").value(), leaf.metrics().apply("numFiles").value()


def test_only_the_superchunks_that_are_reached_are_read(spark, tmp_path, monkeypatch):
    world = spark.range(4000).select("id", (F.col("id") % 2).alias("map"), (F.col("id") * 37 % 3072).alias("tx"), (F.col("id") * 101 % 3072).alias("ty"))
    path = (tmp_path / "world").as_uri()
    movables.store(world, path)
    there = world.select("map", movables.superchunk(F.col("tx"), F.col("ty")).alias("sid")).distinct().count()
    probes = spark.createDataFrame([(0, 3070, 5), (0, 300, 300)], "map long, tx long, ty long")
    needed = movables.reached(probes, 10)
    assert {tuple(r) for r in needed.collect()} == {(0, 0), (0, 11), (0, 132), (0, 143), (0, 13)}
    found = movables.stored(spark, path, needed)
    got = {r.id for r in found.collect()}
    partitions, files = partitions_read(found)
    assert partitions <= 5 < there and files <= 5
    sids = {0, 11, 132, 143, 13}
    assert got == {r.id for r in world.filter(F.col("map") == 0).collect() if r.ty // 256 * 12 + r.tx // 256 in sids}
    monkeypatch.setattr(movables, "MOST_PRUNED", 2)  # too many to name: joined instead
    assert {r.id for r in movables.stored(spark, path, needed).collect()} == got
    assert movables.stored(spark, path, needed.filter("false")).count() == 0
    assert movables.stored(spark, path).count() == 4000


def test_a_stored_world_has_few_directories_however_many_maps(spark, tmp_path):
    """Before, each map had directories of its own."""
    world = spark.range(3000).select("id", (F.col("id") % 300).alias("map"), (F.col("id") * 37 % 512).alias("tx"), (F.col("id") * 101 % 512).alias("ty"))
    movables.store(world, (tmp_path / "world").as_uri(), 2)
    assert sum(p.is_dir() for p in (tmp_path / "world").rglob("*")) == 4
    probes = spark.createDataFrame([(7, 300, 300)], "map long, tx long, ty long")
    got = {r.id for r in movables.stored(spark, (tmp_path / "world").as_uri(), movables.reached(probes, 10)).collect()}
    assert got == {r.id for r in world.filter("map = 7 AND tx >= 256 AND ty >= 256").collect()}


def test_files_are_written_and_read_once(spark):
    plan = world.QUERIES["s8_k2_movables"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "Window" not in plan  # a join of the records with themselves would do both twice


def test_records_of_a_file_are_never_gathered_as_rows(spark):
    """Before, all records of all files of a task lay in memory as arrays of paths and text."""
    files = movables.write_movables(objects(spark))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_a_file_is_read_in_batches(monkeypatch):
    """Before, all records of a file made one batch."""
    import pandas as pd

    monkeypatch.setattr(movables, "_RECORDS", 4)
    data = SIMPLE * 10 + bytes([255, 1, 2, 0, 9, 9])
    got = list(movables._reader({})(iter([pd.DataFrame({"map_id": [1, 1], "sid": [2, 3], "part": [0, 0], "content": [data, None]})])))
    assert [len(b) for b in got] == [4, 4, 2] and [s for b in got for s in b["special"]] == [0] * 9 + [1]
    assert list(pd.concat(got)["seq"]) == list(range(10))


def test_files_are_joined_over_batches_of_records():
    import pyarrow as pa

    rows = [(1, None, 0, True, b"a"), (1, None, 0, False, b"b"), (1, None, 0, False, None), (1, 2, 0, True, b"c"), (1, 3, 1, True, b"d"), (1, 3, 1, False, b"e")]
    table = pa.table(dict(zip([*movables.KEYS, "_first", "_record"], map(list, zip(*rows)), strict=True)))
    for size in range(1, 7):
        got = [tuple(r.values()) for b in movables._joined(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert got == [(1, None, 0, b"ab"), (1, 2, 0, b"c"), (1, 3, 1, b"de")]
    assert list(movables._joined(iter([]))) == []
