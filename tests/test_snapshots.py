"""Saved states: round trips, versions, and writes that fail."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom.sources import snapshots

FILES = "archive string, name string, data binary"


def rows(spark, *files):
    return spark.createDataFrame([(a, n, None if d is None else bytearray(d)) for a, n, d in files], FILES).withColumn("content", F.lit("x"))


def shown(frame):
    return sorted((r.archive, r.name, bytes(r.data)) for r in frame.collect())


@pytest.mark.parametrize("form", ["flex", "zip"])
def test_round_trip_and_versions(spark, tmp_path, form):
    path = (tmp_path / "saves").as_uri()
    assert snapshots.versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        snapshots.restore(spark, path)
    one = [("a", "x/ä 1", b"\x00\xff" * 50), ("a", "b\nc", b""), ("b", "z", b"z")]
    assert snapshots.save(rows(spark, *one, ("b", "none", None)), path, form) == 1
    assert snapshots.save(rows(spark, ("c", "new", b"later")), path, form) == 2
    assert shown(snapshots.restore(spark, path)) == [("c", "new", b"later")]
    assert shown(snapshots.restore(spark, path, 1)) == sorted([*one, ("b", "none", b"")])
    assert shown(snapshots.restored_file(spark, path, "b", 1)) == [("b", "none", b""), ("b", "z", b"z")]
    assert snapshots.save(rows(spark).filter("false"), path, form) == 3 and snapshots.restore(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        snapshots.restore(spark, path, 9)


@pytest.mark.parametrize("form", ["flex", "zip"])
@pytest.mark.parametrize("bad", [[("a", "x", b"1"), ("a", "x", b"2")], [(None, "x", b"1")], [("a", None, b"1")]])
def test_a_write_that_fails_leaves_nothing(spark, tmp_path, form, bad):
    path = (tmp_path / "saves").as_uri()
    snapshots.save(rows(spark, ("ok", "f", b"kept")), path, form)
    with pytest.raises(PySparkException):
        snapshots.save(rows(spark, *[(f"good{i}", "f", b"x") for i in range(20)], *bad), path, form)
    assert snapshots.versions(spark, path) == [1] and shown(snapshots.restore(spark, path)) == [("ok", "f", b"kept")]
    assert [p.name for p in (tmp_path / "saves").iterdir() if not p.name.endswith(".crc")] == ["00000001"]


def test_a_version_being_written_is_not_seen(spark, tmp_path):
    path = (tmp_path / "saves").as_uri()
    snapshots.packed(rows(spark, ("a", "f", b"half")), "zip").write.parquet(f"{path}/.writing-x")
    assert snapshots.versions(spark, path) == []
    (tmp_path / "saves/00000001").mkdir()  # another writer was first
    assert snapshots.save(rows(spark, ("a", "f", b"whole")), path) == 2
    with pytest.raises(ValueError):
        snapshots.save(rows(spark), path, "tar")
