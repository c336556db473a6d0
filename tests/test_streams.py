"""Functions and messages by hand: marks, cut files, odd rows."""

import struct

import pytest
from pyspark.errors import PySparkException

from gridloom.sources import streams


def test_functions_by_hand():
    data = struct.pack("<HH", 7, 2) + b"ab" + struct.pack("<HiI", 0xFFFE, -5, 1) + b"c" + struct.pack("<HHI", 0xFFFF, 9, 0) + struct.pack("<HH", 1, 3) + b"xy"
    assert list(streams._functions(data)) == [(7, b"ab"), (-5, b"c"), (9, b"")]
    for cut in range(len(data)):
        assert len(list(streams._functions(data[:cut]))) == sum(cut >= end for end in (6, 17, 25))


def test_messages_by_hand():
    one = struct.pack("<HHB", streams.MAGIC, 3, 200) + b"abc"
    assert list(streams._messages(one + one[:7])) == [(200, b"abc")]
    assert list(streams._messages(one + b"\x00" + one)) == [(200, b"abc")] and list(streams._messages(b"")) == []


def test_written_and_in_force(spark):
    rows = [(0, False, 1, 5, b"a"), (0, False, 2, 5, b"b"), (1, True, 1, 5, b"c"), (2, True, 1, 5, b"d"), (1, True, 2, 70_000, b"e"), (2, True, 2, 70_000, b""), (1, True, 3, -1, b"f"), (0, False, 3, 6, b"x" * 70_000)]
    frame = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], "rank int, patch boolean, place int, id long, data binary")
    found = streams.functions(streams.write_functions(frame))
    got = {r.id: (bytes(r.data), r.original and bytes(r.original)) for r in streams.in_force(found).collect()}
    assert got == {5: (b"d", b"b"), 70_000: (b"", b"e"), -1: (b"f", None), 6: (b"x" * 70_000, None)}
    empty = frame.filter("false")
    assert streams.functions(streams.write_functions(empty)).count() == streams.in_force(empty).count() == 0
    files = spark.createDataFrame([(0, False, None), (0, False, bytearray(b"")), (1, True, bytearray(b"\x01\x00\x00\x00")), (1, True, bytearray(b"\x01\x00\x00\x00"))], "rank int, patch boolean, content binary")
    assert streams.functions(files).count() == 2


def test_a_feed_in_order_of_its_rows(spark):
    frame = spark.createDataFrame([("a", 2, 1, bytearray(b"two")), ("a", 1, 255, bytearray(b"")), ("b", 9, 0, bytearray(b"x" * 65_535))], "file string, seq long, kind int, data binary")
    got = sorted((r.file, r.place, r.kind, len(r.data)) for r in streams.feed(streams.write_feed(frame)).collect())
    assert got == [("a", 0, 255, 0), ("a", 1, 1, 3), ("b", 0, 0, 65_535)]
    with pytest.raises(PySparkException, match="65,535"):
        streams.write_feed(spark.createDataFrame([("a", 1, 1, bytearray(65_536))], "file string, seq long, kind int, data binary")).collect()
