"""Files of records one behind the other, each with its length: functions of scripts, and messages between programs.

Marks and sizes are fixed values of the formats. A file is a row with its bytes in ``content``. A record that is cut short ends
its file; null or empty contents and empty tables give no rows; repeated files are read as often as they come.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bytes_of
from ..shipping import ship
from .records import _joined

WIDE_ID, WIDE_LENGTH = 0xFFFE, 0xFFFF  # marks before a function's id: both of four bytes, or its length alone
MAGIC, HEADER, LONGEST = 0xF381, 5, 0xFFFF


def _functions(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 2 <= len(data):
        (mark,) = struct.unpack_from("<H", data, at)
        head = struct.Struct({WIDE_ID: "<HiI", WIDE_LENGTH: "<HHI"}.get(mark, "<HH"))
        if at + head.size > len(data):
            return
        *_, number, size = head.unpack_from(data, at)
        at += head.size
        if at + size > len(data):
            return
        yield number, data[at : at + size]
        at += size


def _messages(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + HEADER <= len(data):
        magic, size, kind = struct.unpack_from("<HHB", data, at)
        if magic != MAGIC or at + HEADER + size > len(data):
            return
        yield kind, data[at + HEADER : at + HEADER + size]
        at += HEADER + size


def _read(files: DataFrame, keys: list[str], parse: Callable[[bytes], Iterator[tuple[int, bytes]]], first: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for *key, content in frame.itertuples(index=False):
                rows = [(*key, place, *record) for place, record in enumerate(parse(content or b""))]
                yield pd.DataFrame(rows, columns=[*keys, "place", first, "data"])

    ship(files.sparkSession)
    types = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.select(*keys, "content").mapInPandas(run, f"{types}, place int, {first} long, data binary")


def functions(files: DataFrame) -> DataFrame:
    """rank, patch, place, id, data: the functions of files (rank, patch, content) in the order in which they lie there."""
    return _read(files, ["rank", "patch"], _functions, "id")


def write_functions(rows: DataFrame) -> DataFrame:
    """rank, patch, content: files of functions (rank, patch, place, id, data); ids that two bytes do not hold get the wide form."""
    size, number = F.length("data").cast("long"), F.col("id")
    mark = lambda v: F.unhex(F.lit(struct.pack("<H", v).hex()))
    wide = F.concat(mark(WIDE_ID), bytes_of(number, 4), bytes_of(size, 4))
    long_ = F.concat(mark(WIDE_LENGTH), bytes_of(number, 2), bytes_of(size, 4))
    head = F.when((number < 0) | (number >= WIDE_ID), wide).when(size > 0xFFFF, long_).otherwise(F.concat(bytes_of(number, 2), bytes_of(size, 2)))
    return _joined(rows, ["rank", "patch"], ["place"], F.concat(head, "data"))


def in_force(found: DataFrame) -> DataFrame:
    """id, data, original of functions (rank, patch, place, id, data): the last one read of each id; a patch (read after all others)
    keeps what it replaces: the last one that is no patch, else the first patch. One aggregation; a null id is one of its own."""
    order = F.struct("rank", "place")
    last, base = F.max_by("data", F.struct("patch", "rank", "place")), F.max_by("data", F.when(~F.col("patch"), order))
    patches, bases = F.count_if(F.col("patch")), F.count_if(~F.col("patch"))
    first = F.min_by("data", F.when(F.col("patch"), order))
    return found.groupBy("id").agg(last.alias("data"), F.when((patches > 0) & (bases > 0), base).when(patches > 1, first).alias("original"))


def feed(files: DataFrame) -> DataFrame:
    """file, place, kind, data: the messages of recorded feeds (file, content). What does not begin with the mark ends a feed."""
    return _read(files, ["file"], _messages, "kind")


def write_feed(rows: DataFrame) -> DataFrame:
    """file, content: feeds of messages (file, seq, kind, data) in order of seq; data beyond 65,535 bytes is an error."""
    size = F.length("data").cast("long")
    held = F.when(size <= LONGEST, size).otherwise(F.raise_error(F.lit("a message holds 65,535 bytes at most")).cast("long"))
    return _joined(rows, ["file"], ["seq"], F.concat(F.unhex(F.lit(struct.pack("<H", MAGIC).hex())), bytes_of(held, 2), bytes_of(F.col("kind").cast("long"), 1), "data"))
