"""Movable objects in the files of superchunks, with nested containers, and a world stored by superchunk.

A file is a row (map_id, sid, part, content): a superchunk may have several parts. A record begins with its length, after a
mark where it is extended; what a container holds follows it and ends with a byte of 0 or 1. All sizes, marks and places
below are fixed values of the format. Reading is a filter on partition columns and one pass over each file; files are rows
of any Spark source, so they may lie in any store that Spark reads.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import TILES, bytes_of
from ..operators.hierarchy import paths
from ..shipping import ship

WIDE, LIFTED, SPECIAL, SLOT = 254, 253, 255, 2
LENGTHS = (6, 10, 12, 13, 14, 18)
SUPERCHUNK, ACROSS = 256, 12  # tiles a superchunk, superchunks across the world
MOST_PRUNED = 10_000  # superchunks named in a filter of the scan
KEYS = ["map_id", "sid", "part"]
FIELDS = "seq int, parent_seq int, depth int, kind string, x int, y int, lift int, shape int, frame int, quality int, flags int, type int, npc int, slot int, special int, entry binary"


def _swapped(byte: int) -> int:
    return (byte << 4 | byte >> 4) & 255


def records(data: bytes, classes: dict[int, str]) -> Iterator[tuple]:
    """The records of a file in order, with the number of the one that holds each. A record that is cut short ends the file."""
    at, seq, slot, open_ = 0, -1, None, []
    last = None  # the record before: given out when no special record can follow it any more
    while at < len(data):
        size, wide, lifted = data[at], 0, False
        at += 1
        if size < 2:
            if open_:
                slot = open_.pop()[1]
            continue
        if size == SLOT:
            if at + 2 > len(data):
                break
            slot = data[at] - 256 if data[at] > 127 else data[at]
            at += 2
            continue
        if size == SPECIAL:  # type, length and bytes that belong to the record before
            if at + 3 > len(data) or at + 3 + (n := data[at + 1] | data[at + 2] << 8) > len(data):
                break
            if last is not None:
                last[-2] += 1
            at += 3 + n
            continue
        if size in (WIDE, LIFTED):
            wide, lifted = int(size == WIDE), True
            if at == len(data):
                break
            size = data[at]
            at += 1
        length, entry = size - wide, data[at : at + size]
        at += size
        if length not in LENGTHS:
            continue
        if len(entry) < size:
            break
        seq += 1
        shape = entry[2] | (entry[3] << 8 if wide else (entry[3] & 3) << 8)
        frame = entry[4] if wide else entry[3] >> 2
        b = entry[:3] + entry[3 + wide :]  # without the second byte of a wide shape
        class_ = classes.get(shape)
        extra = int(length == 13)
        lift = _swapped(b[4 if length in (6, 10) and class_ != "egg" else 9 + extra if length > 10 else min(9, len(b) - 1)])
        quality = flags = type_ = 0
        npc = None
        if class_ == "egg":
            kind, type_ = "egg", b[4] | b[5] << 8
        elif length in (6, 10):
            kind, quality, flags = "simple", b[5], b[6] if length == 10 else 0
        elif length == 18 or class_ == "spellbook":
            kind = "spellbook"
        elif class_ == "body" or length == 13:
            kind, type_, quality, flags = "body", b[4] | b[5] << 8, b[7], b[11 + extra]
            if quality == 1 and (extra or b[8] >= 128):
                npc = (b[8] | b[9] << 8 if extra else b[8] - 128) or None
        else:
            kind, type_, quality, flags = class_ or "container", b[4] | b[5] << 8, b[7], b[11]
        holder = open_[-1][0] if open_ else None
        if last is not None:
            yield tuple(last)
        last = [seq, holder, len(open_), kind, entry[0], entry[1], lift if lifted else lift & 15, shape, frame, quality, flags, type_, npc, slot, 0, entry]
        if type_ and kind not in ("egg", "spellbook", "stone"):
            open_.append((seq, slot))
            slot = None
    if last is not None:
        yield tuple(last)


_RECORDS = 1 << 13  # records a batch


def _reader(classes: dict[int, str]):
    names = [*KEYS, *(f.split()[0] for f in FIELDS.split(", "))]
    whole = [n for n in names if n not in ("kind", "entry", *KEYS)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for map_id, sid, part, content in frame.itertuples(index=False):
                found = records(content or b"", classes)
                while rows := [(map_id, sid, part, *r) for r in itertools.islice(found, _RECORDS)]:
                    yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(whole, "Int64"))

    return run


def movables(files: DataFrame, classes: dict[int, str] | None = None) -> DataFrame:
    """map_id, sid, part, and a row a record: seq (place in the file), parent_seq and depth of the container round it, kind,
    x and y (in the superchunk, or in the container's picture), lift, shape, frame, quality, flags, type, npc, slot (where it is
    worn), special (how many special records follow it), entry (its bytes).

    classes names the kind of shapes: egg, body, spellbook, stone, barge; there are at most 65,536 shapes. Records of other
    lengths are passed over; a file that is cut short gives its whole records; null contents give none.
    """
    ship(files.sparkSession)
    return files.select(*KEYS, "content").mapInPandas(_reader(classes or {}), f"map_id long, sid int, part int, {FIELDS}")


def superchunk(tx: Column, ty: Column) -> Column:
    return (F.call_function("div", ty, F.lit(SUPERCHUNK)) * ACROSS + F.call_function("div", tx, F.lit(SUPERCHUNK))).cast("int")


def _record(holds: Column) -> Column:
    """The bytes of one record, length and marks included."""
    c = F.col
    wide = (c("shape") > 1023) | (c("frame") > 63)
    lifted = ~wide & (c("lift") > 15)
    hex_ = lambda v, n: F.hex(bytes_of(v.cast("long"), n))
    lift = hex_(F.when(wide | lifted, F.shiftleft(c("lift").bitwiseAND(15), 4).bitwiseOR(F.shiftright(c("lift"), 4))).otherwise(F.shiftleft(c("lift").bitwiseAND(15), 4)), 1)
    shape = F.when(wide, F.concat(hex_(c("shape"), 2), hex_(c("frame"), 1))).otherwise(F.concat(hex_(c("shape").bitwiseAND(255), 1), hex_(F.shiftright(c("shape"), 8).bitwiseOR(F.shiftleft(c("frame"), 2)), 1)))
    none, type_, quality, flags = F.lit("00"), hex_(holds.cast("int"), 2), hex_(c("quality"), 1), hex_(c("flags"), 1)
    rest = F.when(c("kind") == "simple", F.concat(lift, quality)).when(c("kind") == "temporary", F.concat(lift, quality, F.lit("01000000")))
    rest = rest.when(c("kind") == "body", F.concat(type_, none, quality, F.lit("0000"), lift, none, flags)).otherwise(F.concat(type_, none, quality, none, lift, none, flags))
    length = F.when(c("kind") == "simple", 6).when(c("kind") == "temporary", 10).when(c("kind") == "body", 13).otherwise(12) + wide.cast("int")
    mark = F.when(wide, "FE").when(lifted, "FD").otherwise("")
    worn = F.when(c("slot").isNotNull(), F.concat(F.lit("02"), hex_(c("slot"), 2))).otherwise("")
    return F.concat(worn, mark, hex_(length, 1), hex_(c("x"), 1), hex_(c("y"), 1), shape, rest)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A file of each run of records; _first marks where one begins."""
    head, content = None, bytearray()
    whole = lambda: pa.RecordBatch.from_arrays([*head.columns, pa.array([bytes(content)])], [*KEYS, "content"])
    for batch in batches:
        cuts = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False)).tolist()
        for low, high in itertools.pairwise([*([0] if cuts[:1] != [0] else []), *cuts, batch.num_rows]):
            if low or cuts[:1] == [0]:
                if head is not None:
                    yield whole()
                head, content = batch.select(KEYS).slice(low, 1), bytearray()
            content += b"".join(batch.column("_record").slice(low, high - low).drop_null().to_pylist())
    if head is not None:
        yield whole()


def write_movables(objects: DataFrame, parts: int = 1) -> DataFrame:
    """map_id, sid, part, content: files of objects (id, parent, map, tx, ty, lift, shape, frame, quality, flags, slot, kind).

    kind: simple, temporary, body or container; what holds something must be one of the last two. Objects lie in the file of
    their outermost container's superchunk, in one of `parts` files by a hash of it; what is worn (slot) is so marked, and the
    mark holds for what follows it in the same container until the next, so give all or none in a container a slot. Records stream
    in the order of their files, and a task holds the bytes of one file at a time.
    """
    ship(objects.sparkSession)
    rows = paths(objects)
    place = rows.filter("depth = 0").select("root", F.col("map").alias("map_id"), superchunk(F.col("tx"), F.col("ty")).alias("sid"))
    rows = rows.join(place, "root").withColumn("part", F.pmod(F.xxhash64("root"), F.lit(parts)).cast("int"))
    own = W.partitionBy(*KEYS).orderBy("path")
    after = F.coalesce(F.lead("depth").over(own), F.lit(0))
    rows = rows.withColumns({"_after": after, "_first": F.row_number().over(own) == 1, "x": F.col("tx") % SUPERCHUNK, "y": F.col("ty") % SUPERCHUNK})
    ends = F.repeat(F.lit("01"), F.greatest(F.col("depth") - F.col("_after"), F.lit(0)))
    rows = rows.select(*KEYS, "path", "_first", F.unhex(F.concat(_record(F.col("_after") > F.col("depth")), ends)).alias("_record"))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in KEYS)
    return rows.sortWithinPartitions(*KEYS, "path").drop("path").mapInArrow(_joined, f"{kinds}, content binary")


def store(objects: DataFrame, path: str, files: int = 1) -> None:
    """Write objects (map, tx, ty, and more) in a directory for each superchunk, of all maps, in order of the map, so that there
    are 144 directories however many maps, and a scan for some maps passes over the row groups of others; a directory is spread
    over `files` tasks and files by place."""
    rows = objects.withColumn("map_id", F.col("map")).withColumn("sid", superchunk(F.col("tx"), F.col("ty")))
    spread = F.pmod(F.xxhash64("tx", "ty"), F.lit(files))
    rows.repartition("sid", spread).sortWithinPartitions("sid", "map_id").write.partitionBy("sid").parquet(path)


def stored(spark: SparkSession, path: str, needed: DataFrame | None = None) -> DataFrame:
    """The objects under path; with needed (map_id, sid) only those of these superchunks.

    Up to MOST_PRUNED of them are named in the scan's filter, so that no other directory is listed or read, nor row groups of other
    maps; of more only the superchunks and the range of maps are named. In the end they are joined.
    """
    rows = spark.read.parquet(path)
    if needed is None:
        return rows
    needed = needed.distinct()
    named = needed.limit(MOST_PRUNED + 1).collect()
    if len(named) <= MOST_PRUNED:
        rows = rows.filter(F.col("map_id").isin(sorted({r.map_id for r in named})) & F.col("sid").isin(sorted({r.sid for r in named})))
    else:
        ends = needed.agg(F.min("map_id").alias("low"), F.max("map_id").alias("high"), F.collect_set("sid").alias("sids")).head()
        rows = rows.filter(F.col("map_id").between(ends.low, ends.high) & F.col("sid").isin(sorted(ends.sids)))
    return rows.join(needed, ["map_id", "sid"], "left_semi")


def reached(probes: DataFrame, radius: int) -> DataFrame:
    """map_id, sid: the superchunks that squares round probes (map, tx, ty) meet, round the world."""
    side = lambda c: F.transform(F.sequence(F.floor((F.col(c) - radius) / SUPERCHUNK), F.floor((F.col(c) + radius) / SUPERCHUNK)), lambda k: F.pmod(k, F.lit(TILES // SUPERCHUNK)))
    rows = probes.select(F.col("map").alias("map_id"), F.explode(side("tx")).alias("_x"), "ty").select("map_id", "_x", F.explode(side("ty")).alias("_y"))
    return rows.select("map_id", (F.col("_y") * ACROSS + F.col("_x")).cast("int").alias("sid")).distinct()
