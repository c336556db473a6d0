"""Packed records as tables, and their writers, in columns: fixed objects, equipment, attributes, terrains.

Layouts are fixed by their formats. A file is a row with its bytes in ``content``; a truncated last record is left out; an
empty table gives no rows; repeated rows are written and read as often as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import CHUNK, bytes_of, little_endian
from ..storage import materialize


def _joined(rows: DataFrame, keys: list[str], order: list[str], record: Column, name: str = "content") -> DataFrame:
    """The records of each key in order, one after the other."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.hex(record).alias("_r")))).alias("_v"))
    return listed.select(*keys, F.unhex(F.array_join(F.transform("_v", lambda v: v["_r"]), "")).alias(name))


def _cut(files: DataFrame, size: int, keys: list[str], at: int = 0) -> DataFrame:
    """place and record: the whole records of size bytes from byte at on."""
    n = F.call_function("div", F.length("content") - at, F.lit(size))
    places = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i < n)
    return files.select(*keys, "content", F.explode(places).alias("place")).select(*keys, "place", F.expr(f"substring(content, {at} + 1 + place * {size}, {size})").alias("record"))


def write_fixed(objects: DataFrame, version: int = 1) -> DataFrame:
    """cx, cy, content: the objects (tx, ty, tz, shape, frame) of each chunk as records of four or, in version 2, five bytes."""
    tile = F.shiftleft(F.col("tx") % CHUNK, 4).bitwiseOR(F.col("ty") % CHUNK)
    if version == 1:
        record = F.concat(bytes_of(tile, 1), bytes_of(F.col("tz") % 16, 1), bytes_of(F.col("shape").bitwiseAND(255), 1), bytes_of(F.shiftright("shape", 8).bitwiseAND(3).bitwiseOR(F.shiftleft(F.col("frame"), 2)), 1))
    else:
        record = F.concat(bytes_of(tile, 1), bytes_of(F.col("tz"), 1), bytes_of(F.col("shape"), 2), bytes_of(F.col("frame"), 1))
    rows = objects.withColumn("cx", F.call_function("div", F.col("tx"), F.lit(CHUNK))).withColumn("cy", F.call_function("div", F.col("ty"), F.lit(CHUNK)))
    return _joined(rows, ["cx", "cy"], ["tx", "ty", "tz", "shape", "frame"], record)


def fixed_objects(chunks: DataFrame, version: int = 1) -> DataFrame:
    """tx, ty, tz, shape, frame of the records of chunks (cx, cy, content)."""
    r = F.col("record")
    rows = _cut(chunks, 4 if version == 1 else 5, ["cx", "cy"])
    tile = little_endian(r, 0, 1)
    shape = F.col("_two") if version == 2 else little_endian(r, 2, 2).bitwiseAND(1023)
    frame = little_endian(r, 4, 1) if version == 2 else F.shiftright(little_endian(r, 3, 1), 2)
    tz = little_endian(r, 1, 1) if version == 2 else little_endian(r, 1, 1).bitwiseAND(15)
    rows = rows.withColumn("_two", little_endian(r, 2, 2))
    return rows.select((F.col("cx") * CHUNK + F.shiftright(tile, 4)).alias("tx"), (F.col("cy") * CHUNK + tile.bitwiseAND(15)).alias("ty"), tz.alias("tz"), shape.alias("shape"), frame.alias("frame"))


def write_equipment(rows: DataFrame, each: int = 100) -> DataFrame:
    """file, content: records of ten elements (record, elem, shape, probability, quantity), each of six bytes, two unused."""
    rows = rows.withColumn("file", F.call_function("div", F.col("record"), F.lit(each)))
    return _joined(rows, ["file"], ["record", "elem"], F.concat(bytes_of(F.col("shape"), 2), bytes_of(F.col("probability"), 1), bytes_of(F.col("quantity"), 1), F.unhex(F.lit("0000"))))


def equipment(files: DataFrame, each: int = 100) -> DataFrame:
    """record, elem, shape, probability, quantity; records are counted on from file to file."""
    r, place = F.col("record"), F.col("place")
    rows = _cut(files, 6, ["file"])
    return rows.select((F.col("file") * each + F.call_function("div", place, F.lit(10))).alias("record"), (place % 10).cast("int").alias("elem"), little_endian(r, 0, 2).alias("shape"), little_endian(r, 2, 1).alias("probability"), little_endian(r, 3, 1).alias("quantity"))


def write_attributes(rows: DataFrame) -> DataFrame:
    """file, content: of each file of rows (file, shape, value) a count (one byte, or 255 and two bytes) and records of shape and
    value, two bytes each."""
    record = F.hex(F.concat(bytes_of(F.col("shape"), 2), bytes_of(F.col("value"), 2)))
    listed = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("shape", record.alias("r")))).alias("v"))
    n = F.size("v").cast("long")
    head = F.when(n < 255, bytes_of(n, 1)).otherwise(F.concat(F.unhex(F.lit("FF")), bytes_of(n, 2)))
    return listed.select("file", F.concat(head, F.unhex(F.array_join(F.transform("v", lambda x: x["r"]), ""))).alias("content"))


def attributes(files: DataFrame) -> DataFrame:
    """file, shape, value of the records of files (file, content), after their count."""
    c = F.col("content")
    wide = little_endian(c, 0, 1) == 255
    body = files.select("file", F.expr("substring(content, CASE WHEN hex(substring(content, 1, 1)) = 'FF' THEN 4 ELSE 2 END)").alias("content"), F.when(wide, little_endian(c, 1, 2)).otherwise(little_endian(c, 0, 1)).alias("n"))
    rows = _cut(body, 4, ["file", "n"]).filter(F.col("place") < F.col("n"))
    return rows.select("file", little_endian(F.col("record"), 0, 2).alias("shape"), little_endian(F.col("record"), 2, 2).alias("value"))


def patched(base: DataFrame, patch: DataFrame) -> DataFrame:
    """file, shape, value: of the patch where it has the shape, else of the base."""
    both = base.withColumn("_p", F.lit(0)).unionByName(patch.withColumn("_p", F.lit(1)))
    return both.groupBy("file", "shape").agg(F.max_by("value", "_p").alias("value"))


def write_terrains(tiles: DataFrame, wide: bool = False) -> DataFrame:
    """terrain, content: the 256 tiles (terrain, i, shape, frame) of each terrain, row by row: two bytes a tile, or three in the wide
    form, which has shapes of sixteen bits and frames of eight."""
    if wide:
        return _joined(tiles, ["terrain"], ["i"], F.concat(bytes_of(F.col("shape"), 2), bytes_of(F.col("frame"), 1)))
    return _joined(tiles, ["terrain"], ["i"], bytes_of(F.col("shape").bitwiseOR(F.shiftleft(F.col("frame"), 10)), 2))


def terrains(files: DataFrame, wide: bool = False) -> DataFrame:
    """terrain, x, y, shape, frame of files (terrain, content) of either form."""
    two, place = little_endian(F.col("record"), 0, 2), F.col("place")
    shape, frame = (two, little_endian(F.col("record"), 2, 1)) if wide else (two.bitwiseAND(1023), F.shiftright(two, 10).bitwiseAND(31))
    return _cut(files, 3 if wide else 2, ["terrain"]).select("terrain", (place % CHUNK).cast("long").alias("x"), F.call_function("div", place, F.lit(CHUNK)).cast("long").alias("y"), shape.alias("shape"), frame.alias("frame"))


def renumbered(rows: DataFrame, order: str) -> DataFrame:
    """Adds place, from 0, by order: ranges of it are sorted by themselves, and each is counted on from those before it."""
    sorted_ = materialize(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "places")
    counts = sorted_.groupBy("_part").agg(F.count("*").alias("_k"))
    before = counts.select("_part", (F.sum("_k").over(W.orderBy("_part")) - F.col("_k")).alias("_before"))  # a row a range
    own = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return sorted_.withColumn("_own", own).join(before, "_part").withColumn("place", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")
