"""Container files as tables: three archive formats, type sniffing, message files, and a writer.

Layouts are fixed by their formats: sizes, magic numbers and byte orders below are fixed values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship

FLEX_MAGIC, FLEX_TITLE, FLEX_HEADER = 0xFFFF1A00, 80, 128
TABLE_END = 0xFFFF
BATCH_BYTES = 8 << 20  # of objects that a task gives on at once, about


def kind_of(data: bytes) -> str:
    """iff, flex, table or flat: the first that fits."""
    if data[:4] == b"FORM":
        return "iff"
    if len(data) >= FLEX_HEADER and struct.unpack_from("<I", data, FLEX_TITLE)[0] == FLEX_MAGIC:
        return "flex"
    at = 0
    while at + 2 <= len(data):
        (size,) = struct.unpack_from("<H", data, at)
        if size == TABLE_END:
            return "table" if at else "flat"
        if at + 6 > len(data) or struct.unpack_from("<I", data, at + 2)[0] + size > len(data):
            break
        at += 6
    return "flat"


def _flex(data: bytes) -> Iterator[bytes]:
    (count,) = struct.unpack_from("<I", data, FLEX_TITLE + 4)
    for i in range(min(count, (len(data) - FLEX_HEADER) // 8)):  # an index may be cut short
        offset, size = struct.unpack_from("<II", data, FLEX_HEADER + 8 * i)
        yield data[offset : offset + size]


def _table(data: bytes) -> Iterator[bytes]:
    at = 0
    while (size := struct.unpack_from("<H", data, at)[0]) != TABLE_END:
        (offset,) = struct.unpack_from("<I", data, at + 2)
        yield data[offset : offset + size]
        at += 6


def _iff(data: bytes) -> Iterator[bytes]:
    (total,) = struct.unpack_from(">I", data, 4)
    at, end = 12, min(len(data), 8 + total)
    while at + 8 <= end and (size := struct.unpack_from(">I", data, at + 4)[0]):
        yield data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


DECODERS = {"flex": _flex, "table": _table, "iff": _iff, "flat": lambda data: iter([data])}


def write_flex(objects: list[bytes], title: str = "") -> bytes:
    """A flex archive of the objects: header, index, then payload."""
    offset = FLEX_HEADER + 8 * len(objects)
    head = title.encode()[: FLEX_TITLE - 1].ljust(FLEX_TITLE, b"\x00") + struct.pack("<III", FLEX_MAGIC, len(objects), 0xCC)
    index = b""
    for o in objects:
        index += struct.pack("<II", offset if o else 0, len(o))
        offset += len(o)
    return head.ljust(FLEX_HEADER, b"\x00") + index + b"".join(objects)


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "kind", "num", "data"]
    for frame in frames:
        rows, held = [], 0
        for path, content in frame[["path", "content"]].itertuples(index=False):
            data = bytes(content)
            kind = kind_of(data)
            for i, o in enumerate(DECODERS[kind](data)):
                rows.append((path, kind, i, o))
                held += len(o)
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)


def decoded(files: DataFrame) -> DataFrame:
    """path, kind, num, data: the objects of each of files (path, content); a file is decoded by one task, small ones together."""
    return files.select("path", "content").mapInPandas(_decode, "path string, kind string, num int, data binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, num, data: the objects of every archive under path."""
    ship(spark)
    return decoded(spark.read.format("binaryFile").load(path))


def _little(value: Column, size: int) -> Column:
    return F.concat(*[F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)])


def _big(value: Column, size: int) -> Column:
    return F.lpad(F.hex(value), 2 * size, "0")


def _listed(objects: DataFrame) -> DataFrame:
    """path and v: the objects (path, num, data) of each path in order of num, as hexadecimal text, with their sizes."""
    row = F.struct("num", F.hex("data").alias("x"), F.length("data").cast("long").alias("n"))
    return objects.groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("v"))


def _index(v: str, start: Column, entry) -> Column:
    """The entries of an index (offset, size) of objects that lie one after the other from start on, joined."""
    first = F.struct(start.alias("at"), F.lit("").alias("out"))
    return F.aggregate(v, first, lambda acc, o: F.struct((acc["at"] + o["n"]).alias("at"), F.concat(acc["out"], entry(acc["at"], o["n"])).alias("out")), lambda acc: acc["out"])


def as_flex(objects: DataFrame, title: str = "") -> DataFrame:
    """path, content: an archive of the objects (path, num, data) of each path, numbered from 0 in order of num."""
    n = F.size("v").cast("long")
    head = title.encode()[: FLEX_TITLE - 1].ljust(FLEX_TITLE, b"\x00") + struct.pack("<I", FLEX_MAGIC)
    index = _index("v", FLEX_HEADER + 8 * n, lambda at, size: F.concat(_little(F.when(size > 0, at).otherwise(F.lit(0).cast("long")), 4), _little(size, 4)))
    body = F.array_join(F.transform("v", lambda o: o["x"]), "")
    start = F.concat(F.lit(head.hex()), _little(n, 4), _little(F.lit(0xCC).cast("long"), 4), F.lit("00" * (FLEX_HEADER - FLEX_TITLE - 12)))
    return _listed(objects).select("path", F.unhex(F.concat(start, index, body)).alias("content"))


def as_table(objects: DataFrame) -> DataFrame:
    """path, content: sizes and offsets, ended by a size of 65535, then the objects."""
    index = _index("v", 6 * F.size("v").cast("long") + 2, lambda at, size: F.concat(_little(size, 2), _little(at, 4)))
    body = F.array_join(F.transform("v", lambda o: o["x"]), "")
    return _listed(objects).select("path", F.unhex(F.concat(index, F.lit("ffff"), body)).alias("content"))


def as_iff(objects: DataFrame) -> DataFrame:
    """path, content: entries of a type, a big-endian size and the object, padded to even; an empty object would end the file."""
    entry = lambda o: F.concat(F.lit(b"DATA".hex()), _big(o["n"], 4), o["x"], F.when(o["n"] % 2 == 1, "00").otherwise(""))
    body = F.array_join(F.transform("v", entry), "")
    return _listed(objects).select("path", F.unhex(F.concat(F.lit(b"FORM".hex()), _big(F.call_function("div", F.length(body), F.lit(2)) + 4, 4), F.lit(b"TEXT".hex()), body)).alias("content"))


def latest_of(rows: DataFrame) -> DataFrame:
    """num, data: for each num of rows (num, rank, data) the non-empty object of highest rank."""
    return rows.filter(F.length("data") > 0).groupBy("num").agg(F.max_by("data", "rank").alias("data"))


def latest(archives: DataFrame, priority: dict[str, int]) -> DataFrame:
    """For each num the non-empty object of the path of highest priority."""
    rank = F.lit(None).cast("int")
    for path, p in priority.items():
        rank = F.when(F.col("path").endswith(path), p).otherwise(rank)
    return latest_of(archives.withColumn("rank", rank).filter(F.col("rank").isNotNull()))


def message_files(lines: DataFrame) -> DataFrame:
    """path, value: a file of the lines (path, section, place, line) of each path, those of a section in order of place within its marks."""
    listed = lines.groupBy("path", "section").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("v"))
    text = F.concat(F.lit("%%section "), F.col("section"), F.lit("\n"), F.array_join(F.transform("v", lambda x: x["line"]), "\n"), F.lit("\n%%endsection\n"))
    return listed.select("path", text.alias("t")).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("t")), "").alias("value"))


def message_parts(lines: DataFrame, each: int) -> DataFrame:
    """path, part, value: as message_files, but a file is cut between lines into parts, of the places of a section that share
    place div each."""
    rows = lines.withColumn("_slice", F.floor(F.col("place") / each))
    own, whole = W.partitionBy("path", "section").orderBy("_slice"), W.partitionBy("path").orderBy("section", "_slice")
    marks = rows.select("path", "section", "_slice").distinct().select("*", F.row_number().over(whole).alias("part"), F.lag("_slice").over(own).isNull().alias("_first"), F.lead("_slice").over(own).isNull().alias("_last"))
    listed = rows.groupBy("path", "section", "_slice").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("v")).join(marks, ["path", "section", "_slice"])
    head = F.when(F.col("_first"), F.concat(F.lit("%%section "), "section", F.lit("\n"))).otherwise("")
    return listed.select("path", "part", F.concat(head, F.array_join(F.transform("v", lambda x: x["line"]), "\n"), F.lit("\n"), F.when(F.col("_last"), "%%endsection\n").otherwise("")).alias("value"))


def messages(files: DataFrame) -> DataFrame:
    """section, idx, text of message files (path, value; with a column part those of one path are cut between lines, in its order).

    Lines stand within `%%section name` and `%%endsection`, or outside of sections (a null section). `index:text` has its
    index in decimal, 0x hexadecimal or octal with a leading 0; `:text` has the next number of the file's one counter,
    which only such lines move. Leading blanks, empty lines, # comments and lines without a colon are left out. Of lines
    with the same section and index the last one counts. Each file is read by itself.
    """
    keys = ["path", "part"]
    raw = (files if "part" in files.columns else files.withColumn("part", F.lit(0))).select(*keys, F.posexplode(F.split("value", r"[\r\n]+")).alias("line", "s")).withColumn("s", F.regexp_replace("s", r"^[ \t\x08]+", ""))
    before = W.partitionBy(*keys).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    s = F.col("s")
    mark = F.when(s.startswith("%%section"), F.regexp_extract("s", r"^%%section[ \t\x08]*(.*)$", 1)).when(s.startswith("%%endsection"), "")
    raw = raw.withColumn("_mark", mark)
    rows = raw.withColumn("section", F.last("_mark", ignorenulls=True).over(before))
    rows = rows.withColumn("auto", F.sum(s.startswith(":").cast("int")).over(before) - 1)
    if "part" in files.columns:  # a part goes on with the section and the count of those before it: a row a part
        sums = raw.groupBy(*keys).agg(F.sum(s.startswith(":").cast("long")).alias("_n"), F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("line"))).alias("_mark"))
        earlier = W.partitionBy("path").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        carried = sums.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.last("_mark", ignorenulls=True).over(earlier).alias("_carried"))
        rows = rows.join(carried, keys).withColumn("section", F.coalesce("section", "_carried")).withColumn("auto", F.col("auto") + F.col("_n"))
    rows = rows.withColumn("section", F.nullif("section", F.lit("")))
    rows = rows.filter(~s.startswith("%%section") & ~s.startswith("%%endsection") & ~s.startswith("#") & s.contains(":"))
    low = F.lower(F.regexp_extract("s", r"^([^:]*):", 1))
    number = F.when(low == "", F.col("auto")).when(low.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(low, 3, 16), 16, 10)).when(low.rlike("^0[0-7]*$"), F.conv(low, 8, 10)).when(low.rlike("^[0-9]+$"), low)
    found = rows.select("path", "section", number.cast("int").alias("idx"), F.struct("part", "line").alias("line"), F.regexp_extract("s", r"(?s)^[^:]*:(.*)$", 1).alias("text")).filter("idx IS NOT NULL")
    return found.groupBy("path", "section", "idx").agg(F.max_by("text", "line").alias("text")).select("section", "idx", "text")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """section, idx, text of the message files under path; a message file is one configuration file, read whole."""
    files = spark.read.text(path, wholetext=True)
    return messages(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def _leaves(node: ElementTree.Element, path: str) -> Iterator[tuple[str, str]]:
    text = (node.text or "").strip()
    if text or not len(node):
        yield path, text
    for child in node:
        yield from _leaves(child, f"{path}/{child.tag}")


def _settings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [leaf for text in frame.value for root in [ElementTree.fromstring(text)] for leaf in _leaves(root, root.tag)]
        yield pd.DataFrame(rows, columns=["path", "value"])


def settings(files: DataFrame) -> DataFrame:
    """path, value of each element with text or without children of trees of settings (value), names parted by slashes."""
    return files.select("value").mapInPandas(_settings, "path string, value string")
