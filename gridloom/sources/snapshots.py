"""Saved states as versions of a folder: written whole or not at all, as rows, Flex or ZIP archives.

A version is written to a folder of its own name that begins with a dot, and takes its number by one rename when all tasks have
committed; a job that fails takes its folder with it. Readers look at numbered versions only, so they never see a part of one.
All is done through Spark's own file system, so the folder may lie in any store that Spark writes.

Two writers at once: the later rename finds the number taken and tries the next. A null or repeated name in an archive and a
null archive are errors of the caller's: the write fails and leaves nothing. Empty data is kept; an empty table is a version
without files.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import archives

DIGITS = 8
EPOCH = (1980, 1, 1, 0, 0, 0)  # the earliest time that the format knows: the same files give the same bytes


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that are complete."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in names if len(n) == DIGITS and n.isdigit())


def _zipped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for archive, entries in frame.itertuples(index=False):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for e in entries:
                    z.writestr(zipfile.ZipInfo(e["name"], EPOCH), bytes(e["data"]), zipfile.ZIP_DEFLATED)
            yield pd.DataFrame({"archive": [archive], "content": [out.getvalue()]})


def _unzipped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for archive, content in frame.itertuples(index=False):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                rows = [(archive, i.filename, z.read(i)) for i in z.infolist()]
            yield pd.DataFrame(rows, columns=["archive", "name", "data"])


def packed(files: DataFrame, form: str) -> DataFrame:
    """archive, content: an archive of the files (archive, name, data) of each archive, in order of name; a Flex archive holds the
    names, one a line, as its first object."""
    ship(files.sparkSession)
    name = F.when(F.col("archive").isNull() | F.col("name").isNull(), F.raise_error(F.lit("an archive and a name are needed")).cast("string")).otherwise(F.col("name"))
    rows = files.select("archive", name.alias("name"), F.coalesce("data", F.lit(b"")).alias("data"))
    listed = rows.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("name", "data"))).alias("entries"))
    twice = F.size(F.array_distinct("entries.name")) < F.size("entries")
    listed = listed.withColumn("entries", F.when(twice, F.raise_error(F.lit("a name is there twice")).cast(listed.schema["entries"].dataType)).otherwise(F.col("entries")))
    if form == "zip":
        return listed.mapInPandas(_zipped, "archive string, content binary")
    names = F.array_join(F.transform("entries.name", lambda n: F.hex(F.encode(n, "UTF-8"))), "\n")
    numbered = listed.select("archive", F.posexplode(F.concat(F.array(F.struct(F.lit("").alias("name"), F.encode(names, "UTF-8").alias("data"))), "entries")).alias("num", "e"))
    return archives.as_flex(numbered.select(F.col("archive").alias("path"), "num", "e.data")).select(F.col("path").alias("archive"), "content")


def unpacked(packed_: DataFrame, form: str) -> DataFrame:
    """archive, name, data of archives (archive, content)."""
    ship(packed_.sparkSession)
    if form == "zip":
        return packed_.select("archive", "content").mapInPandas(_unzipped, "archive string, name string, data binary")
    objects = archives.decoded(packed_.select(F.col("archive").alias("path"), "content"))
    names = objects.filter("num = 0").select("path", F.posexplode(F.split(F.decode("data", "UTF-8"), "\n")).alias("num", "_n")).filter("_n <> '' OR num > 0")
    names = names.select("path", (F.col("num") + 1).alias("num"), F.decode(F.unhex("_n"), "UTF-8").alias("name"))
    return objects.filter("num > 0").join(names, ["path", "num"]).select(F.col("path").alias("archive"), "name", "data")


def save(files: DataFrame, path: str, form: str = "flex") -> int:
    """Write files (archive, name, data) as the next version under path, and return its number."""
    if form not in ("flex", "zip"):
        raise ValueError(f"no such form: {form}")
    spark = files.sparkSession
    fs, folder = _folder(spark, path)
    writing = f"{path.rstrip('/')}/.writing-{uuid.uuid4().hex}"
    try:
        packed(files, form).withColumn("form", F.lit(form)).write.parquet(writing)
        number = max(versions(spark, path), default=0)
        while True:
            number += 1
            _, final = _folder(spark, f"{path.rstrip('/')}/{number:0{DIGITS}d}")
            if not fs.exists(final) and fs.rename(_folder(spark, writing)[1], final):
                return number
            if not fs.exists(final):
                raise OSError(f"cannot rename to {final}")
    finally:
        fs.delete(_folder(spark, writing)[1], True)


def restore(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """archive, name, data of a version, the latest by default."""
    known = versions(spark, path)
    if not known or number is not None and number not in known:
        raise FileNotFoundError(f"no version {number or ''} under {path}")
    rows = spark.read.schema("archive string, content binary, form string").parquet(f"{path.rstrip('/')}/{known[-1] if number is None else number:0{DIGITS}d}")
    first = rows.select("form").head()
    return unpacked(rows, first.form if first else "flex")


def restored_file(spark: SparkSession, path: str, archive: str, number: int | None = None) -> DataFrame:
    """The files of one archive alone: the scan keeps only its row."""
    known = versions(spark, path)
    rows = spark.read.schema("archive string, content binary, form string").parquet(f"{path.rstrip('/')}/{known[-1] if number is None else number:0{DIGITS}d}").filter(F.col("archive") == archive)
    first = rows.select("form").head()
    return unpacked(rows, first.form if first else "flex")
