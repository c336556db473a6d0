"""What the corpus operators share: reading, checkpoint folders, word rules."""

from __future__ import annotations

import gc
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, shared_dir  # noqa: F401 (of all operators here)

# Words are runs of anything but the six ASCII blanks.
BLANK_CLASS = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as one literal of the plan (no pandas or Python workers)."""
    names = [f.split()[0] for f in _fields(schema)]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{','.join(':'.join(f.split(maxsplit=1)) for f in _fields(schema))}>>")))


def _fields(schema: str) -> list[str]:
    return [f.strip() for f in schema.split(";")]


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referenced; they go with the JVM's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """Evaluate value once and use it many times inside body (an array of one element, transformed)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words; empty for null and blank texts."""
    cut = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), BLANK_CLASS + "+")
    return let(cut, lambda w: F.when((F.size(w) == 1) & (F.get(w, F.lit(0)) == ""), F.array().cast("array<string>")).otherwise(w))


def content_id() -> Column:
    """A hash of doc_id and text: the same in every reading of a table, and for repeated rows."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
