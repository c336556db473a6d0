"""Classes with single inheritance, and static values read as of a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.registry import Registry
from .hierarchy import closure


def method_table(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """class, method, owner, function, super: what each class answers to each method that it or an ancestor has.

    classes: class, parent; methods: class, method, function. The nearest class that has the method owns it; super is the
    function of the next one up, null where there is none. Of several functions that one class gives a method the largest
    counts; methods of unknown classes are not answered; a class that inherits from itself is an error; a null class or
    method answers nothing.
    """
    lines = closure(classes.filter("class IS NOT NULL").select(F.col("class").alias("node"), "parent").distinct())
    own = methods.filter("method IS NOT NULL").groupBy(F.col("class").alias("ancestor"), "method").agg(F.max("function").alias("function"))
    found = lines.join(own, "ancestor").groupBy(F.col("node").alias("class"), "method")
    # a line of ancestors is as long as the inheritance is deep; the two nearest are enough
    line = F.slice(F.array_sort(F.collect_set(F.struct("depth", F.col("ancestor").alias("owner"), "function"))), 1, 2)
    return found.agg(line.alias("l")).select("class", "method", F.col("l")[0]["owner"].alias("owner"), F.col("l")[0]["function"].alias("function"), F.get(F.col("l.function"), F.lit(1)).alias("super"))


def called(calls: DataFrame, table: DataFrame, known: Registry, *args: Column) -> DataFrame:
    """Adds answer to calls (class, method, and what args name): the value of the function that the class answers with.

    Null where the class does not answer the method or no function has that number. The table is a row a class and method and
    is joined by both, so a class with most of the calls can be split.
    """
    rows = calls.withColumnsRenamed({"class": "_class", "method": "_method"})
    own = table.select(F.col("class").alias("_class"), F.col("method").alias("_method"), F.col("function").alias("_function"))
    answer = known.dispatch(F.col("_function"), *args)
    return rows.join(own, ["_class", "_method"], "left").withColumn("answer", answer).drop("_function").withColumnsRenamed({"_class": "class", "_method": "method"}).select(*calls.columns, "answer")


def statics_as_of(writes: DataFrame, reads: DataFrame, width: int = 1 << 20) -> DataFrame:
    """read_id, value of reads (read_id, owner, slot, at): the last value written before or at that time, 0 where none was.

    writes: owner (a function; null for values that all share), slot, at, seq, value. Of writes at one time the last by seq
    counts. Time is cut into spans of `width`, and each owner, slot and span is sorted by itself; the value a span begins with
    is the last of the spans before it, of which there is one row each. So a value that most rows write or read is many groups.
    A null slot or time of a write writes nothing, of a read reads 0; a null value written is 0.
    """
    key = ["_owner", "slot"]
    own = F.struct(F.col("owner").isNull().alias("all"), F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("of")).alias("_owner")
    span = F.floor(F.col("at") / width)
    wrote = writes.filter("slot IS NOT NULL AND at IS NOT NULL").select(own, "slot", "at", F.lit(0).alias("_read"), F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("value", F.lit(0)).cast("long").alias("value"), F.lit(None).cast(reads.schema["read_id"].dataType).alias("read_id"))
    asked = reads.select(own, "slot", "at", F.lit(1).alias("_read"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("long").alias("value"), "read_id")
    rows = wrote.unionByName(asked).withColumn("_span", span)
    ends = wrote.withColumn("_span", span).groupBy(*key, "_span").agg(F.max_by("value", F.struct("at", "seq", "value")).alias("last"))
    # one row a span in which something is written or read
    spans = rows.select(*key, "_span").distinct().join(ends, [*key, "_span"], "left")
    before = F.last("last", ignorenulls=True).over(W.partitionBy(*key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
    begin = spans.withColumn("_begin", before).select(*key, "_span", "_begin")
    order = W.partitionBy(*key, "_span").orderBy("at", "_read", "seq", "value").rowsBetween(W.unboundedPreceding, 0)
    now = rows.withColumn("_now", F.last("value", ignorenulls=True).over(order)).filter("_read = 1")
    found = now.join(begin, [*key, "_span"], "left").select("read_id", F.coalesce("_now", "_begin", F.lit(0)).alias("value"))
    return found
