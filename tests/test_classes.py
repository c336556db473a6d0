"""Classes and statics: odd tables, and statics on a stream against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.registry import Registry
from gridloom.operators import classes
from gridloom.streaming import timers
from gridloom.streaming.statics import statics_stream

CLASSES, METHODS = "class long, parent long", "class long, method string, function long"
WRITES, READS = "owner long, slot long, at long, seq long, value long", "read_id long, owner long, slot long, at long"


def test_methods_of_the_nearest_class(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (4, 3), (9, 8), (None, 1)], CLASSES)
    methods = spark.createDataFrame([(1, "a", 10), (3, "a", 30), (2, "b", 20), (2, "b", 21), (8, "c", 80), (7, "d", 70), (1, None, 1), (None, "a", 5), (4, "e", None)], METHODS)
    got = {(r["class"], r.method): (r.owner, r.function, r.super) for r in classes.method_table(tree, methods).collect()}
    assert got == {(1, "a"): (1, 10, None), (2, "a"): (1, 10, None), (3, "a"): (3, 30, 10), (4, "a"): (3, 30, 10), (2, "b"): (2, 21, None), (3, "b"): (2, 21, None), (4, "b"): (2, 21, None), (9, "c"): (8, 80, None), (4, "e"): (4, None, None)}
    known = Registry()
    known.add("f", 1, lambda v: v + 1, number=10)
    calls = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", None, "x"), (4, "a", 5, "x"), (None, "a", 5, "x"), (1, "z", 5, "x"), (1, None, 5, "x"), (1, "a", 5, "x")], "class long, method string, v long, answer_ string").withColumnRenamed("answer_", "function")
    answered = classes.called(calls, classes.method_table(tree, methods), known, F.col("v")).select("class", "method", "answer", "function").collect()
    assert sorted(map(str, map(tuple, answered))) == sorted(map(str, [(1, "a", 6, "x"), (2, "a", None, "x"), (4, "a", None, "x"), (None, "a", None, "x"), (1, "z", None, "x"), (1, None, None, "x"), (1, "a", 6, "x")]))
    assert classes.method_table(tree.filter("false"), methods).count() == classes.method_table(tree, methods.filter("false")).count() == 0
    with pytest.raises(ValueError):
        classes.method_table(spark.createDataFrame([(1, 2), (2, 1)], CLASSES), methods)


def script(seed):
    rng = random.Random(seed)
    writes = [(rng.choice((None, 1, 2)), rng.randrange(3), 100 * i + rng.randrange(90), i, rng.randrange(1000)) for i in range(80)]
    reads = [(1000 + i, rng.choice((None, 1, 2, 5)), rng.randrange(3), rng.randrange(8000)) for i in range(80)]
    return writes, reads


def by_hand(writes, reads):
    out = {}
    for read_id, owner, slot, at in reads:
        seen = [(w[2], w[3], w[4]) for w in writes if w[:2] == (owner, slot) and w[2] <= at]
        out[read_id] = max(seen)[2] if seen else 0
    return out


@pytest.mark.parametrize("width", [1, 700, 1 << 20])
def test_statics_by_hand(spark, width):
    writes, reads = script(4)
    writes += [(None, 0, 500, 900, 7), (None, 0, 500, 901, 8)]
    got = classes.statics_as_of(spark.createDataFrame(writes, WRITES), spark.createDataFrame(reads, READS), width).collect()
    assert dict(map(tuple, got)) == by_hand(writes, reads) and len(got) == len(reads)


def test_odd_statics(spark):
    writes = spark.createDataFrame([(1, None, 5, 1, 9), (1, 0, None, 1, 9), (1, 0, 5, None, None), (1, 1, -7, 1, 3), (1, 1, -7, 1, 3)], WRITES)
    reads = spark.createDataFrame([(1, 1, None, 9), (2, 1, 0, None), (3, 1, 0, 9), (4, 1, 1, -7), (5, 1, 1, -8), (6, None, 1, 0), (None, 1, 1, 0)], READS)
    assert sorted(map(str, map(tuple, classes.statics_as_of(writes, reads).collect()))) == sorted(map(str, [(1, 0), (2, 0), (3, 0), (4, 3), (5, 0), (6, 0), (None, 3)]))
    assert classes.statics_as_of(writes.filter("false"), reads).agg(F.sum("value")).head()[0] == 0
    assert classes.statics_as_of(writes, reads.filter("false")).count() == 0


def test_statics_on_a_stream_equal_the_batch(spark, tmp_path):
    timers.prepare(spark)
    writes, reads = script(8)
    rows = sorted([(o, at, seq, slot, value, None) for o, slot, at, seq, value in writes] + [(o, at, None, slot, None, r) for r, o, slot, at in reads], key=lambda r: r[1])
    rows = [r for _, r in sorted(((i + random.Random(i).randrange(12), r) for i, r in enumerate(rows)), key=lambda e: e[0])] + [(77, 10**6, 0, 0, 0, None)]
    for i in range(4):
        part = rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        spark.createDataFrame(part, "owner long, at long, seq long, slot long, value long, read_id long").coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    schema = "owner long, at long, seq long, slot long, value long, read_id long"
    # files are taken in the order of their age
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = statics_stream(source, "3 seconds").writeStream.format("memory").queryName("statics_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300) and not q.exception()
    assert dict(map(tuple, spark.table("statics_out").collect())) == by_hand(writes, reads)
