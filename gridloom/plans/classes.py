"""Queries over classes and static values of scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.registry import Registry
from ..operators import classes
from .queries import _table, query


def _known() -> Registry:
    known = Registry()
    known.add("price", 2, lambda a, b: a * 3 + b, number=0)
    known.add("difference", 2, lambda a, b: a - b)
    known.add("double", 1, lambda a: a * 2)
    return known


_CLASSES = """c AS (SELECT p_partkey AS class, CASE WHEN p_partkey % 50 > 0 THEN CAST((p_partkey - p_partkey % 3) / 3 AS BIGINT) END AS parent FROM part),
m AS (SELECT p_partkey AS class, v AS method, (p_partkey + v) % 3 AS function FROM part, (VALUES (0), (1), (2)) t(v) WHERE p_partkey % (v + 2) = 0),
l AS (SELECT class AS node, class AS ancestor, 0 AS depth FROM c UNION ALL SELECT l.node, c.parent, depth + 1 FROM l JOIN c ON c.class = l.ancestor WHERE c.parent IS NOT NULL),
r AS (SELECT node AS class, method, ancestor AS owner, function, lead(function) OVER w AS super, row_number() OVER w AS k FROM l JOIN m ON m.class = l.ancestor WINDOW w AS (PARTITION BY node, method ORDER BY depth))"""


def _classes(spark, d):
    p = F.col("p_partkey")
    part = _table(spark, d, "part")
    tree = part.select(p.alias("class"), F.when(p % 50 > 0, F.call_function("div", p, F.lit(3))).alias("parent"))
    methods = part.select(p.alias("class"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("method")).filter("class % (method + 2) = 0")
    return classes.method_table(tree, methods.withColumn("function", (F.col("class") + F.col("method")) % 3))


@query("u5_methods", f"WITH RECURSIVE {_CLASSES} SELECT class, method, owner, function, super FROM r WHERE k = 1")
def u5(spark, d):
    """What each part, as a class under a third of its key, answers to three methods, and what that would call above it."""
    return _classes(spark, d)


@query("u5_called", f"""WITH RECURSIVE {_CLASSES} SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, CASE r.function WHEN 0 THEN l_partkey * 3 + l_suppkey WHEN 1 THEN l_partkey - l_suppkey WHEN 2 THEN l_partkey * 2 END AS answer
FROM lineitem LEFT JOIN r ON r.class = l_partkey AND r.method = l_linenumber % 4 AND k = 1""")
def u5_called(spark, d):
    """Each line calls a method of its part's class; the fourth is one that no class has."""
    line = _table(spark, d, "lineitem")
    calls = line.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("class"), (F.col("l_linenumber") % 4).alias("method"))
    return classes.called(calls, _classes(spark, d), _known(), F.col("part"), F.col("supp")).select("id", "line", "part", "supp", "answer")


@query("u8_statics", """WITH e AS (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN user_id % 20 END AS owner, event_id % 4 AS slot, epoch_us(ts) // 1000 AS at FROM events),
w AS (SELECT * FROM e WHERE event_id % 2 = 0), k AS (SELECT r.event_id AS read_id, w.event_id AS value, row_number() OVER (PARTITION BY r.event_id ORDER BY w.at DESC, w.event_id DESC) AS n FROM e r LEFT JOIN w ON w.owner IS NOT DISTINCT FROM r.owner AND w.slot = (r.slot + r.event_id % 2) % 4 AND w.at <= r.at WHERE r.event_id % 2 = 1)
SELECT read_id, coalesce(value, 0) AS value FROM k WHERE n = 1""")
def u8(spark, d):
    """Half of the events write a static of their user's function, a third of it one that all share; the others read one."""
    k = F.col("event_id")
    e = _table(spark, d, "events").select(k, F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 20).alias("owner"), (k % 4).alias("slot"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    writes = e.filter("event_id % 2 = 0").select("owner", "slot", "at", k.alias("seq"), k.alias("value"))
    reads = e.filter("event_id % 2 = 1").select(k.alias("read_id"), "owner", ((F.col("slot") + k % 2) % 4).alias("slot"), "at")
    return classes.statics_as_of(writes, reads)
