"""Queries over queues and scripts in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal
from ..streaming import timers
from .queries import query
from .world import view

_Q = "WITH q AS (SELECT user_id AS key, event_id, epoch_us(ts) // 1000 AS due, event_id AS seq FROM events), n AS (SELECT min(due) + (max(due) - min(due)) // 2 AS now FROM q) "


def _queue(spark, d):
    q = view(spark, d, "queue").select(F.col("k").alias("key"), "event_id", F.unix_millis(F.col("due").cast("timestamp")).alias("due"), F.col("event_id").alias("seq"))
    now = q.agg((F.min("due") + F.call_function("div", F.max("due") - F.min("due"), F.lit(2))).alias("now")).head().now
    return q, F.lit(now)


@query("w1_popped", _Q + "SELECT key, event_id, row_number() OVER (PARTITION BY key ORDER BY due, seq) AS place FROM q, n WHERE due <= now")
def w1(spark, d):
    """What is due at the middle of all times, in order."""
    q, now = _queue(spark, d)
    return temporal.popped(q, now).select("key", "event_id", F.col("place").cast("long").alias("place"))


@query("w3_cancel_and_delay", _Q + ", p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY due, seq) AS k FROM q), c AS (SELECT * FROM p WHERE k > key % 3), f AS (SELECT key, min(due) AS due FROM c GROUP BY key) SELECT k.key, CASE WHEN f.due IS NULL THEN -1 ELSE greatest(f.due - now, 0) END AS delay FROM (SELECT DISTINCT key FROM q) k LEFT JOIN f USING (key), n")
def w3(spark, d):
    """After the first entries of some keys are cancelled: how long until the next entry of each key."""
    q, now = _queue(spark, d)
    keys = q.select("key").distinct()
    left = temporal.cancelled(q, keys.select("key", (F.col("key") % 3).alias("n")))
    return temporal.remaining(left, keys, now)


@query("w12_halted", _Q + "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN lead(due) OVER (PARTITION BY key ORDER BY due, seq) END AS ended FROM q")
def w12(spark, d):
    q, _ = _queue(spark, d)
    scripts = q.select("key", "event_id", F.col("due").alias("started"), "seq", (F.col("event_id") % 4 == 0).alias("dont_halt"))
    return temporal.halted(scripts).select("event_id", "ended")


@query("w1_w3_fired", """WITH q AS (SELECT user_id AS key, event_id, epoch_us(ts) // 1000 AS added FROM events), n AS (SELECT min(added) + (max(added) - min(added)) // 2 AS now FROM q)
SELECT key, event_id, added + event_id % 7 * 1000 AS due FROM q, n WHERE added + event_id % 7 * 1000 <= now AND NOT (event_id % 3 = 0 AND event_id % 7 > 2)""")
def w1_fired(spark, d):
    """Entries due some seconds after they are added; a third is cancelled two seconds on, too late for some. The stream's twin."""
    q, now = _queue(spark, d)
    adds = q.select("key", F.col("due").alias("at"), "seq", F.lit("add").alias("what"), "event_id", (F.col("due") + F.col("event_id") % 7 * 1000).alias("due"))
    cancels = adds.filter("event_id % 3 = 0").select("key", (F.col("at") + 2000).alias("at"), "seq", F.lit("cancel").alias("what"), "event_id", F.lit(None).cast("long").alias("due"))
    return timers.fired(adds.unionByName(cancels), now)


_AROUND = """WITH v AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS "at", event_id AS seq, (event_id // 60 + user_id * 11) % 192 // {block} AS x, (event_id // 90 + user_id * 3) % 192 // {block} AS y FROM events),
p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v WINDOW w AS (PARTITION BY key ORDER BY "at", seq)), d AS (SELECT i, j FROM range(-{reach}, {reach} + 1) r(i), range(-{reach}, {reach} + 1) s(j)),
n AS (SELECT key, "at", seq, (x + i + {across}) % {across} AS bx, (y + j + {across}) % {across} AS "by" FROM p, d), o AS (SELECT key, "at", seq, (px + i + {across}) % {across} AS bx, (py + j + {across}) % {across} AS "by" FROM p, d WHERE px IS NOT NULL)
SELECT key, "at", seq, CAST(bx AS INTEGER) AS bx, CAST("by" AS INTEGER) AS "by", true AS loaded FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT key, "at", seq, CAST(bx AS INTEGER), CAST("by" AS INTEGER), false FROM (SELECT * FROM o EXCEPT SELECT * FROM n)"""


def _visits(spark, d):
    q, _ = _queue(spark, d)
    place = lambda by, own: (F.call_function("div", F.col("event_id"), F.lit(by)) + F.col("key") * own) % 192
    return q.select("key", F.col("due").alias("at"), "seq", place(60, 11).alias("x"), place(90, 3).alias("y"))


@query("w11_chunks_held", _AROUND.format(block=1, reach=2, across=192))
def w11(spark, d):
    """The chunks that come and go as each user moves, five by five round the one that is visited."""
    return temporal.cache_changes(_visits(spark, d), 1, 2, 192, 1 << 22)


@query("w11_superchunks_held", _AROUND.format(block=16, reach=1, across=12))
def w11_super(spark, d):
    return temporal.cache_changes(_visits(spark, d), 16, 1, 12, 1 << 22)
