"""Queries over movable objects in files of superchunks and over a world stored by superchunk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial
from ..sources import movables
from ..storage import materialize, new_path
from .queries import _FLAT, _probes, query
from .world import having, view

# Shape and quality of a record hold the id here, so that records can be told apart when they are read again.
_TREE = f"""{having('thing')}, t AS (SELECT id, parent, 0 AS depth, tx % 256 AS x, ty % 256 AS y, id % 3 AS map_id, ty // 256 * 12 + tx // 256 AS sid FROM thing WHERE parent IS NULL
 UNION ALL SELECT c.id, c.parent, t.depth + 1, c.tx % 256, c.ty % 256, t.map_id, t.sid FROM thing c JOIN t ON c.parent = t.id)"""


def _written(spark, d):
    t = view(spark, d, "thing")
    k = F.col("id")
    holders = t.filter("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct().withColumn("holds", F.lit(True))
    rows = t.join(holders, "id", "left").withColumn("holds", F.coalesce("holds", F.lit(False)))
    kind = F.when(F.col("holds"), F.when(k % 7 == 0, "body").otherwise("container")).when(k % 3 == 0, "container").when(k % 4 == 1, "temporary").otherwise("simple")
    rows = rows.select("id", "parent", (k % 3).alias("map"), "tx", "ty", (F.col("tz") * 17 % 256).alias("lift"), (k % 65536).alias("shape"), "frame", F.shiftright("id", 16).bitwiseAND(255).alias("quality"), (k % 2 * 8).alias("flags"), F.lit(None).cast("int").alias("slot"), kind.alias("kind"))
    return movables.write_movables(rows, 2)


@query("s8_k2_movables", f"""{_TREE} SELECT t.id, t.parent, CAST(depth AS INTEGER) AS depth, map_id, CAST(sid AS INTEGER) AS sid, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(CASE WHEN t.id % 65536 > 1023 OR frame > 63 THEN tz * 17 % 256 ELSE tz * 17 % 256 END AS INTEGER) AS lift, CAST(frame AS INTEGER) AS frame,
 CASE WHEN h.id IS NOT NULL THEN CASE WHEN t.id % 7 = 0 THEN 'body' ELSE 'container' END WHEN t.id % 3 = 0 THEN 'container' ELSE 'simple' END AS kind,
 CAST(CASE WHEN h.id IS NOT NULL OR t.id % 3 = 0 THEN t.id % 2 * 8 WHEN t.id % 4 = 1 THEN 1 ELSE 0 END AS INTEGER) AS flags
 FROM t JOIN thing USING (id) LEFT JOIN (SELECT DISTINCT parent AS id FROM thing WHERE parent IS NOT NULL) h USING (id)""")
def s8(spark, d):
    """Things in containers of any depth, written as two files a superchunk and read again; lifts beyond 15 need the extended form."""
    found = movables.movables(_written(spark, d))
    id_ = (F.col("shape").cast("long") + F.shiftleft(F.col("quality").cast("long"), 16)).alias("id")
    # written, as both sides of the join below would else sort, write and read all files for themselves
    own = materialize(found.select(*movables.KEYS, "seq", "parent_seq", id_, "depth", "x", "y", "lift", "frame", "kind", "flags"), "records")
    above = own.select(*movables.KEYS, F.col("seq").alias("parent_seq"), F.col("id").alias("parent"))
    both = own.join(above, [*movables.KEYS, "parent_seq"], "left")
    return both.select("id", "parent", "depth", "map_id", "sid", "x", "y", "lift", "frame", "kind", "flags")


_STORED = f"{having('obj')}, w AS (SELECT *, id // 5000 AS map FROM obj), p AS (SELECT * FROM w WHERE id % 100 = 0 AND tx < 600 AND ty < 900)"


@query("s19_k2_superchunks", f"{_STORED} SELECT p.id AS p_id, o.id, {_FLAT} AS dist FROM p JOIN w o ON o.map = p.map AND {_FLAT} <= 24")
def s19(spark, d):
    """A world stored by map and superchunk; what is near the probes of one corner is read from the superchunks they reach."""
    w = view(spark, d, "obj").withColumn("map", F.call_function("div", F.col("id"), F.lit(5000)))
    path = new_path(spark, "world")
    movables.store(w, path, 2)
    probes = _probes(w).filter("tx < 600 AND ty < 900")
    found = movables.stored(spark, path, movables.reached(probes, 24)).drop("map_id", "sid")
    return spatial.near(probes, found, 24, ("map",)).select("p_id", "id", "dist")
