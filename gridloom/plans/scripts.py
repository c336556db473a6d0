"""Queries over scripts, named functions, sight, profiles, terrains and configuration."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.registry import Registry
from ..operators import graph, scripts
from ..shipping import ship
from ..sources import archives, records
from .queries import _probes, _table, query
from .world import having, view


@query("w4_scripts", """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 6 AS n, o_orderkey % 4 + 1 AS d FROM orders)
SELECT id, t AS tick, 0 AS place, 70 AS op FROM t, range(0, 6) r(t) WHERE t <= n UNION ALL SELECT id, t, 1, 11 FROM t, range(1, 7) r(t) WHERE t <= n + 1 UNION ALL SELECT id, n + 1, 4, 39 FROM t UNION ALL SELECT id, n + 1 + d, 6, 71 FROM t""")
def w4(spark, d):
    """An operation repeated n times, a delay, another operation."""
    k = F.col("o_orderkey")
    code = F.array(F.lit(70), F.lit(scripts.REPEAT), F.lit(-1), (k % 6).cast("int"), F.lit(scripts.DELAY_TICKS), (k % 4 + 1).cast("int"), F.lit(71))
    return scripts.run_scripts(_table(spark, d, "orders").select(k.alias("id"), code.alias("code"), F.lit(0).alias("near_until")), 1000)


@query("w10_purged", f"{having('thing')} SELECT id, CASE WHEN frame % 4 = 0 OR greatest(least(abs(tx - 1000), 3072 - abs(tx - 1000)), least(abs(ty - 1000), 3072 - abs(ty - 1000))) <= 400 THEN 'kept' WHEN quality = 1 THEN 'finished' ELSE 'halted' END AS fate FROM thing")
def w10(spark, d):
    from ..functions.exprs import chebyshev

    t = view(spark, d, "thing").withColumn("started", F.col("frame") % 4 == 0).withColumn("must_finish", F.col("quality") == 1)
    return scripts.purged(t, chebyshev(F.lit(1000), F.lit(1000), F.col("tx"), F.col("ty")), 400).select("id", "fate")


@query("w9_next_look", f"{having('thing')} SELECT id, id * 10 + CASE WHEN quality >= 4 THEN id % 2000 ELSE id % 4000 + 2000 END * 200 // 100 AS at FROM thing WHERE npc")
def w9(spark, d):
    k = F.col("id")
    return view(spark, d, "thing").filter("npc").select("id", scripts.next_look(k * 10, k, F.col("quality") >= 4).alias("at"))


def _functions() -> Registry:
    known = Registry()
    known.add("worth", 2, lambda price, tax: price * 2 + tax, number=10)
    known.add("double", 1, lambda price: price * 2)
    known.override("worth", 2, lambda before, price, tax: before(price, tax) + 1)
    known.override("worth", 1, lambda before, price: before(price) * 10)
    return known


@query("u1_u3_u4_functions", "SELECT o_orderkey AS id, (o_custkey * 2 + 1) * 10 AS worth, o_custkey * 2 AS twice, CASE o_orderkey % 13 WHEN 10 THEN (o_custkey * 2 + 1) * 10 WHEN 11 THEN o_custkey * 2 END AS by_number FROM orders")
def u1(spark, d):
    """A function of two arguments overridden twice, each override calling the one before it; a missing argument is 0."""
    known, c = _functions(), F.col("o_custkey")
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), known.call("worth", c).alias("worth"), known.call(11, c).alias("twice"), known.dispatch(F.col("o_orderkey") % 13, c).alias("by_number"))


@query("u7_names", "SELECT * FROM (VALUES (10, 'worth'), (11, 'double')) v(number, name)")
def u7(spark, d):
    names = F.array(*[F.struct(F.lit(i).alias("number"), F.lit(n).alias("name")) for i, n in sorted(_functions().names().items())])
    return spark.range(1).select(F.inline(names))


@query("f17_contest", "SELECT o_orderkey AS id, CASE o_orderkey % 30 WHEN 0 THEN false WHEN 29 THEN true ELSE o_orderkey % 30 + o_custkey % 12 - o_custkey % 17 >= 14 END AS won FROM orders")
def f17(spark, d):
    """A contested roll of thirty sides: the lowest always loses, the highest always wins."""
    roll, c = F.col("o_orderkey") % 30, F.col("o_custkey")
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(roll == 0, False).when(roll == 29, True).otherwise(roll + c % 12 - c % 17 >= 14).alias("won"))


@query("f19_damage", """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 31 AS str, CASE WHEN o_custkey % 20 = 0 THEN 127 ELSE o_custkey % 9 END AS wpoints, o_orderkey % 5 = 0 AS lightning, o_orderkey AS r1, o_custkey AS r2 FROM orders)
SELECT id, CASE WHEN wpoints = 127 THEN 127 ELSE CASE WHEN NOT lightning AND str // 3 > 0 THEN 1 + r1 % greatest(str // 3, 1) ELSE 0 END + CASE WHEN wpoints > 0 THEN 1 + r2 % greatest(wpoints, 1) ELSE 0 END END AS damage FROM t""")
def f19(spark, d):
    """Base damage from strength and weapon, with the rolls given; 127 points do 127."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    points, third = F.when(c % 20 == 0, 127).otherwise(c % 9), F.call_function("div", k % 31, F.lit(3))
    strong = F.when((k % 5 != 0) & (third > 0), 1 + k % F.greatest(third, F.lit(1))).otherwise(0)
    weapon = F.when(points > 0, 1 + c % F.greatest(points, F.lit(1))).otherwise(0)
    return _table(spark, d, "orders").select(k.alias("id"), F.when(points == 127, 127).otherwise(strong + weapon).alias("damage"))


_BLOCKED = "b AS (SELECT DISTINCT tx AS x, ty AS y FROM thing WHERE volume > 2)"


_ROUND = "CASE WHEN o.{0} - p.{0} >= 1536 THEN o.{0} - p.{0} - 3072 WHEN o.{0} - p.{0} <= -1536 THEN o.{0} - p.{0} + 3072 ELSE o.{0} - p.{0} END"
_CLOSE_BY = "least(abs(o.{0} - p.{0}), 3072 - abs(o.{0} - p.{0})) <= 40"


@query("g4_line_of_sight", f"""{having('thing')}, {_BLOCKED}, w AS (SELECT p.id, o.id AS to_id, p.tx AS x0, p.ty AS y0, {_ROUND.format('tx')} AS dx, {_ROUND.format('ty')} AS dy, o.tz - p.tz AS dz FROM thing p JOIN thing o ON o.id <> p.id AND p.id % 100 = 0 AND {_CLOSE_BY.format('tx')} AND {_CLOSE_BY.format('ty')}),
n AS (SELECT *, greatest(abs(dx), abs(dy), abs(dz)) AS n FROM w), s AS (SELECT n.*, unnest(range(1, greatest(n, 1))) AS i FROM n), t AS (SELECT id, to_id, (x0 + sign(dx)::BIGINT * (i * abs(dx) // n) + 3072) % 3072 AS x, (y0 + sign(dy)::BIGINT * (i * abs(dy) // n) + 3072) % 3072 AS y FROM s)
SELECT id, to_id, NOT EXISTS (SELECT 1 FROM t JOIN b USING (x, y) WHERE t.id = n.id AND t.to_id = n.to_id) AS seen FROM n""")
def g4(spark, d):
    """Whether no large thing stands on the tiles between two things at most 40 apart, round the world."""
    from ..operators import spatial

    t = view(spark, d, "thing")
    return spatial.seen(_probes(t), t.withColumn("blocks", F.col("volume") > 2), 40)


@query("a10_profile", "SELECT event_type AS phase, count(*) AS calls, sum(epoch_us(ts) % 1000000)::BIGINT AS micros FROM events GROUP BY 1")
def a10(spark, d):
    """Time spent in each named phase."""
    micros = F.unix_micros(F.col("due").cast("timestamp")) % 1_000_000
    return view(spark, d, "queue").groupBy(F.col("kind").alias("phase")).agg(F.count("*").alias("calls"), F.sum(micros).alias("micros"))


@query("m6_terrain_edits", "WITH k AS (SELECT p_partkey, p_size, CASE WHEN p_partkey = 20 THEN 30 WHEN p_partkey = 30 THEN 20 ELSE p_partkey END + 0.0 AS spot FROM part WHERE p_partkey % 10 <> 7 UNION ALL SELECT -1, 99, 50.5) SELECT (row_number() OVER (ORDER BY spot) - 1)::BIGINT AS place, p_partkey AS terrain, p_size AS size FROM k")
def m6(spark, d):
    """A list of terrains after deletions, a swap and an insertion: places are counted anew by a global sort, not in one task."""
    part = _table(spark, d, "part").select(F.col("p_partkey").alias("terrain"), F.col("p_size").alias("size"), F.col("p_partkey").cast("double").alias("at"))
    kept = part.filter("terrain % 10 <> 7").withColumn("at", F.when(F.col("terrain") == 20, 30.0).when(F.col("terrain") == 30, 20.0).otherwise(F.col("at")))
    new = spark.range(1).select(F.lit(-1).cast("long").alias("terrain"), F.lit(99).alias("size"), F.lit(50.5).alias("at"))
    return records.renumbered(kept.unionByName(new), "at").select("place", "terrain", "size")


def _terrains(spark, d, wide):
    k = F.col("terrain")
    # parts are dealt before they become 256 tiles each, so that tiles are made where they are written; a named number of tasks
    # keeps few bytes of parts from being put into one
    dealt = _table(spark, d, "part").select(F.col("p_partkey").alias("terrain"), "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "terrain")
    tiles = dealt.select("terrain", "p_size", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("i"))
    tiles = tiles.select("terrain", "i", ((k * 7 + F.col("i")) % (65536 if wide else 1024)).alias("shape"), ((F.col("p_size") + F.col("i")) % (256 if wide else 32)).alias("frame"))
    return records.terrains(records.write_terrains(tiles, wide), wide).select("terrain", "x", "y", "shape", F.col("frame").cast("int").alias("frame"))


_TERRAINS = "SELECT p_partkey AS terrain, i % 16 AS x, i // 16 AS y, (p_partkey * 7 + i) % {0} AS shape, CAST((p_size + i) % {1} AS INTEGER) AS frame FROM part, range(0, 256) r(i)"


@query("s9_terrains", _TERRAINS.format(1024, 32))
def s9(spark, d):
    """Terrains of sixteen by sixteen tiles of two bytes, one for each part, written and read again."""
    return _terrains(spark, d, False)


@query("s9_terrains_wide", _TERRAINS.format(65536, 256))
def s9_wide(spark, d):
    """Tiles of three bytes."""
    return _terrains(spark, d, True)


@query("s17_config", "SELECT 'config/nations/n' || n_nationkey AS path, n_name AS value FROM nation UNION ALL SELECT 'config/regions', CAST(count(*) AS VARCHAR) FROM region")
def s17(spark, d):
    """A tree of settings written as text and read as paths and values."""
    ship(spark)
    k = F.col("n_nationkey").cast("string")
    named = _table(spark, d, "nation").select(F.concat(F.lit("<n"), k, F.lit(">"), "n_name", F.lit("</n"), k, F.lit(">")).alias("x")).agg(F.array_join(F.array_sort(F.collect_list("x")), "\n").alias("x"))
    n = _table(spark, d, "region").count()
    return archives.settings(named.select(F.lit("").alias("path"), F.concat(F.lit("<config><nations>"), "x", F.lit(f"</nations><regions> {n} </regions></config>")).alias("value")))
