"""Registered queries over the world views, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import dims, graph, hierarchy, spatial, temporal
from .world import having, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _probes(obj: DataFrame, every: int = 100) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return obj.filter(F.col("id") % every == 0)


_GAPX, _GAPY = "least(abs(p.tx - o.tx), 3072 - abs(p.tx - o.tx))", "least(abs(p.ty - o.ty), 3072 - abs(p.ty - o.ty))"
_FLAT = f"greatest({_GAPX}, {_GAPY})"
_PAIRS = f"{having('obj')}, prb AS (SELECT * FROM obj WHERE id % 100 = 0), hit AS (SELECT p.id AS p_id, p.tx AS p_tx, p.ty AS p_ty, p.tz AS p_tz, p.side AS p_side, o.*, {_FLAT} AS dist FROM prb p, obj o WHERE {_FLAT} <= {{r}}) "


@query("j1_find_nearby", _PAIRS.format(r=24) + "SELECT p_id, id, dist, row_number() OVER (PARTITION BY p_id ORDER BY ty DESC, tx DESC, tz DESC, id) AS place FROM hit")
def j1(spark, d):
    obj = view(spark, d, "obj")
    return spatial.nearby_ids(_probes(obj), obj, 24)


@query("p1_wildcard_nearby", _PAIRS.format(r=64) + "SELECT p_id, count(*) AS n FROM hit WHERE frame = 7 GROUP BY p_id")
def p1(spark, d):
    obj = view(spark, d, "obj")
    return spatial.find_nearby(_probes(obj), obj, 64, frame=7).groupBy("p_id").agg(F.count("*").alias("n"))


@query("j2_rectangle", f"{having('obj')} SELECT p.id AS p_id, o.id FROM obj p JOIN obj o ON p.id % 100 = 0 AND (o.tx - p.tx + 3072) % 3072 < 200 AND (o.ty - p.ty + 3072) % 3072 < 100 AND o.frame = p.frame AND o.shape % 4 = p.shape % 4")
def j2(spark, d):
    obj = view(spark, d, "obj").withColumn("shape", F.col("shape") % 4)  # few shapes, so that some match
    return spatial.in_rectangle(_probes(obj), obj, 200, 100).select("p_id", "id")


@query("t2_nearest_flat", _PAIRS.format(r=96) + "SELECT p_id, arg_min(id, ((tx-p_tx)*(tx-p_tx)+(ty-p_ty)*(ty-p_ty)+(tz-p_tz)*(tz-p_tz)) * 1000000 + id) AS id, min((tx-p_tx)*(tx-p_tx)+(ty-p_ty)*(ty-p_ty)+(tz-p_tz)*(tz-p_tz)) AS d FROM hit WHERE id <> p_id AND (tx-p_tx)*(tx-p_tx)+(ty-p_ty)*(ty-p_ty)+(tz-p_tz)*(tz-p_tz) < 100000 GROUP BY p_id")
def t2(spark, d):
    obj = view(spark, d, "obj").select("id", "tx", "ty", "tz")
    dx, dy, dz = F.col("tx") - F.col("p_tx"), F.col("ty") - F.col("p_ty"), F.col("tz") - F.col("p_tz")
    return spatial.nearest(_probes(obj), obj, 96, dx * dx + dy * dy + dz * dz, lambda r: (r + 1) ** 2).filter("d < 100000")  # not round the world: across a seam it is far


@query("t3_nearest_wrapped", _PAIRS.format(r=96) + "SELECT p_id, arg_min(id, greatest(dist, abs(tz - p_tz)) * 1000000 + id) AS id, min(greatest(dist, abs(tz - p_tz))) AS d FROM hit WHERE id <> p_id GROUP BY p_id")
def t3(spark, d):
    obj = view(spark, d, "obj").select("id", "tx", "ty", "tz")
    return spatial.nearest(_probes(obj), obj, 96, F.greatest("dist", F.abs(F.col("tz") - F.col("p_tz"))))


@query("t4_k_nearest", _PAIRS.format(r=96) + "SELECT * FROM (SELECT p_id, id, greatest(dist, abs(tz - p_tz)) AS d, row_number() OVER (PARTITION BY p_id ORDER BY greatest(dist, abs(tz - p_tz)), id) AS place FROM hit WHERE id <> p_id) WHERE place <= 5")
def t4(spark, d):
    obj = view(spark, d, "obj").select("id", "tx", "ty", "tz")
    return spatial.k_nearest(_probes(obj), obj, 96, 5).select("p_id", "id", "d", F.col("place").cast("long"))


@query("j4_enclosing_group", f"{having('obj')}, h AS (SELECT p.id AS p_id, o.id, o.tx, o.ty, o.tz, p.tz AS p_tz FROM obj p JOIN obj o ON p.id % 10 = 0 AND o.id <> p.id AND {_FLAT} <= 20 AND (o.tx - p.tx + 3072) % 3072 < 8 AND (o.ty - p.ty + 3072) % 3072 < 8) SELECT p_id, id FROM (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY CASE WHEN tz <= p_tz THEN tz ELSE -1 END DESC, ty DESC, tx DESC, tz DESC, id) AS k FROM h) WHERE k = 1")
def j4(spark, d):
    obj = view(spark, d, "obj")
    return spatial.enclosing(_probes(obj, 10), obj).select("p_id", "id")


@query("a8_hostile_near", _PAIRS.format(r=48) + "SELECT p_id AS id FROM hit WHERE side <> 0 AND p_side <> 0 AND side <> p_side GROUP BY p_id")
def a8(spark, d):
    obj = view(spark, d, "obj")
    return spatial.with_any(_probes(obj), obj, 48, spatial.hostile(F.col("side"), F.col("p_side"))).select("id")


@query("c1_spot_occupied", _PAIRS.format(r=12) + "SELECT p_id AS id FROM hit WHERE id <> p_id AND tz // 5 = p_tz // 5 GROUP BY p_id")
def c1(spark, d):
    obj = view(spark, d, "obj")
    floor = lambda c: F.call_function("div", F.col(c), F.lit(5))
    return spatial.with_any(_probes(obj), obj, 12, (F.col("id") != F.col("p_id")) & (floor("tz") == floor("p_tz"))).select("id")


@query("c3_tables_by_chairs", _PAIRS.format(r=32) + ", s AS (SELECT DISTINCT p_id FROM hit WHERE frame % 4 = 1) SELECT id, id IN (SELECT p_id FROM s) AS eating FROM prb")
def c3(spark, d):
    obj = view(spark, d, "obj")
    probes = _probes(obj)
    chairs = F.col("frame") % 4 == 1
    eating = spatial.with_any(probes, obj, 32, chairs).select("id", F.lit(True).alias("eating"))
    return eating.unionByName(spatial.with_any(probes, obj, 32, chairs, anti=True).select("id", F.lit(False).alias("eating")))


@query("c4_expanding_radius", _PAIRS.format(r=50) + ", t AS (SELECT p_id, id, CASE WHEN dist <= 26 THEN 26 WHEN dist <= 36 THEN 36 ELSE 50 END AS tier FROM hit WHERE id <> p_id) SELECT p_id, id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY p_id) AS least FROM t) WHERE tier = least")
def c4(spark, d):
    obj = view(spark, d, "obj")
    return spatial.smallest_tier(_probes(obj), obj, (26, 36, 50)).select("p_id", "id", "tier")


@query("c5_unattended", _PAIRS.format(r=6) + "SELECT id FROM prb WHERE id NOT IN (SELECT p_id FROM hit WHERE id <> p_id AND side > 1)")
def c5(spark, d):
    obj = view(spark, d, "obj")
    return spatial.with_any(_probes(obj), obj, 6, (F.col("id") != F.col("p_id")) & (F.col("side") > 1), anti=True).select("id")


@query("c10_on_moving_group", _PAIRS.format(r=40) + "SELECT p_id, count(*) AS n, sum(tz) AS height FROM hit WHERE id <> p_id AND tz > p_tz AND tz <= p_tz + 5 GROUP BY p_id")
def c10(spark, d):
    obj = view(spark, d, "obj")
    hits = spatial.near(_probes(obj), obj, 40).filter("id <> p_id AND tz > p_tz AND tz <= p_tz + 5")
    return hits.groupBy("p_id").agg(F.count("*").alias("n"), F.sum("tz").alias("height"))


@query("f3_f6_f7_way", f"""{having('obj')}, w AS (SELECT p.id, o.tx - p.tx AS x, o.ty - p.ty AS y FROM obj p JOIN obj o ON o.id = p.id + 1),
v AS (SELECT id, CASE WHEN x >= 1536 THEN x - 3072 WHEN x <= -1536 THEN x + 3072 ELSE x END AS dx, CASE WHEN y >= 1536 THEN y - 3072 WHEN y <= -1536 THEN y + 3072 ELSE y END AS dy FROM w),
u AS (SELECT *, CASE WHEN dx = 0 THEN 0 ELSE (1024 * dy) // dx END AS t FROM v)
SELECT id, dx, dy, greatest(abs(dx), abs(dy)) AS far, CASE WHEN dx = 0 THEN CASE WHEN dy > 0 THEN 0 ELSE 4 END WHEN dx > 0 THEN CASE WHEN t >= 2472 THEN 0 WHEN t >= 424 THEN 1 WHEN t >= -424 THEN 2 WHEN t >= -2472 THEN 3 ELSE 4 END
 ELSE CASE WHEN t >= 2472 THEN 4 WHEN t >= 424 THEN 5 WHEN t >= -424 THEN 6 WHEN t >= -2472 THEN 7 ELSE 0 END END AS facing FROM u""")
def f3(spark, d):
    obj = view(spark, d, "obj").select("id", "tx", "ty")
    to = obj.select((F.col("id") - 1).alias("id"), F.col("tx").alias("ox"), F.col("ty").alias("oy"))
    way = obj.join(to, "id").select("id", E.delta(F.col("tx"), F.col("ox")).alias("dx"), E.delta(F.col("ty"), F.col("oy")).alias("dy"), E.chebyshev(F.col("tx"), F.col("ty"), F.col("ox"), F.col("oy")).alias("far"))
    return way.withColumn("facing", E.direction(F.col("dx"), F.col("dy")))


@query("f1_script_arithmetic", """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 50 - 25 END AS a, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey % 5 - 1 END AS b, o_orderpriority AS s FROM orders)
SELECT id, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a + b END AS total,
 CASE WHEN b IS NULL THEN 0 WHEN b = 0 THEN CASE WHEN coalesce(a, 0) < 0 THEN -9223372036854775808 ELSE 9223372036854775807 END ELSE coalesce(a, 0) // b END AS quotient,
 CASE WHEN b IS NULL THEN 0 WHEN b = 0 THEN CASE WHEN coalesce(a, 0) < 0 THEN -9223372036854775808 ELSE 9223372036854775807 END ELSE coalesce(a, 0) % b END AS remainder,
 coalesce(TRY_CAST(regexp_extract(s, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS leading, CASE WHEN left(s, 1) IN ('a','e','i','o','u','y','A','E','I','O','U','Y') THEN 'an' ELSE 'a' END AS article FROM t""")
def f1(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = _table(spark, d, "orders").select(k.alias("id"), F.when(k % 7 != 0, k % 50 - 25).alias("a"), F.when(c % 11 != 0, c % 5 - 1).alias("b"), F.col("o_orderpriority").alias("s"))
    a, b = F.col("a"), F.col("b")
    return t.select("id", E.plus(a, b).alias("total"), E.divided(a, b).alias("quotient"), E.divided(a, b, "mod").alias("remainder"), E.leading_int(F.col("s")).alias("leading"), E.a_or_an(F.col("s")).alias("article"))


@query("f15_arrays", "WITH t AS (SELECT l_orderkey AS id, list_sort(list(CAST(l_quantity AS BIGINT))) AS v FROM lineitem GROUP BY 1) SELECT id, CAST(len(v) AS BIGINT) AS n, v[1] AS first, coalesce(v[3], 0) AS third, list_contains(v, 7) AS has_seven, list_sum(list_concat(v, [1, 2])) AS total FROM t")
def f15(spark, d):
    t = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("long"))).alias("v"))
    v = F.col("v")
    total = F.aggregate(F.concat(v, F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))), F.lit(0).cast("long"), lambda x, y: x + y)
    return t.select("id", F.size(v).cast("long").alias("n"), E.item(v, F.lit(1)).alias("first"), E.item(v, F.lit(3)).alias("third"), F.array_contains(v, F.lit(7).cast("long")).alias("has_seven"), total.cast("decimal(38,0)").alias("total"))


@query("f21_stack_frames", f"{having('item')} SELECT CASE WHEN quantity > 12 THEN 7 WHEN quantity > 6 THEN 6 ELSE quantity - 1 END AS band, count(*) AS n FROM item GROUP BY 1")
def f21(spark, d):
    return view(spark, d, "item").groupBy(E.stack_frame(F.col("quantity")).alias("band")).agg(F.count("*").alias("n"))


@query("f10_clock", "SELECT event_id, hour(ts) // 3 AS slot, dayofyear(ts) * 24 + hour(ts) AS hours, (dayofyear(ts) * 24 + hour(ts)) * 60 + minute(ts) AS minutes FROM events")
def f10(spark, d):
    day, hour = F.dayofyear("ts"), F.hour("ts")
    return _table(spark, d, "events").select("event_id", F.call_function("div", hour, F.lit(3)).alias("slot"), (day * 24 + hour).cast("long").alias("hours"), ((day * 24 + hour) * 60 + F.minute("ts")).cast("long").alias("minutes"))


@query("f11_clock_increment", """WITH t AS (SELECT event_id, dayofyear(ts) AS d, hour(ts) AS h, minute(ts) AS m, event_id % 3000 AS more FROM events),
r AS (SELECT *, more + 7 - (more + 7) % 15 AS inc FROM t), u AS (SELECT event_id, d * 1440 + h * 60 + m + inc AS total FROM r)
SELECT event_id, total // 1440 AS day, total % 1440 // 60 AS hour, total % 60 AS minute FROM u""")
def f11(spark, d):
    after = E.clock_after(F.dayofyear("ts"), F.hour("ts"), F.minute("ts"), F.col("event_id") % 3000)
    return _table(spark, d, "events").select("event_id", after.alias("t")).select("event_id", "t.day", "t.hour", "t.minute")


@query("p8_substring", "SELECT 'part' AS kind, p_partkey AS id, instr(lower(p_name), 'a') AS at FROM part WHERE contains(lower(p_name), 'a') UNION ALL SELECT 'document', doc_id, instr(lower(text), 'a') FROM documents WHERE contains(lower(text), 'a')")
def p8(spark, d):
    """Every part name and every document whose text holds the letters, in any case; at is the place of the first hit, from 1."""
    named = _table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    told = _table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    hit = named.unionByName(told).withColumn("at", F.instr(F.lower("text"), "a"))
    return hit.filter(F.col("at") > 0).select("kind", "id", F.col("at").cast("long").alias("at"))


_TREE = f"{having('thing')}, inside AS (SELECT parent AS owner, id FROM thing WHERE parent IN (SELECT id FROM thing WHERE {{ok}}) UNION ALL SELECT t.parent, i.id FROM inside i JOIN thing t ON t.id = i.owner WHERE t.parent IN (SELECT id FROM thing WHERE {{ok}})) "
_HOLDS = "NOT (shape = 17 OR burning)"


@query("a1_recursive_count", _TREE.format(ok=_HOLDS) + "SELECT owner, sum(quantity)::BIGINT AS n FROM inside JOIN thing USING (id) WHERE shape = 17 AND frame % 32 % 4 = 3 GROUP BY owner")
def a1(spark, d):
    """How many of a shape lie in each container, at any depth; frames are told apart by their low bits here, so that some match."""
    things = view(spark, d, "thing").withColumn("frame", F.col("frame") % 4)
    return hierarchy.recursive_count(things, 17, 3, refuses=F.col("burning")).select("owner", F.col("n").cast("long").alias("n"))


@query("a2_party_count", _TREE.format(ok=_HOLDS) + "SELECT owner % 3 AS party, sum(quantity)::BIGINT AS n FROM inside JOIN thing USING (id) WHERE shape = 17 AND owner IN (SELECT id FROM thing WHERE parent IS NULL) GROUP BY 1")
def a2(spark, d):
    """The counts of all members of a party: the roots of the forest are the members, of three parties."""
    things = view(spark, d, "thing")
    members = things.filter("parent IS NULL").select(F.col("id").alias("owner"))
    return hierarchy.recursive_count(things, 17, refuses=F.col("burning")).join(members, "owner", "left_semi").groupBy((F.col("owner") % 3).alias("party")).agg(F.sum("n").cast("long").alias("n"))


@query("a3_rolled_up_weight", """WITH l AS (SELECT l_orderkey AS o, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY 1), o AS (SELECT o_custkey AS c, sum(w) AS w FROM l JOIN orders ON o = o_orderkey GROUP BY 1),
c AS (SELECT c_nationkey AS n, sum(w) AS w FROM o JOIN customer ON c = c_custkey GROUP BY 1), n AS (SELECT n_regionkey AS r, sum(w) AS w FROM c JOIN nation ON n = n_nationkey GROUP BY 1)
SELECT 0 AS level, o AS node, w::BIGINT AS weight FROM l UNION ALL SELECT 1, c, w::BIGINT FROM o UNION ALL SELECT 2, n, w::BIGINT FROM c UNION ALL SELECT 3, r, w::BIGINT FROM n""")
def a3(spark, d):
    up = [("orders", "o_orderkey", "o_custkey"), ("customer", "c_custkey", "c_nationkey"), ("nation", "n_nationkey", "n_regionkey")]
    return hierarchy.rolled_up(view(spark, d, "item"), [(_table(spark, d, t), child, parent) for t, child, parent in up], F.col("quantity"), "owner", "weight")


_WEIGHT = "CASE WHEN light OR counted THEN greatest(CASE WHEN light THEN quantity * unit // 10 ELSE quantity * unit END, 1) ELSE quantity * unit END"


@query("a3_carried_weight", _TREE.format(ok="NOT pocket") + f"SELECT t.id, (any_value({_WEIGHT.replace('light', 't.light').replace('counted', 't.counted').replace('quantity', 't.quantity').replace('unit', 't.unit')}) + coalesce(sum(w.weight), 0))::BIGINT AS weight FROM thing t LEFT JOIN inside i ON i.owner = t.id LEFT JOIN (SELECT id, {_WEIGHT} AS weight FROM thing) w ON w.id = i.id GROUP BY t.id")
def a3_carried(spark, d):
    things = view(spark, d, "thing").withColumn("weight", hierarchy.own_weight(F.col("quantity"), F.col("unit"), F.col("light"), F.col("counted")))
    return hierarchy.carried_weight(things.select("id", "parent", "pocket", "weight"), F.col("pocket")).select("id", F.col("weight").cast("long").alias("weight"))


@query("a4_volume_used", f"{having('thing')}, u AS (SELECT parent AS box, sum(volume)::BIGINT AS used FROM thing WHERE parent IS NOT NULL GROUP BY 1) SELECT id AS box, coalesce(used, 0) AS used, capacity = 0 OR coalesce(used, 0) + 5 <= capacity AS fits FROM thing LEFT JOIN u ON box = id")
def a4(spark, d):
    """The volume used in each thing, and whether something of volume 5 still fits; a capacity of 0 has no bound."""
    things = view(spark, d, "thing")
    used = things.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("box")).agg(F.sum("volume").alias("used"))
    both = things.select(F.col("id").alias("box"), "capacity").join(used, "box", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return both.select("box", "used", ((F.col("capacity") == 0) | (F.col("used") + 5 <= F.col("capacity"))).alias("fits"))


@query("a5_warmth", "SELECT l_orderkey AS id, (-75 + sum(CASE WHEN l_linenumber <= 6 THEN l_quantity ELSE 0 END))::BIGINT AS warmth FROM (SELECT l_orderkey, l_linenumber, max(CAST(l_quantity AS BIGINT)) AS l_quantity FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def a5(spark, d):
    """What is worn in the first six of seven places, over a base of -75; of several in a place the warmest."""
    worn = view(spark, d, "item").groupBy("owner", "frame").agg(F.max("quantity").alias("warm"))
    return worn.groupBy(F.col("owner").alias("id")).agg((F.sum(F.when(F.col("frame") <= 6, F.col("warm")).otherwise(0)) - 75).cast("long").alias("warmth"))


@query("a7_opponents", f"""{having('thing')}, p AS (SELECT * FROM thing WHERE id % 100 = 0), h AS (SELECT p.id AS p_id, o.*, {_FLAT} AS dist FROM p, thing o WHERE o.npc AND o.id <> p.id AND {_FLAT} <= 60),
s AS (SELECT *, CASE WHEN id % 3 = 0 THEN 16 ELSE 0 END + CASE WHEN quality = 2 OR dead THEN 32 ELSE 0 END + dist AS far FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY strength, ty DESC, tx DESC, tz DESC, id) AS weak, row_number() OVER (PARTITION BY p_id ORDER BY strength DESC, ty DESC, tx DESC, tz DESC, id) AS strong,
 row_number() OVER (PARTITION BY p_id ORDER BY far, ty DESC, tx DESC, tz DESC, id) AS close FROM s)
SELECT p_id, max(CASE WHEN weak = 1 THEN id END) AS weakest, max(CASE WHEN strong = 1 THEN id END) AS strongest, max(CASE WHEN close = 1 AND far < 64 THEN id END) AS nearest FROM k GROUP BY p_id""")
def a7(spark, d):
    things = view(spark, d, "thing")
    npcs = things.filter("npc").select("id", "tx", "ty", "tz", "strength", (F.col("id") % 3 == 0).alias("taken"), (F.col("quality") == 2).alias("fleeing"), (~F.col("dead")).alias("able"))
    return spatial.opponents(_probes(things), npcs, 60)


@query("p3_p4_p6_masks", f"""{having('thing')}, p AS (SELECT * FROM thing WHERE id % 100 = 0), h AS (SELECT p.id AS p_id, o.* FROM p, thing o WHERE {_FLAT} <= 48)
SELECT p_id, count(*) FILTER (WHERE NOT egg_like AND NOT transparent AND NOT invisible) AS plain, count(*) FILTER (WHERE npc AND NOT dead AND NOT egg_like AND NOT transparent AND (NOT invisible OR in_party)) AS live,
 count(*) FILTER (WHERE (shape = 7 OR npc AND disguise = 7) AND NOT egg_like AND NOT transparent AND NOT invisible) AS disguised, count(*) FILTER (WHERE NOT free) AS left_alone FROM h GROUP BY p_id""")
def p3(spark, d):
    things = view(spark, d, "thing")
    probes = _probes(things)
    M = spatial
    kinds = {"plain": dict(mask=0), "live": dict(mask=M.LIVE_NPC | M.INVISIBLE_PARTY), "disguised": dict(mask=M.ANY_NPC, shape=7), "left_alone": dict(mask=M.EGG_LIKE | M.INVISIBLE | M.TRANSPARENT, leave_free=True)}
    out = M.near(probes, things, 48).select("p_id").distinct()
    for name, how in kinds.items():
        out = out.join(M.find_masked(probes, things, 48, **how).groupBy("p_id").agg(F.count("*").alias(name)), "p_id", "left")
    return out.select("p_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in kinds])


@query("p5_default_radius", _PAIRS.format(r=24) + "SELECT p_id, count(*) AS n FROM hit GROUP BY p_id")
def p5(spark, d):
    obj = view(spark, d, "obj")
    return spatial.near(_probes(obj), obj, -1).groupBy("p_id").agg(F.count("*").alias("n"))


@query("p2_frame_mask", f"{having('thing')} SELECT (SELECT count(*) FROM thing WHERE frame = 3) AS whole, (SELECT count(*) FROM thing WHERE frame & 31 = 3) AS masked")
def p2(spark, d):
    frame = F.col("frame")
    return view(spark, d, "thing").agg(F.count(F.when(E.matches(frame, 3), 1)).alias("whole"), F.count(F.when(E.matches(frame.bitwiseAND(31), 3), 1)).alias("masked"))


@query("p9_p7_groups", f"{having('thing')} SELECT g AS \"group\", count(*) AS n FROM (SELECT DISTINCT shape, unnest(list_filter([CASE WHEN npc THEN 'npc' END, CASE WHEN egg_like THEN 'egg' END, CASE WHEN transparent THEN 'clear' END, CASE WHEN light THEN 'light' END], lambda x: x IS NOT NULL)) AS g FROM thing) GROUP BY 1")
def p9(spark, d):
    things = view(spark, d, "thing")
    groups = {"npc": F.col("npc"), "egg": F.col("egg_like"), "clear": F.col("transparent"), "light": F.col("light")}
    return dims.with_groups(things, groups).distinct().groupBy("group").agg(F.count("*").alias("n"))


@query("p12_inside_locked", _TREE.format(ok="true") + "SELECT id, id IN (SELECT i.id FROM inside i JOIN thing t ON t.id = i.owner WHERE t.locked) AS inside_locked FROM thing")
def p12(spark, d):
    return hierarchy.with_locked_inside(view(spark, d, "thing"))


_WISH = "w AS (SELECT id AS item, (id * 7 + 3) % (SELECT count(*) FROM thing) AS box FROM thing), rules AS (SELECT DISTINCT p_partkey % 64 AS box_shape, p_size % 64 AS shape, min(p_partkey) % 3 > 0 AS accept FROM part GROUP BY 1, 2)"


@query("m1_p13_admission", _TREE.format(ok="true") + f""", {_WISH}, u AS (SELECT parent AS box, sum(volume) AS used FROM thing WHERE parent IS NOT NULL GROUP BY 1)
SELECT w.item, w.box, CASE WHEN i.shape = b.shape THEN 'shape' WHEN b.locked THEN 'locked' WHEN NOT coalesce(r.accept, true) THEN 'rule' WHEN i.burning AND NOT i.spell THEN 'fire'
 WHEN i.id = b.id OR c.id IS NOT NULL THEN 'cycle' WHEN b.capacity > 0 AND i.volume + coalesce(u.used, 0) > b.capacity THEN 'volume' END AS reason
FROM w JOIN thing i ON i.id = w.item JOIN thing b ON b.id = w.box LEFT JOIN rules r ON r.box_shape = b.shape AND r.shape = i.shape LEFT JOIN u ON u.box = b.id LEFT JOIN (SELECT DISTINCT owner, id FROM inside) c ON c.owner = i.id AND c.id = b.id""")
def m1(spark, d):
    """Every thing is put into another; the rules come from parts."""
    things = view(spark, d, "thing")
    n = things.count()
    wishes = things.select(F.col("id").alias("item"), ((F.col("id") * 7 + 3) % n).alias("box"))
    rules = _table(spark, d, "part").groupBy((F.col("p_partkey") % 64).alias("box_shape"), (F.col("p_size") % 64).alias("shape")).agg((F.min("p_partkey") % 3 > 0).alias("accept"))
    return hierarchy.admission(wishes, things, rules)


_EDGES = "e AS (SELECT 'l' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS node, 'o' || l_orderkey AS parent FROM lineitem GROUP BY ALL UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region)"


@query("j8_closure", f"""WITH RECURSIVE {_EDGES}, c AS (SELECT node AS ancestor, node, 0 AS depth FROM e UNION ALL SELECT e.parent, c.node, c.depth + 1 FROM c JOIN e ON e.node = c.ancestor WHERE e.parent IS NOT NULL)
SELECT ancestor, depth::INTEGER AS depth, count(*) AS n, max(node) AS last FROM c GROUP BY 1, 2""")
def j8(spark, d):
    """For each node of the whole tree, from regions to line items, how many nodes lie at each depth below it, and the last of them."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    line = F.concat(F.lit("l"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    e = _table(spark, d, "lineitem").select(line.alias("node"), name("o", "l_orderkey").alias("parent")).distinct()
    for t, node, parent in (("orders", "o_orderkey", "o_custkey"), ("customer", "c_custkey", "c_nationkey"), ("nation", "n_nationkey", "n_regionkey")):
        e = e.unionByName(_table(spark, d, t).select(name(t[0], node).alias("node"), name({"o_custkey": "c", "c_nationkey": "n", "n_regionkey": "r"}[parent], parent).alias("parent")))
    e = e.unionByName(_table(spark, d, "region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent")))
    first = [F.lit(1).cast("long").alias("n"), F.col("node").alias("last")]
    return hierarchy.by_depth(e, first, [F.sum("n").alias("n"), F.max("last").alias("last")])


_STACKS = f"{having('item')}, s AS (SELECT *, coalesce(sum(quantity) OVER (PARTITION BY owner ORDER BY part, supp, price, frame, quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(quantity) OVER (PARTITION BY owner) AS held FROM item) "
_ORDER: list = ["part", "supp", "price", "frame", "quantity"]


@query("m3_remove_quantity", _STACKS + "SELECT owner, sum(CASE WHEN held >= 60 THEN least(greatest(60 - before, 0), quantity) ELSE 0 END)::BIGINT AS taken, sum(CASE WHEN held >= 60 AND before < 60 THEN 1 ELSE 0 END)::BIGINT AS stacks FROM s GROUP BY owner")
def m3(spark, d):
    t = hierarchy.removed(view(spark, d, "item"), "owner", F.lit(60), _ORDER, all_or_nothing=True)
    return t.groupBy("owner").agg(F.sum("taken").cast("long").alias("taken"), F.sum((F.col("taken") > 0).cast("long")).alias("stacks"))


@query("m2_add_quantity", f"{having('item')}, s AS (SELECT *, greatest(50 - quantity, 0) AS room FROM item), b AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY owner ORDER BY part, supp, price, frame, quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT owner, sum(least(greatest(40 - before, 0), room))::BIGINT AS given, (40 - sum(least(greatest(40 - before, 0), room)))::BIGINT AS left_over FROM b GROUP BY owner")
def m2(spark, d):
    t = hierarchy.added(view(spark, d, "item"), "owner", F.lit(40), 50, _ORDER)
    return t.groupBy("owner").agg(F.sum("given").cast("long").alias("given"), (40 - F.sum("given")).cast("long").alias("left_over"))


@query("c9_all_components", "SELECT l_orderkey AS owner FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 3")
def c9(spark, d):
    items = view(spark, d, "item")
    return hierarchy.has_all(items.select("owner", "frame"), items.sparkSession.createDataFrame([(1,), (2,), (3,)], "frame int"), "owner", "frame")


@query("j5_wildcard_lookup", f"""{having('obj', 'dim')}, r AS (SELECT o.id, d.size, row_number() OVER (PARTITION BY o.id ORDER BY (d.frame <> -1) DESC, (d.quality <> -1) DESC) AS k
 FROM obj o LEFT JOIN dim d ON NOT d.invalid AND d.shape = o.shape % 64 AND d.frame IN (o.frame % 8, -1) AND d.quality IN (o.quality % 4, -1)) SELECT id, size FROM r WHERE k = 1""")
def j5(spark, d):
    rows = view(spark, d, "obj").select("id", (F.col("shape") % 64).alias("shape"), (F.col("frame") % 8).alias("frame"), (F.col("quality") % 4).alias("quality"))
    return dims.lookup(rows, view(spark, d, "dim"), "size").select("id", "size")


@query("so6_overlay", """WITH b AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 2 = 0), p AS (SELECT p_partkey AS k, p_size * 10 AS v, p_partkey % 9 = 0 AS invalid FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(p.k, b.k) AS k, CASE WHEN p.k IS NULL THEN b.v ELSE p.v END AS v, p.k IS NOT NULL AS patched FROM b FULL JOIN p ON b.k = p.k WHERE p.k IS NULL OR NOT p.invalid""")
def so6(spark, d):
    part = _table(spark, d, "part")
    base = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"), F.lit(False).alias("invalid"))
    patch = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 10).alias("v"), (F.col("p_partkey") % 9 == 0).alias("invalid"))
    return dims.overlay(base, patch, ["k"])


@query("a6_census", "SELECT DISTINCT p_partkey % 1024 AS shape FROM part EXCEPT SELECT l_partkey % 1024 FROM lineitem WHERE l_quantity > 45")
def a6(spark, d):
    used = _table(spark, d, "lineitem").filter("l_quantity > 45").select((F.col("l_partkey") % 1024).alias("shape"))
    return _table(spark, d, "part").select((F.col("p_partkey") % 1024).alias("shape")).distinct().join(used, "shape", "left_anti")


@query("j9_circular_as_of", """WITH s AS (SELECT c_custkey AS k, (c_custkey * m) % 8 AS slot, min(m) AS kind FROM customer, (VALUES (1), (3), (5)) v(m) GROUP BY 1, 2),
e AS (SELECT event_id, user_id AS k, hour(ts) // 3 AS h FROM events), r AS (SELECT e.event_id, s.slot, s.kind, row_number() OVER (PARTITION BY event_id ORDER BY (h - s.slot + 8) % 8) AS n FROM e JOIN s ON e.k = s.k)
SELECT event_id, slot, kind FROM r WHERE n = 1""")
def j9(spark, d):
    times = F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("m")
    s = _table(spark, d, "customer").select(F.col("c_custkey").alias("k"), times).groupBy("k", ((F.col("k") * F.col("m")) % 8).alias("slot")).agg(F.min("m").alias("kind"))
    e = view(spark, d, "queue").select("event_id", "k", "due")
    return temporal.circular_as_of(e, s, "k", F.call_function("div", F.hour("due"), F.lit(3)))\
        .select("event_id", "slot", "kind")


@query("w5_edges", "WITH t AS (SELECT event_id, user_id, ts, value > 50 AS inside, coalesce(lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS before FROM events) SELECT event_id, inside AND NOT before AS entered, before AND NOT inside AS left FROM t")
def w5(spark, d):
    rows = view(spark, d, "queue")
    return temporal.edges(rows, "k", ["due", "event_id"], F.col("value") > 50).select("event_id", "entered", "left")


@query("w2_pause_resume", "SELECT event_id, floor(epoch(ts))::BIGINT % 86400 + CASE WHEN event_id % 5 >= 2 THEN 90 ELSE 0 END AS due FROM events")
def w2(spark, d):
    q = view(spark, d, "queue")
    second = F.unix_timestamp(F.col("due").cast("timestamp")) % 86400
    return q.select("event_id", temporal.resumed(second, F.col("event_id") % 5, F.lit(2), F.lit(92)).alias("due"))


@query("w8_slot_changes", "SELECT date_trunc('day', ts) + INTERVAL 3 HOUR * (hour(ts) // 3) AS slot_start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def w8(spark, d):
    slot = F.window("due", "3 hours")
    return view(spark, d, "queue").groupBy(slot.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("slot_start"), "kind", "n")


@query("w1_queue_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def w1(spark, d):
    return view(spark, d, "queue").select("event_id", F.row_number().over(W.partitionBy("k").orderBy("due", "event_id")).cast("long").alias("place"))


def _grids(spark, d):
    """Each part is a tile of a 64 x 64 grid, a grid for every 4,096 keys, and the start of a search."""
    p, size = F.col("p_partkey"), F.col("p_size")
    x, y = (p % 64).cast("int"), (F.call_function("div", p, F.lit(64)) % 64).cast("int")
    part = _table(spark, d, "part").select(p, size, F.call_function("div", p, F.lit(4096)).alias("grid"), x.alias("x"), y.alias("y"))
    tiles = part.select("grid", "x", "y", (size % 4 == 1).alias("blocked"), (size % 5 == 2).alias("avoid"), (size % 3).alias("lift"), (size % 7 == 3).alias("poison"), (size % 11 == 4).alias("paved"))
    return part, graph.neighbour_steps(tiles, graph.actor_cost())


def _toward(x1, y1):
    """Twice the larger way: no step costs less than 2."""
    return 2 * F.greatest(F.abs(F.col("x") - x1), F.abs(F.col("y") - y1))


@query("g1_grid_costs")
def g1_whole(spark, d):
    """A path from each part's tile to one at most 15 away, below 74 or three times an estimate. No SQL: least costs of many searches."""
    part, steps = _grids(spark, d)
    p, size, x1, y1 = F.col("p_partkey"), F.col("p_size"), F.col("x1"), F.col("y1")
    near = lambda c, by: F.least(F.greatest(F.col(c) + (by % 31 - 15), F.lit(0)), F.lit(63)).cast("int")
    searches = part.select(p.alias("search"), "grid", "x", "y", near("x", size).alias("x1"), near("y", p * 7).alias("y1"))
    dx, dy = F.abs(x1 - F.col("x")), F.abs(y1 - F.col("y"))
    searches = searches.withColumn("most", F.greatest(F.lit(74), 3 * (2 * F.greatest(dx, dy) + F.least(dx, dy))))
    return graph.least_costs(searches, steps, graph.at_tile(x1, y1), F.col("most"), _toward(x1, y1))


@query("g2_one_coordinate")
def g2_line(spark, d):
    """From each part's tile to the nearest by cost of a column or a row up to seven away."""
    part, steps = _grids(spark, d)
    p, size = F.col("p_partkey"), F.col("p_size")
    line = lambda c, here: F.when(here, F.least(F.greatest(F.col(c) + size % 15 - 7, F.lit(0)), F.lit(63)))
    searches = part.select(p.alias("search"), "grid", "x", "y", line("x", p % 2 == 0).alias("x1"), line("y", p % 2 == 1).alias("y1"))
    x1, y1 = F.col("x1"), F.col("y1")
    return graph.least_costs(searches, steps, graph.at_line(x1, y1), F.lit(60), 2 * F.coalesce(F.abs(F.col("x") - x1), F.abs(F.col("y") - y1)))


@query("g2_approach")
def g2_near(spark, d):
    """From each part's tile to within two tiles of another one, which may itself be blocked."""
    part, steps = _grids(spark, d)
    p, size, x1, y1 = F.col("p_partkey"), F.col("p_size"), F.col("x1"), F.col("y1")
    searches = part.select(p.alias("search"), "grid", "x", "y", F.least(F.greatest(F.col("x") + size % 21 - 10, F.lit(0)), F.lit(63)).alias("x1"), F.least(F.greatest(F.col("y") + p * 5 % 21 - 10, F.lit(0)), F.lit(63)).alias("y1"))
    return graph.least_costs(searches, steps, graph.within_reach(x1, y1, 2), F.lit(60), F.greatest(_toward(x1, y1) - 4, F.lit(0)))


@query("g2_off_screen")
def g2_off(spark, d):
    """From each part's tile out of a screen of nine by seven tiles round it."""
    part, steps = _grids(spark, d)
    searches = part.select(F.col("p_partkey").alias("search"), "grid", "x", "y", (F.col("x") - 4).alias("left"), (F.col("y") - 3).alias("top"))
    return graph.least_costs(searches, steps, graph.outside(F.col("left"), F.col("top"), F.lit(9), F.lit(7)), F.lit(40))


def _to_next(obj: DataFrame) -> DataFrame:
    """Each object with the place of its successor. Objects are small and have 800 tiles each on their way, so they are dealt to as
    many tasks as the tiles ask for; by bytes alone, few tasks would walk all ways."""
    tasks = max(int(obj.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-obj.count() // 100_000))
    to = obj.select((F.col("id") - 1).alias("id"), F.col("tx").alias("x1"), F.col("ty").alias("y1"), F.col("tz").alias("z1"))
    return obj.select("id", "tx", "ty", "tz").repartition(tasks, "id").join(to, "id")


def _tiles_to_next(pairs: DataFrame) -> DataFrame:
    return graph.walked(pairs, ["id"], ("tx", "ty", "tz"), ("x1", "y1", "z1"))


@query("g3_straight_walk", f"""{having('obj')}, w AS (SELECT p.id, p.tx AS x0, p.ty AS y0, p.tz AS z0, CASE WHEN o.tx - p.tx >= 1536 THEN o.tx - p.tx - 3072 WHEN o.tx - p.tx <= -1536 THEN o.tx - p.tx + 3072 ELSE o.tx - p.tx END AS dx,
 CASE WHEN o.ty - p.ty >= 1536 THEN o.ty - p.ty - 3072 WHEN o.ty - p.ty <= -1536 THEN o.ty - p.ty + 3072 ELSE o.ty - p.ty END AS dy, o.tz - p.tz AS dz FROM obj p JOIN obj o ON o.id = p.id + 1),
n AS (SELECT *, greatest(abs(dx), abs(dy), abs(dz)) AS n FROM w), s AS (SELECT n.*, unnest(range(1, n + 1)) AS i FROM n),
t AS (SELECT id, i, (x0 + sign(dx)::BIGINT * (i * abs(dx) // n) + 3072) % 3072 AS x, (y0 + sign(dy)::BIGINT * (i * abs(dy) // n) + 3072) % 3072 AS y, z0 + sign(dz)::BIGINT * (i * abs(dz) // n) AS z FROM s)
SELECT id, count(*) AS steps, sum(x * i)::BIGINT AS xs, sum(y * i)::BIGINT AS ys, sum(z * i)::BIGINT AS zs FROM t GROUP BY id""")
def g3(spark, d):
    """From every object to its successor, in three dimensions round the world: the number of tiles, and sums of their places by step."""
    obj = view(spark, d, "obj")
    return _tiles_to_next(_to_next(obj)).groupBy("id").agg(F.count("*").alias("steps"), *[F.sum(F.col(c) * F.col("step")).cast("long").alias(f"{c}s") for c in "xyz"])


@query("g3_straight_walk_whole")
def g3_whole(spark, d):
    """From every object to its successor, in three dimensions over the seams; too long for SQL in a test.

    Each task walks one after another what goes the same way for about as long (its few objects are sorted, not its tiles), lengths
    of one remainder by eight together, as Parquet packs values by eight: neighbouring walks then repeat each other's bytes, and
    what is written is half as large."""
    pairs = _to_next(view(spark, d, "obj"))
    ahead = lambda a, b: F.pmod(F.col(b) - F.col(a), F.lit(3072))
    way = lambda a, b: F.least(ahead(a, b), ahead(b, a))
    n = F.greatest(way("tx", "x1"), way("ty", "y1"), F.abs(F.col("z1") - F.col("tz")))
    return _tiles_to_next(pairs.sortWithinPartitions(ahead("ty", "y1") >= 1536, n % 8, F.floor(n / 64), "ty"))


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(p_name, ''), lambda c: ord(c)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"


@query("f22_checksums", f"WITH t AS (SELECT p_partkey, {_CRC} AS crc FROM part) SELECT p_partkey, crc, crc IN (SELECT crc FROM t WHERE p_partkey % 2 = 0) AS known FROM t")
def f22(spark, d):
    """The CRC-32 of each name, and whether a golden table (that of the even parts) has it. SHA-1 is held against known values in a test."""
    t = _table(spark, d, "part").select("p_partkey", F.crc32(F.col("p_name").cast("binary")).alias("crc"))
    golden = t.filter("p_partkey % 2 = 0").select("crc").distinct().withColumn("known", F.lit(True))
    return t.join(golden, "crc", "left").select("p_partkey", "crc", F.coalesce("known", F.lit(False)).alias("known"))


@query("p10_hostility", f"{having('obj')} SELECT a.side AS a, b.side AS b, a.side <> 0 AND b.side <> 0 AND a.side <> b.side AS hostile FROM (SELECT DISTINCT side FROM obj) a, (SELECT DISTINCT side FROM obj) b")
def p10(spark, d):
    sides = view(spark, d, "obj").select("side").distinct()
    other = sides.agg(F.collect_set("side").alias("bs"))  # four sides
    return sides.withColumn("_", F.lit(0)).join(F.broadcast(other.withColumn("_", F.lit(0))), "_").select(F.col("side").alias("a"), F.explode("bs").alias("b")).withColumn("hostile", spatial.hostile(F.col("a"), F.col("b")))


@query("so1_array_sets", "SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY 1")
def so1(spark, d):
    return _table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query("m4_patches", f"{having('obj')} SELECT id, CASE WHEN id % 6 = 0 THEN (tx + 5) % 3072 ELSE tx END AS tx, frame FROM obj WHERE NOT (shape % 10 = 3 AND frame = 9)")
def m4(spark, d):
    kept = view(spark, d, "obj").filter(~((F.col("shape") % 10 == 3) & (F.col("frame") == 9)))
    return kept.select("id", F.when(F.col("id") % 6 == 0, (F.col("tx") + 5) % 3072).otherwise(F.col("tx")).alias("tx"), "frame")


@query("m2_added_within", f"""{having('thing')}, x AS (SELECT id, parent, id % 3 AS shape, frame % 2 AS frame, quantity, quantity * unit AS weight, burning AS closed, id % 7 * 20 AS cap FROM thing),
t AS (SELECT id, id AS root, [id] AS path FROM x WHERE parent IS NULL UNION ALL SELECT c.id, t.root, list_append(t.path, c.id) FROM x c JOIN t ON c.parent = t.id),
o AS (SELECT id FROM x WHERE NOT closed AND shape <> 1), c AS (SELECT o.id AS box, o.id AS node FROM o UNION ALL SELECT c.box, x.id FROM c JOIN x ON x.parent = c.node WHERE c.node IN (SELECT id FROM o)),
w AS (SELECT root, sum(weight)::BIGINT AS weight FROM t JOIN x USING (id) GROUP BY 1),
r AS (SELECT id AS req, id AS box, id % 40 AS delta FROM thing),
a AS (SELECT req, box, delta, CASE WHEN o.id IS NULL THEN 0 WHEN cap = 0 THEN delta ELSE least(delta, greatest(CAST(floor((cap * 100 - w.weight * 10) / 30) AS BIGINT), 0)) END AS fits FROM r JOIN x ON x.id = box JOIN t ON t.id = box JOIN w USING (root) LEFT JOIN o ON o.id = box),
s AS (SELECT a.req, a.fits, x.id, 8 - x.quantity AS room, sum(8 - x.quantity) OVER (PARTITION BY a.req ORDER BY p.path, x.id ROWS UNBOUNDED PRECEDING) - (8 - x.quantity) AS before FROM a JOIN c ON c.box = a.box AND c.node <> c.box JOIN x ON x.id = c.node JOIN t p ON p.id = x.parent WHERE x.shape = 1 AND x.frame = 1 AND x.quantity < 8 AND fits > 0),
g AS (SELECT req, id, least(greatest(fits - before, 0), room)::BIGINT AS given FROM s), h AS (SELECT req, sum(given)::BIGINT AS filled, sum(id * given)::BIGINT AS mark FROM g WHERE given > 0 GROUP BY req)
SELECT a.req, coalesce(filled, 0) AS filled, fits - coalesce(filled, 0) AS created, delta - fits AS remainder, coalesce(mark, 0) AS mark FROM a LEFT JOIN h USING (req)""")
def m2_within(spark, d):
    """Some of a shape put into each thing as a box: what it bears, stacks in it at any depth, new stacks, and what remains."""
    t = view(spark, d, "thing")
    k = F.col("id")
    things = t.select("id", "parent", (k % 3).alias("shape"), (F.col("frame") % 2).alias("frame"), "quantity", (F.col("quantity") * F.col("unit")).alias("weight"), F.col("burning").alias("closed"), (k % 7 * 20).alias("limit"))
    got = hierarchy.added_within(t.select(k.alias("req"), k.alias("box"), (k % 40).alias("delta")), things, 1, 1, 30, 8)
    mark = F.aggregate("fillings", F.lit(0).cast("long"), lambda acc, f: acc + f["id"] * f["given"])
    return got.select("req", "filled", "created", "remainder", mark.alias("mark"))
