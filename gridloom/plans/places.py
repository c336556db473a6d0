"""Queries over places: triggers, free spots, cursors, composites of searches, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dims, spatial
from .queries import _FLAT, _probes, _table, query
from .world import having, view

_KINDS = ("monster", "teleport", "jukebox", "missile", "fire_field", "poison_field", "caltrops_field")
_STEPS = """m AS (SELECT id, tx, ty, tz, (tx + id % 3 - 1 + 3072) % 3072 AS from_tx, (ty + id % 5 % 3 - 1 + 3072) % 3072 AS from_ty, id % 2 = 0 AS main, in_party OR id % 3 = 0 AS in_party, npc OR id % 2 = 0 AS actor, id % 24 AS hour FROM thing),
e AS (SELECT id AS egg, tx, ty, tz, shape % 32 AS reach, quality AS criteria, ['monster', 'teleport', 'jukebox', 'missile', 'fire_field', 'poison_field', 'caltrops_field'][id % 7 + 1] AS kind, id % 4 = 0 AS nocturnal, id % 6 = 0 AS hatched, id % 12 = 0 AS auto_reset FROM thing WHERE egg_like)"""
_IN = "(({x} - e.tx + e.reach - {s} + 6144) % 3072 < 2 * e.reach + 1 - 2 * {s} AND ({y} - e.ty + e.reach - {s} + 6144) % 3072 < 2 * e.reach + 1 - 2 * {s})"
_NOW, _OLD, _NOW1, _OLD1 = (_IN.format(x=x, y=y, s=s) for x, y, s in (("m.tx", "m.ty", 0), ("from_tx", "from_ty", 0), ("m.tx", "m.ty", 1), ("from_tx", "from_ty", 1)))
_NEAR = f"CASE WHEN kind IN ('teleport', 'intermap') THEN m.tz = e.tz WHEN kind IN ('jukebox', 'soundsfx', 'voice') THEN true ELSE (abs(m.tz - e.tz) < 2 OR kind = 'missile' AND abs(m.tz - e.tz) < 5) AND NOT {_OLD} END"


def _steps_and_eggs(spark, d):
    t = view(spark, d, "thing")
    k = F.col("id")
    steps = t.select("id", "tx", "ty", "tz", F.pmod(F.col("tx") + k % 3 - 1, F.lit(3072)).alias("from_tx"), F.pmod(F.col("ty") + k % 5 % 3 - 1, F.lit(3072)).alias("from_ty"), (k % 2 == 0).alias("main"), (F.col("in_party") | (k % 3 == 0)).alias("in_party"), (F.col("npc") | (k % 2 == 0)).alias("actor"), (k % 24).alias("hour"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 7 + 1).cast("int"))
    eggs = t.filter("egg_like").select("id", "tx", "ty", "tz", (F.col("shape") % 32).alias("reach"), F.col("quality").alias("criteria"), kind.alias("kind"), (k % 4 == 0).alias("nocturnal"), (k % 6 == 0).alias("hatched"), (k % 12 == 0).alias("auto_reset"))
    return steps, eggs


@query("j3_w5_w6_triggers", f"""{having('thing')}, {_STEPS}
SELECT egg, id AS step FROM m JOIN e ON {_NOW} WHERE NOT (hatched AND NOT auto_reset) AND NOT (nocturnal AND hour > 4 AND hour < 21) AND
 CASE criteria WHEN 0 THEN main AND (NOT hatched OR NOT {_OLD}) WHEN 1 THEN in_party AND {_NEAR} WHEN 2 THEN main AND in_party AND {_NEAR} WHEN 3 THEN main AND {_OLD1} AND NOT {_NOW1}
 WHEN 4 THEN main AND m.tz = e.tz WHEN 5 THEN m.tz = e.tz AND CASE WHEN kind LIKE '%_field' THEN actor ELSE in_party END WHEN 6 THEN abs(m.tz - e.tz) < 4 AND NOT actor ELSE false END""")
def j3(spark, d):
    """Every thing steps once; the egg-like ones are the regions."""
    return spatial.triggered(*_steps_and_eggs(spark, d))


_OFF = f"(NOT {_NOW} OR m.tz <> e.tz)"
_CLOSE = f"CASE WHEN kind IN ('teleport', 'intermap') THEN false WHEN kind IN ('jukebox', 'soundsfx', 'voice') THEN NOT {_NOW} AND {_OLD} ELSE NOT ((abs(m.tz - e.tz) < 2 OR kind = 'missile' AND abs(m.tz - e.tz) < 5) AND {_NOW} AND NOT {_OLD}) END"


@query("w7_untriggered", f"""{having('thing')}, {_STEPS}
SELECT egg, id AS step FROM m JOIN e ON {_NOW} OR {_OLD} WHERE main AND egg % 5 < 4 AND hatched AND (nocturnal AND hour > 4 AND hour < 21 OR
 CASE criteria WHEN 0 THEN {_OLD} AND NOT {_NOW} WHEN 1 THEN in_party AND {_CLOSE} WHEN 2 THEN in_party AND {_CLOSE} WHEN 3 THEN {_OLD} AND NOT {_OLD1} AND {_NOW1} WHEN 4 THEN {_OFF}
 WHEN 5 THEN {_OFF} AND CASE WHEN kind LIKE '%_field' THEN actor ELSE in_party END WHEN 6 THEN (NOT {_NOW} OR abs(m.tz - e.tz) >= 4) AND NOT actor ELSE false END)""")
def w7(spark, d):
    """Hatched regions that a step of the main actor sets back; a fifth cannot be."""
    steps, eggs = _steps_and_eggs(spark, d)
    return spatial.untriggered(steps, eggs.withColumn("revocable", F.col("id") % 5 < 4))


@query("t9_next_of_shape", f"{having('obj')} SELECT id AS cursor, lead(id) OVER (PARTITION BY shape ORDER BY ty // 16, tx // 16, id) AS found FROM obj")
def t9(spark, d):
    obj = view(spark, d, "obj")
    return spatial.located(obj, obj)


@query("t9_previous_of_shape", f"{having('obj')} SELECT id AS cursor, lead(id) OVER (PARTITION BY shape ORDER BY ty // 16 DESC, tx // 16 DESC, id DESC) AS found FROM obj")
def t9_back(spark, d):
    obj = view(spark, d, "obj")
    return spatial.located(obj, obj, upwards=True)


_RINGS = """r AS (SELECT d, n, CASE WHEN d = 0 THEN 0 ELSE (3 * d - d // 2 + n + 8 * d) % (8 * d) END AS k FROM range(0, 4) a(d), range(0, 24) b(n) WHERE n < greatest(8 * d, 1)),
o AS (SELECT d, n, CASE WHEN d = 0 THEN 0 WHEN k < 2 * d THEN k - d WHEN k < 4 * d THEN d WHEN k < 6 * d THEN d - (k - 4 * d) ELSE -d END AS dx, CASE WHEN d = 0 THEN 0 WHEN k < 2 * d THEN -d WHEN k < 4 * d THEN k - 2 * d - d WHEN k < 6 * d THEN d ELSE d - (k - 6 * d) END AS dy FROM r)"""


@query("t10_free_spot", f"""{having('obj')}, {_RINGS}, c AS (SELECT p.id, d, n, (tx + dx + 3072) % 3072 AS x, (ty + dy + 3072) % 3072 AS y FROM obj p, o WHERE p.id % 100 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, n) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM obj b WHERE b.tx = c.x AND b.ty = c.y)) SELECT id, x, y, d FROM f WHERE k = 1""")
def t10(spark, d):
    """The first free tile within three rings, east first."""
    obj = view(spark, d, "obj")
    return spatial.free_spots(_probes(obj).select("id", "tx", "ty"), obj, 3, 2).withColumn("d", F.col("d").cast("long"))


_NEAR_THINGS = f"{having('thing')}, p AS (SELECT * FROM thing WHERE id % 100 = 0), h AS (SELECT p.id AS p_id, p.tz AS p_tz, o.*, {_FLAT} AS dist FROM p, thing o WHERE {_FLAT} <= {{r}}) "


@query("c2_seat_occupied", _NEAR_THINGS.format(r=24) + "SELECT p_id AS id FROM h WHERE id <> p_id AND npc AND NOT dead AND NOT egg_like AND NOT transparent AND NOT invisible AND frame & 15 IN (10, 13) GROUP BY p_id")
def c2(spark, d):
    """Probes near which a living actor sits or bows (two frames, the facing left out), within 24 tiles so that there are some."""
    t = view(spark, d, "thing")
    hits = spatial.find_masked(_probes(t), t, 24, spatial.LIVE_NPC).filter((F.col("id") != F.col("p_id")) & F.col("frame").bitwiseAND(15).isin(10, 13))
    return hits.select(F.col("p_id").alias("id")).distinct()


@query("c6_customers", _NEAR_THINGS.format(r=32) + "SELECT p_id, id, row_number() OVER (PARTITION BY p_id ORDER BY ty, tx, tz, id DESC) AS turn FROM h WHERE npc AND id <> p_id AND quality = 3")
def c6(spark, d):
    """Actors of one occupation near each probe, taken from the end of the list."""
    t = view(spark, d, "thing")
    hits = spatial.find_nearby(_probes(t), t.filter("npc AND quality = 3"), 32).filter("id <> p_id")
    last = F.max("place").over(spatial.W.partitionBy("p_id"))
    turn = F.row_number().over(spatial.W.partitionBy("p_id").orderBy(F.desc("place")))
    return hits.withColumn("last", last).select("p_id", "id", turn.cast("long").alias("turn"))


@query("c7_preferred_shapes", _NEAR_THINGS.format(r=40) + ", r AS (SELECT *, CASE WHEN shape IN (3, 5) THEN 0 WHEN shape IN (7, 11, 13) THEN 1 END AS rank FROM h WHERE id <> p_id), b AS (SELECT *, min(rank) OVER (PARTITION BY p_id) AS best FROM r WHERE rank IS NOT NULL) SELECT p_id, id FROM b WHERE rank = best AND tz // 5 = p_tz // 5")
def c7(spark, d):
    """Objects of the preferred shapes, of the others where there are none, then those on the same floor."""
    t = view(spark, d, "thing")
    shape = F.col("shape")
    hits = spatial.near(_probes(t), t.filter(shape.isin(3, 5, 7, 11, 13)), 40).filter("id <> p_id").withColumn("rank", F.when(shape.isin(3, 5), 0).otherwise(1))
    floor = lambda c: F.call_function("div", F.col(c), F.lit(5))
    best = hits.withColumn("best", F.min("rank").over(spatial.W.partitionBy("p_id")))
    return best.filter((F.col("rank") == F.col("best")) & (floor("tz") == floor("p_tz"))).select("p_id", "id")


@query("c8_nearest_of_list", _NEAR_THINGS.format(r=64) + ", k AS (SELECT *, greatest(dist, abs(tz - p_tz)) AS far FROM h WHERE id <> p_id AND quality = 5), n AS (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY far, ty DESC, tx DESC, tz DESC, id) AS r FROM k) SELECT p_id, id, far FROM n WHERE r = 1")
def c8(spark, d):
    """Of a list the nearest, the first of equals."""
    t = view(spark, d, "thing")
    place = [F.desc("ty"), F.desc("tx"), F.desc("tz"), "id"]
    listed = t.filter("quality = 5").select("id", "tx", "ty", "tz")
    far = F.greatest("dist", F.abs(F.col("tz") - F.col("p_tz")))
    return spatial.first_by(_probes(t).select(*listed.columns), listed, 64, 1, far, place, lambda r: r + 1).select("p_id", "id", F.col("d").alias("far"))


@query("c11_party_aboard", f"{having('thing')}, p AS (SELECT * FROM thing WHERE id % 100 = 0), m AS (SELECT p.id AS p_id, (o.tx - p.tx + 3072) % 3072 < 12 AND (o.ty - p.ty + 3072) % 3072 < 12 AS aboard FROM p JOIN thing o ON o.in_party AND o.id // 100 = p.id // 100) SELECT p_id AS id, bool_and(aboard) AS all_aboard, count(*) FILTER (WHERE aboard) AS n FROM m GROUP BY 1")
def c11(spark, d):
    """Whether all members of a party (those of the same hundred) stand in the footprint."""
    t = view(spark, d, "thing")
    p = _probes(t).select(F.col("id").alias("p_id"), F.col("tx").alias("px"), F.col("ty").alias("py"), F.call_function("div", F.col("id"), F.lit(100)).alias("team"))
    m = t.filter("in_party").withColumn("team", F.call_function("div", F.col("id"), F.lit(100))).join(p, "team")
    aboard = (F.pmod(F.col("tx") - F.col("px"), F.lit(3072)) < 12) & (F.pmod(F.col("ty") - F.col("py"), F.lit(3072)) < 12)
    return m.withColumn("aboard", aboard).groupBy(F.col("p_id").alias("id")).agg(F.bool_and("aboard").alias("all_aboard"), F.count(F.when(F.col("aboard"), 1)).alias("n"))


@query("c12_danger_near", _NEAR_THINGS.format(r=40) + "SELECT id, id IN (SELECT p_id FROM h WHERE npc AND NOT dead AND id <> p_id AND quality = 0 AND shape % 4 > 0 AND p_id % 4 > 0 AND shape % 4 <> p_id % 4) AS danger FROM p")
def c12(spark, d):
    """Whether a living hostile actor that fights is near."""
    t = view(spark, d, "thing")
    side = lambda c: F.col(c) % 4
    near = spatial.near(_probes(t), t.filter("npc AND NOT dead AND quality = 0"), 40).filter((F.col("id") != F.col("p_id")) & spatial.hostile(side("p_id"), side("shape")))
    found = near.select(F.col("p_id").alias("id")).distinct().withColumn("danger", F.lit(True))
    return _probes(t).select("id").join(found, "id", "left").select("id", F.coalesce("danger", F.lit(False)).alias("danger"))


@query("j6_one_key_lookup", f"{having('obj')}, d AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN -1 ELSE p_partkey % 50 END AS frame, min(p_partkey) AS v, min(p_partkey) % 4 = 1 AS invalid FROM part GROUP BY 1) SELECT id, coalesce((SELECT v FROM d WHERE d.frame = o.frame AND NOT invalid), (SELECT v FROM d WHERE d.frame = -1 AND NOT invalid)) AS v FROM obj o")
def j6(spark, d):
    k = F.col("p_partkey") % 50
    dim = _table(spark, d, "part").groupBy(F.when(k == 0, -1).otherwise(k).alias("frame")).agg(F.min("p_partkey").alias("v"), (F.min("p_partkey") % 4 == 1).alias("invalid"))
    return dims.lookup_one(view(spark, d, "obj").select("id", "frame"), dim, "frame", "v").select("id", "v")


@query("j10_names", f"""{having('thing')}, f AS (SELECT DISTINCT shape, frame % 8 AS frame, [-255, -1, 0, 1, 2][(shape + frame % 8) % 5 + 1] AS kind, (shape * 3 + frame % 8) % 40 AS msg, (shape + frame % 8 * 5) % 40 AS other FROM thing WHERE (shape + frame % 8) % 3 > 0),
t AS (SELECT p_partkey AS idx, p_name AS text FROM part WHERE p_partkey % 40 < 30), s AS (SELECT n_nationkey AS shape, n_name AS name FROM nation)
SELECT o.id, CASE WHEN coalesce(kind, -255) NOT IN (-255, 0, 1, 2) THEN '' WHEN coalesce(kind, -255) = -255 OR m.text IS NULL THEN coalesce(s.name, '') WHEN kind = 0 THEN m.text WHEN kind = 1 THEN coalesce(x.text, s.name, '') || m.text ELSE m.text || coalesce(x.text, s.name, '') END AS name
FROM thing o LEFT JOIN f ON f.shape = o.shape AND f.frame = o.frame % 8 LEFT JOIN t m ON m.idx = f.msg LEFT JOIN t x ON x.idx = f.other LEFT JOIN s ON s.shape = o.shape""")
def j10(spark, d):
    """A quarter of the indices have no message."""
    t = view(spark, d, "thing").withColumn("frame", F.col("frame") % 8)
    frame, shape = F.col("frame"), F.col("shape")
    kind = F.element_at(F.array(*map(F.lit, (-255, -1, 0, 1, 2))), ((shape + frame) % 5 + 1).cast("int"))
    frames = t.filter((shape + frame) % 3 > 0).select("shape", "frame", kind.alias("kind"), ((shape * 3 + frame) % 40).alias("msg"), ((shape + frame * 5) % 40).alias("other")).distinct()
    messages = _table(spark, d, "part").filter("p_partkey % 40 < 30").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("text"))
    shapes = _table(spark, d, "nation").select(F.col("n_nationkey").alias("shape"), F.col("n_name").alias("name"))
    return dims.names_of(t.select("id", "shape", "frame"), frames, messages, shapes)


@query("j12_patched", f"{having('obj')}, a AS (SELECT DISTINCT tx, ty, tz, CASE WHEN id % 2 = 0 THEN shape ELSE -359 END AS shape FROM obj WHERE id % 9 = 0) SELECT id FROM obj o WHERE EXISTS (SELECT 1 FROM a WHERE a.tx = o.tx AND a.ty = o.ty AND a.tz = o.tz AND a.shape IN (o.shape, -359))")
def j12(spark, d):
    """Objects that a patch names by its exact tile, and by shape unless that is the wildcard."""
    obj = view(spark, d, "obj")
    patches = obj.filter("id % 9 = 0").select("tx", "ty", "tz", F.when(F.col("id") % 2 == 0, F.col("shape")).otherwise(-359).alias("wanted")).distinct()
    both = obj.join(patches, ["tx", "ty", "tz"]).filter((F.col("wanted") == -359) | (F.col("wanted") == F.col("shape")))
    return both.select("id").distinct()


@query("j7_references", f"{having('thing')}, r AS (SELECT id, CASE id % 4 WHEN 0 THEN -356 WHEN 1 THEN -(id % 50) - 1 WHEN 2 THEN id + 1 ELSE 10000000000 END AS ref FROM thing) SELECT r.id, r.ref, t.id AS found FROM r LEFT JOIN thing t ON t.id = CASE WHEN ref = -356 THEN 0 WHEN ref < 0 THEN -ref ELSE ref END")
def j7(spark, d):
    """A reference names the leader (-356, thing 0 here), an actor by its negative number, or a thing by its id; null where there is none."""
    k = F.col("id")
    t = view(spark, d, "thing")
    refs = t.select("id", F.when(k % 4 == 0, -356).when(k % 4 == 1, -(k % 50) - 1).when(k % 4 == 2, k + 1).otherwise(10_000_000_000).alias("ref"))
    return dims.resolved(refs, t.select(F.col("id").alias("found")), 0)


@query("j10_display_names", f"""{having('thing')}, f AS (SELECT DISTINCT shape, frame % 8 AS frame, [-255, -1, 0, 1, 2, 3, 4][(shape + frame % 8) % 7 + 1] AS kind, (shape * 3 + frame % 8) % 40 AS msg, (shape + frame % 8 * 5) % 45 - 3 AS other FROM thing WHERE (shape + frame % 8) % 6 > 0),
m AS (SELECT p_partkey AS idx, CASE p_partkey % 3 WHEN 0 THEN 'a/' || p_brand || '//s' WHEN 1 THEN p_name ELSE 'x/' || p_brand END AS text FROM part WHERE p_partkey % 40 < 30),
s AS (SELECT shape, '/' || shape || '/y/ies' AS name, shape % 2 = 0 AS has_quality, shape % 3 = 0 AS has_quantity, shape % 7 = 0 AS body FROM (SELECT DISTINCT shape FROM thing) WHERE shape % 11 > 0),
a AS (SELECT s_suppkey AS npc, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS own, s_suppkey % 4 = 3 AS unused, s_suppkey % 2 = 1 AS met FROM supplier),
j AS (SELECT o.id, coalesce(kind, -255) AS kind, msg.text AS mt, other, oth.text AS ot, s.name AS sn, coalesce(has_quality, false) AS hq, coalesce(has_quantity, false) AS hn, coalesce(body, false) AS body, o.quality AS q, a.own, a.unused, a.met
 FROM thing o LEFT JOIN f ON f.shape = o.shape AND f.frame = o.frame % 8 LEFT JOIN s ON s.shape = o.shape LEFT JOIN m msg ON msg.idx = f.msg LEFT JOIN m oth ON oth.idx = f.other LEFT JOIN a ON a.npc = CASE WHEN NOT coalesce(body, false) THEN o.quality WHEN o.quality = 1 THEN o.id % 10 END),
k AS (SELECT *, kind >= 1 AND mt IS NOT NULL AND (hq OR body) AS joined, coalesce(NOT unused AND (NOT body OR met) AND own <> '', false) AS known FROM j),
n AS (SELECT *, CASE WHEN joined THEN CASE WHEN ot IS NOT NULL THEN ot WHEN other < 0 AND other <> -255 THEN '' ELSE sn END WHEN kind = 0 AND mt IS NOT NULL THEN mt ELSE sn END AS alone, CASE WHEN hn THEN q & 127 ELSE 1 END AS n FROM k),
p AS (SELECT *, string_split(alone, '/') AS w FROM n)
SELECT id, CASE WHEN kind < 0 AND kind <> -255 THEN '' WHEN joined AND kind >= 3 AND known THEN CASE WHEN kind % 2 = 1 THEN own || mt ELSE mt || own END WHEN joined AND kind < 3 THEN CASE WHEN kind % 2 = 1 THEN coalesce(ot, sn, '') || mt ELSE mt || coalesce(ot, sn, '') END
 WHEN alone IS NULL OR alone = '' THEN '' WHEN len(w) = 1 THEN CASE WHEN n <= 1 THEN alone ELSE n || ' ' || alone END WHEN len(w) < 4 THEN '?' WHEN n <= 1 THEN CASE WHEN w[1] <> '' THEN w[1] || ' ' ELSE '' END || w[2] || w[3] ELSE n || ' ' || w[2] || array_to_string(w[4:], '/') END AS name FROM p""")
def j10_shown(spark, d):
    """Names with quantities, templates, qualities and the names of actors; some messages are templates, some incomplete ones."""
    t = view(spark, d, "thing").withColumn("frame", F.col("frame") % 8)
    frame, shape = F.col("frame"), F.col("shape")
    kind = F.element_at(F.array(*map(F.lit, (-255, -1, 0, 1, 2, 3, 4))), ((shape + frame) % 7 + 1).cast("int"))
    frames = t.filter((shape + frame) % 6 > 0).select("shape", "frame", kind.alias("kind"), ((shape * 3 + frame) % 40).alias("msg"), ((shape + frame * 5) % 45 - 3).alias("other")).distinct()
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("a/"), "p_brand", F.lit("//s"))).when(k % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("x/"), "p_brand"))
    messages = _table(spark, d, "part").filter(k % 40 < 30).select(k.alias("idx"), text.alias("text"))
    shapes = t.select("shape").distinct().filter("shape % 11 > 0").select("shape", F.concat(F.lit("/"), "shape", F.lit("/y/ies")).alias("name"), (shape % 2 == 0).alias("has_quality"), (shape % 3 == 0).alias("has_quantity"), (shape % 7 == 0).alias("body"))
    n = F.col("s_suppkey")
    actors = _table(spark, d, "supplier").select(n.alias("npc"), F.when(n % 5 == 0, "").otherwise(F.col("s_name")).alias("name"), (n % 4 == 3).alias("unused"), (n % 2 == 1).alias("met"))
    return dims.display_names(t.withColumn("live_npc", F.col("id") % 10), frames, messages, shapes, actors)
