"""Queries over solid things: blocked places, steps, free places, seats, falling, roofs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composites, solids
from ..operators.solids import EDIT, FLY, SWIM, WALK
from .queries import _probes, query
from .world import having, view

# Levels that things block, one by one, listed by tile: another way to the same answers than merged spans.
_BLOCKED = """b AS (SELECT DISTINCT map, (tx - xs + 1 + i + 3072) % 3072 AS x, (ty - ys + 1 + j + 3072) % 3072 AS y, tz + k AS z FROM solid, range(0, 3) r(i), range(0, 2) s(j), range(0, 5) t(k) WHERE i < xs AND j < ys AND k < zs),
lv AS (SELECT map, x, y, list(z) AS zs FROM b GROUP BY ALL), ground AS (SELECT map, tx AS x, ty AS y, max(CASE WHEN id % 2 = 0 THEN 2 ELSE 4 END) AS bits FROM solid WHERE id % 3 = 0 GROUP BY ALL)"""
_ROOM = "len([v FOR v IN zs IF v >= {z} AND v < {z} + h]) = 0"


def _levels(tiles: str, rise: int, drop: int, editing: bool, ground: str) -> str:
    """n: the level of each row of tiles (map, x, y, lift, h and what else it has)."""
    far = f"lift - {drop}" if editing else "NULL"
    return f"""t AS (SELECT p.*, coalesce(zs, []) AS zs, coalesce(bits, 0) AS bits FROM {tiles} p LEFT JOIN lv USING (map, x, y) LEFT JOIN ground USING (map, x, y)),
u AS (SELECT *, list_min([z FOR z IN range(lift, least(lift + {rise}, 255) + 1) IF {_ROOM.format(z='z')}]) AS up, coalesce(list_max([v FOR v IN zs IF v < lift]), -1) + 1 AS floor FROM t),
d AS (SELECT *, CASE WHEN lift - floor <= {drop} THEN floor ELSE {far} END AS down FROM u),
e AS (SELECT *, CASE WHEN up > lift THEN up WHEN up IS NULL AND (floor >= lift OR NOT ({_ROOM.format(z='floor')})) THEN NULL WHEN {_ROOM.format(z='down')} THEN down END AS m FROM d),
f AS (SELECT *, CASE WHEN m = 0 AND NOT ({ground}) THEN NULL ELSE m END AS n FROM e)"""


_AT = "SELECT id, map, (tx + 1) % 3072 AS tx, (ty + 2) % 3072 AS ty, tz, xs, ys, zs FROM solid"
_FOOT = "(SELECT id, i, j, map, (tx - xs + 1 + i + 3072) % 3072 AS x, (ty - ys + 1 + j + 3072) % 3072 AS y, tz AS lift, greatest(zs, 1) AS h FROM p, range(0, 3) r(i), range(0, 2) s(j) WHERE i < xs AND j < ys)"
_LANDED = "SELECT id, CASE WHEN count(n) = count(*) THEN CAST(max(n) AS INTEGER) END AS lift FROM f GROUP BY id"


def _solid(spark, d):
    things = view(spark, d, "solid")
    moved = things.withColumn("tx", (F.col("tx") + 1) % 3072).withColumn("ty", (F.col("ty") + 2) % 3072)
    ground = things.filter("id % 3 = 0").select("map", F.col("tx").alias("x"), F.col("ty").alias("y"), F.when(F.col("id") % 2 == 0, 2).otherwise(4).alias("terrain"))
    return things, moved, solids.spans(things), ground


@query("j11_blocked_walking", f"{having('solid')}, {_BLOCKED}, p AS ({_AT}), {_levels(_FOOT, 1, 2, False, 'bits = 0')} {_LANDED}")
def j11_walk(spark, d):
    """Every thing put one tile east and two south of where it is, on foot; a third of the tiles is water or solid."""
    _, moved, columns, ground = _solid(spark, d)
    return solids.landed(moved, columns, WALK, 2, terrain=ground)


@query("j11_blocked_swimming", f"{having('solid')}, {_BLOCKED}, p AS ({_AT}), {_levels(_FOOT, 0, 12, False, 'bits & 2 <> 0')}, g AS (SELECT * REPLACE (CASE WHEN n > 0 THEN NULL ELSE n END AS n) FROM f) {_LANDED.replace('FROM f', 'FROM g')}")
def j11_swim(spark, d):
    """What only swims is stopped anywhere but in the water."""
    _, moved, columns, ground = _solid(spark, d)
    return solids.landed(moved, columns, SWIM, 12, terrain=ground)


@query("j11_blocked_editing", f"{having('solid')}, {_BLOCKED}, p AS ({_AT}), {_levels(_FOOT, 3, 3, True, 'true')} {_LANDED}")
def j11_edit(spark, d):
    """A flying editor rises or drops three levels, and hangs in the air above a deeper floor."""
    _, moved, columns, ground = _solid(spark, d)
    return solids.landed(moved, columns, EDIT | FLY, 3, terrain=ground)


@query("j11_blocked_step", f"""{having('solid')}, {_BLOCKED}, p AS (SELECT *, (tx + id % 3 - 1 + 3072) % 3072 AS from_tx, (ty + id % 5 % 3 - 1 + 3072) % 3072 AS from_ty FROM ({_AT})),
foot AS (SELECT q.*, (from_tx - x + 3072) % 3072 < xs AND (from_ty - y + 3072) % 3072 < ys AS old, (from_ty - y + 3072) % 3072 < ys AS old_row FROM {_FOOT} q JOIN (SELECT id, from_tx, from_ty, xs, ys FROM p) USING (id)),
fresh AS (SELECT * FROM foot WHERE NOT old), {_levels('fresh', 1, 2, False, 'bits = 0')},
s AS (SELECT id, count(n) = count(*) AND coalesce(min(n) FILTER (WHERE n <> lift) = max(n) FILTER (WHERE n <> lift), true) AS ok, arg_max(n, CASE WHEN old_row THEN 100 + i * 10 + j ELSE j * 10 + i END) AS n FROM f GROUP BY id)
SELECT p.id, CAST(CASE WHEN s.id IS NULL THEN tz WHEN ok THEN n END AS INTEGER) AS lift FROM p LEFT JOIN s USING (id)""")
def j11_step(spark, d):
    """Steps from a neighbouring tile: only what is newly covered counts, and must agree on the level."""
    _, moved, columns, ground = _solid(spark, d)
    k = F.col("id")
    steps = moved.withColumn("from_tx", F.pmod(F.col("tx") + k % 3 - 1, F.lit(3072))).withColumn("from_ty", F.pmod(F.col("ty") + k % 5 % 3 - 1, F.lit(3072)))
    return solids.stepped(steps, columns, WALK, 2, terrain=ground)


_RINGS = """o AS (SELECT d, n, CASE WHEN d = 0 THEN 0 WHEN k < 2 * d THEN k - d WHEN k < 4 * d THEN d WHEN k < 6 * d THEN d - (k - 4 * d) ELSE -d END AS dx, CASE WHEN d = 0 THEN 0 WHEN k < 2 * d THEN -d WHEN k < 4 * d THEN k - 2 * d - d WHEN k < 6 * d THEN d ELSE d - (k - 6 * d) END AS dy
 FROM (SELECT d, n, CASE WHEN d = 0 THEN 0 ELSE (3 * d - d // 2 + n + 8 * d) % (8 * d) END AS k FROM range(0, 4) a(d), range(0, 24) b(n) WHERE n < greatest(8 * d, 1)))"""


@query("t10_free_place", f"""{having('solid')}, {_BLOCKED}, {_RINGS}, s AS (SELECT id AS spot, d, n AS turn, map, (tx + dx + 3072) % 3072 AS tx, (ty + dy + 3072) % 3072 AS ty, tz, xs, ys, zs FROM solid, o WHERE id % 100 = 0), p AS (SELECT *, row_number() OVER () AS id FROM s),
{_levels(_FOOT, 4, 4, False, 'true')}, g AS ({_LANDED}), r AS (SELECT spot AS id, p.tx, p.ty, lift, CAST(d AS INTEGER) AS d, row_number() OVER (PARTITION BY spot ORDER BY d, turn) AS k FROM p JOIN g USING (id) WHERE lift IS NOT NULL) SELECT id, tx, ty, lift, d FROM r WHERE k = 1""")
def t10_place(spark, d):
    """Where each probe's footprint has room, within three rings, east first, four levels up or down."""
    things, _, columns, _ = _solid(spark, d)
    return solids.free_places(_probes(things), columns, 3, 2, 4)


@query("c2_seat_taken", f"""{having('solid')}, {_BLOCKED}, s AS (SELECT id, map, tx, ty, tz, id + id % 3 AS actor FROM solid WHERE id % 5 = 0), p AS (SELECT id, map, tx, ty, tz, 1 AS xs, 1 AS ys, 3 AS zs FROM s), {_levels(_FOOT, 1, 0, False, '(bits * 0) = 0')}, g AS ({_LANDED}),
w AS (SELECT s.id, bool_or(a.id <> actor AND NOT dead AND frame & 15 IN (10, 13)) AS sat, bool_or(a.id = actor AND a.tz = s.tz) AS own FROM s JOIN solid a USING (map, tx, ty) GROUP BY s.id)
SELECT id, coalesce(sat, false) OR (NOT coalesce(own, false) AND lift IS NULL) AS taken FROM g LEFT JOIN w USING (id)""")
def c2_seat(spark, d):
    """Every fifth thing is a seat, wanted by an actor three levels high that may stand there; each thing is an actor as well."""
    things, _, columns, _ = _solid(spark, d)
    seats = things.filter("id % 5 = 0").select("id", "map", "tx", "ty", "tz", (F.col("id") + F.col("id") % 3).alias("actor"), F.lit(3).alias("height"))
    return solids.seats_taken(seats, things, columns, (10, 13))


@query("m5_gravity")
def m5(spark, d):
    """A ninth of all things is taken away; what stood over them falls. No SQL: each round depends on the one before."""
    return solids.fallen(view(spark, d, "stack"))


@query("m5_gravity_small_gaps")
def m5_small(spark, d):
    """Only what has a gap of at most seventeen levels falls."""
    return solids.fallen(view(spark, d, "stack"), within=17)


_PAINT = """c AS (SELECT *, kind = 1 AND whole AS all_ FROM solid WHERE kind IN (1, 2)),
q AS (SELECT id, map, tz AS roof, CASE WHEN all_ THEN tx - tx % 16 + 15 ELSE tx END AS tx, CASE WHEN all_ THEN ty - ty % 16 + 15 ELSE ty END AS ty, CASE WHEN all_ THEN 16 ELSE xs END AS xs, CASE WHEN all_ THEN 16 ELSE ys END AS ys FROM c),
paint AS (SELECT map, (tx - xs + 1 + i + 3072) % 3072 AS x, (ty - ys + 1 + j + 3072) % 3072 AS y, arg_max(roof, id) AS roof FROM q, range(0, 16) r(i), range(0, 16) s(j) WHERE i < xs AND j < ys GROUP BY ALL)"""


def _tops(spark, d):
    return view(spark, d, "solid").withColumn("seq", F.lit(0))


@query("g5_roofs", f"{having('solid')}, {_PAINT} SELECT * FROM paint")
def g5(spark, d):
    return solids.roofs(_tops(spark, d))


@query("g5_lights_inside", f"{having('solid')}, {_PAINT} SELECT id, coalesce(roof > 0, false) AS inside FROM solid s LEFT JOIN paint ON paint.map = s.map AND x = tx AND y = ty WHERE light > 2")
def g5_lights(spark, d):
    """Things that give light, parted by whether a roof is over them."""
    things = _tops(spark, d)
    return solids.lights(things.filter("light > 2"), solids.roofs(things))


@query("g5_ice_quarters", f"{having('solid')} SELECT map, tx // 16 AS cx, ty // 16 AS cy, bit_or(CAST(1 << CAST(tx % 16 // 8 + 2 * (ty % 16 // 8) AS INTEGER) AS INTEGER)) AS ice FROM solid WHERE kind = 2 GROUP BY ALL")
def g5_ice(spark, d):
    return solids.ice_quarters(_tops(spark, d))


_FLAT_SOLID = "greatest(least(abs(p.tx - o.tx), 3072 - abs(p.tx - o.tx)), least(abs(p.ty - o.ty), 3072 - abs(p.ty - o.ty)))"


@query("c1_bed_taken", f"""{having('solid')} SELECT p.id, EXISTS (SELECT 1 FROM solid o WHERE o.map = p.map AND {_FLAT_SOLID} <= 2 AND o.tz // 5 = p.tz // 5 AND NOT o.dead AND (p.tx - o.tx + 3072) % 3072 < p.xs AND (p.ty - o.ty + 3072) % 3072 < p.ys AND o.id <> p.id + p.id % 3) AS taken
FROM solid p WHERE kind = 1""")
def c1_bed(spark, d):
    """Whether anyone alive but its owner stands in the footprint of a bed, on its floor."""
    things = view(spark, d, "solid")
    beds = things.filter("kind = 1").withColumn("actor", F.col("id") + F.col("id") % 3)
    return composites.beds_taken(beds, things.filter("NOT dead"))


@query("c5_unattended_plates", f"""{having('solid')}, f AS (SELECT * FROM solid p WHERE kind = 2 AND NOT dead AND NOT EXISTS (SELECT 1 FROM solid o WHERE o.light = 4 AND o.map = p.map AND {_FLAT_SOLID} <= 2))
SELECT p.id AS p_id, o.id, row_number() OVER (PARTITION BY p.id ORDER BY greatest({_FLAT_SOLID}, abs(o.tz - p.tz)), o.id) AS place FROM solid p JOIN f o ON o.map = p.map AND {_FLAT_SOLID} <= 32 AND o.tz // 5 = p.tz // 5 WHERE p.id % 100 = 0""")
def c5_plates(spark, d):
    """Plates near each probe that nobody stands by, in the order in which they are fetched."""
    things = view(spark, d, "solid")
    plates = things.filter("kind = 2").withColumn("temporary", F.col("dead"))
    return composites.unattended(_probes(things), plates, things.filter("light = 4")).withColumn("place", F.col("place").cast("long"))


_EDGE = "CASE WHEN d{c} > 0 THEN least(abs(p.t{c} - (o.t{c} - o.{c}s + 1 + 3072) % 3072), 3072 - abs(p.t{c} - (o.t{c} - o.{c}s + 1 + 3072) % 3072)) WHEN d{c} < 0 THEN least(abs((p.t{c} - p.{c}s + 1 + 3072) % 3072 - o.t{c}), 3072 - abs((p.t{c} - p.{c}s + 1 + 3072) % 3072 - o.t{c})) ELSE 0 END"
_WAY = "CASE WHEN o.{c} - p.{c} >= 1536 THEN o.{c} - p.{c} - 3072 WHEN o.{c} - p.{c} <= -1536 THEN o.{c} - p.{c} + 3072 ELSE o.{c} - p.{c} END"


@query("c8_nearest_by_edges", f"""{having('solid')}, h AS (SELECT p, o, {_WAY.format(c='tx')} AS dx, {_WAY.format(c='ty')} AS dy FROM solid p JOIN solid o ON o.map = p.map AND o.id <> p.id AND {_FLAT_SOLID} <= 20 WHERE p.id % 100 = 0),
g AS (SELECT p.id AS p_id, o.id AS id, o.tx AS tx, o.ty AS ty, o.tz AS tz, greatest({_EDGE.format(c='x')}, {_EDGE.format(c='y')}, CASE WHEN p.tz < o.tz THEN greatest(o.tz - p.tz - p.zs, 0) WHEN p.tz > o.tz THEN greatest(p.tz - o.tz - o.zs, 0) ELSE 0 END) AS far FROM h)
SELECT p_id, id, far FROM (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY far, ty DESC, tx DESC, tz DESC, id) AS k FROM g WHERE far < 1000) WHERE k = 1""")
def c8_edges(spark, d):
    """The thing whose edges are nearest to each probe's."""
    things = view(spark, d, "solid")
    return composites.nearest_by_edges(_probes(things), things, 20)
