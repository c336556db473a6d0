"""Solid things on a wrapping grid of tiles: what blocks a place, free places, falling, roofs.

A thing (id, map, tx, ty, tz, xs, ys, zs) covers the xs x ys tiles up and left of its anchor, round the world, and the levels
tz to tz + zs - 1 below 256; one without height blocks nothing. Tiles are matched by equi-joins on (map, x, y). What a tile's
things block is kept as its merged spans, so a tile with any number of things has 128 spans at most.

In all operators here: a null in a place, size or height gives no tiles, so such a thing blocks nothing and such a probe has
no result row; repeated things block once; probes must have distinct ids; empty tables give empty results (probes against no
things find free ground); columns that are not named are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import CHUNK, TILES
from ..storage import materialize

LEVELS = 256  # fixed value
WALK, SWIM, FLY, ETHEREAL, LEVITATE, EDIT = 1, 2, 4, 8, 16, 32
WATER, SOLID = 2, 4  # fixed values: bits of a terrain
TILE = ["map", "x", "y"]
_ROWS, _CUT = 250_000, 10  # things for each task that falls are dealt to; rounds after which their levels are written


def _tiles(things: DataFrame, *keep: str | Column) -> DataFrame:
    """The tiles of each footprint (columns i and j count from its far corner)."""
    axis = lambda size: F.filter(F.sequence(F.lit(0), F.greatest(F.col(size).cast("int"), F.lit(1)) - 1), lambda k: k < F.col(size))
    rows = things.withColumn("i", F.explode(axis("xs"))).withColumn("j", F.explode(axis("ys")))
    at = lambda anchor, size, k: F.pmod(F.col(anchor) - F.col(size) + 1 + F.col(k), F.lit(TILES))
    return rows.select("map", at("tx", "xs", "i").alias("x"), at("ty", "ys", "j").alias("y"), *keep)


def spans(things: DataFrame) -> DataFrame:
    """map, x, y, spans: the blocked levels of each tile as sorted intervals [low, high) that do not touch."""
    cells = _tiles(things, F.col("tz").cast("int").alias("low"), F.least(F.col("tz") + F.col("zs"), F.lit(LEVELS)).cast("int").alias("high")).filter("map IS NOT NULL AND high > low").distinct()
    up = W.partitionBy(*TILE).orderBy("low", "high")
    before = F.max("high").over(up.rowsBetween(W.unboundedPreceding, -1))
    parts = cells.withColumn("new", F.coalesce((before < F.col("low")).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(up))
    merged = parts.groupBy(*TILE, "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return merged.groupBy(*TILE).agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"))


def _floor(spans_: Column, lift: Column) -> Column:
    """The level above the highest blocked one below lift."""
    return F.coalesce(F.array_max(F.transform(F.filter(spans_, lambda s: s["low"] < lift), lambda s: F.least(s["high"], lift))), F.lit(0))


def level(spans_: Column, lift: Column, height: Column, moves: int, max_drop: int, max_rise: int | None = None, terrain: Column | None = None) -> Column:
    """The level that something of a height comes to stand on when it moves onto a tile at a lift; null if it is blocked.

    It rises to the first level with room within max_rise (max_drop for those that fly or edit, 1 for those that walk, else
    0), else drops to the floor, at most max_drop; editing hangs it in the air there. On the ground it must walk, swim or fly
    as the terrain asks. Ethereal ones are never blocked.
    """
    lift, height = lift.cast("int"), F.greatest(height.cast("int"), F.lit(1))
    if moves & ETHEREAL:
        return lift
    if max_rise is None:
        max_rise = max_drop if moves & (EDIT | FLY) else 1 if moves & WALK else 0
    room = lambda z: ~F.exists(spans_, lambda s: (s["low"] < z + height) & (s["high"] > z))
    most = F.least(lift + max_rise, F.lit(LEVELS - 1))
    ends = F.concat(F.array(lift), F.transform(spans_, lambda s: s["high"]))
    up = F.array_min(F.filter(ends, lambda z: (z >= lift) & (z <= most) & room(z)))
    floor = _floor(spans_, lift)
    down = lift if moves & LEVITATE else floor
    down = F.when(lift - down <= max_drop, down).otherwise(lift - max_drop if moves & EDIT else F.lit(None).cast("int"))
    reached = F.when(up > lift, up).when(up.isNull() & ((floor >= lift) | ~room(floor)), None).when(room(down), down)
    bits = F.coalesce(terrain, F.lit(0)) if terrain is not None else F.lit(0)
    if moves & EDIT:
        ground = F.lit(True)
    elif not moves & (WALK | SWIM | FLY):
        ground = F.lit(False)
    else:
        ground = F.lit(True)
        if not moves & FLY:
            if moves & SWIM and not moves & WALK:
                ground = bits.bitwiseAND(WATER) != 0
            elif moves & WALK and not moves & SWIM:
                ground = (bits.bitwiseAND(WATER) == 0) & (bits.bitwiseAND(SOLID) == 0)
    return F.when(reached == 0, F.when(ground, reached)).when(F.lit(bool(moves & (WALK | FLY))), reached)


def _levelled(tiles: DataFrame, columns: DataFrame, terrain: DataFrame | None, moves: int, max_drop: int, max_rise: int | None) -> DataFrame:
    """Adds level to tiles (map, x, y, lift, height)."""
    rows = tiles.join(columns, TILE, "left")
    if terrain is not None:
        rows = rows.join(terrain.groupBy(*TILE).agg(F.max("terrain").alias("_terrain")), TILE, "left")
    none = F.array().cast("array<struct<low:int,high:int>>")
    return rows.withColumn("level", level(F.coalesce("spans", none), F.col("lift"), F.col("height"), moves, max_drop, max_rise, F.col("_terrain") if terrain is not None else None))


_LIFT, _HEIGHT = "tz AS lift", "zs AS height"


def landed(probes: DataFrame, columns: DataFrame, moves: int = WALK, max_drop: int = 1, max_rise: int | None = None, terrain: DataFrame | None = None) -> DataFrame:
    """id, lift of probes (shaped like things) put where they are, against spans: the highest level of their tiles, null if any is blocked."""
    tiles = _tiles(probes, "id", F.expr(_LIFT), F.expr(_HEIGHT))
    rows = _levelled(tiles, columns, terrain, moves, max_drop, max_rise)
    return rows.groupBy("id").agg(F.when(F.count("level") == F.count("*"), F.max("level")).alias("lift"))


def stepped(steps: DataFrame, columns: DataFrame, moves: int = WALK, max_drop: int = 1, max_rise: int | None = None, terrain: DataFrame | None = None) -> DataFrame:
    """id, lift of steps (like things, and from_tx, from_ty) to a neighbouring tile at tz: null if blocked.

    Only tiles that were not covered before count; those that change the level must agree on it. The level is that of the
    last tile: new rows before new columns, each from the far corner on. A step that covers nothing new keeps its level.
    """
    was = lambda c, size: F.pmod(F.col(f"from_t{c}") - F.col(c), F.lit(TILES)) < F.col(size)
    tiles = _tiles(steps, "id", F.expr(_LIFT), F.expr(_HEIGHT), "i", "j", "xs", "ys", "from_tx", "from_ty").withColumn("old_row", was("y", "ys"))
    tiles = tiles.withColumn("old", was("x", "xs") & F.col("old_row"))
    rows = _levelled(tiles.filter("NOT old"), columns, terrain, moves, max_drop, max_rise)
    order = F.struct(F.col("old_row"), F.when(F.col("old_row"), F.col("i")).otherwise(F.col("j")), F.when(F.col("old_row"), F.col("j")).otherwise(F.col("i")))
    changed = F.when(F.col("level") != F.col("lift"), F.col("level"))
    agreed = (F.count("level") == F.count("*")) & F.coalesce(F.min(changed) == F.max(changed), F.lit(True))
    found = rows.groupBy("id").agg(F.when(agreed, F.max_by("level", order)).alias("level"), F.lit(True).alias("moved"))
    return tiles.groupBy("id").agg(F.first("lift").alias("own")).join(found, "id", "left").select("id", F.when(F.col("moved"), F.col("level")).otherwise(F.col("own")).cast("int").alias("lift"))


def ring_tiles(spots: DataFrame, reach: int, direction: int) -> DataFrame:
    """Adds d, n and moves tx, ty: each spot, then the tiles of rings d = 1 .. reach in order n, from the preferred direction on
    (0 north, clockwise; a ring starts north-west)."""
    ring = (direction + 1) % 8
    k, d, side = F.col("k"), F.col("d"), F.call_function("div", F.col("k"), 2 * F.col("d"))
    along = k % (2 * d)
    x = F.when(d == 0, 0).when(side == 0, along - d).when(side == 1, d).when(side == 2, d - along).otherwise(-d)
    y = F.when(d == 0, 0).when(side == 0, -d).when(side == 1, along - d).when(side == 2, d).otherwise(d - along)
    rings = spots.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(reach))))
    rings = rings.withColumn("n", F.explode(F.sequence(F.lit(0), F.greatest(8 * F.col("d") - 1, F.lit(0)))))
    start = ring * d - F.call_function("div", d, F.lit(2))
    rings = rings.withColumn("k", F.when(d == 0, 0).otherwise(F.pmod(start + F.col("n"), 8 * d)))
    return rings.withColumn("tx", F.pmod(F.col("tx") + x, F.lit(TILES))).withColumn("ty", F.pmod(F.col("ty") + y, F.lit(TILES))).drop("k")


def free_places(spots: DataFrame, columns: DataFrame, reach: int, direction: int, max_drop: int, terrain: DataFrame | None = None) -> DataFrame:
    """id, tx, ty, lift, d of the first place with room for each spot (shaped like a thing), looking outwards; a level may be up
    to max_drop above or below. No row if none is free.

    The spots are tried first, and rings only for those that are taken.
    """
    here = landed(spots, columns, WALK | FLY, max_drop, None, terrain)
    free = spots.join(here.filter("lift IS NOT NULL"), "id").select("id", "tx", "ty", "lift", F.lit(0).alias("d"))
    taken = spots.join(here.filter("lift IS NULL").select("id"), "id", "left_semi")
    rings = ring_tiles(taken, reach, direction).filter("d > 0").withColumnRenamed("id", "spot").withColumn("id", F.struct("spot", "d", "n", "tx", "ty"))
    found = landed(rings, columns, WALK | FLY, max_drop, None, terrain).filter("lift IS NOT NULL")
    best = found.groupBy(F.col("id.spot").alias("id")).agg(F.min(F.struct("id.d", "id.n", "id.tx", "id.ty", "lift")).alias("b"))
    return free.unionByName(best.select("id", "b.tx", "b.ty", "b.lift", "b.d"))


def seats_taken(seats: DataFrame, actors: DataFrame, columns: DataFrame, postures: tuple[int, ...]) -> DataFrame:
    """id, taken of seats (id, map, tx, ty, tz, actor, height: who wants it, and how high that one is).

    A seat is taken if a living actor (id, map, tx, ty, tz, frame, dead) other than its own sits or bows on its tile, or if its
    own one does not stand there and the place is blocked for walking without a drop. postures are frames without their
    direction bit (the low four bits count).
    """
    own = F.col("a.id") == F.col("actor")
    tile = [F.col(f"s.{c}") == F.col(f"a.{c}") for c in ("map", "tx", "ty")]
    who = seats.alias("s").join(actors.alias("a"), tile)
    sits = ~own & ~F.col("dead") & F.col("frame").bitwiseAND(15).isin(*postures)
    there = who.groupBy(F.col("s.id").alias("id")).agg(F.bool_or(sits).alias("sat_on"), F.bool_or(own & (F.col("a.tz") == F.col("s.tz"))).alias("standing"))
    probes = seats.select("id", "map", "tx", "ty", "tz", F.lit(1).alias("xs"), F.lit(1).alias("ys"), F.col("height").alias("zs"))
    room = landed(probes, columns, WALK, 0).join(there, "id", "left")
    taken = F.coalesce("sat_on", F.lit(False)) | (~F.coalesce("standing", F.lit(False)) & F.col("lift").isNull())
    return room.select("id", taken.alias("taken"))


def fallen(things: DataFrame, max_drop: int = 100, within: int | None = None) -> DataFrame:
    """id, tz: the things that fall, and where they come to rest, once those with `gone` are taken away.

    things: also movable and gone. A movable thing anywhere above a place that was freed falls to the highest top below its
    tiles if it rests on none; where a tile of it is more than max_drop above its floor it stays; within bounds the gap that
    it may have (1 is the rule of the worlds whose records are read here; None has no bound). What fell frees its own place.
    All that can fall in a round do so at once, from how things stood before it.

    Falling keeps the order of things in every tile, so who stands over whom is found once, by a window over each tile;
    rounds then touch only tiles in which something moved. Each round lowers something or is the last, and moves work
    upwards through a stack, so it ends within the height of the highest stack in rounds. Things that overlap in height
    within a tile count as standing on the nearest one whose base is not above theirs (ties by id).

    The tiles are dealt twice and kept, by tile and by thing, and so are the levels of the things. A round shuffles what
    moved and what is above that, but never all tiles or things; the side that is kept is neither shuffled nor sorted.
    """
    conf = things.sparkSession.conf
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), -(-things.count() // _ROWS))
    few = lambda df: df.hint("shuffle_hash")
    up = W.partitionBy(*TILE).orderBy("tz", "id")
    under = F.last(F.when(~F.col("gone"), F.col("id")), ignorenulls=True).over(up.rowsBetween(W.unboundedPreceding, -1))
    cells = _tiles(things.filter("zs > 0"), "id", "tz", "movable", "gone").repartition(tasks, *TILE)
    cells = cells.select(*TILE, "id", "movable", "gone", F.row_number().over(up).alias("place"), under.alias("under")).persist()
    on = F.coalesce("under", "id").alias("on")  # the ground is looked up at the thing itself, or all on it would meet in one task
    feet = cells.filter("movable AND NOT gone").select("id", *TILE, "place", on, F.col("under").isNull().alias("ground")).repartition(tasks, "id").persist()
    base = things.filter("zs > 0 AND NOT gone").select("id", "tz", "zs").repartition(tasks, "id").groupBy("id").agg(F.min("tz").alias("tz"), F.max("zs").alias("zs"))
    state = base.withColumn("was", F.col("tz")).persist()
    kept, freed, rounds = [cells, feet, state], cells.filter("gone"), 0
    try:
        while True:
            lowest = freed.groupBy(*TILE).agg(F.min("place").alias("from"))
            ids = cells.join(few(lowest), TILE).filter("movable AND NOT gone AND place > from").select("id").distinct()
            mine = feet.join(few(ids), "id", "left_semi").select("id", "on", "ground").distinct()
            tops = state.select(F.col("id").alias("on"), (F.col("tz") + F.col("zs")).alias("top"))
            top = F.when(~F.col("ground") & F.col("top").isNotNull(), F.col("top")).otherwise(0)
            floors = tops.join(few(mine), "on").groupBy("id").agg(F.max(top).alias("floor"), F.min(top).alias("lowest"))
            falls = (F.col("floor") < F.col("tz")) & (F.col("tz") - 1 - F.col("lowest") <= max_drop)
            if within is not None:
                falls = falls & (F.col("tz") - F.col("lowest") <= within)
            moved = state.join(few(floors), "id").filter(falls).select("id", F.col("floor").cast(state.schema["tz"].dataType).alias("now"))
            moved = materialize(moved, "fell")
            if moved.isEmpty():
                return materialize(state.filter("tz < was").select("id", "tz"), "fallen")
            for before in kept[2:-1]:  # this round has read the levels that came of it
                before.unpersist()
            kept[2:], rounds = [state], rounds + 1
            state = state.join(few(moved), "id", "left").select("id", F.coalesce("now", "tz").alias("tz"), "zs", "was")
            if rounds % _CUT == 0:
                state = materialize(state, "levels").repartition(tasks, "id")
            kept.append(state.persist())
            freed = feet.join(few(moved), "id", "left_semi")
    finally:
        for df in kept:
            df.unpersist()


def roofs(things: DataFrame, level_: int | None = None) -> DataFrame:
    """map, x, y, roof: the level that mountain tops paint on their tiles; of several the last painted (by seq, then id) stays.

    things: also kind (1 a mountain top, 2 a snowy one, else none), whole (a mountain top of the whole chunk of its anchor) and
    seq. level_ is painted in place of the lift where given.
    """
    corner = lambda c: F.when(F.col("_all"), F.col(c) - F.col(c) % CHUNK + CHUNK - 1).otherwise(F.col(c))
    tops = things.filter("kind IN (1, 2)").withColumn("_all", (F.col("kind") == 1) & F.col("whole"))
    side = lambda c: F.when(F.col("_all"), CHUNK).otherwise(F.col(c))
    tops = tops.select("id", "map", "tz", "seq", corner("tx").alias("tx"), corner("ty").alias("ty"), side("xs").alias("xs"), side("ys").alias("ys"))
    painted = F.col("tz") if level_ is None else F.lit(level_)
    return _tiles(tops, "id", "seq", painted.alias("roof")).groupBy(*TILE).agg(F.max_by("roof", F.struct("seq", "id")).alias("roof"))


def ice_quarters(things: DataFrame) -> DataFrame:
    """map, cx, cy, ice: a bit for each quarter of a chunk (1 and 2 its upper ones, 4 and 8 its lower ones) with a snowy top's anchor."""
    quarter = F.call_function("div", F.col("tx") % CHUNK, F.lit(8)) + 2 * F.call_function("div", F.col("ty") % CHUNK, F.lit(8))
    chunk = [F.call_function("div", F.col(c), F.lit(CHUNK)).alias(n) for c, n in (("tx", "cx"), ("ty", "cy"))]
    return things.filter("kind = 2").groupBy("map", *chunk).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), quarter.cast("int"))).alias("ice"))


def lights(things: DataFrame, roofs_: DataFrame) -> DataFrame:
    """id, inside of things (id, map, tx, ty) that give light: whether a roof above the ground is over their anchor."""
    at = roofs_.filter("roof > 0").select("map", F.col("x").alias("tx"), F.col("y").alias("ty"), F.lit(True).alias("inside"))
    return things.join(at, ["map", "tx", "ty"], "left").select("id", F.coalesce("inside", F.lit(False)).alias("inside"))
