"""Range, rectangle and nearest-neighbour joins on the wrapping grid.

A probe is exploded into the chunks its square covers, joined with the objects by chunk (an equi-join that Spark can
shuffle, broadcast and split when skewed), and the exact wrapped distance is the residual predicate. Each pair meets
in one chunk only, the object's, so nothing has to be made distinct.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.exprs import CHUNK, CHUNKS, TILES, chebyshev, matches
from ..storage import materialize

LARGEST_RADIUS = 1527


def _covered(low: Column, high: Column) -> Column:
    """Chunks from one tile to another, wrapped; floor keeps negative tiles in order."""
    return F.transform(F.sequence(F.floor(low / CHUNK), F.floor(high / CHUNK)), lambda c: F.pmod(c, F.lit(CHUNKS)))


def _with_chunk(objects: DataFrame) -> DataFrame:
    return _chunks_of(objects, "tx", "ty")


def near(probes: DataFrame, objects: DataFrame, radius: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a probe (columns prefixed p_) and an object within radius, by wrapped distance; column dist (one of the object's of
    that name is replaced). keys must agree as well, such as a map. Repeated rows pair as often as they come; a null place pairs
    with nothing; empty tables give no pairs."""
    radius = 24 if radius < 0 else radius
    if radius > LARGEST_RADIUS:
        raise ValueError("the square would meet itself round the world")
    p = probes.select(*[F.col(c).alias(f"p_{c}") for c in probes.columns], *[F.col(k) for k in keys])
    p = p.withColumn("_cx", F.explode(_covered(F.col("p_tx") - radius, F.col("p_tx") + radius))).withColumn("_cy", F.explode(_covered(F.col("p_ty") - radius, F.col("p_ty") + radius)))
    dist = chebyshev(F.col("p_tx"), F.col("p_ty"), F.col("tx"), F.col("ty"))
    return p.join(_with_chunk(objects), ["_cx", "_cy", *keys]).withColumn("dist", dist).filter(F.col("dist") <= radius).drop("_cx", "_cy")


CELL = 32  # least tiles across a cell
PAIRS = 1 << 20  # pairs a task, about


def _celled(probes: DataFrame, objects: DataFrame, radius: int) -> tuple[DataFrame, DataFrame, int, int]:
    """probes in their own cell and objects in every cell that they may be met from (column _cell: row by row), the number of tasks
    to deal them to, which goes by the pairs to be expected, and the side of a cell."""
    if not 0 <= radius <= LARGEST_RADIUS:
        raise ValueError("the square would meet itself round the world")
    side = CELL
    while side < radius and side < TILES // 3:
        side *= 2
    across = TILES // side
    pairs = probes.count() * objects.count() * ((2 * radius + 1) / TILES) ** 2
    tasks = max(int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(pairs / PAIRS), across * across))
    own = lambda c: F.floor(F.pmod(F.col(c), F.lit(TILES)) / side)
    first = lambda c: F.floor((F.col(c) - radius) / side)
    met = lambda c: F.explode(F.sequence(first(c), F.least(F.floor((F.col(c) + radius) / side), first(c) + across - 1)))
    p = probes.filter("tx IS NOT NULL AND ty IS NOT NULL").withColumn("_cell", own("ty") * across + own("tx"))
    o = objects.withColumn("_cx", met("tx")).withColumn("_cy", met("ty"))
    o = o.withColumn("_cell", F.pmod("_cy", F.lit(across)) * across + F.pmod("_cx", F.lit(across))).drop("_cx", "_cy")
    return p, o, tasks, side


def _cells(probes: DataFrame, objects: DataFrame, radius: int) -> tuple[DataFrame, DataFrame, int]:
    """_celled, dealt to tasks by cell; and the side of a cell."""
    p, o, tasks, side = _celled(probes, objects, radius)
    return p.repartition(tasks, "_cell"), o.repartition(tasks, "_cell"), side


def near_by_cell(probes: DataFrame, objects: DataFrame, radius: int) -> DataFrame:
    """near, with all pairs of a probe in one task: what is grouped by _cell and p_id is not shuffled again, so that only probes and
    objects are. A probe's id names one place."""
    p, o, _ = _cells(probes, objects, radius)
    p = p.select(*[F.col(c).alias(f"p_{c}" if c != "_cell" else c) for c in p.columns])
    dist = chebyshev(F.col("p_tx"), F.col("p_ty"), F.col("tx"), F.col("ty"))
    return o.join(p.hint("shuffle_hash"), "_cell").withColumn("dist", dist).filter(F.col("dist") <= radius)


def find_nearby(probes: DataFrame, objects: DataFrame, radius: int = 24, shape: int = -359, frame: int = -359, quality: int = -359) -> DataFrame:
    """near with wildcards, and place: the order of results (ty, tx, tz descending)."""
    wanted = objects.filter(matches(F.col("shape"), shape) & matches(F.col("frame"), frame) & matches(F.col("quality"), quality))
    hits = near_by_cell(probes, wanted, 24 if radius < 0 else radius)
    order = W.partitionBy("_cell", "p_id").orderBy(F.desc("ty"), F.desc("tx"), F.desc("tz"), "id")
    return hits.withColumn("place", F.row_number().over(order)).drop("_cell")


class _Held:
    """The objects of a cell in the order of results."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.ids = pa.concat_arrays([b.column("id") for b in parts])
        x, self.y = (np.concatenate([b.column(c).to_numpy().astype("int64") for b in parts]) for c in ("tx", "ty"))
        self.x = x.astype("int32") if np.abs(x).max() < 1 << 30 else x
        self.first = np.flatnonzero(np.concatenate([[True], self.y[1:] != self.y[:-1]]))  # of each row of tiles
        self.rows, self.ends = self.y[self.first], np.append(self.first, len(x))

    def near(self, x: int, y: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Which are within radius of a place, and how far."""
        gap = np.abs(self.rows - y)
        gap = np.minimum(gap, TILES - gap)
        cuts = np.flatnonzero(np.diff(np.concatenate([[0], (gap <= radius).astype("int8"), [0]])))
        at, far = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        for low, high in zip(cuts[::2], cuts[1::2]):
            a, b = self.ends[low], self.ends[high]
            across = np.abs(self.x[a:b] - x)
            across = np.minimum(across, TILES - across)
            hits = np.flatnonzero(across <= radius)
            down = np.abs(self.y[a + hits] - y)
            at.append(a + hits)
            far.append(np.maximum(across[hits], np.minimum(down, TILES - down)))
        return np.concatenate(at), np.concatenate(far)


_ROWS = 1 << 17  # rows a batch, about


def nearby_ids(probes: DataFrame, objects: DataFrame, radius: int = 24, shape: int = -359, frame: int = -359, quality: int = -359) -> DataFrame:
    """p_id, id, dist, place of find_nearby, without sorting pairs: objects are sorted by cell in the order of results, and what a
    probe meets is a part of its cell's in that order. A task holds the objects of one cell at a time; probes and pairs stream.
    Places are whole numbers; a probe's id names one row.
    """
    wanted = objects.filter(matches(F.col("shape"), shape) & matches(F.col("frame"), frame) & matches(F.col("quality"), quality))
    radius = 24 if radius < 0 else radius
    columns = ["id", "tx", "ty", "tz"]
    p, o, tasks, _ = _celled(probes.select(columns), wanted.select(columns), radius)
    rows = o.withColumn("_probe", F.lit(False)).unionByName(p.withColumn("_probe", F.lit(True))).repartition(tasks, "_cell")
    rows = rows.sortWithinPartitions("_cell", "_probe", F.desc("ty"), F.desc("tx"), F.desc("tz"), "id").drop("tz")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, held = None, [], None
        for batch in batches:
            cells, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_cell", "_probe"))
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1), len(cells)]
            for low, high in zip(cuts, cuts[1:]):
                if high == low:
                    continue
                part = batch.slice(low, high - low)
                if cells[low] != cell:
                    cell, parts, held = cells[low], [], None
                if not asks[low]:
                    parts.append(part)
                elif parts:
                    held = held or _Held(parts)
                    yield from _pairs(held, part, radius)

    kinds = [df.schema["id"].dataType.simpleString() for df in (probes, objects)]
    found = rows.mapInArrow(meet, f"p_id {rows.schema['id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, dist long, place long")
    return found.select(F.col("p_id").cast(kinds[0]), F.col("id").cast(kinds[1]), "dist", "place")


def _pairs(held: _Held, probes: pa.RecordBatch, radius: int) -> Iterator[pa.RecordBatch]:
    """p_id, id, dist, place of the objects near some probes of their cell."""
    xs, ys = (probes.column(c).to_numpy().astype("int64").tolist() for c in ("tx", "ty"))
    met, size = [], 0
    for k, (x, y) in enumerate(zip(xs, ys)):
        at, far = held.near(x, y, radius)
        met.append((np.full(len(at), k), at, far, np.arange(1, len(at) + 1)))
        size += len(at)
        if size >= _ROWS or size and k == len(xs) - 1:
            who, at, far, place = (np.concatenate(c) for c in zip(*met))
            yield pa.RecordBatch.from_arrays([probes.column("id").take(pa.array(who)), held.ids.take(pa.array(at)), pa.array(far.astype("int64")), pa.array(place)], ["p_id", "id", "dist", "place"])
            met, size = [], 0


def in_rectangle(probes: DataFrame, objects: DataFrame, width: int, height: int) -> DataFrame:
    """Pairs of a probe and the objects in the width x height tiles from its corner on, of the same shape and frame."""
    p = probes.select(*[F.col(c).alias(f"p_{c}") for c in probes.columns])
    p = p.withColumn("_cx", F.explode(_covered(F.col("p_tx"), F.col("p_tx") + width - 1))).withColumn("_cy", F.explode(_covered(F.col("p_ty"), F.col("p_ty") + height - 1)))
    inside = (F.pmod(F.col("tx") - F.col("p_tx"), F.lit(3072)) < width) & (F.pmod(F.col("ty") - F.col("p_ty"), F.lit(3072)) < height)
    return p.join(_with_chunk(objects), ["_cx", "_cy"]).filter(inside & (F.col("shape") == F.col("p_shape")) & (F.col("frame") == F.col("p_frame"))).drop("_cx", "_cy")


def first_by(probes: DataFrame, objects: DataFrame, radius: int, k: int, distance: Column, order: list[str | Column], beyond: Callable[[int], int], keys: tuple[str, ...] = (), bound: int | None = None, start: int | None = None) -> DataFrame:
    """The first k objects of each probe within radius, itself excluded, by d (the distance, below bound if there is one) and then
    order, with place; keys must agree as well.

    beyond(r) is a distance that nothing outside of the square of r falls below. The square grows from start, or one that
    holds a few objects on average, until it holds k that are nearer than that, or is that of radius, so that a probe meets no more objects
    the denser they lie; what is settled is written.
    """
    r = max(math.ceil(math.sqrt(k * TILES * TILES / max(objects.count(), 1))), 1) if start is None else start
    left, done = probes, None
    by = W.partitionBy("p_id").orderBy("d", *order)
    while True:
        met = near(left, objects, min(r, radius), keys).filter("id <> p_id").withColumn("d", distance)
        best = (met if bound is None else met.filter(F.col("d") < bound)).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)
        if r >= radius:
            return best if done is None else done.unionByName(best)
        sure = best.filter(F.col("d") < beyond(r)).withColumn("_n", F.count("*").over(W.partitionBy("p_id"))).filter(F.col("_n") == k).drop("_n")
        sure = materialize(sure, "nearest")
        done = sure if done is None else done.unionByName(sure)
        left = left.join(sure.select(F.col("p_id").alias("id")).distinct(), "id", "left_anti")
        r *= 2


def nearest(probes: DataFrame, objects: DataFrame, radius: int, distance: Column, beyond: Callable[[int], int] = lambda r: r + 1) -> DataFrame:
    """For each probe the object of least distance within radius, itself excluded; the smaller id wins ties. Nothing outside of
    the square of r is nearer than beyond(r)."""
    return first_by(probes, objects, radius, 1, distance, ["id"], beyond).select("p_id", "id", "d")


def k_nearest(probes: DataFrame, objects: DataFrame, radius: int, k: int) -> DataFrame:
    """The k nearest objects of each probe by wrapped distance with height, ranked."""
    return first_by(probes, objects, radius, k, F.greatest("dist", F.abs(F.col("tz") - F.col("p_tz"))), ["id"], lambda r: r + 1)


def with_any(probes: DataFrame, objects: DataFrame, radius: int, condition: Column, anti: bool = False) -> DataFrame:
    """Probes that have (or have not) an object within radius that meets the condition."""
    found = near(probes, objects, radius).filter(condition).select(F.col("p_id").alias("id")).distinct()
    return probes.join(found, "id", "left_anti" if anti else "left_semi")


def hostile(a: Column, b: Column) -> Column:
    """Sides: 0 neutral, 1 good, 2 evil, 3 chaotic; each of the last three is hostile to the other two."""
    return (a != 0) & (b != 0) & (a != b)


def seen(probes: DataFrame, objects: DataFrame, radius: int) -> DataFrame:
    """id, to_id, seen of probes and the objects (id, tx, ty, tz, blocks) within radius, themselves excluded: whether no object that
    blocks stands on a tile between the two, on the straight way of `graph.walked`.

    A task holds the tiles and objects of one cell and those round it, and walks the ways of a few hundred thousand pairs
    together, each until it is blocked; neither pairs nor tiles are shuffled.
    """
    p, o, side = _cells(probes.select("id", "tx", "ty", "tz"), objects.select("id", "tx", "ty", "tz", "blocks"), radius)
    across, wide = TILES // side, min(side + 2 * radius, TILES)

    def look(key: tuple, own: pd.DataFrame, round_: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(own) and len(round_):
            local = lambda rows: [(rows[c].to_numpy("int64") - k * side + radius) % TILES for c, k in (("tx", int(key[0]) % across), ("ty", int(key[0]) // across))]
            round_ = round_.iloc[np.argsort(local(round_)[1], kind="stable")]
            (x, y), (px, py) = local(round_), local(own)
            blocked = np.zeros((wide, wide), bool)
            large = round_["blocks"].to_numpy("bool")
            blocked[x[large], y[large]] = True
            z, pz = round_["tz"].to_numpy("int64"), own["tz"].to_numpy("int64")
            ids, names = round_["id"].to_numpy(), own["id"].to_numpy()
            low, high = np.searchsorted(y, py - radius), np.searchsorted(y, py + radius, "right")
            at, who, size = [], [], 0
            for k in range(len(own)):
                hits = low[k] + np.flatnonzero(np.abs(x[low[k] : high[k]] - px[k]) <= radius)
                hits = hits[ids[hits] != names[k]]
                at.append(hits)
                who.append(np.full(len(hits), k))
                size += len(hits)
                if size > _PAIRS_SEEN or k == len(own) - 1:
                    i, j = np.concatenate(at), np.concatenate(who)
                    free = _clear(blocked, px[j], py[j], x[i] - px[j], y[i] - py[j], np.abs(z[i] - pz[j]))
                    found.append(pd.DataFrame({"id": names[j], "to_id": ids[i], "seen": free}))
                    at, who, size = [], [], 0
        return pd.concat(found) if found else pd.DataFrame({"id": pd.Series(dtype="int64"), "to_id": pd.Series(dtype="int64"), "seen": pd.Series(dtype="bool")})

    # nulls count as what near and a filter make of them
    o = o.filter("id IS NOT NULL AND tz IS NOT NULL").withColumn("blocks", F.coalesce("blocks", F.lit(False)))
    return p.filter("id IS NOT NULL AND tz IS NOT NULL").groupBy("_cell").cogroup(o.groupBy("_cell")).applyInPandas(look, "id long, to_id long, seen boolean")


_PAIRS_SEEN = 1 << 18


def _clear(blocked: np.ndarray, x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Whether no tile strictly between the ends of each way is blocked; a way has as many steps as the longest of its sides."""
    n = np.maximum(np.maximum(np.abs(dx), np.abs(dy)), up).astype("int32")
    free = np.ones(len(n), bool)
    left = np.flatnonzero(n > 1)
    x, y, ax, ay, sx, sy = (v.astype("int32") for v in (x, y, np.abs(dx), np.abs(dy), np.sign(dx), np.sign(dy)))
    part = [v[left] for v in (x, y, ax, ay, sx, sy, n)]
    step = 1
    while len(left):
        x, y, ax, ay, sx, sy, n_ = part
        hit = blocked[x + sx * (step * ax // n_), y + sy * (step * ay // n_)]
        free[left[hit]] = False
        step += 1
        on = np.flatnonzero(~hit & (n_ > step))
        left, part = left[on], [v[on] for v in part]
    return free


def smallest_tier(probes: DataFrame, objects: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """Pairs within the smallest radius at which a probe has any, and that radius as tier: it is that of the nearest object, so
    pairs are joined within it only, and none is shuffled."""
    flat = [c.select("id", "tx", "ty") for c in (probes, objects)]
    least = materialize(nearest(*flat, max(radii), F.col("dist")).select(F.col("p_id").alias("id"), F.col("d").alias("_least")), "tiers")
    out, inner = None, -1
    for r in sorted(radii):
        own = least.filter((F.col("_least") > inner) & (F.col("_least") <= r)).select("id")
        hits = near(probes.join(own, "id", "left_semi"), objects, r).filter("id <> p_id").withColumn("tier", F.lit(r))
        out, inner = hits if out is None else out.unionByName(hits), r
    return out


def enclosing(points: DataFrame, groups: DataFrame, reach: int = 20, size: int = 8) -> DataFrame:
    """For each point the group whose footprint (up and left of its anchor) holds it: the highest at or below; where all lie
    above, and between equals, the first in the order of results (ty, tx, tz descending, then id)."""
    hits = near(points, groups, reach).filter("id <> p_id").filter((F.pmod(F.col("tx") - F.col("p_tx"), F.lit(3072)) < size) & (F.pmod(F.col("ty") - F.col("p_ty"), F.lit(3072)) < size))
    above = F.col("tz") > F.col("p_tz")
    order = W.partitionBy("p_id").orderBy(above, F.when(~above, -F.col("tz")), F.desc("ty"), F.desc("tx"), F.desc("tz"), "id")
    return hits.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


ANY_NPC, LIVE_NPC, EGG_LIKE, INVISIBLE, INVISIBLE_PARTY, TRANSPARENT = 4, 8, 16, 32, 64, 128  # fixed values


def visible(mask: int, shape: int = -359) -> Column:
    """What a search with a mask sees, over the flags npc, dead, egg_like, transparent, invisible, in_party.

    A mask of just ANY_NPC counts for nothing once a shape is given."""
    if shape > 0 and mask == ANY_NPC:
        mask = 0
    tests = []
    if mask & ANY_NPC:
        tests.append(F.col("npc"))
    if mask & LIVE_NPC:
        tests.append(F.col("npc") & ~F.col("dead"))
    if not mask & EGG_LIKE:
        tests.append(~F.col("egg_like"))
    if not mask & TRANSPARENT:
        tests.append(~F.col("transparent"))
    if not mask & INVISIBLE:
        tests.append(~F.col("invisible") | F.col("in_party") if mask & INVISIBLE_PARTY else ~F.col("invisible"))
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def find_masked(probes: DataFrame, objects: DataFrame, radius: int, mask: int = 0, shape: int = -359, frame: int = -359, quality: int = -359, leave_free: bool = False) -> DataFrame:
    """find_nearby with a mask; an actor also counts by the shape it is disguised as; leave_free leaves out what is free to take."""
    seen = objects.filter(visible(mask, shape))
    if shape >= 0:
        seen = seen.filter((F.col("shape") == shape) | (F.col("npc") & (F.col("disguise") == shape)))
    if leave_free:
        seen = seen.filter(~F.col("free"))
    return find_nearby(probes, seen, radius, -359, frame, quality)


def pick_opponent(hits: DataFrame, how: str) -> DataFrame:
    """p_id, id of the weakest, strongest or nearest of hits (p_id, id, place, strength, dist, taken, fleeing, able).

    The first of equals by place. Weakest is below 100. Nearest is within 64 after 16 more for one that another fights
    (taken) and 32 more for one that flees or cannot act.
    """
    far = F.col("dist") + F.when(F.col("taken"), 16).otherwise(0) + F.when(F.col("fleeing") | ~F.col("able"), 32).otherwise(0)
    score, bound = {"weakest": (F.col("strength"), F.col("strength") < 100), "strongest": (-F.col("strength"), F.col("strength") > -100), "nearest": (far, far < 64)}[how]
    return hits.filter(bound).groupBy("p_id").agg(F.min_by("id", F.struct(score.alias("s"), "place")).alias("id"))


def opponents(probes: DataFrame, objects: DataFrame, radius: int) -> DataFrame:
    """p_id, weakest, strongest, nearest: what pick_opponent picks of the objects (id, tx, ty, tz, strength, taken, fleeing, able)
    within radius of each probe, itself excluded; probes with nobody in reach have no row.

    The order of objects is one number for each pick, so pairs are aggregated where they meet and none is shuffled or sorted. Of
    objects that differ in nothing but their id two are enough, as a probe may be one of them. Strengths are below 2**20 either
    way, lifts 0 to 65,535.
    """
    odd = F.when(F.col("taken"), 16).otherwise(0) + F.when(F.col("fleeing") | ~F.col("able"), 32).otherwise(0)
    rows = objects.select("id", "tx", "ty", "tz", "strength", odd.alias("_odd"))
    of = lambda c: F.row_number().over(W.partitionBy("tx", "ty", "tz", c).orderBy("id"))
    rows = rows.withColumns({"_s": of("strength"), "_o": of("_odd")}).filter("_s < 3 OR _o < 3")
    place = ((TILES - 1 - F.col("ty")) * TILES + TILES - 1 - F.col("tx")) * 131072 + (65535 - F.col("tz")) * 2
    rows = rows.withColumns({"_s": F.when(F.col("_s") < 3, place + F.col("_s") - 1), "_o": F.when(F.col("_o") < 3, place + F.col("_o") - 1)})
    hits = near_by_cell(probes.select("id", "tx", "ty"), rows, radius).filter("id <> p_id")
    key = lambda score, order, bound: F.when(bound, score.cast("long") * (1 << 41) + F.col(order))
    power, far = F.col("strength"), F.col("dist") + F.col("_odd")
    picks = {"weakest": key(power, "_s", power < 100), "strongest": key(-power, "_s", power > -100), "nearest": key(far, "_o", far < 64)}
    return hits.groupBy("_cell", "p_id").agg(*[F.min_by("id", k).alias(n) for n, k in picks.items()]).drop("_cell")


FIELDS = ("fire_field", "sleep_field", "poison_field", "caltrops_field", "campfire_field", "mirror_object")  # fixed values: kinds that any actor sets off


def _inside(x: str, y: str, shrink: int = 0) -> Column:
    """Whether a tile of a step lies in the square of an egg (columns e_), less a rim."""
    wide = 2 * F.col("e_reach") + 1 - 2 * shrink
    strip = lambda c, e: F.pmod(F.col(c) - (F.col(e) - F.col("e_reach") + shrink), F.lit(3072)) < wide
    return strip(x, "e_tx") & strip(y, "e_ty")


EGG_CELL = 8  # tiles across the cells in which steps meet eggs
MAIN, PARTY, ACTOR, THING, NIGHT = 1, 2, 4, 8, 16  # what a step has and an egg asks for


def _spread_eggs(eggs: DataFrame) -> DataFrame:
    """Eggs (columns e_) in every cell that their own square meets, with the ends _x0, _x1, _y0, _y1 of the square as tiles of that
    copy of the world; ones without a reach or a place are in none."""
    out = eggs.select(*[F.col(c).alias(f"e_{c}" if c != "id" else "egg") for c in eggs.columns])
    round_ = F.col("e_reach") * 2 + 1 >= TILES
    for c in "xy":
        low = F.when(round_, 0).otherwise(F.col(f"e_t{c}") - F.col("e_reach"))
        high = F.when(round_, TILES - 1).otherwise(F.col(f"e_t{c}") + F.col("e_reach"))
        out = out.withColumn("_k", F.explode(F.sequence(F.floor(low / EGG_CELL), F.floor(high / EGG_CELL))))
        own = F.pmod("_k", F.lit(TILES // EGG_CELL))
        out = out.withColumns({f"_c{c}": own, f"_{c}0": low - (F.col("_k") - own) * EGG_CELL, f"_{c}1": high - (F.col("_k") - own) * EGG_CELL}).drop("_k")
    return out


def _in_cells(steps: DataFrame, x: str, y: str) -> DataFrame:
    """Steps by the cell of a tile, and what they have as bits; a null is nothing."""
    bit = lambda c, b: F.when(c, b).otherwise(0)
    day = (F.col("hour") > 4) & (F.col("hour") < 21)
    have = bit(F.col("main"), MAIN) + bit(F.col("in_party"), PARTY) + bit(F.col("actor"), ACTOR) + bit(~F.col("actor"), THING) + bit(~day, NIGHT)
    return steps.select("id", "tx", "ty", "tz", "from_tx", "from_ty", have.alias("_have"), day.alias("_day"), *[F.floor(F.col(c) / EGG_CELL).alias(k) for c, k in ((x, "_cx"), (y, "_cy"))])


def _meet(steps: DataFrame, eggs: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Pairs of a step and an egg whose square holds the tile (x, y) of it. Both are shuffled by cell and merged, never broadcast,
    and the tests on a pair are few comparisons: as one large expression they were not compiled."""
    return steps.join(eggs.hint("merge"), ["_cx", "_cy", *keys]).filter(F.col(x).between(F.col("_x0"), F.col("_x1")) & F.col(y).between(F.col("_y0"), F.col("_y1")))


def _has(need: str) -> Column:
    return F.col("_have").bitwiseAND(F.col(need)) == F.col(need)


def _chunks_of(steps: DataFrame, x: str, y: str) -> DataFrame:
    return steps.withColumn("_cx", F.floor(F.col(x) / CHUNK)).withColumn("_cy", F.floor(F.col(y) / CHUNK))


def triggered(steps: DataFrame, eggs: DataFrame) -> DataFrame:
    """egg, step of the eggs that fire for steps.

    steps: id, tx, ty, tz, from_tx, from_ty, main, in_party, actor, hour. eggs: id, tx, ty, tz, reach (the area is the
    square round it, round the world), criteria, kind, nocturnal, hatched, auto_reset. Fixed values: criteria 0 main actor inside, 1 party enters, 2 main actor enters, 3 main actor
    leaves, 4 main actor stands, 5 party stands (any actor on a field), 6 thing lies, others never; kinds by name.

    A null in a tested column does not fire; a step and an egg meet once, however often chunks bring them together; repeated
    rows fire as often as they come; other columns are dropped.
    """
    c, kind = F.col("criteria"), F.col("kind")
    still, sound = kind.isin("teleport", "intermap"), kind.isin("jukebox", "soundsfx", "voice")
    near_, missile = c.isin(1, 2), F.when(kind == "missile", 5).otherwise(2)
    need = F.when(c.isin(0, 3, 4), MAIN).when(c == 1, PARTY).when(c == 2, MAIN + PARTY).when(c == 5, F.when(kind.isin(*FIELDS), ACTOR).otherwise(PARTY)).when(c == 6, THING)
    need = need + F.when(F.coalesce("nocturnal", F.lit(True)), NIGHT).otherwise(0)
    level = c.isin(4, 5) | (near_ & F.coalesce(still, F.lit(False)))
    rise = F.when(near_, F.when(sound, None).otherwise(missile)).when(c == 6, 4)  # lifts differ by less; null is any
    edge = F.when(c == 0, F.when(F.coalesce("hatched", F.lit(True)), 1).otherwise(0)).when(near_, F.when(sound, 0).otherwise(1)).when(c == 3, 2).otherwise(0)
    # what can fire at all; the others meet no step
    ready = eggs.filter(~(F.col("hatched") & ~F.col("auto_reset")) & c.between(0, 6))
    ready = ready.select("id", "tx", "ty", "tz", "reach", need.alias("need"), level.alias("level"), rise.alias("rise"), edge.alias("edge"))
    own, columns = _in_cells(steps, "tx", "ty"), ["egg", F.col("id").alias("step")]
    level_ = _spread_eggs(ready.filter("level")).withColumn("tz", F.col("e_tz"))
    on_level = _meet(own, level_, "tx", "ty", "tz").filter(_has("e_need")).select(*columns)
    lift = F.abs(F.col("tz") - F.col("e_tz"))
    crossed = F.when(F.col("e_edge") == 1, ~_inside("from_tx", "from_ty")).otherwise(_inside("from_tx", "from_ty", 1) & ~_inside("tx", "ty", 1))
    other = _meet(own, _spread_eggs(ready.filter("NOT level")), "tx", "ty").filter(_has("e_need") & (F.col("e_rise").isNull() | (lift < F.col("e_rise"))))
    return on_level.unionByName(other.filter((F.col("e_edge") == 0) | crossed).select(*columns))


def untriggered(steps: DataFrame, eggs: DataFrame) -> DataFrame:
    """egg, step of the hatched eggs that a step of the main actor sets back, shaped as for triggered; eggs also have revocable.

    A step concerns an egg if it begins or ends in its square. By day a nocturnal one is always set back; others when the main
    actor walks out (0, and sounds of 1 and 2), walks in over the rim (3), or is off its tiles or level (4, and 5 for the party
    or, on a field, any actor); those of 1 and 2 that are no sounds by any step but one that would fire them, teleports never.
    """
    c, kind = F.col("criteria"), F.col("kind")
    still, sound = kind.isin("teleport", "intermap"), kind.isin("jukebox", "soundsfx", "voice")
    quiet = F.coalesce(~still, F.lit(True))
    who = F.when(kind.isin(*FIELDS), ACTOR).otherwise(PARTY)
    # what a step must have that sets an egg back by ending in its square (in) or by leaving it (out); null is never
    out = F.when(c.isin(0, 4), 0).when(c.isin(1, 2) & quiet, PARTY).when(c == 5, who).when(c == 6, THING)
    in_ = F.when(c.isin(1, 2) & quiet & F.coalesce(~sound, F.lit(True)), PARTY).when(c.isin(3, 4), 0).when(c == 5, who).when(c == 6, THING)
    night = F.coalesce("nocturnal", F.lit(False))
    set_ = eggs.filter("hatched AND revocable").select("id", "tx", "ty", "tz", "reach", "criteria", (kind == "missile").alias("missile"), night.alias("nocturnal"), out.alias("out"), in_.alias("in"))
    main, columns = steps.filter("main"), ["egg", F.col("id").alias("step")]
    lift, before = F.abs(F.col("tz") - F.col("e_tz")), _inside("from_tx", "from_ty")
    by_day = F.col("e_nocturnal") & F.col("_day")
    back = F.when(F.col("e_criteria") < 3, ~(((lift < 2) | (F.col("e_missile") & (lift < 5))) & ~before)).when(F.col("e_criteria") == 3, before & ~_inside("from_tx", "from_ty", 1) & _inside("tx", "ty", 1))
    back = back.when(F.col("e_criteria") < 6, lift != 0).otherwise(lift >= 4)
    ends = _meet(_in_cells(main, "tx", "ty"), _spread_eggs(set_.filter("in IS NOT NULL OR nocturnal")), "tx", "ty").filter(by_day | (_has("e_in") & back))
    # what ends inside is above
    begins = _meet(_in_cells(main, "from_tx", "from_ty"), _spread_eggs(set_.filter("out IS NOT NULL OR nocturnal")), "from_tx", "from_ty").filter((by_day | _has("e_out")) & ~_inside("tx", "ty"))
    return ends.select(*columns).unionByName(begins.select(*columns))


def located(cursors: DataFrame, objects: DataFrame, upwards: bool = False) -> DataFrame:
    """cursor, found: the next object of the cursor's shape in the order of chunks (row by row), then id; null at the end.

    One sort by shape instead of a search for each: of the rows of a shape in order the next one is the answer.
    """
    keyed = _with_chunk(objects).select("id", "shape", "_cx", "_cy")
    order = [F.col(c).desc() if upwards else F.col(c) for c in ("_cy", "_cx", "id")]
    ahead = keyed.withColumn("found", F.lead("id").over(W.partitionBy("shape").orderBy(*order)))
    return ahead.join(cursors.select(F.col("id")), "id", "left_semi").select(F.col("id").alias("cursor"), "found")


def free_spots(spots: DataFrame, blocked: DataFrame, reach: int, direction: int) -> DataFrame:
    """id, x, y, d: the first free tile round each spot (id, tx, ty): the spot, else rings d = 1 .. reach, each from the
    preferred direction on (0 north, clockwise; a ring starts north-west). blocked: tx, ty of taken tiles. No row if none is free."""
    ring = (direction + 1) % 8
    # The k-th tile of ring d, clockwise from its north-west corner.
    k, d, side = F.col("k"), F.col("d"), F.call_function("div", F.col("k"), 2 * F.col("d"))
    along = k % (2 * d)
    x = F.when(d == 0, 0).when(side == 0, along - d).when(side == 1, d).when(side == 2, d - along).otherwise(-d)
    y = F.when(d == 0, 0).when(side == 0, -d).when(side == 1, along - d).when(side == 2, d).otherwise(d - along)
    rings = spots.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(reach))))
    rings = rings.withColumn("n", F.explode(F.sequence(F.lit(0), F.greatest(8 * F.col("d") - 1, F.lit(0)))))
    start = ring * d - F.call_function("div", d, F.lit(2))
    rings = rings.withColumn("k", F.when(d == 0, 0).otherwise(F.pmod(start + F.col("n"), 8 * d)))
    tiles = rings.select("id", "d", "n", F.pmod(F.col("tx") + x, F.lit(3072)).alias("x"), F.pmod(F.col("ty") + y, F.lit(3072)).alias("y"))
    taken = blocked.select(F.col("tx").alias("x"), F.col("ty").alias("y")).distinct()
    free = tiles.join(taken, ["x", "y"], "left_anti")
    return free.groupBy("id").agg(F.min(F.struct("d", "n", "x", "y")).alias("b")).select("id", F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.d").alias("d"))
