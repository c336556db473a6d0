"""Composites of searches over things with a footprint: beds, plates nobody tends, the nearest of a list.

Things lie on maps; only those of one map meet. In all of them: a null in a place or size meets nothing; a null flag is false;
repeated rows count once in yes-or-no answers and as often as they come in lists; ids of probes must be distinct; empty tables
give empty results, or probes without a find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import TILES, footprint_gap, height_gap
from .spatial import first_by, near

FLOOR = 5  # fixed value: levels a floor


def floor_of(tz: Column) -> Column:
    return F.floor(tz / FLOOR)


def beds_taken(beds: DataFrame, actors: DataFrame, reach: int = 2) -> DataFrame:
    """id, taken of beds (id, map, tx, ty, tz, xs, ys, actor: whose it is): whether another one of actors (id, map, tx, ty, tz) at
    most reach from its anchor stands on its floor and within its footprint (up and left of the anchor)."""
    hits = near(beds.select("id", "map", "tx", "ty", "tz", "xs", "ys", "actor"), actors.select("id", "map", "tx", "ty", "tz"), reach, ("map",))
    inside = (F.pmod(F.col("p_tx") - F.col("tx"), F.lit(TILES)) < F.col("p_xs")) & (F.pmod(F.col("p_ty") - F.col("ty"), F.lit(TILES)) < F.col("p_ys"))
    other = ~F.coalesce(F.col("id") == F.col("p_actor"), F.lit(False))
    found = hits.filter((floor_of(F.col("tz")) == floor_of(F.col("p_tz"))) & inside & other).select(F.col("p_id").alias("id")).distinct()
    return beds.select("id").join(found.withColumn("taken", F.lit(True)), "id", "left").select("id", F.coalesce("taken", F.lit(False)).alias("taken"))


def unattended(probes: DataFrame, plates: DataFrame, actors: DataFrame, radius: int = 32, close: int = 2) -> DataFrame:
    """p_id, id, place: the plates (id, map, tx, ty, tz, temporary) on a probe's floor and within radius that are not temporary and
    have no actor within close of them, nearest first by the larger of the ways (with height), then by id."""
    columns = ("id", "map", "tx", "ty", "tz")
    own = plates.filter(~F.coalesce("temporary", F.lit(False))).select(*columns)
    tended = near(own.select("id", "map", "tx", "ty"), actors.select(*columns), close, ("map",)).select(F.col("p_id").alias("id"))
    free = own.join(tended.distinct(), "id", "left_anti")
    hits = near(probes.select(*columns), free, radius, ("map",)).filter(floor_of(F.col("tz")) == floor_of(F.col("p_tz")))
    far = F.greatest("dist", F.abs(F.col("tz") - F.col("p_tz")))
    return hits.select("p_id", "id", F.row_number().over(W.partitionBy("p_id").orderBy(far, "id")).alias("place"))


def nearest_by_edges(probes: DataFrame, things: DataFrame, radius: int, bound: int = 1000) -> DataFrame:
    """p_id, id, far: of things (id, map, tx, ty, tz, xs, ys, zs) with an anchor within radius of a probe the one whose edges are
    nearest to the probe's, below bound; of equals the first in the order of results (ty, tx, tz descending, then id).

    Edges are nearer than anchors by less than the largest size, so a square that grows with the probe settles it."""
    columns = ("id", "map", "tx", "ty", "tz", "xs", "ys", "zs")
    flat = [footprint_gap(F.col(f"p_t{c}"), F.col(f"t{c}"), F.col(f"p_{c}s"), F.col(f"{c}s")) for c in "xy"]
    far = F.greatest(*flat, height_gap(F.col("p_tz"), F.col("tz"), F.col("p_zs"), F.col("zs")))
    largest = lambda rows: rows.agg(F.max(F.greatest("xs", "ys"))).head()[0] or 1
    size = max(largest(probes), largest(things), 1)
    order = [F.desc("ty"), F.desc("tx"), F.desc("tz"), "id"]
    best = first_by(probes.select(*columns), things.select(*columns), radius, 1, far, order, lambda r: r + 2 - size, ("map",), bound, size)
    return best.select("p_id", "id", F.col("d").alias("far"))
