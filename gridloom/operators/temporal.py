"""Time: circular as-of lookups, pauses, edges and periodic buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def circular_as_of(probes: DataFrame, schedule: DataFrame, key: str, slot: Column, slots: int = 8) -> DataFrame:
    """For each probe the schedule row (key, slot, kind) at or before its slot, round the clock."""
    own = schedule.groupBy(key).agg(F.collect_set(F.struct("slot", "kind")).alias("list"))  # a few slots a key
    at = probes.withColumn("_at", slot).join(own, key)
    best = F.array_min(F.transform("list", lambda s: F.struct(F.pmod(F.col("_at") - s["slot"], F.lit(slots)).alias("ago"), s["slot"].alias("slot"), s["kind"].alias("kind"))))
    return at.withColumn("_b", best).select(*probes.columns, F.col("_b.slot").alias("slot"), F.col("_b.kind").alias("kind"))


def edges(rows: DataFrame, key: str, order: list[str], inside: Column) -> DataFrame:
    """Adds entered and left: inside now and not before, and the reverse; the first row of a key was outside."""
    before = F.coalesce(F.lag("_in").over(W.partitionBy(key).orderBy(*order)), F.lit(False))
    return rows.withColumn("_in", inside).withColumn("entered", F.col("_in") & ~before).withColumn("left", ~F.col("_in") & before).drop("_in")


def resumed(due: Column, added: Column, paused_at: Column, resumed_at: Column) -> Column:
    """Due seconds after a pause: entries added in this pause are put off by its length."""
    return F.when(added >= paused_at, due + (resumed_at - paused_at)).otherwise(due)


def popped(queue: DataFrame, now: Column) -> DataFrame:
    """place, key, event_id of the entries of queue (key, event_id, due, seq) that are due by now: by due time, then as added."""
    order = W.partitionBy("key").orderBy("due", "seq")
    return queue.filter(F.col("due") <= now).withColumn("place", F.row_number().over(order)).select("key", "event_id", "place")


def remaining(queue: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """key, delay: until the first entry of each of keys is due, 0 if it is, -1 without an entry."""
    first = queue.groupBy("key").agg(F.min("due").alias("due"))
    return keys.join(first, "key", "left").select("key", F.coalesce(F.greatest(F.col("due") - now, F.lit(0)), F.lit(-1)).alias("delay"))


def cancelled(queue: DataFrame, cancels: DataFrame) -> DataFrame:
    """queue without the first entry (by due, seq) of each key in cancels (key, n), n of them."""
    place = F.row_number().over(W.partitionBy("key").orderBy("due", "seq"))
    return queue.withColumn("_p", place).join(cancels, "key", "left").filter(F.col("_p") > F.coalesce("n", F.lit(0))).drop("_p", "n")


def halted(scripts: DataFrame) -> DataFrame:
    """Adds ended: when a later script of the same key replaces a script (key, started, seq, dont_halt); null if none does."""
    later = F.lead("started").over(W.partitionBy("key").orderBy("started", "seq"))
    return scripts.withColumn("ended", F.when(~F.col("dont_halt"), later))


def cache_changes(visits: DataFrame, block: int, reach: int, across: int, width: int = 1 << 24) -> DataFrame:
    """key, at, seq, bx, by, loaded: the blocks that each of visits (key, at, seq, x, y) of a viewer brings in (true) or lets go (false).

    A block is block x block places; those within reach of the visit's one are held, round a world of `across` blocks: two round
    each chunk (block 1, reach 2) or one round each superchunk (block 16, reach 1) by the rules of the worlds read here. The first
    visit of a key brings in all. Visits go by at, then seq, which together must be distinct for a key; those with a null among
    key, at or place are left out. Time is cut into spans of `width`, each sorted by itself, and a span begins where the one
    before it ended, so a viewer with most of the visits is many groups.
    """
    rows = visits.filter("key IS NOT NULL AND at IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select("key", "at", F.coalesce("seq", F.lit(0)).alias("seq"), *[F.floor(F.col(c) / block).cast("int").alias(f"_{c}") for c in "xy"])
    rows = rows.withColumn("_span", F.floor(F.col("at") / width))
    here = F.struct("_x", "_y")
    ends = rows.groupBy("key", "_span").agg(F.max_by(here, F.struct("at", "seq")).alias("end"))
    begin = ends.select("key", "_span", F.lag("end").over(W.partitionBy("key").orderBy("_span")).alias("_begin"))
    rows = rows.withColumn("_before", F.lag(here).over(W.partitionBy("key", "_span").orderBy("at", "seq"))).join(begin, ["key", "_span"])
    rows = rows.withColumn("_before", F.coalesce("_before", "_begin"))
    moved = rows.filter(F.col("_before").isNull() | (F.col("_before._x") != F.col("_x")) | (F.col("_before._y") != F.col("_y")))
    # the blocks round a place as rows, so the arithmetic stays in generated code; in a small world each block once
    offsets = range(-reach, reach + 1) if 2 * reach < across else range(across)
    moved = moved.select("key", "at", "seq", F.explode(F.array(F.lit(True), F.lit(False))).alias("loaded"), "_x", "_y", F.col("_before._x").alias("_px"), F.col("_before._y").alias("_py"))
    for c in "xy":
        now, old = F.when(F.col("loaded"), F.col(f"_{c}")).otherwise(F.col(f"_p{c}")), F.when(F.col("loaded"), F.col(f"_p{c}")).otherwise(F.col(f"_{c}"))
        moved = moved.withColumns({f"_now{c}": now, f"_old{c}": old})
    moved = moved.filter("_nowx IS NOT NULL")
    for c in "xy":
        moved = moved.withColumn("_k", F.explode(F.array(*map(F.lit, offsets)))).withColumn(f"b{c}", F.pmod(F.col(f"_now{c}") + F.col("_k"), F.lit(across))).drop("_k")
    held = lambda c: F.pmod(F.col(f"b{c}") - F.col(f"_old{c}") + reach, F.lit(across)) <= 2 * reach
    return moved.filter(~F.coalesce(held("x") & held("y"), F.lit(False))).select("key", "at", "seq", "bx", "by", "loaded")
