"""Attribute dimensions: base and patch overlays, and lookups that fall back to wildcard rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Patch rows win by key; an invalid patch row removes the base row. One aggregation, no join."""
    both = base.withColumn("_p", F.lit(0)).unionByName(patch.withColumn("_p", F.lit(1)))
    rest = [c for c in both.columns if c not in (*keys, "_p")]
    top = both.groupBy(*keys).agg(F.max_by(F.struct(*rest, (F.col("_p") == 1).alias("patched")), "_p").alias("r"))
    return top.select(*keys, "r.*").filter("NOT invalid").drop("invalid")


def lookup(rows: DataFrame, dim: DataFrame, value: str) -> DataFrame:
    """Adds the value of the best valid dim row: (frame, quality), (frame, any), (any, quality), (any, any)."""
    live = dim.filter("NOT invalid")
    exact = live.select(F.col("shape").alias("s"), F.col("frame").alias("f"), F.col("quality").alias("q"), F.col(value).alias("v"))
    out = rows
    picks = []
    for i, (f, q) in enumerate(((F.col("frame"), F.col("quality")), (F.col("frame"), F.lit(-1)), (F.lit(-1), F.col("quality")), (F.lit(-1), F.lit(-1)))):
        side = exact.select(F.col("s").alias(f"s{i}"), F.col("f").alias(f"f{i}"), F.col("q").alias(f"q{i}"), F.col("v").alias(f"v{i}"))
        out = out.join(side, (F.col("shape") == F.col(f"s{i}")) & (f == F.col(f"f{i}")) & (q == F.col(f"q{i}")), "left").drop(f"s{i}", f"f{i}", f"q{i}")
        picks.append(F.col(f"v{i}"))
    return out.withColumn(value, F.coalesce(*picks)).drop("v0", "v1", "v2", "v3")


def lookup_one(rows: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """Adds the value of the dim row (key, value, invalid) of the key, else of the wildcard -1; two left joins.

    An invalid row of the key falls through to the wildcard row; key, value and invalid are unique by key.
    """
    live = dim.filter("NOT invalid")
    exact = live.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    wild = live.filter(F.col(key) == -1).groupBy(F.col(key).cast("int").alias("_any")).agg(F.max(value).alias("_w"))  # one row at most
    out = rows.join(exact, F.col(key) == F.col("_k"), "left").withColumn("_any", F.lit(-1)).join(F.broadcast(wild), "_any", "left")
    return out.withColumn(value, F.coalesce("_v", "_w")).drop("_k", "_v", "_w", "_any")


def names_of(rows: DataFrame, frames: DataFrame, messages: DataFrame, shapes: DataFrame) -> DataFrame:
    """id, name of rows (id, shape, frame): of the frame's row its message, else the shape's name; a chain of left joins.

    frames: shape, frame, kind, msg, other. Kind -255 or a message that is missing: the shape's name; other negative kinds:
    no name; 0: the message; odd: other message then message; even: message then other message (the shape's name where
    that is missing). messages: idx, text; shapes: shape, name.
    """
    said = lambda c: messages.select(F.col("idx").alias(c), F.col("text").alias(f"{c}_text"))
    all_ = rows.join(frames, ["shape", "frame"], "left").join(shapes, "shape", "left").join(said("msg"), "msg", "left").join(said("other"), "other", "left")
    kind, plain = F.coalesce("kind", F.lit(-255)), F.coalesce("name", F.lit(""))
    other = F.coalesce("other_text", plain)
    name = F.when((kind < 0) & (kind != -255), "").when((kind == -255) | F.col("msg_text").isNull(), plain).when(kind == 0, F.col("msg_text"))
    return all_.select("id", name.when(kind % 2 == 1, F.concat(other, "msg_text")).otherwise(F.concat("msg_text", other)).alias("name"))


def display_names(things: DataFrame, frames: DataFrame, messages: DataFrame, shapes: DataFrame, actors: DataFrame) -> DataFrame:
    """id, name: what is shown for things (id, shape, frame, quality, live_npc: whose body it is).

    frames: shape, frame, kind, msg, other; messages: idx, text; shapes: shape, name, has_quality, has_quantity, body; actors: npc,
    name, unused, met. Each is keyed by its first columns (of repeated rows the largest counts).

    The message of the frame stands for the shape's name where there is one. Kinds below 0 have no name (-255: the shape's). From
    kind 1 on, on shapes with a quality or bodies, another text is joined to it, before it for odd kinds and behind it for even
    ones: the other message (else the shape's name), from kind 3 on the name of the actor that the quality or the body stands for,
    if that one is in use, has a name and, for a body, was met; otherwise the other message alone (none for negative ones but -255,
    which is the shape's name). Names that are not joined show their quantity: `a/b/c/d` is `a bc` for one and `n bd` for more, with
    fewer parts `?`; others have the number before them. Nulls are texts that are not there: the name is then empty.
    """
    best = lambda df, keys: df.groupBy(*keys).agg(F.max(F.struct(*[c for c in df.columns if c not in keys])).alias("_r")).select(*keys, "_r.*")
    named = best(frames.select("shape", "frame", "kind", "msg", "other"), ["shape", "frame"])
    text = best(messages.select("idx", "text"), ["idx"])
    said = lambda c: text.select(F.col("idx").alias(c), F.col("text").alias(f"_{c}"))
    shape = best(shapes.select("shape", F.col("name").alias("_shape"), "has_quality", "has_quantity", "body"), ["shape"])
    actor = best(actors.select(F.col("npc").alias("_npc"), F.col("name").alias("_own"), "unused", "met"), ["_npc"])
    rows = things.select("id", "shape", "frame", "quality", "live_npc").join(named, ["shape", "frame"], "left").join(shape, "shape", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    body = flag("body")
    rows = rows.withColumn("_npc", F.when(~body, F.col("quality")).when(F.col("quality") == 1, F.col("live_npc")))
    rows = rows.join(said("msg"), "msg", "left").join(said("other"), "other", "left").join(actor, "_npc", "left")
    kind, plain, other = F.coalesce("kind", F.lit(-255)), F.col("_shape"), F.col("_other")
    known = F.col("unused").isNotNull() & ~flag("unused") & (~body | flag("met")) & (F.coalesce("_own", F.lit("")) != "")
    joined = (kind >= 1) & F.col("_msg").isNotNull() & (flag("has_quality") | body)
    with_actor, with_other = joined & (kind >= 3) & known, joined & (kind < 3)
    second = F.when(with_actor, F.col("_own")).otherwise(F.coalesce(other, plain, F.lit("")))
    alone = F.when(joined, F.when(other.isNotNull(), other).when((F.col("other") < 0) & (F.col("other") != -255), "").otherwise(plain)).when((kind == 0) & F.col("_msg").isNotNull(), F.col("_msg")).otherwise(plain)
    n, parts = F.when(flag("has_quantity"), F.coalesce("quality", F.lit(0)).bitwiseAND(127)).otherwise(1), F.split("_alone", "/", 4)
    one = F.concat(F.when(parts[0] != "", F.concat(parts[0], F.lit(" "))).otherwise(""), parts[1], parts[2])
    many = F.concat(n.cast("string"), F.lit(" "))
    shown = F.when(~F.contains("_alone", F.lit("/")), F.when(n <= 1, F.col("_alone")).otherwise(F.concat(many, "_alone"))).when(F.size(parts) < 4, "?").when(n <= 1, one).otherwise(F.concat(many, parts[1], F.get(parts, F.lit(3))))
    rows = rows.withColumn("_alone", alone)
    pair = F.when(kind % 2 == 1, F.concat(second, "_msg")).otherwise(F.concat("_msg", second))
    return rows.select("id", F.when((kind < 0) & (kind != -255), "").when(with_actor | with_other, pair).otherwise(F.coalesce(F.when(F.col("_alone") == "", "").otherwise(shown), F.lit(""))).alias("name"))


def with_groups(shapes: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """A row (shape, group) for each group that a shape is in."""
    named = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in groups.items()]), lambda g: g.isNotNull())
    return shapes.select("shape", F.explode(named).alias("group"))


LEADER = -356  # fixed value


def resolved(refs: DataFrame, known: DataFrame, leader: int) -> DataFrame:
    """Adds found to refs (ref): the row of known that the leader's number, a negative number or an id stands for, else null."""
    ref = F.col("ref")
    wanted = refs.withColumn("_id", F.when(ref == LEADER, leader).when(ref < 0, -ref).otherwise(ref))
    return wanted.join(known, F.col("_id") == F.col("found"), "left").drop("_id")
