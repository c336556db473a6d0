"""Connected components of an edge list by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Keys that are broadcast in one join, at most.
MOST_HOT = 1 << 14


def by_key(rows: DataFrame, named: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """rows with the value that named (key, value, k: its rows in rows, of which rows has total) gives a key, or null.

    Keys of many rows, MOST_HOT at most, are broadcast. Their rows are dealt by a hash of themselves in the join of the others;
    should that equal some key, the broadcast value still counts.
    """
    many = max(100, total // MOST_HOT)
    hot = named.filter(F.col("k") >= many).select(key, F.col(value).alias("_hot"))
    rest = named.filter(F.col("k") < many).select(F.col(key).alias("_key"), value)
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    return dealt.join(rest, "_key", "left").select(*rows.columns, F.coalesce("_hot", value).alias(value))


def _large(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of u goes to the smallest of u and its neighbours."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k"))
    return by_key(both.filter("v > u"), least, "u", "m", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, total: int) -> DataFrame:
    """u and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    own = F.struct("u", F.col("m").alias("v"))  # of the edge to m itself; the others lead to their own smaller end
    return by_key(down, least, "u", "m", total).select(F.when(F.col("v") == F.col("m"), own).otherwise(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))).alias("e")).select("e.*")


def _ends() -> list[Column]:
    return [F.struct(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("downs"))]


def shape(edges: DataFrame) -> tuple[bool, int]:
    """Do distinct edges (u > v) form stars, each around its smallest node? And how many are they?"""
    ends = edges.select(F.inline(F.array(*_ends()))).groupBy("node").agg(F.sum("ups").alias("ups"), F.sum("downs").alias("downs"))
    both = ends.agg(F.count_if(F.expr("ups > 1 or (ups = 1 and downs > 0)")).alias("loose"), F.sum("ups").alias("total")).head()
    return both["loose"] == 0, both["total"] or 0


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (u, v); labels name themselves too."""
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:  # labels only fall, so this ends, after rounds that grow with the logarithm of the longest path
        done, total = shape(now)
        if done:
            break
        new = materialize(_small(_large(now, total), total).filter("u <> v").distinct(), "edges")
        discard(now)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label), as components gives them, after more edges (u, v): only their components are joined anew."""
    of = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"{s}l"))
    named = edges.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("ul", "u").alias("u"), F.coalesce("vl", "v").alias("v"))
    merged = materialize(components(named), "merged")
    sizes = labels.groupBy("label").agg(F.count("*").alias("k"))
    moved = merged.filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("to")).join(sizes, "label")
    kept = by_key(labels, moved, "label", "to", labels.count()).select("node", F.coalesce("to", "label").alias("label"))
    return kept.unionByName(merged.join(labels.select("node"), "node", "left_anti"))
