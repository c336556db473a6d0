"""Views that map the fixture tables to world tables, as SQL text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "obj": """SELECT o_orderkey AS id, (o_orderkey * 37) % 3072 AS tx, (o_custkey * 53 + o_orderkey * 7) % 3072 AS ty, o_orderkey % 16 AS tz,
 o_custkey % 1024 AS shape, o_orderkey % 64 AS frame, o_custkey % 256 AS quality, (o_orderkey + o_custkey) % 4 AS side FROM orders""",
    "thing": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT) END AS parent, (o_orderkey * 37) % 3072 AS tx,
 (o_custkey * 53 + o_orderkey * 7) % 3072 AS ty, o_orderkey % 16 AS tz, o_custkey % 64 AS shape, o_orderkey % 64 AS frame, o_custkey % 8 AS quality, o_custkey % 7 = 0 AS npc,
 o_orderkey % 11 = 0 AS dead, o_custkey % 13 IN (1, 2) AS egg_like, o_custkey % 17 = 3 AS transparent, o_orderkey % 6 = 1 AS invisible, o_orderkey % 4 = 1 AS in_party,
 o_orderkey % 19 = 2 AS free, o_orderkey % 64 AS disguise, o_orderkey % 13 = 0 AS locked, o_custkey % 29 = 4 AS burning, o_custkey % 3 = 1 AS spell, o_orderkey % 17 = 0 AS pocket,
 o_orderkey % 7 + 1 AS quantity, o_custkey % 9 AS unit, o_custkey % 10 = 3 AS light, o_custkey % 4 = 1 AS counted, o_orderkey % 5 + 1 AS volume, (o_custkey % 4) * 6 AS capacity,
 o_custkey % 30 AS strength FROM orders""",
    "item": """SELECT l_orderkey AS owner, l_partkey % 1024 AS shape, l_linenumber AS frame, CAST(l_quantity AS BIGINT) AS quantity, l_partkey AS part, l_suppkey AS supp,
 l_extendedprice AS price FROM lineitem""",
    "dim": """SELECT p_partkey % 64 AS shape, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE p_partkey % 8 END AS frame, CASE WHEN p_partkey % 5 < 2 THEN -1 ELSE p_partkey % 4 END AS quality,
 p_partkey % 11 = 0 AS invalid, min(p_size) AS size FROM part GROUP BY 1, 2, 3, 4""",
    # things with a size on a small part of each map, across its seam; a map for every 2,000
    "solid": """SELECT o_orderkey AS id, CAST((o_orderkey - o_orderkey % 2000) / 2000 AS BIGINT) AS map, (3040 + (o_orderkey * 37) % 64) % 3072 AS tx, (3040 + (o_custkey * 53 + o_orderkey * 7) % 64) % 3072 AS ty,
 o_orderkey % 12 AS tz, o_custkey % 3 + 1 AS xs, o_orderkey % 2 + 1 AS ys, CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE o_custkey % 4 + 1 END AS zs, o_orderkey % 64 AS frame, o_custkey % 11 = 0 AS dead,
 CASE o_custkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS kind, o_orderkey % 50 = 0 AS whole, o_custkey % 5 AS light FROM orders""",
    # stacks of eight things that do not overlap, with gaps below some
    "stack": """SELECT id, map, x AS tx, y AS ty, (id % 8 * 4 + x % 2 * 2 + y % 2) * 5 + cust % 3 AS tz, id % 2 + 1 AS xs, cust % 2 + 1 AS ys, cust % 3 + 1 AS zs, cust % 7 > 0 AS movable, id % 9 = 0 AS gone FROM
 (SELECT o_orderkey AS id, o_custkey AS cust, CAST((o_orderkey - o_orderkey % 18432) / 18432 AS BIGINT) AS map, CAST((o_orderkey % 384 - o_orderkey % 8) / 8 AS BIGINT) AS x, CAST((o_orderkey % 18432 - o_orderkey % 384) / 384 AS BIGINT) AS y FROM orders)""",
    "queue": "SELECT event_id, user_id AS k, event_type AS kind, ts AS due, value FROM events",
}
TABLES = {"obj": ["orders"], "solid": ["orders"], "stack": ["orders"], "thing": ["orders"], "item": ["lineitem"], "dim": ["part"], "queue": ["events"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view, each source table read by its path."""
    text = VIEWS[name]
    for t in TABLES[name]:
        text = text.replace(f"FROM {t}", "FROM {src}")
        return spark.sql(text, src=spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    raise KeyError(name)


def having(*names: str) -> str:
    """The WITH clause of an oracle."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
