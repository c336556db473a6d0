"""Sums by depth, paths with marks and shares of owners: what they write and deal."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import hierarchy
from gridloom.plans import queries as world
from gridloom.sources import movables

DIR = "/root/testdata/sf0.001"


def test_levels_are_those_of_the_closure(spark):
    edges = spark.createDataFrame([(1, 9), (2, 1), (2, 1), (3, 2), (4, 2), (5, None), (None, 1)], "node long, parent long")
    got = hierarchy.by_depth(edges, [F.lit(1).cast("long").alias("n"), F.col("node").alias("last")], [F.sum("n").alias("n"), F.max("last").alias("last")])
    want = hierarchy.closure(edges).groupBy("ancestor", "depth").agg(F.count("*").alias("n"), F.max("node").alias("last"))
    rows = lambda df: sorted(map(str, df.select("ancestor", "depth", "n", "last").collect()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("chain", [0, 5])
def test_a_circle_is_an_error_of_levels(spark, chain):
    edges = [(1, 2), (2, 3), (3, 1)] + [(10 + i, 11 + i) for i in range(chain)]
    with pytest.raises(ValueError):
        hierarchy.by_depth(spark.createDataFrame(edges, "node long, parent long"), [F.lit(1).alias("n")], [F.sum("n").alias("n")])


@pytest.mark.parametrize("name", ["j8_closure", "a3_carried_weight", "m2_added_within"])
def test_no_pairs_of_a_closure_are_written(spark, monkeypatch, name):
    def refuse(edges):
        raise AssertionError("all pairs")

    monkeypatch.setattr(hierarchy, "closure", refuse)
    assert world.QUERIES[name](spark, DIR).count() > 0


def test_a_round_of_paths_meets_only_what_lies_deeper(spark, monkeypatch):
    written, keep = [], hierarchy.materialize

    def count(df, name="step"):
        out = keep(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(hierarchy, "materialize", count)
    tree = spark.createDataFrame([(i, i // 2 or None, i % 3) for i in range(1, 64)] + [(90, 91, 0), (91, 90, 0), (92, 99, 1)], "id long, parent long, m long")
    got = {r.id: (r.root, r.depth, r.path, r.path_m) for r in hierarchy.paths(tree, ("m",)).collect()}
    line = lambda i: line(i // 2) + [i] if i > 1 else [i]
    assert got == {i: (1, len(line(i)) - 1, line(i), [k % 3 for k in line(i)]) for i in range(1, 64)} | {92: (92, 0, [92], [1])}
    assert written == [66, 64, 62, 58, 50, 34, 2]


def test_owners_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "_ROWS", 100)
    have = spark.range(3000).selectExpr("id % 1000 AS owner", "id % 3 AS key").filter("owner < 900")
    got = hierarchy.has_all(have, spark.createDataFrame([(0,), (1,)], "key long"), "owner", "key")
    assert "hashpartitioning(owner" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 27)" in plan
    assert got.count() == 900
