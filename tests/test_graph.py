"""Searches for least costs against Dijkstra's method, for all kinds of goals."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import graph
from gridloom.plans import world  # noqa: F401
from gridloom.plans import queries

DIR = "/root/testdata/sf0.001"
TILE = "grid long, x int, y int, blocked boolean, avoid boolean, lift int, poison boolean, paved boolean"


def step_cost(old, new):
    """By the rules in words: 3 a step; as much again for a bad tile and for a change of lift; double on poison; pavement 1 less."""
    if new[0]:
        return None
    cost = 3 + (3 if new[1] else 0) + (3 if old[2] != new[2] else 0)
    return cost * (2 if new[3] and not new[2] else 1) - int(new[4])


def least(tiles, start, goal, bound):
    """The least cost below bound from start to where goal holds."""
    left, done = [(0, start)], set()
    while left:
        cost, t = heapq.heappop(left)
        if t in done:
            continue
        if goal(*t):
            return cost if cost < bound else None
        done.add(t)
        for to in ((t[0] + i, t[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j):
            if to in tiles and t in tiles and (step := step_cost(tiles[t], tiles[to])) is not None:
                heapq.heappush(left, (cost + step, to))
    return None


def check(rows, tiles, starts, goals, bound):
    found = 0
    for r in rows:
        grid, start = starts[r.search]
        want = least(tiles[grid], start, goals[r.search], bound[r.search] if isinstance(bound, dict) else bound)
        assert r.cost == want, (r, want)
        way = [start, *((p.x, p.y) for p in r.path)]
        if want is None:
            assert not r.path
        else:
            found += 1
            assert goals[r.search](*way[-1]) and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(way, way[1:]))
            assert sum(step_cost(tiles[grid][a], tiles[grid][b]) for a, b in zip(way, way[1:])) == want
    return found


@pytest.mark.parametrize("doublings", [0, 1, 2])
def test_least_costs_of_random_grids(spark, doublings):
    rng = random.Random(9)
    tiles = {g: {(x, y): (rng.random() < 0.3, rng.random() < 0.2, rng.randrange(2), rng.random() < 0.2, rng.random() < 0.2) for x in range(12) for y in range(12)} for g in (0, 1)}
    searches = [(i, rng.randrange(2), rng.randrange(12), rng.randrange(12), rng.randrange(12), rng.randrange(12)) for i in range(60)]
    frame = spark.createDataFrame([(g, x, y, *t) for g, all_ in tiles.items() for (x, y), t in all_.items()], TILE)
    asked = spark.createDataFrame(searches, "search long, grid long, x int, y int, x1 int, y1 int").withColumn("cost_", F.lit("x"))
    steps = graph.neighbour_steps(frame, graph.actor_cost())
    starts = {s: (g, (x, y)) for s, g, x, y, _, _ in searches}
    x1, y1 = F.col("x1"), F.col("y1")
    got = graph.least_costs(asked, steps, graph.at_tile(x1, y1), F.lit(45), 2 * F.greatest(F.abs(F.col("x") - x1), F.abs(F.col("y") - y1)), doublings).collect()
    goals = {s: (lambda a, b, u=u, v=v: (a, b) == (u, v)) for s, _, _, _, u, v in searches}
    assert len(got) == 60 and check(got, tiles, starts, goals, 45) > 20


def test_the_queries_cost_least(spark):
    part = spark.read.parquet(f"{DIR}/part.parquet").collect()
    tiles, starts = {}, {}
    for r in part:
        k, s = r.p_partkey, r.p_size
        starts[k] = (k // 4096, (k % 64, k // 64 % 64))
        tiles.setdefault(k // 4096, {})[k % 64, k // 64 % 64] = (s % 4 == 1, s % 5 == 2, s % 3, s % 7 == 3, s % 11 == 4)
    clip = lambda v: min(max(v, 0), 63)
    at = {r.p_partkey: starts[r.p_partkey][1] for r in part}
    size = {r.p_partkey: r.p_size for r in part}
    to = {k: (clip(x + size[k] % 31 - 15), clip(y + k * 7 % 31 - 15)) for k, (x, y) in at.items()}
    way = {k: sorted((abs(to[k][0] - x), abs(to[k][1] - y))) for k, (x, y) in at.items()}
    run = lambda name: queries.QUERIES[name](spark, DIR).collect()
    got = run("g1_grid_costs")
    assert len(got) == len(part) and check(got, tiles, starts, {k: (lambda a, b, t=t: (a, b) == t) for k, t in to.items()}, {k: max(74, 3 * (2 * b + a)) for k, (a, b) in way.items()}) > 20
    lines = {k: (lambda a, b, v=clip(at[k][k % 2] + size[k] % 15 - 7), i=k % 2: (a, b)[i] == v) for k in at}
    assert check(run("g2_one_coordinate"), tiles, starts, lines, 60) > 20
    near = {k: (lambda a, b, u=clip(x + size[k] % 21 - 10), v=clip(y + k * 5 % 21 - 10): max(abs(a - u), abs(b - v)) <= 2) for k, (x, y) in at.items()}
    assert check(run("g2_approach"), tiles, starts, near, 60) > 20
    off = {k: (lambda a, b, x=x, y=y: abs(a - x) > 4 or abs(b - y) > 3) for k, (x, y) in at.items()}
    check(run("g2_off_screen"), tiles, starts, off, 40)


def test_odd_searches(spark):
    tiles = spark.createDataFrame([(0, x, 0, False, False, 0, False, False) for x in range(4)] + [(None, 9, 9, False, False, 0, False, False)], TILE)
    steps = graph.neighbour_steps(tiles.unionByName(tiles.limit(1)), graph.actor_cost())
    asked = spark.createDataFrame([(1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 3, 0), (3, 0, None, 0, 3, 0), (4, 0, 0, 0, 3, 3), (5, 7, 0, 0, 3, 0), (6, 0, 50, 50, 3, 0), (7, None, 9, 9, 9, 9)], "search long, grid long, x int, y int, x1 int, y1 int")
    goal = graph.at_tile(F.col("x1"), F.col("y1"))
    got = {r.search: (r.cost, [(p.x, p.y) for p in r.path]) for r in graph.least_costs(asked, steps, goal, F.lit(10)).collect()}
    assert got == {1: (0, []), 2: (9, [(1, 0), (2, 0), (3, 0)]), 3: (None, []), 4: (None, []), 5: (None, []), 6: (None, []), 7: (0, [])}
    assert {r.cost for r in graph.least_costs(asked, steps, goal, F.lit(9)).filter("search = 2").collect()} == {None}  # below the bound
    assert graph.least_costs(asked.filter("false"), steps, goal, F.lit(9)).count() == 0
    assert graph.least_costs(asked, steps.filter("false"), goal, F.lit(9)).filter("cost > 0").count() == 0


def test_searches_write_no_rounds(spark):
    from pathlib import Path

    from gridloom.storage import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    there = lambda: sum(1 for _ in shared.rglob("*")) if shared.exists() else 0
    before = there()
    tiles = spark.createDataFrame([(0, x, 0, False, False, 0, False, False) for x in range(150)], TILE)
    asked = spark.createDataFrame([(i, 0, i, 0, 149, 0) for i in range(3)], "search long, grid long, x int, y int, x1 int, y1 int")
    got = graph.least_costs(asked, graph.neighbour_steps(tiles, graph.actor_cost()), graph.at_tile(F.col("x1"), F.col("y1")), F.lit(1000)).collect()
    assert {r.search: (r.cost, len(r.path)) for r in got} == {i: (3 * (149 - i), 149 - i) for i in range(3)}
    assert there() == before  # the earlier form wrote its state once a round


@pytest.mark.parametrize("name", ["g1_grid_costs", "g2_one_coordinate", "g2_approach", "g2_off_screen"])
def test_tiles_and_searches_are_never_broadcast(spark, name):
    """Before, 1.2 million tiles, 5 MB as a file, were made a table in the driver."""
    plan = queries.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
