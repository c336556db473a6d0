"""What a viewer holds in odd cases."""

import pytest

from gridloom.operators import temporal


@pytest.mark.parametrize("width", [1, 100, 1 << 24])
def test_blocks_held_by_hand(spark, width):
    rows = [(1, 10, 1, 0, 0), (1, 20, 2, 15, 3), (1, 30, 3, 16, 3), (1, 250, 4, 100, 100), (1, None, 5, 0, 0), (None, 5, 6, 0, 0), (1, 40, 7, None, 0), (2, -5, None, 191, 0)]
    visits = spark.createDataFrame(rows, "key long, at long, seq long, x int, y int").selectExpr("*", "'x' AS bx", "1 AS _span")
    got = temporal.cache_changes(visits, 16, 1, 12, width).collect()
    held, seen = set(), {}
    for r in sorted((r for r in got if r.key == 1), key=lambda r: (r.at, r.seq, r.loaded)):
        assert ((r.bx, r.by) in held) != r.loaded
        (held.add if r.loaded else held.remove)((r.bx, r.by))
        seen[r.at] = set(held)
    block = lambda x, y: {((x + i) % 12, (y + j) % 12) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    assert seen == {10: block(0, 0), 30: block(1, 0), 250: block(6, 6)}  # within a block nothing changes
    assert {(r.bx, r.by) for r in got if r.key == 2} == block(11, 0)
    assert temporal.cache_changes(visits.filter("false"), 1, 2, 192).count() == 0


@pytest.mark.parametrize("across, reach", [(12, 1), (5, 2), (4, 2), (3, 2), (1, 1)])
def test_blocks_of_small_worlds_come_once_and_without_lambdas(spark, across, reach):
    rows = [(1, t, t, t * 7 % across, t * t % across) for t in range(12)]
    got = temporal.cache_changes(spark.createDataFrame(rows, "key long, at long, seq long, x int, y int"), 1, reach, across)
    assert "lambdafunction" not in got._jdf.queryExecution().executedPlan().toString()  # those run uncompiled, block by block
    held = lambda x, y: {((x + i) % across, (y + j) % across) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)}
    want, old = [], set()
    for _, t, _, x, y in rows:
        now = held(x, y)
        want += [(t, b, True) for b in now - old] + [(t, b, False) for b in old - now]
        old = now
    assert sorted((r.at, (r.bx, r.by), r.loaded) for r in got.collect()) == sorted(want)
