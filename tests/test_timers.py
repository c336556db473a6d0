"""Queues with timers: the stream against its batch twin and a simulation, over several micro-batches."""

import random

import pytest

from gridloom.streaming import timers

SCHEMA = "key long, at long, seq long, what string, event_id long, due long"


def run(spark, tmp_path, batches, delay, name):
    timers.prepare(spark)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
        for f in (tmp_path / f"in/b{i}").glob("*.parquet"):  # files are taken by age
            import os

            os.utime(f, (1_000_000 + i, 1_000_000 + i))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = timers.fired_stream(source, delay).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300) and not q.exception()
    return [tuple(r) for r in spark.table(name).collect()], q


def operations(seed, cancels=("cancel",)):
    rng, rows = random.Random(seed), []
    for seq in range(120):
        at = 1000 * seq + rng.randrange(900)
        if rng.random() < 0.6 or not rows:
            rows.append((rng.randrange(4), at, seq, "add", seq, at + rng.choice((0, 500, 4000, 20_000, 40_000))))
        else:
            key, _, _, _, event_id, _ = rng.choice([r for r in rows[-12:] if r[3] == "add"] or rows[:1])
            what = rng.choice(cancels)
            rows.append((key, at, seq, what, event_id if what == "cancel" else None, None))
    return rows


def cut(rows, n):
    return [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]


@pytest.mark.parametrize("n,shuffle", [(6, False), (4, True)])
def test_stream_equals_batch(spark, tmp_path, n, shuffle):
    rows = operations(7)
    latest = max(r[1] for r in rows)
    order = list(rows)
    if shuffle:  # rows come up to ten places late, which a delay of fifteen seconds covers
        rng = random.Random(1)
        order = [r for _, r in sorted((i + rng.randrange(10), r) for i, r in enumerate(rows))]
    got, q = run(spark, tmp_path, cut(order, n), "15 seconds", f"fired_{n}")
    want = timers.fired(spark.createDataFrame(rows, SCHEMA), latest - 15_000).collect()
    assert sorted(got) == sorted(map(tuple, want)) and len(got) > 20
    assert len({p["batchId"] for p in q.recentProgress}) >= n


def simulate(rows, until):
    """A plain queue, in the order of time."""
    waiting, out = [], []

    def fire(now):
        out.extend(w for w in waiting if w[2] <= now)
        waiting[:] = [w for w in waiting if w[2] > now]

    for key, at, seq, what, event_id, due in sorted(rows, key=lambda r: (r[1], r[2])):
        if at <= until:
            fire(at)
            if what == "add":
                waiting.append((key, event_id, due, seq))
            gone = sorted((w for w in waiting if w[0] == key and (what == "cancel_first" or w[1] == event_id)), key=lambda w: (w[2], w[3])) if what != "add" else []
            waiting = [w for w in waiting if w not in gone[:1]]
    fire(until)
    return [w[:3] for w in out]


def test_the_first_entry_is_cancelled(spark, tmp_path):
    rows = operations(3, ("cancel", "cancel_first"))
    got, _ = run(spark, tmp_path, cut(rows, 5), "0 seconds", "fired_first")
    want = simulate(rows, max(r[1] for r in rows))
    assert sorted(got) == sorted(want) and len(want) > 20


def test_odd_rows(spark, tmp_path):
    rows = [(None, 1000, 1, "add", 1, 1500), (1, 1000, 2, "add", None, 1500), (1, 1000, 3, "add", 3, None), (1, 1000, 4, "add", 4, 500), (1, 1100, 5, "add", 5, 2000), (1, 1200, 6, "add", 5, 3000), (1, 1300, 7, "cancel", 99, None), (2, 1300, 8, "cancel_first", None, None), (1, 1400, 9, None, 4, None)]
    later = [[(9, 60_000, 10, "add", 10, 10**9)], [(1, 10, 11, "add", 11, 20)], [(9, 70_000, 12, "cancel", 98, None)]]
    got, _ = run(spark, tmp_path, [rows, *later], "0 seconds", "fired_odd")
    assert sorted(got) == [(1, 4, 500), (1, 5, 3000)]  # a row far behind the watermark is dropped
    assert timers.fired(spark.createDataFrame([], SCHEMA), 10).count() == 0
    assert {tuple(r) for r in timers.fired(spark.createDataFrame(rows, SCHEMA), 10_000).collect()} == {(1, 4, 500), (1, 5, 3000)}
