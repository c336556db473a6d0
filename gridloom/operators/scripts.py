"""Delayed scripts: a small state machine for each key, one operation a tick."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# Operations (fixed values); all others are passed on as they are.
CONT, RESET, REPEAT, REPEAT2, WAIT_NEAR, DELAY_TICKS, DELAY_MINUTES, DELAY_HOURS, WAIT_FAR = 0x01, 0x0A, 0x0B, 0x0C, 0x24, 0x27, 0x28, 0x29, 0x2B
TICKS_A_MINUTE, FOREVER = 25, 255


class Rule(NamedTuple):
    """What an operation with its arguments does: its length, when it holds its place, and where it jumps, for how many ticks it
    waits, and whether the tick goes on after it. jump and hold see its arguments, how often it has jumped, and the observer."""

    length: int = 1
    jump: Callable[[list[int], int, bool], int | None] = lambda args, jumped, near: None
    wait: Callable[[list[int]], int | None] = lambda args: None  # a tick in which nothing waits takes one
    goes_on: bool = False
    forgets: bool = False  # whether it counts its jumps anew once they are used up


def _turns(args: list[int], jumped: int, near: bool) -> int | None:
    return args[0] if args[1] == FOREVER or jumped < args[1] else None


def _delay(ticks: int) -> Rule:
    return Rule(2, wait=lambda args: args[0] * ticks)


PLAIN = Rule()
RULES = {
    CONT: Rule(goes_on=True),
    REPEAT: Rule(3, _turns, goes_on=True),
    REPEAT2: Rule(4, _turns, goes_on=True, forgets=True),
    WAIT_NEAR: Rule(2, lambda args, jumped, near: 0 if near else None),
    WAIT_FAR: Rule(2, lambda args, jumped, near: None if near else 0),
    DELAY_TICKS: _delay(1),
    DELAY_MINUTES: _delay(TICKS_A_MINUTE),
    DELAY_HOURS: _delay(60 * TICKS_A_MINUTE),
}


def play(code: list[int], near_until: int, last_tick: int, most_at_once: int = 1000) -> Iterator[tuple[int, int, int]]:
    """(tick, place, operation) of each step until last_tick. The observer is near before the tick near_until.

    A tick runs one operation, and on as long as CONT follows or a loop turns. REPEAT goes back by its offset as often as its
    count says (255 for ever); REPEAT2 does so again each time it is reached, after the count that follows the first. A loop
    that turns without end within a tick is cut after most_at_once steps and goes on a tick later.
    """
    at = tick = steps = 0
    waits = None
    jumped: dict[int, int] = {}
    counts: dict[int, int] = {}
    while at < len(code) and tick <= last_tick:
        op, here = code[at], at
        rule = RULES.get(op, PLAIN)
        args = [*code[at + 1 : at + 4], 0, 0, 0]
        args[1] = counts.get(here, args[1])
        offset = rule.jump(args, jumped.get(here, 0), tick < near_until)
        yield tick, here, op
        steps += 1
        waits = waits if rule.wait(args) is None else rule.wait(args)
        if op == RESET:
            at = 0
        elif offset is None:
            if rule.forgets:
                jumped[here], counts[here] = 0, args[2]
            at += rule.length
        else:
            jumped[here] = jumped.get(here, 0) + 1
            at = max(0, at + offset)
        if not ((rule.goes_on or (at < len(code) and code[at] == CONT)) and steps < most_at_once):
            tick += max(1 if waits is None else waits, int(steps >= most_at_once))
            waits, steps = None, 0


def run_scripts(scripts: DataFrame, last_tick: int) -> DataFrame:
    """id, tick, place, op of scripts (id, code array<int>, near_until); each script is a row and runs in its own task's loop.

    A null code is empty; repeated rows run twice; an empty table gives no rows.
    """
    ship(scripts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *step) for i, code, near in zip(frame.id, frame.code, frame.near_until, strict=True) for step in play(code if code is not None else [], near, last_tick)]
            yield pd.DataFrame(rows, columns=["id", "tick", "place", "op"])

    return scripts.select("id", "code", "near_until").mapInPandas(run, "id long, tick long, place int, op int")


def purged(scripts: DataFrame, distance: Column, most: int) -> DataFrame:
    """scripts (started, must_finish) with fate: kept, halted (not begun and too far) or finished (the same, but it must)."""
    gone = ~F.col("started") & (distance > most)
    return scripts.withColumn("fate", F.when(~gone, "kept").when(F.col("must_finish"), "finished").otherwise("halted"))


def next_look(now: Column, roll: Column, hostile: Column, tick: int = 200) -> Column:
    """When a nearby actor is next attended to, in milliseconds: within 2 seconds if hostile, else 2 to 6, in ticks of 100; roll is any whole number."""
    wait = F.when(hostile, roll % 2000).otherwise(roll % 4000 + 2000)
    return now + F.call_function("div", wait * tick, F.lit(100))
