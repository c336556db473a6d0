"""Mixing overlapping sources to target weights by min-cost flow, then selecting documents by seed.

Method: documents are aggregated by the set of sources they count for (their membership pattern). Word capacity
flows from patterns to source quotas; a pattern's first use is free and each repetition costs more than the last
(convex), so no document is repeated while a fresh one could serve. The flow of each pattern then becomes whole
passes over its documents and a rest, which is filled with documents in seeded order: the longest prefix of the order
whose words fit up to a short run of documents, of that run whatever still fits (once more where repetition is allowed),
and one more document where that comes nearer.

Scale: one pass counts words and writes each row with its size and key. The prefix is found by histogram levels of four
bits of the key, each a map-side combined aggregation of at most 16 sums a pattern, until the run is short
(``MOST_RUN`` documents, so the number of levels grows with the logarithm of the rows); a source with a third of all rows is never in one task. What
the driver holds is a row a pattern, at most ``max_patterns``; where there are more, the patterns of fewest words
count for the first of their sources alone.

Defined results: a null text has size 0 and is never taken; a null source comes last; the order of sources in a row
and their repetition do not matter; a row without sources is not taken; a null doc_id is drawn like any other;
repeated rows are drawn one by one; an empty table gives no rows; other columns pass through ``mixed``.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, small_table

Source = str | None
KEY_BITS, LEVEL_BITS = 60, 4
MOST_RUN = 256  # documents of a pattern that are chosen among one by one; the steps on them grow with its square


def targets_of(sizes: dict[Source, int], weights: dict[Source, float], most: float = 3.0) -> dict[Source, float]:
    """Shares of the total by weight; what a source cannot take (most times its size) is shared again by weight."""
    out: dict[Source, float] = {}
    left, open_ = float(sum(sizes.values())), set(sizes)
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total > most * sizes[s]}
        if not full:
            return out | {s: left * weights[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def flow(capacity: dict[int, int], members: dict[int, tuple[Source, ...]], quota: dict[Source, int], most: int = 3) -> dict[int, int]:
    """Words that each pattern gives in a maximum flow of least cost; use k of a pattern costs k - 1 a word.

    Only arcs out of the start have a cost and no shortest way comes back to it, so the cheapest ways are those through
    the first uses, then those through the second, and so on: a maximum flow is found for each use in turn, on what the
    uses before it left, by blocking flows on the layers of shortest ways.
    """
    patterns = sorted(capacity)
    sources = sorted({s for p in patterns for s in members[p]}, key=lambda s: (s is None, s or ""))
    number = {s: len(patterns) + i for i, s in enumerate(sources)}
    start, end = len(patterns) + len(sources), len(patterns) + len(sources) + 1
    out: list[list[int]] = [[] for _ in range(end + 1)]
    to: list[int] = []
    room: list[int] = []  # of arc i; the way back is arc i ^ 1

    def arc(a: int, b: int, n: int) -> int:
        for x, y, r in ((a, b, n), (b, a, 0)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
        return len(to) - 2

    first = [arc(start, i, 0) for i in range(len(patterns))]
    for i, p in enumerate(patterns):
        for s in members[p]:
            arc(i, number[s], most * capacity[p])
    for s in sources:
        arc(number[s], end, quota[s])
    for _ in range(most):
        for i, p in enumerate(patterns):
            room[first[i]] += capacity[p]
        while True:
            depth, queue = {start: 0}, deque([start])
            while queue and end not in depth:
                a = queue.popleft()
                for i in out[a]:
                    if room[i] and to[i] not in depth:
                        depth[to[i]] = depth[a] + 1
                        queue.append(to[i])
            if end not in depth:
                break
            todo = [0] * len(out)  # arcs of each node that are used up for these layers
            way: list[int] = []
            while True:
                a = to[way[-1]] if way else start
                if a == end:
                    n = min(room[i] for i in way)
                    for i in way:
                        room[i] -= n
                        room[i ^ 1] += n
                    del way[next(k for k, i in enumerate(way) if not room[i]) :]
                elif todo[a] == len(out[a]):
                    if not way:
                        break
                    way.pop()
                    todo[to[way[-1]] if way else start] += 1
                elif room[i := out[a][todo[a]]] and depth.get(to[i]) == depth[a] + 1:
                    way.append(i)
                else:
                    todo[a] += 1
    return {p: room[first[i] ^ 1] for i, p in enumerate(patterns)}


def order_key(seed: int) -> Column:
    """60 bits: 40 from the row's content, 20 from its place, which only part repeated rows."""
    top = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").bitwiseAND((1 << 40) - 1)
    low = F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).bitwiseAND((1 << 20) - 1)
    return F.shiftleft(top, 20).bitwiseOR(low)


def _crossing(rows: DataFrame, gaps: dict[int, int], counts: dict[int, int], most_run: int) -> dict[int, tuple[int, int, int]]:
    """For each pattern: (the first key of a run of documents, the first after it, the gap): what comes before the run
    fits, what comes before its end does not. A pattern that fits whole has an empty run at the end of all keys."""
    spark = rows.sparkSession
    end = 1 << KEY_BITS
    out: dict[int, tuple[int, int, int]] = {}
    out |= {p: (0, end, g) for p, g in gaps.items() if counts[p] <= most_run}
    state = {p: (0, g) for p, g in gaps.items() if p not in out}  # the bits found so far, and the gap behind them
    bits = 0
    while state:
        bits += LEVEL_BITS
        shift = KEY_BITS - bits
        at = small_table(spark, [(p, high, gap) for p, (high, gap) in state.items()], "p int;high long;gap long")
        own = rows.join(F.broadcast(at), "p").filter((F.shiftright("key", shift + LEVEL_BITS) == F.col("high")) & (F.col("size") > 0))
        sums = own.groupBy("p", "gap", F.shiftright("key", shift).alias("b")).agg(F.sum("size").alias("n"), F.count("*").alias("k"))
        listed = sums.groupBy("p", "gap").agg(F.sort_array(F.collect_list(F.struct("b", "n", "k"))).alias("bins"))  # 16 bins at most
        start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("k"))
        step = lambda acc, x: F.when(acc["b"].isNull() & (acc["used"] + x["n"] <= F.col("gap")), F.struct((acc["used"] + x["n"]).alias("used"), acc["b"].alias("b"), acc["k"].alias("k"))).when(
            acc["b"].isNull(), F.struct(acc["used"].alias("used"), x["b"].alias("b"), x["k"].alias("k"))
        ).otherwise(acc)
        got = {r.p: r.x for r in listed.select("p", F.aggregate("bins", start, step).alias("x")).collect()}
        new = {}
        for p, (high, gap) in state.items():
            x = got.get(p)
            if x is None or x["b"] is None:  # all of it fits
                out[p] = ((high + 1) << (shift + LEVEL_BITS),) * 2 + (gap - (x["used"] if x else 0),)
            elif x["k"] <= most_run or not shift:
                out[p] = (x["b"] << shift, min(end, (x["b"] + 1) << shift), gap - x["used"])
            else:
                new[p] = (x["b"], gap - x["used"])
        state = new
    return out


def plan_mix(rows: DataFrame, given: dict[int, int], words: dict[int, int], counts: dict[int, int], most: int = 3) -> DataFrame:
    """From rows (p, size, key): p, passes, upto (keys below are taken once more), picked and again (so are these before until), one (this key once more still)."""
    spark = rows.sparkSession
    passes = {p: g // words[p] if words[p] else 0 for p, g in given.items()}
    gaps = {p: g - passes[p] * words[p] for p, g in given.items()}
    runs = _crossing(rows, {p: g for p, g in gaps.items() if g > 0}, counts, MOST_RUN)
    plan = small_table(spark, [(p, passes[p], *runs.get(p, (0, 0, gaps[p]))) for p in given], "p int;passes int;upto long;until long;gap long")
    # Of the run, a short list: in order of key as long as the largest still fits, then the largest that fit, then again those that may be repeated.
    run = rows.join(F.broadcast(plan), "p").filter((F.col("key") >= F.col("upto")) & (F.col("key") < F.col("until")) & (F.col("size") > 0))
    units = run.groupBy("p", "passes", "gap", "key").agg(F.sum("size").alias("n")).groupBy("p", "passes", "gap").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("units"))
    none = F.array().cast("array<bigint>")
    fits = lambda acc, x: F.struct((acc["left"] - x["n"]).alias("left"), F.concat(acc["keys"], F.array(x["key"])).alias("keys"), acc["open"].alias("open"))
    shut = lambda acc: F.struct(acc["left"].alias("left"), acc["keys"].alias("keys"), F.lit(False).alias("open"))
    ordered = lambda x: F.sort_array(F.transform(x, lambda u: F.struct(u["n"].alias("n"), u["key"].alias("key"))), False)
    greedy = lambda x, left: F.aggregate(x, F.struct(left.alias("left"), none.alias("keys"), F.lit(True).alias("open")), lambda acc, u: F.when(u["n"] <= acc["left"], fits(acc, u)).otherwise(acc))
    prefix = F.aggregate("units", F.struct(F.col("gap").alias("left"), none.alias("keys"), F.lit(True).alias("open")), lambda acc, u: F.when(~acc["open"], acc).when(u["n"] + F.col("big") <= acc["left"], fits(acc, u)).otherwise(shut(acc)))
    got = units.withColumn("big", F.array_max(F.transform("units", lambda u: u["n"]))).select("p", "passes", "units", prefix.alias("a"))
    rest = F.filter("units", lambda u: ~F.array_contains(F.col("a.keys"), u["key"]))
    got = got.withColumn("b", greedy(ordered(rest), F.col("a.left")))
    free = F.filter("units", lambda u: (F.col("passes") + F.when(F.array_contains(F.col("a.keys"), u["key"]) | F.array_contains(F.col("b.keys"), u["key"]), 2).otherwise(1)) <= most)
    got = got.withColumn("c", greedy(ordered(free), F.col("b.left")))
    picked = got.select("p", F.concat("a.keys", "b.keys").alias("picked"), F.col("c.keys").alias("again"), F.col("c.left").alias("left"))
    plan = plan.join(F.broadcast(picked), "p", "left")
    plan = plan.select("p", "passes", "upto", "until", F.coalesce("picked", none).alias("picked"), F.coalesce("again", none).alias("again"), F.coalesce("left", "gap").alias("gap"))
    plan = materialize(plan, "mix-plan")
    # One more document where that comes nearer: the one whose size is closest to the gap.
    used = rows.join(F.broadcast(plan.filter("gap > 0")), "p").withColumn("used", taken_words(F.col("size"), F.col("key"), last=False))
    free = used.filter((F.col("used") + F.col("size") <= most * F.col("size")) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
    best = free.groupBy("p").agg(F.min_by(F.struct("size", "key"), F.struct(F.abs(F.col("size") - F.col("gap")), "key")).alias("one"))
    one = {r.p: (r.one["size"], r.one["key"]) for r in best.collect()}
    last = small_table(spark, [(p, *one.get(p, (-1, -1))) for p in given], "p int;one_size long;one_key long")
    return plan.drop("gap").join(F.broadcast(last), "p")


def taken_words(size: Column, key: Column, last: bool = True) -> Column:
    run = (key >= F.col("upto")) & (key < F.col("until"))
    once = (key < F.col("upto")).cast("int") + F.when(run, F.array_contains("picked", key).cast("int") + F.array_contains("again", key).cast("int")).otherwise(0)
    one = ((size == F.col("one_size")) & (key == F.col("one_key"))).cast("int") if last else F.lit(0)
    return size * (F.col("passes") + once + one)


def mix_sources(docs: DataFrame, seed: int = 17, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), sources: Column | None = None, max_patterns: int = 100_000, with_doc: bool = False) -> DataFrame:
    """A row for each of docs: doc_id or doc, size, sources, source_size and target (of its first source), taken.

    sources: array of the sources a document counts for; by default its source alone.
    """
    spark = docs.sparkSession
    of = F.array(F.col("source")) if sources is None else F.array_sort(F.array_distinct(F.coalesce(sources.cast("array<string>"), F.array().cast("array<string>"))))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc") if with_doc else F.col("doc_id")
    rows = materialize(docs.select(own, of.alias("sources"), size.alias("size"), order_key(seed).alias("key")), "mix")
    counted = rows.groupBy("sources").agg(F.sum("size").alias("n"), F.count("*").alias("k"))
    found = counted.orderBy(F.desc("n"), "sources").limit(max_patterns + 1).collect()
    effective = F.col("sources")
    if len(found) > max_patterns:
        kept = materialize(counted.orderBy(F.desc("n"), "sources").limit(max_patterns).select(F.col("sources").alias("of")), "mix-patterns")
        rows = rows.join(F.broadcast(kept), F.col("sources").eqNullSafe(F.col("of")), "left").withColumn("pattern", F.when(F.col("of").isNotNull(), F.col("sources")).otherwise(F.slice("sources", 1, 1))).drop("of")
        effective = F.col("pattern")
        found = rows.groupBy(effective.alias("sources")).agg(F.sum("size").alias("n"), F.count("*").alias("k")).collect()
    found.sort(key=lambda r: [(s is None, s or "") for s in r.sources])
    members = {p: tuple(r.sources) for p, r in enumerate(found)}
    words = {p: r.n or 0 for p, r in enumerate(found)}
    counts = {p: r.k for p, r in enumerate(found)}
    sizes: dict[Source, int] = {}
    for p, names in members.items():
        for s in names:
            sizes[s] = sizes.get(s, 0) + words[p]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = sum(words[p] for p in members if members[p])
    quota = targets_of(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, most)
    if sum(sizes.values()) > total:  # overlapping sources share what there is once
        quota = {s: q * total / sum(sizes.values()) for s, q in quota.items()}
    given = flow(words, members, {s: round(q) for s, q in quota.items()}, most)
    known = small_table(spark, [(p, list(m), sizes[m[0]] if m else None, float(quota[m[0]]) if m else None) for p, m in members.items()], "p int;of array<string>;source_size long;target double")
    keyed = rows.join(F.broadcast(known.select("p", "of")), effective.eqNullSafe(F.col("of"))).select("p", "size", "key")
    plan = known.join(F.broadcast(plan_mix(keyed, given, words, counts, most)), "p")
    joined = rows.join(F.broadcast(plan), effective.eqNullSafe(F.col("of")), "left")
    return joined.select("doc" if with_doc else "doc_id", "size", "sources", "source_size", "target", F.coalesce(taken_words(F.col("size"), F.col("key")), F.lit(0)).alias("taken"))


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    picked = mix_sources(docs, seed, with_doc=True).filter("taken > 0")
    return picked.select("doc", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select("doc.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
