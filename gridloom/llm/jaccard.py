"""N-gram Jaccard join: a size-aware heavy-light join of word-shingle sets, down to components.

Method. Two sets link when 100 * intersection >= 75 * union, so a set of n shingles shares at least
ceil(0.75 n) with any partner, and under one global order of shingles two partners share one of their first
``n - ceil(0.75 n) + 1`` shingles and two of their first one more. Small sets enumerate all 2-subsets of that longer
prefix and meet partners in them; large sets scan the inverted lists of the single shingles of the shorter one. The
boundary between small and large is the size at which the measured scan steps begin to cost less than the subsets;
sets just below it are in both. The global order puts shingles that many documents share (passages, boilerplate)
last, so their lists are scanned only for texts that consist of them.

Dense groups. A large group of near copies has quadratically many links, but components need only some of them. First
every set is compared with one partner per list (two rounds of leaders: the best by a 1024-bit parity sketch that bounds the
symmetric difference from below), and links found join sets into components. Then the exact step compares every pair that
shares a list entry and is not joined yet: its join tests size and sketch inside the join, so pairs inside a component
are never made; one of two bits a shingle then leaves few pairs that do not link; the likeliest pair of each node is verified
first, then all others whose nodes these did not join. No pair of sets that links is left out: it is either compared, or its ends are already joined.

Scale: texts are read by three narrow passes; only 64-bit keys are shuffled, not texts. Exact copies are one node.
Lists with a single node are dropped by a map-side combined count before anything is joined. What is broadcast is
bounded: the order of at most ``2**18`` frequent shingles and a bitmap of ``2**22`` bits. Rows, sets and nodes are named by
64-bit hashes of their content, so any input may be read again in another order. Nothing is collected.

Defined results: a null or blank text has no shingles and links with nothing; a text of fewer than five words is one
shingle; null doc_ids take part and only count where no other doc_id is in their component; repeated rows are
copies; an empty table gives no rows; other columns are ignored by the join and kept by ``keep_one``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import content_id, discard, materialize, read, release
from .components import components, extended

WIDTH = 5
SKETCH_WORDS = 16
MIN_WIDE, MAX_WIDE = 32, 4096
BITMAP_BITS = 22
LARGEST_SMALL = 64  # beyond this size subsets of a prefix are always more than scan steps
POSTING_COST = 8  # of shuffling a posting, in scan steps

_ODD = (np.frombuffer(b"".join(xxhash.xxh3_64_digest(bytes([i])) for i in range(WIDTH)), dtype=">u8").astype(np.uint64)) | np.uint64(1)


BLOCK = 1 << 16  # bytes of text hashed at once, more where a word is longer
_STEP = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided by
_OF_BYTE = np.frombuffer(b"".join(xxhash.xxh3_64_digest(bytes([i]), seed=1) for i in range(256)), dtype=">u8").astype(np.uint64)
_IS_BLANK = np.isin(np.arange(256), [*b" \t\n\x0b\x0c\r"])
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _STEP, np.uint64)), np.cumprod(np.full(n, pow(_STEP, -1, 1 << 64), np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words_in(block: bytes) -> np.ndarray:
    """Hashes of the words of a block in order: differences of one running polynomial sum, divided by their place."""
    b = np.frombuffer(block, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_IS_BLANK[b]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1
    up, down = _powers(max(BLOCK, 1 << (len(b) - 1).bit_length()))
    value = _OF_BYTE[b] * up[: len(b)]
    run = np.cumsum(value)
    return _mix((run[end] - run[start] + value[start]) * down[start])


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of a text in order (A-Z lower-cased, cut at ASCII blanks)."""
    data = (text or "").encode().lower()
    out, at = [], 0
    while at < len(data):
        cut = len(data)
        if cut - at > BLOCK:
            found = _BLANK.search(data, at + BLOCK // 2)
            cut = found.end() if found else cut
        out.append(_words_in(data[at:cut]))
        at = cut
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _distinct(h: np.ndarray) -> np.ndarray:
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(WIDTH, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h += w[k : len(w) - n + 1 + k] * _ODD[k]
    return _distinct(_mix(h))


def _least(n: int) -> int:
    """The fewest shingles a set of n shares with a partner."""
    return -(-3 * n // 4)


def ordered(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order: by hash, then the frequent ones by their number of documents."""
    if not len(frequent):
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    hit = frequent[at] == s
    if not hit.any():
        return s
    return np.concatenate([s[~hit], s[hit][np.argsort(rank[at[hit]], kind="stable")]])


def parities(s: np.ndarray, words: int) -> np.ndarray:
    """Of each of 64 * words slots whether an odd number of shingles fall in it. What two sets share cancels out of the
    slots in which they differ, so these are at most as many as the shingles that only one of them has. The halves of a
    sketch, xored, are the sketch of half the words."""
    slots = (s & np.uint64(64 * words - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=64 * words) & 1).astype(bool)).view(np.int64)


def wide_words(n: int) -> int:
    """Words of the wide sketch of a set of n: two to four slots a shingle, within bounds."""
    return min(max(MIN_WIDE, 1 << (n >> 5).bit_length()), MAX_WIDE)


def keys_of(s: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set in the global order, and the place in the set of each (of the first of two)."""
    n = len(s)
    if n < 3:  # partners would be equal sets, which are one node
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    single = n - _least(n) + 1
    keys, places = [], []
    if n <= boundary:
        i, j = np.triu_indices(min(n, single + 1), 1)
        keys.append(_mix(s[i] * _ODD[0] + s[j] * _ODD[0] + np.uint64(2)))  # the same whichever comes first
        places.append(i)
    if n >= _least(boundary + 1):
        keys.append(s[:single])
        places.append(np.arange(single))
    return (np.concatenate(keys), np.concatenate(places)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _statistics(block: int = 1 << 22, least: int = 4):
    """Per block of shingles: (0, shingle, documents) of those in several, and (1, size, sets, scan steps) of small sets."""

    def emit(sets: list[np.ndarray]) -> pa.RecordBatch:
        h, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= least
        rows = [np.zeros(often.sum(), np.int64), _signed(h[often]), counts[often], np.zeros(often.sum(), np.int64)]
        small: dict[int, list[int]] = {}
        for s in sets:
            if 3 <= len(s) <= LARGEST_SMALL:
                got = small.setdefault(len(s), [0, 0])
                got[0] += 1
                got[1] += int(np.sort(counts[np.searchsorted(h, s)])[: len(s) - _least(len(s)) + 1].sum())
        extra = np.array([(1, n, a, b) for n, (a, b) in small.items()], np.int64).reshape(-1, 4).T
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])) for a, b in zip(rows, extra, strict=True)], names=["kind", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingles(text)
                name = xxhash.xxh3_64_intdigest(s.tobytes())
                if len(s) and name not in sets:
                    sets[name] = s
                    held += len(s)
                    if held >= block:
                        yield emit(list(sets.values()))
                        sets, held = {}, 0
        if sets:
            yield emit(list(sets.values()))

    return run


def global_order(texts: DataFrame, least: int = 1000, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent shingles (sorted, with their rank by documents; it orders, never drops), and the boundary."""
    stats = materialize(texts.mapInArrow(_statistics(), "kind long, a long, b long, c long").groupBy("kind", "a").agg(F.sum("b").alias("b"), F.sum("c").alias("c")), "order")
    top = stats.filter((F.col("kind") == 0) & (F.col("b") >= least)).orderBy(F.desc("b"), "a").limit(most).collect()
    h = np.array([r.a for r in top], np.int64).view(np.uint64)
    by = np.argsort(h, kind="stable")
    rank = np.empty(len(h), np.int64)
    rank[:] = len(h) - 1 - by  # the most frequent last
    boundary = 2
    for r in sorted(stats.filter("kind = 1").collect(), key=lambda r: r.a):  # at most LARGEST_SMALL rows
        single = r.a - _least(r.a) + 1
        if comb(min(r.a, single + 1), 2) * POSTING_COST * r.b > single * POSTING_COST * r.b + r.c:
            break
        boundary = r.a
    return h[by], rank, boundary


SETS = "row long, doc_id long, node long, n long, keys array<long>, places array<int>, sketch array<long>, wide array<long>"


def _lister(order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank, boundary = order.value
        for batch in batches:
            nodes, sizes, sketches, wides, lengths, keys, places = [], [], [], [], [0], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text)
                k, p = keys_of(ordered(s, frequent, rank), boundary)
                wides.append(parities(s, wide_words(len(s))))
                nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                sizes.append(len(s))
                sketches.append(parities(s, SKETCH_WORDS))
                lengths.append(lengths[-1] + len(k))
                keys.append(k)
                places.append(p)
            flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values)
            each = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(flat(x, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists(pa.array(_signed(flat(keys, np.uint64)))), lists(pa.array(flat(places, np.int32))), each(sketches), each(wides)],
                names=["row", "doc_id", "node", "n", "keys", "places", "sketch", "wide"],
            )

    return run


def _setter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and items of texts; repeated rows once a task."""
    done: set[int] = set()
    for batch in batches:
        named = {}
        for t in batch.column(0).to_pylist():
            s = shingles(t)
            name = xxhash.xxh3_64_intdigest(s.tobytes())
            if len(s) and name not in done:
                named[name] = s
        done.update(named)
        if named:
            sets = list(named.values())
            ends = np.cumsum([0, *map(len, sets)])
            nodes = np.array(list(named), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(nodes)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(np.concatenate(sets))))], names=["node", "items"])


def _slot(row: Column) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(1 << BITMAP_BITS))


def with_row(docs: DataFrame) -> DataFrame:
    return docs.select(content_id().alias("row"), "doc_id", "text")


def _sketch_columns(side: str) -> list[Column]:
    return [F.col("sketch")[i].alias(f"{side}{i}") for i in range(SKETCH_WORDS)]


def _possible() -> Column:
    """By sizes an, bn and sketches: can a and b link? (The sketches' difference bounds the sets' from below.)"""
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    return (4 * F.least("an", "bn") >= 3 * F.greatest("an", "bn")) & (7 * apart <= F.col("an") + F.col("bn"))


def _folded(x: str, y: str) -> Column:
    """The wide sketch x at the width of y, if y is narrower (by half at most, as the sizes are near)."""
    half = F.shiftright(F.size(x), 1)
    return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(x))


class Join:
    """One run of the join; the steps share the written tables."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        ship(self.spark)
        self.rows = with_row(docs)
        order = self.spark.sparkContext.broadcast(global_order(docs.select("text")))
        self.sets = materialize(self.rows.mapInArrow(_lister(order), SETS), "sets")
        self.reps = self.sets.filter("n > 0").groupBy("node").agg(F.min("row").alias("row"))
        exploded = self.sets.select("node", "n", F.posexplode("keys").alias("i", "key"), "places").select("key", "node", F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("places")[F.col("i")]).alias("np"))
        shared = exploded.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
        self.lists = materialize(exploded.join(shared, "key", "left_semi").distinct(), "lists")
        del exploded, shared
        release(self.spark)
        self.nodes = materialize(self.sets.select("node", "n", "sketch", "wide").join(self.lists.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "nodes")
        slim = materialize(self.sets.select("row", "doc_id", "node", "n"), "rows")
        reps = materialize(self.reps, "reps")  # both no longer need the keys
        discard(self.sets)
        self.sets, self.reps = slim, reps
        release(self.spark)
        self.labels = None

    def side(self, name: str, of: DataFrame) -> DataFrame:
        return of.select(F.col("node").alias(name), F.col("n").alias(f"{name}n"), *_sketch_columns(name))

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) that can link."""
        return pairs.join(self.side("a", self.nodes), "a").join(self.side("b", self.nodes), "b").filter(_possible())

    def verified(self, pairs: DataFrame, keep_pairs: bool = False, parts: int = 1) -> DataFrame:
        """Those of the distinct pairs (a, b, an, bn) that link, by their whole sets, as edges (u, v)."""
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(self.reps, "node")
        slots = wanted.select(_slot(F.col("row")).alias("s"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(63).cast("int"))
        bits = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(bit).alias("bits"))  # 2**(BITMAP_BITS - 6) rows at most
        read = self.rows.withColumn("s", _slot(F.col("row"))).withColumn("w", F.shiftright("s", 6))
        hit = read.join(F.broadcast(bits), "w").filter(F.col("bits").bitwiseAND(bit) != 0)
        sets = materialize(hit.select("text").mapInArrow(_setter, "node long, items array<long>"), "items")
        edges = None
        for part in range(parts):  # in turn, so that only a part of the sets is on disk beside their pairs
            mine = pairs.select("a", "b", "an", "bn").filter(F.pmod(F.xxhash64("a"), F.lit(parts)) == part)
            both = mine.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
            linked = both.filter(7 * F.size(F.array_intersect("x", "y")) >= 3 * (F.col("an") + F.col("bn")))
            found = materialize(linked.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
            edges = found if edges is None else edges.unionByName(found)
            del mine, both, linked
            release(self.spark)
        discard(sets, *([] if keep_pairs else [pairs]))
        return edges

    def labelled(self) -> DataFrame:
        """lists with the label of each node (the node itself until it is joined)."""
        if self.labels is None:
            return self.lists.withColumn("label", F.col("node"))
        return self.lists.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def add(self, edges: DataFrame) -> None:
        if self.labels is not None and edges.isEmpty():
            return
        self.labels = materialize(components(edges) if self.labels is None else extended(self.labels, edges), "labels")

    def lead(self, seed: int) -> None:
        """Compare each node with the likeliest of the four leaders it shares most keys with, where not yet joined."""
        of = self.labelled()
        draw = F.xxhash64(F.lit(seed), "node")
        leader = of.groupBy("key").agg(F.min_by(F.struct("node", "label"), draw).alias("to"))
        pairs = of.join(leader, "key").filter(F.col("label") != F.col("to.label")).select(F.col("node").alias("a"), F.col("to.node").alias("b"))
        shared = pairs.repartition("a").groupBy("a", "b").agg(F.count("*").alias("k"))  # one shuffle; a node has no more keys than its text
        most = shared.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "b")), False), 1, 4).alias("to"))
        near = self.sketched(most.select("a", F.explode("to.b").alias("b")))
        apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
        best = near.groupBy("a").agg(F.min_by(F.struct("b", "an", "bn"), F.struct(apart / (F.col("an") + F.col("bn")), "b")).alias("x"))
        self.add(self.verified(materialize(best.select("a", "x.*"), "pairs")))

    def finish(self) -> None:
        """Compare all pairs that share a key and are not joined yet."""
        of = materialize(self.labelled().withColumn("n", F.shiftright("np", 32)), "labelled")
        parts = of.groupBy("key", "label").agg(F.count("*").alias("k"))
        main = parts.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1").select("key", "main")
        mixed = materialize(of.join(main, "key").join(self.nodes.drop("n", "wide"), "node"), "mixed")
        cols = lambda s: [F.col("key"), F.col("node").alias(s), F.col("label").alias(f"{s}l"), F.col("n").alias(f"{s}n"), F.col("np").bitwiseAND((1 << 32) - 1).alias(f"{s}p"), (F.col("label") == F.col("main")).alias(f"{s}m"), *_sketch_columns(s)]
        a = mixed.filter("label <> main").select(*cols("a"))
        b = mixed.select(*cols("b"))
        # Of two nodes outside the main component each pair is taken once. The first key that two sets share, in the global
        # order, has nothing shared before it, so what follows it in both must suffice; other keys need not yield the pair.
        once = F.col("bm") | (F.col("a") < F.col("b"))
        rest = F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp"))
        pairs = a.join(b, "key").filter((F.col("al") != F.col("bl")) & once & _possible() & (7 * rest >= 3 * (F.col("an") + F.col("bn"))))
        pairs = materialize(pairs.select("a", "b", "an", "bn", "al", "bl").distinct(), "pairs")
        discard(of, mixed)
        # A wider sketch leaves few pairs that do not link.
        wide = self.nodes.select("node", "wide")
        both = pairs.join(wide.select(F.col("node").alias("a"), F.col("wide").alias("x")), "a").join(wide.select(F.col("node").alias("b"), F.col("wide").alias("y")), "b")
        apart = F.aggregate(F.zip_with(_folded("x", "y"), _folded("y", "x"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
        likely = materialize(both.select("a", "b", "an", "bn", "al", "bl", (apart / (F.col("an") + F.col("bn"))).alias("apart")).filter("7 * apart <= 1").drop("al", "bl"), "likely")
        discard(pairs)
        del a, b, both, pairs, mixed, of
        release(self.spark)
        # The likeliest pair of each node first: what these join needs no further look.
        best = likely.groupBy("a").agg(F.min_by(F.struct("b", "an", "bn"), F.struct("apart", "b")).alias("x")).select("a", "x.*")
        best = materialize(best, "pairs")
        left = likely.join(best.select("a", "b"), ["a", "b"], "left_anti")
        self.add(self.verified(best, keep_pairs=True))
        left = materialize(self.apart(left), "likely")
        # In as many parts as it takes for each to carry no more than half of all sets, twelve at most (each is a round of jobs).
        carried = left.agg(F.sum("an")).head()[0] or 0
        half = (self.sets.agg(F.sum("n")).head()[0] or 0) // 2
        self.add(self.verified(left, parts=max(1, min(12, -(-carried // max(1, half))))))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b, ...) whose nodes are in different components."""
        named = lambda s: self.labels.select(F.col("node").alias(s), F.col("label").alias(f"{s}l"))
        return pairs.join(named("a"), "a", "left").join(named("b"), "b", "left").filter(F.coalesce("al", "a") != F.coalesce("bl", "b")).select(*pairs.columns)

    def result(self) -> DataFrame:
        """row, doc_id, n, label: of every row; label is a node, or null for texts without words."""
        named = self.sets.select("row", "doc_id", "node", "n").join(self.labels, "node", "left")
        return named.select("row", "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))


def joined(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """row, doc_id, n, label of each row of docs (doc_id, text)."""
    run = Join(docs)
    for seed in range(rounds):
        run.lead(seed)
    run.finish()
    return materialize(run.result(), "joined")


def _component_key() -> Column:
    return F.coalesce(F.concat(F.lit("n"), F.col("label")), F.concat(F.lit("r"), F.col("row")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    rows = joined(docs).withColumn("c", _component_key())
    least = rows.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k"))
    # Components with many rows, 2**14 at most, are broadcast; their rows are dealt by themselves in the join of the others.
    many = max(100, rows.count() >> 14)
    large = materialize(least.filter(F.col("k") >= many).select("c", F.col("component_id").alias("large"), F.lit(True).alias("is_large")), "large")
    dealt = rows.join(F.broadcast(large), "c", "left").withColumn("c", F.when(F.col("is_large"), F.concat(F.lit("l"), F.col("row"))).otherwise(F.col("c")))
    both = dealt.join(least.filter(F.col("k") < many).drop("k"), "c", "left")
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("is_large"), F.col("large")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component of docs the row with the smallest doc_id; texts without words all stay."""
    rows = joined(docs).withColumn("c", _component_key())
    first = rows.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("_row"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), content_id().alias("_row"))
    return own.join(first, "_row", "left_semi").dropDuplicates(["_row"]).select("doc.*")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
