"""Order MinHash fingerprints: minimal occurrence-numbered k-mers, kept in text order.

Method: the words of a text give k-mers of ``k`` words (a shorter text is one k-mer of all its words). The i-th
time a k-mer comes it is numbered i, so every numbered k-mer is unique. Each of ``m`` independent hash functions draws
two minimal numbered k-mers: its hashes part the k-mers at random in two classes, and the smallest of either class is
drawn (from the one class where the other is empty). The two are put back into text order and the tuple of their hashes
gives one value of the signature. Two signatures are compared place by place: likeness is the share of places that agree.
A place agrees only if both k-mers are shared and keep their order, so moving or replacing a passage changes the
signature with the edit distance, not just with the set of k-mers. Words are cut at ASCII blanks; a text without words
has the empty fingerprint.

Scale: DataFrame functions only. Documents go to ranges of doc_id of about ``range_bytes`` by one shuffle; rows of one
doc_id that fills several ranges are dealt by a hash of their text. Each range gets the first document of the range
after it as a guest, and a window looks one row ahead. K-mers are exploded within the range and the minima are plain
long aggregates in generated code without another shuffle. The table of ranges is at most ``most_ranges`` rows.

Defined results: a null text is the empty text; documents of the same doc_id follow each other in order of a hash of
their text; null doc_ids come last; after the last comes the first; a single document follows itself; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, read, words_of

K, SIZE = 3, 40
PLACE_BITS = 30  # a text of two gigabytes has fewer words


def numbered_mers(text: Column, k: int = K) -> Column:
    """array<struct<h, at>>: the hash of each numbered k-mer of a text, and its place."""

    def numbered(h: Column) -> Column:
        n = F.size(h)
        plain = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))

        def counted(s: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i)["h"] != F.get(s, i - 1)["h"]))
            times = let(starts, lambda f: F.flatten(F.transform(f, lambda a, i: F.sequence(F.lit(0), F.coalesce(F.get(f, i + 1), n) - a - 1))))
            return F.zip_with(s, times, lambda x, t: F.struct(F.when(t == 0, x["h"]).otherwise(F.xxhash64(x["h"], t)).alias("h"), x["at"].alias("at")))

        return F.when(F.size(F.array_distinct(h)) == n, plain).otherwise(let(F.sort_array(plain), counted))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        mers = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)])), F.lit(1), n - (k - 1))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64(w))).otherwise(mers)

    return let(let(words_of(text), of_words), numbered)


def signatures(texts: DataFrame, keys: list[str], text: str = "text", m: int = SIZE, k: int = K) -> DataFrame:
    """keys and signature (array<int> of m values, empty for a text without words) of rows with distinct keys."""
    mers = texts.select(*keys, F.explode_outer(numbered_mers(F.col(text), k)).alias("x")).select(*keys, F.col("x.h").alias("_h"), F.col("x.at").cast("long").alias("_at"))
    # hash above place in one long: the smallest negative and the smallest other long are the smallest of two classes
    low = (1 << PLACE_BITS) - 1
    draw = "((xxhash64(_h, {j}) & {keep}L) | _at)"
    flip = -(1 << 63)
    least = [F.expr(f"min({x}) AS _a{j}") for j in range(m) for x in [draw.format(j=j, keep=-1 - low)]]
    other = [F.expr(f"min({x} ^ ({flip + 1}L - 1L)) AS _b{j}") for j in range(m) for x in [draw.format(j=j, keep=-1 - low)]]
    drawn = mers.groupBy(*keys).agg(*least, *other)
    values = []
    for j in range(m):
        a, b = f"_a{j}", f"(_b{j} ^ ({flip + 1}L - 1L))"
        ha, hb = f"shiftright({a}, {PLACE_BITS})", f"shiftright({b}, {PLACE_BITS})"
        values.append(f"CAST((CASE WHEN ({a} & {low}L) <= ({b} & {low}L) THEN xxhash64({ha}, {hb}) ELSE xxhash64({hb}, {ha}) END) & 2147483647L AS INT)")
    return drawn.selectExpr(*[f"`{x}`" for x in keys], f"CASE WHEN _a0 IS NULL THEN CAST(array() AS ARRAY<INT>) ELSE array({', '.join(values)}) END AS signature")


def fingerprint(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the places at which two signatures agree; 1 for two empty ones, 0 for an empty one and another."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(same / F.greatest(F.size(a), F.size(b), F.lit(1)))


def fingerprints(docs: DataFrame, **params) -> DataFrame:
    """doc_id and signature of each row of docs."""
    return signatures(docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), "text"), ["doc_id", "_row"], **params).drop("_row")


def _below(bounds: Column, n: int, fits) -> Column:
    """How many of n sorted bounds fit (those that do come first), by bisection."""
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= n) & F.coalesce(fits(F.get(bounds, at + step - 1)), F.lit(False)), at + step).otherwise(at))


def with_next(docs: DataFrame, range_bytes: int = 1 << 23, most_ranges: int = 1 << 20) -> DataFrame:
    """docs (doc_id, text) in ranges: range, place, guest, doc_id, text, next_text; a guest only lends its text."""
    size = docs.agg(F.sum(F.octet_length("text") + F.lit(16)).alias("bytes"), F.count("*").alias("n"), F.count("doc_id").alias("told")).head()
    ranges = max(1, min(most_ranges, (size.bytes or 0) // range_bytes))
    of_null = -(-ranges * (size.n - size.told) // max(size.n, 1)) if size.n > size.told else 0
    bounds = []
    if ranges > 1 and size.told:
        bounds = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], min(10 * ranges, 1 << 20)).alias("b")).head().b
    own = docs.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    share = F.col("tie") / F.lit(float(1 << 63))
    known = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    n = len(bounds)
    under, upto = _below(known, n, lambda b: b < F.col("doc_id")), _below(known, n, lambda b: b <= F.col("doc_id"))
    deal = lambda first, parts: first + F.least(F.floor(share * parts).cast("int"), F.greatest(parts - 1, F.lit(0)))
    place = F.when(F.col("doc_id").isNull(), deal(F.lit(n + 1), F.lit(of_null))).otherwise(let(F.struct(under.alias("a"), upto.alias("b")), lambda x: deal(x["a"], x["b"] - x["a"])))
    own = own.withColumn("range", place)
    # The first row of each range is the guest of the range before it; that of the first is the guest of the last.
    heads = own.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("head"))
    to = heads.selectExpr("range AS first", "head.doc_id AS head_id", "head.tie AS head_tie", "coalesce(lag(range) OVER (ORDER BY range), max(range) OVER ()) AS host")
    to = materialize(to, "heads")
    guest = own.join(to, (F.col("range") == F.col("first")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")))
    both = own.select("range", F.lit(0).alias("guest"), "doc_id", "tie", "text").unionByName(guest.select(F.col("host").alias("range"), F.lit(1).alias("guest"), "doc_id", "tie", "text"))
    order = "(PARTITION BY range ORDER BY guest, doc_id NULLS LAST, tie, text)"
    return both.selectExpr("range", f"row_number() OVER {order} AS place", "guest", "doc_id", "text", f"lead(text) OVER {order} AS next_text")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return edited_fingerprints(docs)


def edited_fingerprints(docs: DataFrame, **ranges) -> DataFrame:
    """Of docs (doc_id, text): the fingerprints of each text and of the text whose second half the next one replaces."""
    rows = with_next(docs, **ranges)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = rows.select("range", "place", "guest", "doc_id", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.when(F.col("guest") == 0, edited).alias("t")))).alias("x"))
    both = both.select("range", "place", "guest", "doc_id", "x.kind", F.col("x.t").alias("text")).filter("guest + kind < 2")
    # what is to be known of a text besides its signature goes along as a key
    both = both.withColumn("fact", F.when(F.col("kind") == 0, F.length("text").cast("string")).otherwise(F.sha2("text", 256)))
    signed = signatures(both, ["range", "place", "guest", "doc_id", "kind", "fact"])
    order = "(PARTITION BY range ORDER BY place, kind)"  # a text, its edited text, the next text
    ahead = signed.selectExpr("*", f"lead(fact, 1) OVER {order} AS sha", f"lead(signature, 1) OVER {order} AS edited", f"lead(signature, 2) OVER {order} AS next").filter("guest = 0 AND kind = 0")
    return ahead.select(
        "doc_id",
        F.col("fact").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        fingerprint(F.col("signature")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next")).alias("near_next"),
    )
