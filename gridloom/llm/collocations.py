"""Phrases that occur more often than their parts suggest, by language.

N-grams are exploded into rows, hash-aggregated by language, joined with the counts of their first and last parts, scored in
Decimal, anti-joined with their one-word extensions and ranked by a window.

What is not frequent cannot be part of a frequent phrase. A first pass counts pairs under short names and keeps those of
`least` occurrences in a bit table of fixed size, the only kind of thing that is broadcast; a second one does so for longer
n-grams of which each pair is in the table. The third pass explodes single words and the n-grams that are in the tables, as
text. A wrong bit (two n-grams with one bit) only lets rows through that the exact count drops, so the result does not depend
on the tables' size. Rows are counted within a task before they leave it, under integers that stand for the words themselves.

Null texts count as empty, a null language is `und` (as is one of that name). Repeated rows count again, equal scores go by
count, then by phrase in the order of its UTF-8 bytes. Other columns are not looked at; an empty table gives no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shipping import ship
from .common import materialize, read

BLANKS, CUTS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"  # fixed values
WORD, BLANK, CUT = range(3)
BLOCK = 4 << 20  # bytes of text counted together before rows leave Python
FILTER_BITS = 1 << 27  # 16 MB
NAME_BITS = 40  # of a name while names are counted: a third less to shuffle than 64, and strangers rarely meet
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    kinds, lower = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    kinds[list(BLANKS)], kinds[list(CUTS)] = BLANK, CUT
    lower[ord("A") : ord("Z") + 1] += 32
    return kinds, lower


KINDS, LOWER = _kinds()


class Words:
    """The words of some texts in order: a number for each word with its language, and whether the next one is in its piece."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = KINDS[data]
        inside = kind == WORD
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edge[::2], edge[1::2]
        # the bytes of all words without what lies between them
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[inside].tobytes())])
        coded = joined.dictionary_encode()
        piece = np.cumsum(kind == CUT, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
        self.follows = piece[1:] == piece[:-1]
        names = pa.array(langs).dictionary_encode()
        doc_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
        lang = names.indices.to_numpy()[np.searchsorted(doc_starts, starts, "right") - 1].astype(np.int64)
        both = lang * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
        known, self.ids = np.unique(both, return_inverse=True)
        self.langs = names.dictionary.to_pylist()
        self.lang_of = known // max(len(coded.dictionary), 1)
        self.word_of = coded.dictionary.take(pa.array(known % max(len(coded.dictionary), 1)))

    def names(self) -> np.ndarray:
        """A 64-bit name of each word with its language, the same in every task."""
        import xxhash

        seeds = [xxhash.xxh3_64_intdigest(s.encode()) for s in self.langs]
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[k]) for w, k in zip(self.word_of.to_pylist(), self.lang_of.tolist(), strict=True)), np.uint64, len(self.lang_of))


def joined_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of n-grams from those of all but the last word and of the last word."""
    out = (left * _MIX) ^ (right + (left >> np.uint64(31)))
    out ^= out >> np.uint64(29)
    return out * _MIX


def grams(words: Words, max_n: int, likely: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, places and names of the n-grams of 2 to max_n words; with a bit table those of which every pair is in it."""
    own = words.names()[words.ids]
    linked = np.append(words.follows, False) if len(words.ids) else np.zeros(0, bool)
    at, names = np.arange(len(words.ids)), own
    for n in range(2, max_n + 1):
        names, at = names[linked[at + n - 2]], at[linked[at + n - 2]]
        if not len(at):
            return
        names = joined_names(names, own[at + n - 1])
        if n == 2 and likely is not None:
            known = contains(likely, names)
            linked[:] = False
            linked[at[known]] = True
            at, names = at[known], names[known]
        yield n, at, names


def contains(table: np.ndarray, names: np.ndarray) -> np.ndarray:
    place = (names >> np.uint64(64 - NAME_BITS)) & np.uint64(32 * len(table) - 1)
    return ((table[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & 1).astype(bool)


def texts_in_blocks(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[tuple[list[bytes], list[str]]]:
    """Rows (lang, text) in blocks of bytes; a longer text is cut after a sign that ends a piece."""
    texts, langs, held = [], [], 0
    for part in (batch.slice(low, 500) for batch in batches for low in range(0, batch.num_rows, 500)):
        for lang, text in zip(part.column(0).fill_null("und").to_pylist(), part.column(1).cast(pa.binary()).fill_null(b"").to_pylist(), strict=True):
            for piece in _parts(text, block):
                texts.append(piece)
                langs.append(lang)
                held += len(piece)
                if held >= block:
                    yield texts, langs
                    texts, langs, held = [], [], 0
    if texts:
        yield texts, langs


def _parts(text: bytes, block: int) -> Iterator[bytes]:
    low = 0
    while len(text) - low > block:
        cuts = np.flatnonzero(KINDS[np.frombuffer(text, np.uint8, offset=low + block)] == CUT)[:1]
        if not len(cuts):
            break
        high = low + block + int(cuts[0]) + 1
        yield text[low:high]
        low = high
    yield text[low:] if low else text


def _count(least_n: int, max_n: int, table=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in texts_in_blocks(batches):
            for n, _, names in grams(Words(texts, langs), max_n, table and table.value):
                if n >= least_n and len(names):
                    found, counts = np.unique(names >> np.uint64(64 - NAME_BITS), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["name", "n"])

    return run


def frequent_names(texts: DataFrame, count, least: int, bits: int) -> np.ndarray:
    """Bit table of the names that occur `least` times: of fixed size, so it may be brought to the driver and broadcast."""
    names = texts.mapInArrow(count, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    slot = F.shiftright(F.expr(f"name & {bits - 1}L"), 5)
    slots = names.groupBy(slot.alias("slot")).agg(F.expr("bit_or(shiftleft(1L, CAST(name & 31 AS INT)))").alias("bits"))
    out = np.zeros(bits // 32, np.uint32)
    rows = slots.toArrow()
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out


def _explode(table, max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in texts_in_blocks(batches):
            words = Words(texts, langs)
            if not len(words.ids):
                continue
            n_words = len(words.lang_of)
            counts = np.bincount(words.ids)
            total = np.bincount(words.lang_of, counts, len(words.langs)).astype(np.int64)
            yield _rows(words, words.lang_of, 1, words.word_of, counts)
            yield _rows(words, np.arange(len(words.langs)), 0, pa.array([b""] * len(words.langs), pa.large_binary()), total)
            gram, phrase = words.ids, words.word_of
            for n, at, names in grams(words, max_n, table.value):
                at = at[contains(table.value, names) & (gram[at] >= 0)]
                if not len(at):
                    break
                # an n-gram is the number of its first n - 1 words and its last word
                known, first, inverse, counts = np.unique(gram[at] * n_words + words.ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
                phrase = pc.binary_join_element_wise(phrase.take(pa.array(known // n_words)), words.word_of.take(pa.array(known % n_words)), pa.scalar(b" ", pa.large_binary()))
                yield _rows(words, words.lang_of[words.ids[at[first]]], n, phrase, counts)
                gram = np.full(len(words.ids), -1)
                gram[at] = inverse

    return run


def _rows(words: Words, lang: np.ndarray, n: int, phrase: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    names = pa.array(words.langs).take(pa.array(lang))
    return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(lang), n, np.int32)), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "words", "phrase", "f"])


def counted(docs: DataFrame, max_n: int, least: int, bits: int = FILTER_BITS) -> DataFrame:
    """lang, words, phrase, f: all phrases of 1 to max_n words that occur `least` times; the row of no words has the language's total."""
    texts = docs.select(F.col("lang").cast("string"), "text")
    send = docs.sparkSession.sparkContext.broadcast
    likely = frequent_names(texts, _count(2, 2), least, bits)
    if max_n > 2:
        likely |= frequent_names(texts, _count(3, max_n, send(likely)), least, bits)
    rows = texts.mapInArrow(_explode(send(likely), max_n), "lang string, words int, phrase string, f long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, scale: int = 2_000_000, contained: int = 80, top: int | None = 2000, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of docs (lang, text), each language's first `top` (None: all).

    A phrase of a occurrences, cut into parts of l and r, scores floor(scale * a / (l + r)) at the cut of least score, the
    first of equals. A phrase goes where one a word longer has `contained` percent of its occurrences; the same then holds
    for any longer one, as all between the two are at least as frequent as the longer.
    """
    ship(docs.sparkSession)
    known = materialize(counted(docs, max_n, least, bits), "phrase-counts")
    phrases = known.filter("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    # the longest extension of each phrase: both parts a word shorter of everything that is frequent
    longer = phrases.filter("words >= 3").select("lang", F.explode(F.array(_after(F.col("phrase"), F.lit(1)), _before(F.col("phrase"), F.col("words") - 1))).alias("phrase"), F.col("a").alias("wide"))
    widest = longer.groupBy("lang", "phrase").agg(F.max("wide").alias("wide"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    kept = phrases.alias("p").join(widest.alias("w"), (F.col("p.lang") == F.col("w.lang")) & (F.col("p.phrase") == F.col("w.phrase")) & (exact("wide") * 100 >= exact("a") * contained), "left_anti")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _before(F.col("phrase"), F.col("k")).alias("first"), _after(F.col("phrase"), F.col("k")).alias("rest"))
    part = lambda key, count: known.select("lang", F.col("phrase").alias(key), F.col("f").alias(count)).filter("words >= 1")
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.call_function("div", exact("a") * F.lit(scale).cast("decimal(19,0)"), exact("l") + exact("r"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    out = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if top is not None:  # within parts of a language first, so that no task sees more than `top` of each
        out = out.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        out = out.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "part")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        out = out.filter(F.col("rank") <= top)
    totals = known.filter("words = 0").select("lang", F.col("f").alias("n"))
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _before(phrase, k):
    return F.call_function("substring_index", phrase, F.lit(" "), k)


def _after(phrase, k):
    """What follows the first k words."""
    return F.substring(phrase, F.length(_before(phrase, k)) + 2, F.length(phrase))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLE_OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM p),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS v(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2 AND f >= 30),
x AS (SELECT lang, unnest([array_to_string(w[2:], ' '), array_to_string(w[:k - 1], ' ')]) AS phrase, a AS wide FROM c WHERE k >= 3),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * CAST(x.wide AS HUGEINT) >= 80 * CAST(c.a AS HUGEINT))),
s AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM kept),
j AS (SELECT s.lang, s.phrase, a, cut, l.f AS l, r.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
 FROM s JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(w[:cut], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM j) WHERE o = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""
