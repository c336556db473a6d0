"""Quality classifier from weak labels: EM over heuristic labellers, then a hashed linear scorer.

Method: eight heuristic labellers vote good, bad or abstain on every text. A document's votes are one of 3**8
patterns; patterns are counted over all documents, and expectation-maximisation on the counts estimates the shares of
good texts and of several kinds of bad ones and each labeller's vote probabilities given each of these classes, from
overlaps alone (no given labels). What overlaps cannot tell apart, texts that one labeller alone condemns, a prior
decides: that a labeller condemns one good text in a hundred (``false_rate``), worth ``worth`` votes however many are cast. The
posterior of its pattern is the soft label on which a logistic scorer over hashed words and binned statistics is
trained, on a bounded sample: by a hash of the content, so whatever the files are cut to, ``most_rows`` rows of at most
``most_words`` words each and ``most_chars`` characters together.

Scale: two narrow passes over the texts in Arrow batches; what is aggregated is at most 6,561 counts, what is broadcast
a weight vector of ``BUCKETS`` floats. Nothing else is shuffled or collected.

Defined results: a null or blank text votes as an empty one; null doc_ids and repeated rows are scored like others; an
empty table gives no rows; without documents on both sides the scorer returns the prior; other columns pass
through ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import content_id, read

BUCKETS = 1 << 16
SYMBOLS = b"#*$%&|<>"
LABELLERS = ("length", "symbols", "variety", "lines", "capitals", "word_length", "stutter", "endings")
ABSTAIN, GOOD, BAD = 0, 1, 2
N_PATTERNS = 3 ** len(LABELLERS)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        i = self[word] = crc32(word) % BUCKETS
        return i


_IDS = _Ids()


def statistics(text: str | None) -> tuple[list[bytes], tuple[float, ...]]:
    """The words, and: their number, and the shares of symbols, distinct words, repeated lines, capital letters,
    mean word length, words equal to the one before, lines that end a sentence."""
    raw = (text or "").encode()
    words = raw.split()
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    low = raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    letters = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    some = max(n, 1)
    return words, (
        n,
        (len(raw) - len(raw.translate(None, SYMBOLS))) / max(chars, 1),
        len(set(words)) / some,
        1 - len(set(lines)) / max(len(lines), 1),
        (len(raw) - len(low)) / max(letters, 1),
        len(b"".join(words).decode(errors="replace")) / some,
        sum(map(bytes.__eq__, words, words[1:])) / some,
        sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in lines) / max(len(lines), 1),
    )


def votes(s: tuple[float, ...]) -> int:
    """The pattern: a base-3 number, a digit for each labeller."""
    n, symbols, variety, lines, capitals, length, stutter, endings = s
    enough = n >= 20
    fires = (n < 5, symbols > 0.02, variety < 0.2, lines > 0.34, capitals > 0.4, not 2.5 <= length <= 11, stutter > 0.1, endings < 0.2)
    told = (True, n > 0, enough, n > 0, n > 0, n > 0, enough, enough)
    cast = (BAD if f else GOOD if t else ABSTAIN for f, t in zip((f and t for f, t in zip(fires, told, strict=True)), told, strict=True))
    return sum(v * 3**i for i, v in enumerate(cast))


def features(words: list[bytes], s: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights: words by their share (all together one), and a bucket for the bin of each statistic."""
    ids = np.fromiter(map(_IDS.__getitem__, words), np.int64, len(words))
    bins = [int(4 * np.log2(1 + 63 * v)) if i else int(2 * np.log2(1 + v)) for i, v in enumerate(s)]
    extra = np.array([crc32(f"{k}={b}".encode()) % BUCKETS for k, b in zip(LABELLERS, bins, strict=True)], np.int64)
    return np.concatenate([ids, extra]), np.concatenate([np.full(len(ids), 1 / max(len(ids), 1)), np.ones(len(extra))])


def learn_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, false_rate: float = 0.01, worth: float = 100.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior of good, vote probabilities [labeller, class (good, bad), vote] of those who vote, posterior of good by pattern given.

    Latent classes: good texts, and a kind of bad text for each labeller, which begins as the texts that it condemns. Votes are
    independent given the class. Probabilities of bad are those of all kinds together.
    """
    n = len(LABELLERS)
    cast = (patterns[:, None] // 3 ** np.arange(n)) % 3
    blamed = (cast == BAD).astype(float)
    some = blamed.sum(axis=1, keepdims=True)
    post = np.where(some > 0, np.concatenate([np.full_like(some, 0.1), 0.9 * blamed / np.maximum(some, 1)], axis=1), np.eye(1, n + 1))
    for _ in range(rounds):
        soft = post * counts[:, None]
        share = soft.sum(axis=0) + np.array([float(n)] + [1.0] * n)  # of nothing known, good and bad are as likely
        prob = np.empty((n, n + 1, 3))
        for v in (GOOD, BAD):
            prob[:, :, v] = np.einsum("pj,pk->jk", (cast == v).astype(float), soft) + 0.5
        prob[:, 0, BAD] += worth * false_rate
        prob[:, 0, GOOD] += worth * (1 - false_rate)
        prob[:, :, 1:] /= prob[:, :, 1:].sum(axis=2, keepdims=True)
        prob[:, :, ABSTAIN] = 1.0  # says nothing of any class
        logs = np.log(prob)[np.arange(n)[None, :], :, cast].sum(axis=1) + np.log(share / share.sum())
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
    bad = share[1:] / share[1:].sum()
    two = np.stack([prob[:, 0, :], np.einsum("jkv,k->jv", prob[:, 1:, :], bad)], axis=1)
    return float(share[0] / share.sum()), two, post[:, 0]


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, epochs: int = 6, rate: float = 0.3, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and shift of a logistic scorer, by Adagrad on soft labels."""
    w, g2, shift = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3), 0.0
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in r.permutation(len(rows)):
            ids, x = rows[i]
            d = 1 / (1 + np.exp(-(w[ids] @ x + shift))) - soft[i]
            g = d * x
            np.add.at(g2, ids, g * g)
            np.add.at(w, ids, -rate * g / np.sqrt(g2[ids]))
            shift -= 0.02 * d
    return w, shift


def _voter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found, counts = np.unique([votes(statistics(t)[1]) for t in b.column(0).to_pylist()], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts.astype(np.int64))], names=["pattern", "n"])


def _sampler(most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(p, votes(s), *features(words, s)) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for words, s in [statistics(t)] if len(words) <= most_words]
            cols = list(zip(*got, strict=True)) if got else [[], [], [], []]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["place", "pattern", "ids", "x"])

    return run


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, shift, posterior = model.value
        for b in batches:
            pattern, score = [], []
            for t in b.column(1).to_pylist():
                words, s = statistics(t)
                ids, x = features(words, s)
                pattern.append(votes(s))
                score.append(float(1 / (1 + np.exp(-(w[ids] @ x + shift)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pattern, pa.int32()), pa.array(posterior[pattern] if pattern else [], pa.float64()), pa.array(score, pa.float64())], names=["row", "pattern", "posterior", "score"])

    return run


def score_quality(docs: DataFrame, most_rows: int = 4096, most_words: int = 16384, most_chars: int = 1 << 25, key: str = "doc_id") -> DataFrame:
    """row (of type long, from key), pattern, posterior and score (probability of good) of each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    counted = docs.select("text").mapInArrow(_voter, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns, counts = np.array([r.pattern for r in counted], np.int64), np.array([r.n for r in counted], np.float64)
    posterior = np.full(N_PATTERNS, 0.5)
    if len(patterns):
        posterior[patterns] = learn_labellers(patterns, counts)[2]
    drawn = docs.select(content_id().alias("place"), "text").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    edge, held = None, 0
    for r in drawn.filter(F.col("n") <= 64 * most_words).select("place", "n").orderBy("place").limit(most_rows).collect():
        held += r.n
        if held > most_chars:
            break
        edge = r.place
    fitting = drawn.filter((F.col("n") <= 64 * most_words) & (F.col("place") <= (edge if edge is not None else -(1 << 63)))).limit(most_rows)
    got = fitting.select("place", "text").mapInArrow(_sampler(most_words), "place long, pattern int, ids array<long>, x array<double>").toPandas().sort_values("place", kind="stable")
    rows = [(np.asarray(i), np.asarray(x)) for i, x in zip(got.ids, got.x, strict=True)]
    w, shift = train_scorer(rows, posterior[got.pattern.to_numpy(int)])
    model = spark.sparkContext.broadcast((w, shift, posterior))
    return docs.select(F.col(key).cast("long").alias("row"), "text").mapInArrow(_scorer(model), "row long, pattern int, posterior double, score double")


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, that score at least this much."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), content_id().alias("_row"), "doc_id", "text")
    good = score_quality(keyed, key="_row").filter(F.col("score") >= least).select(F.col("row").alias("_row")).distinct()
    return keyed.select("doc", "_row").join(good, "_row", "left_semi").select("doc.*")


def op4_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select(F.col("row").alias("doc_id"), F.col("pattern").cast("long").alias("votes"), "posterior", "score", (F.col("score") >= 0.5).alias("kept"))
