"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

Method: words hash to embeddings; filters one, two and three words wide run over them, each is max-pooled over the
whole text, and a logistic layer scores the pooled values. Embeddings, filters and layer are trained by Adagrad on a
bounded sample of labelled rows (``most_rows`` rows of at most ``most_words`` words and ``most_chars`` characters together, chosen by a hash of doc_id);
the first embedding coordinate starts at the word's log-odds in the training rows. A quarter of the sample is set
aside to choose a threshold for each language. The language is guessed from the text's own small words, so no column
but text enters a score. Scores are stretched so that each language's threshold lies at 0.7.

Scale: training data is bounded and the model is 8 MB, broadcast once. Scoring is one narrow pass in Arrow batches;
very long texts are run in blocks whose maxima are combined, so memory is bounded by the block. Nothing is shuffled.

Defined results: a null or blank text is scored like an empty one; a null doc_id is never labelled and not held out;
of repeated labels a toxic one counts; repeated rows get equal scores; without usable labels of both kinds every
score is the share of toxic labels (0 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import read

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
CUT = 0.7
#: Small words by which a language is guessed (fixed values).
SMALL_WORDS = {
    "en": ("the", "of", "and", "to", "that", "is", "was", "with", "this", "for"),
    "de": ("der", "die", "und", "das", "den", "nicht", "von", "mit", "ist", "sich"),
    "fr": ("le", "la", "et", "les", "des", "est", "que", "dans", "pour", "une"),
    "es": ("el", "los", "las", "del", "que", "por", "con", "una", "para", "esos"),
}
LANGUAGES = tuple(SMALL_WORDS)
_PAD = 0


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        i = self[word] = 1 + crc32(word.strip(b".,;:!?\"'()[]#*$%&|<>")) % (BUCKETS - 1)
        return i


_IDS = _Ids()
_LANGUAGE_OF = np.full(BUCKETS, len(LANGUAGES), np.int8)
for _i, _words in enumerate(SMALL_WORDS.values()):
    for _w in _words:
        _LANGUAGE_OF[_IDS[_w.encode()]] = _i


def word_ids(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    return np.fromiter(map(_IDS.__getitem__, words), np.int32, len(words))


def guess_language(ids: np.ndarray) -> int:
    """Index into LANGUAGES, or their number if no small word is there."""
    seen = np.bincount(_LANGUAGE_OF[ids], minlength=len(LANGUAGES) + 1)[:-1]
    return int(seen.argmax()) if seen.any() else len(LANGUAGES)


class Net:
    """Embeddings, filters by width and offset side by side, biases, and the logistic layer."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.emb = (r.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32)
        self.emb[_PAD] = 0
        self.filters = (r.standard_normal((DIM, FILTERS * sum(WIDTHS))) * 0.3).astype(np.float32)
        self.filters[0, :FILTERS] = 1.0
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = (r.standard_normal(FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
        self.out[:FILTERS] = 0.5
        self.shift = np.float32(-2.0)

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Rectified filter values at each position; none at padding."""
        m = self.emb[ids] @ self.filters
        out, at = np.empty((len(ids), len(self.bias)), np.float32), 0
        for k, w in enumerate(WIDTHS):
            part = out[:, k * FILTERS : (k + 1) * FILTERS]
            part[:] = m[:, at : at + FILTERS]
            for j in range(1, w):
                part[:-j] += m[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
        out += self.bias
        out[ids == _PAD] = 0  # a window that starts in the padding may reach the next text
        return np.maximum(out, 0, out=out)

    def pooled(self, texts: list[np.ndarray], block: int = 1 << 17) -> np.ndarray:
        pad = np.zeros(2, np.int32)
        flat = np.concatenate([p for t in texts for p in (t, pad)])
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
        best = np.zeros((len(texts), len(self.bias)), np.float32)
        for at in range(0, len(flat), block):
            ids = flat[at : at + block + 2]
            v = self.windows(ids)[:block]
            first = np.searchsorted(starts, at, side="right") - 1
            last = np.searchsorted(starts, at + len(v), side="left")
            cuts = np.maximum(starts[first:last] - at, 0)
            best[first:last] = np.maximum(best[first:last], np.maximum.reduceat(v, cuts, axis=0))
        return best

    def probability(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.pooled(texts) @ self.out + self.shift)))

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.05, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        toxic, total = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for t, y in zip(texts, labels, strict=True):
            u = np.unique(t)
            total[u] += 1
            toxic[u] += y
        share = labels.mean()
        odds = np.log((toxic + 4 * share) / (total - toxic + 4 * (1 - share)) * (1 - share) / share)
        self.emb[:, 0] = np.where(total >= 3, np.clip(odds, -2, 4), 0)
        weight = np.where(labels > 0, np.sqrt((1 - share) / share), 1.0).astype(np.float32)
        seen = {"emb": np.full((BUCKETS, DIM), 1e-3, np.float32), "filters": np.full_like(self.filters, 1e-3), "bias": np.full_like(self.bias, 1e-3), "out": np.full_like(self.out, 1e-3), "shift": np.float32(1e-3)}

        def step(name: str, grad, rows=None) -> None:
            value, g2 = getattr(self, name), seen[name]
            if rows is None:
                seen[name] = g2 = g2 + grad * grad
                setattr(self, name, value - np.float32(rate) * grad / np.sqrt(g2))
            else:
                g2[rows] += grad * grad
                value[rows] -= rate * grad / np.sqrt(g2[rows])

        pad = np.zeros(2, np.int32)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                flat = np.concatenate([p for i in some for p in (texts[i], pad)])
                starts = np.cumsum([0, *(len(texts[i]) + 2 for i in some)])
                v = self.windows(flat)
                top = np.stack([starts[k] + v[starts[k] : starts[k + 1]].argmax(axis=0) for k in range(len(some))])
                pooled = np.take_along_axis(v, top.reshape(-1, v.shape[1]), axis=0)
                p = 1 / (1 + np.exp(-(pooled @ self.out + self.shift)))
                d = ((p - labels[some]) * weight[some] / len(some)).astype(np.float32)
                back = d[:, None] * self.out * (pooled > 0)
                step("out", pooled.T @ d)
                step("shift", d.sum())
                step("bias", back.sum(axis=0))
                g_filters, rows, grads = np.zeros_like(self.filters), [], []
                col = 0
                for k, w in enumerate(WIDTHS):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        ids = flat[np.minimum(top[:, k * FILTERS : (k + 1) * FILTERS] + j, len(flat) - 1)]
                        e = self.emb[ids]
                        g_filters[:, col : col + FILTERS] = np.einsum("bfd,bf->df", e, g)
                        rows.append(ids.ravel())
                        grads.append((g[:, :, None] * self.filters[:, col : col + FILTERS].T[None]).reshape(-1, DIM))
                        col += FILTERS
                step("filters", g_filters)
                rows, grads = np.concatenate(rows), np.concatenate(grads)
                used = np.abs(grads).sum(axis=1) > 0
                some_rows, at_row = np.unique(rows[used], return_inverse=True)
                total_grad = np.zeros((len(some_rows), DIM), np.float32)
                np.add.at(total_grad, at_row, grads[used])
                real = some_rows != _PAD
                step("emb", total_grad[real], some_rows[real])


def calibrate(p: np.ndarray, labels: np.ndarray, languages: np.ndarray, least: int = 15) -> np.ndarray:
    """The threshold of best F1 for each language index, and for texts of none; the common one where labels are few."""

    def best(p: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
        k = int(f1.argmax())
        return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(p) else 0)) / 2)

    common = best(p, labels) if labels.sum() else 0.5
    out = np.full(len(LANGUAGES) + 1, common)
    for i in range(len(LANGUAGES) + 1):
        own = languages == i
        if least <= labels[own].sum() < own.sum():
            out[i] = best(p[own], labels[own])
    return np.clip(out, 0.02, 0.98)


def stretched(p: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Probabilities with the threshold moved to CUT."""
    return np.where(p < threshold, CUT * p / threshold, CUT + (1 - CUT) * (p - threshold) / (1 - threshold))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [word_ids(t) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["fold", "label", "ids"])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 8192, most_words: int = 16384, most_chars: int = 1 << 26) -> tuple[Net | None, np.ndarray | float]:
    """A trained net and thresholds by language, from labels (doc_id, toxic); None and the share if it can't be trained."""
    named = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sample = named.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).orderBy("fold", "doc_id").limit(most_rows)
    short = F.length("text") <= 8 * most_words
    rows = docs.join(F.broadcast(sample), "doc_id").filter(short).groupBy("doc_id", "fold", "label").agg(F.min("text").alias("text"))
    edge, held = -1, 0
    for r in rows.select("fold", F.length("text").alias("n")).orderBy("fold", "n").collect():  # most_rows at most
        held += r.n
        if held > most_chars:
            break
        edge = r.fold
    rows = rows.filter(F.col("fold") <= edge).select("fold", "label", "text")
    got = rows.mapInArrow(_encode, "fold long, label int, ids array<int>").filter(F.size("ids") <= most_words).toPandas().sort_values("fold", kind="stable")
    y = got.label.to_numpy(np.float32)
    texts = [np.asarray(t, np.int32) for t in got.ids]
    held = np.arange(len(y)) % 4 == 3
    train = ~held
    if not 0 < y[train].sum() < train.sum():
        return None, float(y.mean()) if len(y) else 0.0
    net = Net()
    net.train([t for t, k in zip(texts, train, strict=True) if k], y[train])
    aside = [t for t, k in zip(texts, held, strict=True) if k]
    if not aside:
        return net, np.full(len(LANGUAGES) + 1, 0.5)
    return net, calibrate(net.probability(aside), y[held], np.array([guess_language(t) for t in aside]))


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, thresholds = model.value
        for b in batches:
            texts = b.column(1)
            out = []
            for at in range(0, len(texts), 512):
                ids = [word_ids(t) for t in texts[at : at + 512].to_pylist()]
                if net is None:
                    out.append(np.full(len(ids), thresholds))
                else:
                    out.append(stretched(net.probability(ids), thresholds[[guess_language(t) for t in ids]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))
    return docs.mapInArrow(_scorer(model), "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    scored = score_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), known)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
