"""Quality rules: base counts of each text, and a robust multivariate outlier test per language and source.

Method: word, symbol and repetition counts are transformed to a vector of ``len(FEATURES)`` statistics. For each
(lang, source) the minimum covariance determinant is sought from three deterministic starts around the medians (quartile
spreads alone, correlations of the hyperbolic tangents, correlations of the spatial signs). A concentration step takes
the mean and covariance of the share ``keep_share`` of rows that are nearest by Mahalanobis distance (whole distance
bins, 64 for each doubling); after two steps the start of least determinant goes on until its determinant falls no
more. The covariance is scaled to be consistent at the median, and a text is rejected if its squared distance lies
beyond the ``quantile`` of the chi-square distribution.

Scale: DataFrame functions only. Counting is a narrow pass over the texts; the vectors (a few numbers a row) are
written once, and every step is a map-side combined aggregation by group and by distance bin, so a source that
holds a third of all rows costs each task a few partial rows. What is joined to the rows is a row a group, broadcast up
to ``MOST_BROADCAST`` groups. Groups of fewer than ``least_rows`` rows are pooled by language, and pools
of fewer than that together; a text in a last pool of fewer is not put to the test. Only the number of groups still
moving is collected.

Defined results: a null text has no words and so fails the base rule; null lang and null source are groups of
their own; null doc_ids and repeated rows are judged like any other; an empty table gives no rows; other columns
pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_CLASS, let, materialize, read, words_of

SYMBOLS = "#*$%&|<>"
#: Statistic: least standard deviation.
FEATURES = {"word_len": 0.08, "symbols": 0.05, "dup_lines": 0.25, "repeats": 0.25, "length": 0.50}
BINS = 64  # distance bins for each doubling
MOST_BROADCAST = 50_000  # groups, of at most 400 bytes each


def chi2_quantile(p: float, d: int) -> float:
    """Of the chi-square distribution with d degrees of freedom, by its series and bisection."""

    def below(x: float) -> float:
        a, term, total = d / 2, 1.0, 1.0
        for n in range(1, 1000):
            term *= x / 2 / (a + n)
            total += term
            if term < 1e-16 * total:
                break
        return total * exp(a * log(x / 2) - x / 2 - lgamma(a + 1))

    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return low


def repeated_words(words: Column) -> Column:
    """How many words lie in a 5-word window that the text has twice or more."""
    n = F.size(words)

    def covered(at: Column) -> Column:
        """Of windows starting at the sorted positions at: the words they cover."""
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    def count(h: Column) -> Column:
        m = F.size(h)
        # each key is (hash, position) in one number; equal hashes are neighbours once sorted
        width = (m + 1).cast("long")
        span = F.call_function("div", F.lit((1 << 62) - 1), width)
        keys = F.sort_array(F.transform(h, lambda x, i: F.pmod(x, span) * width + i))

        def twice(keys: Column) -> Column:
            of = lambda i: F.call_function("div", F.get(keys, i), width)
            hit = F.filter(keys, lambda k, i: ((i > 0) & (of(i) == of(i - 1))) | ((i < m - 1) & (of(i) == of(i + 1))))
            # the hashes in the keys are cut: what may be equal is compared by its whole hash
            whole = F.sort_array(F.transform(hit, lambda k: let((k % width).cast("int"), lambda p: F.struct(F.get(h, p).alias("h"), p.alias("p")))))
            return let(whole, lambda c: covered(F.sort_array(F.transform(F.filter(c, lambda x, i: (x["h"] == F.get(c, i - 1)["h"]) | (x["h"] == F.get(c, i + 1)["h"])), lambda x: x["p"]))))

        return F.when(F.size(F.array_distinct(h)) == m, 0).otherwise(let(keys, twice))

    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, 5)])), F.lit(1), n - 4)
    return F.when(n < 6, 0).otherwise(let(windows, count)).cast("long")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc (a struct of all columns of docs) and the counts of its text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        counts.alias("w"),
        lined.alias("l"),
        F.length(F.regexp_replace(text, BLANK_CLASS + "+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select("doc", F.col("w.n_words"), "word_chars", "n_symbols", F.col("l.n_dup_lines"), F.col("l.n_lines"), F.col("w.n_repeat_words"))


def vector() -> list[Column]:
    """The transformed statistics, in the order of FEATURES."""
    rate = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    length = F.log1p(F.col("n_words").cast("double"))
    return [F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))), rate("n_symbols", "word_chars"), rate("n_dup_lines", "n_lines"), rate("n_repeat_words", "n_words"), length]


D = len(FEATURES)
X = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


M = [f"m{i}" for i in range(D)]
L = [f"l{i}_{j}" for i, j in PAIRS]


def _cholesky(stats: DataFrame) -> DataFrame:
    """From columns m{i} and c{i}_{j} of a group: its mean, the lower triangle l{i}_{j} of its covariance, and logdet."""
    floors, lower = list(FEATURES.values()), []
    for i, j in PAIRS:  # each refers to those before it in the same select
        v = f"c{i}_{j}" + (f" + {floors[i] ** 2!r}D" if i == j else "") + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
        lower.append(f"sqrt(greatest({v}, 1e-9D)) AS l{i}_{j}" if i == j else f"({v}) / l{j}_{j} AS l{i}_{j}")
    others = [c for c in stats.columns if c not in {f"c{i}_{j}" for i, j in PAIRS}]
    return stats.selectExpr(*others, *lower, " + ".join(f"2 * ln(l{i}_{i})" for i in range(D)) + " AS logdet")


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance."""
    steps = [f"(x{i} - m{i}" + "".join(f" - l{i}_{k} * y{k}" for k in range(i)) + f") / l{i}_{i} AS y{i}" for i in range(D)]
    return rows.selectExpr("*", *steps, " + ".join(f"y{i} * y{i}" for i in range(D)) + " AS d2")


def _starts(vectors: DataFrame, near: Callable = F.broadcast) -> DataFrame:
    """Three first estimates of each group, by start s."""
    floors = list(FEATURES.values())
    quart = vectors.groupBy("g").agg(F.expr("count(*) AS n"), *[F.expr(f"percentile(round({x}, 2), array(0.25D, 0.5D, 0.75D)) AS q{i}") for i, x in enumerate(X)])
    quart = materialize(quart.selectExpr("g", "n", *[f"q{i}[1] AS m{i}" for i in range(D)], *[f"greatest((q{i}[2] - q{i}[0]) / 1.349D, {floors[i]!r}D) AS w{i}" for i in range(D)]), "mcd")
    z = vectors.join(near(quart.drop("n")), "g").selectExpr("g", *[f"(x{i} - m{i}) / w{i} AS z{i}" for i in range(D)], "greatest(sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(D)) + "), 1e-9D) AS size")
    z = z.selectExpr("g", *[f"tanh(z{i}) AS t{i}" for i in range(D)], *[f"z{i} / size AS u{i}" for i in range(D)])
    sums = z.groupBy("g").agg(*[F.expr(e) for e in [f"avg(t{i}) AS a{i}" for i in range(D)] + [f"avg({v}{i} * {v}{j}) AS {v}{i}_{j}" for v in "tu" for i, j in PAIRS]])
    got = quart.join(sums, "g")
    kinds = [lambda i, j: "0D", lambda i, j: f"(t{i}_{j} - a{i} * a{j})", lambda i, j: f"u{i}_{j}"]
    out = None
    for s, kind in enumerate(kinds):
        cov = [f"w{i} * w{j} * " + ("1D" if i == j else f"{kind(i, j)} / greatest(sqrt(greatest({kind(i, i)} * {kind(j, j)}, 0D)), 1e-9D)") + f" AS c{i}_{j}" for i, j in PAIRS]
        part = got.selectExpr("g", f"{s} AS s", "n", *M, *cov)
        out = part if out is None else out.unionByName(part)
    return materialize(_cholesky(out), "mcd")


def _concentrated(vectors: DataFrame, params: DataFrame, keep_share: float, near: Callable = F.broadcast) -> DataFrame:
    """g, s, n, now (the estimate given, with mid, the bin of its middle distance) and next (that of the nearest rows)."""
    far = _distance(vectors.join(near(params.drop("n", "logdet")), "g")).selectExpr("g", "s", f"floor(log2(d2 + 1e-6D) * {BINS}) AS bin", *X)
    sums = far.groupBy("g", "s", "bin").agg(*[F.expr(e) for e in ["count(*) AS k"] + [f"sum(x{i}) AS s{i}" for i in range(D)] + [f"sum(x{i} * x{j}) AS t{i}_{j}" for i, j in PAIRS]])
    sums = sums.selectExpr("*", "sum(k) OVER (PARTITION BY g, s) AS n", "sum(k) OVER (PARTITION BY g, s ORDER BY bin) - k AS before")
    part = lambda c: f"sum({c}) FILTER (WHERE before < {keep_share} * n)"
    got = sums.groupBy("g", "s").agg(*[F.expr(e) for e in ["max(n) AS n", f"{part('k')} AS h", "min(bin) FILTER (WHERE before + k >= 0.5 * n) AS mid"] + [f"{part(c)} AS {c}" for c in [f"s{i}" for i in range(D)] + [f"t{i}_{j}" for i, j in PAIRS]]])
    new = _cholesky(got.selectExpr("g", "s", "n", "mid", *[f"s{i} / h AS m{i}" for i in range(D)], *[f"t{i}_{j} / h - (s{i} / h) * (s{j} / h) AS c{i}_{j}" for i, j in PAIRS]))
    new = new.select("g", "s", "n", "mid", F.struct(*M, *L, "logdet").alias("next"))
    old = params.select("g", "s", F.struct(*M, *L, "logdet").alias("now"))
    return materialize(new.join(old, ["g", "s"]), "mcd")


def estimate(vectors: DataFrame, keep_share: float = 0.75, most_steps: int = 30, near: Callable = F.broadcast) -> DataFrame:
    """Per group g of vectors (g, x0, x1, ...): size n, mean m{i}, triangle l{i}_{j}, logdet, scale (of squared distances)."""
    params = _starts(vectors, near)
    for _ in range(2):
        got = _concentrated(vectors, params, keep_share, near)
        params = got.select("g", "s", "n", "next.*")
    best = got.groupBy("g").agg(F.min_by(F.struct("s", "n", "next"), F.struct("next.logdet", "s")).alias("x"))
    params = materialize(best.select("g", "x.s", "x.n", "x.next.*"), "mcd")
    done = None
    for step in range(most_steps):
        got = _concentrated(vectors, params, keep_share, near)
        settled = (F.col("next.logdet") >= F.col("now.logdet") - 1e-4) | F.lit(step == most_steps - 1)
        final = got.filter(settled)
        done = final if done is None else done.unionByName(final)
        params = got.filter(~settled).select("g", "s", "n", "next.*")
        if params.isEmpty():
            break
    # Consistent at the median: the middle squared distance is that of a chi-square.
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("mid") + 0.5) / BINS) / chi2_quantile(0.5, D))
    return materialize(done.select("g", "n", "now.*", scale.alias("scale")), "mcd")


def _group(level: int, lang: Column, source: Column) -> Column:
    return F.to_json(F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source")))


def pooled(rows: DataFrame, least_rows: int) -> DataFrame:
    """own, g: the group that the rows (own) of a language and source are judged in, and its number of rows."""
    none = F.lit(None).cast("string")
    counts = rows.groupBy("lang", "source").agg(F.count("*").alias("k"))
    small = counts.withColumn("few", F.col("k") < least_rows)
    of_lang = small.groupBy(F.col("lang").alias("of")).agg(F.sum(F.when(F.col("few"), F.col("k"))).alias("pool"))
    both = small.join(of_lang, F.col("lang").eqNullSafe(F.col("of")))
    g = F.when(~F.col("few"), _group(0, F.col("lang"), F.col("source"))).when(F.col("pool") >= least_rows, _group(1, F.col("lang"), none)).otherwise(_group(2, none, none))
    return materialize(both.select(_group(0, F.col("lang"), F.col("source")).alias("own"), g.alias("g")), "groups")


def judge_quality(docs: DataFrame, with_doc: bool = True, least_words: int = 10, most_repeats: int = 20, least_rows: int = 50, quantile: float = 0.9999) -> DataFrame:
    """doc (all columns of docs, or doc_id alone), the counts, base_failed, d2 and kept."""
    if not with_doc:
        docs = docs.select("doc_id", "text", "lang", "source")
    counted = base_counts(docs)
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    lang, source = F.col("doc.lang").cast("string"), F.col("doc.source").cast("string")
    rows = counted.select("doc" if with_doc else F.struct("doc.doc_id").alias("doc"), *COUNTS, base.alias("base_failed"), lang.alias("lang"), source.alias("source"), *[v.alias(x) for v, x in zip(vector(), X, strict=True)])
    rows = materialize(rows, "quality")
    groups = pooled(rows.filter(~F.col("base_failed")), least_rows)
    # One row a group is broadcast where there are few, else joined as Spark sees fit (and splits what is skewed).
    near = F.broadcast if groups.count() <= MOST_BROADCAST else (lambda df: df)
    keyed = rows.withColumn("own", _group(0, F.col("lang"), F.col("source")))
    params = estimate(materialize(keyed.filter(~F.col("base_failed")).join(near(groups), "own").select("g", *X), "vectors"), near=near)
    best = materialize(groups.join(params.filter(F.col("n") >= least_rows), "g").drop("g", "n", "logdet"), "groups")
    far = _distance(keyed.join(near(best), "own", "left")).withColumn("d2", F.col("d2") / F.col("scale"))
    outlier = F.coalesce(F.col("d2") > chi2_quantile(quantile, D), F.lit(False))
    return far.select("doc", *COUNTS, "base_failed", "d2", (~F.col("base_failed") & ~outlier).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, that pass the base rules and are no outliers."""
    return judge_quality(docs).filter("kept").select("doc.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(read(spark, sf_dir, "documents"), with_doc=False)
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance2"))
