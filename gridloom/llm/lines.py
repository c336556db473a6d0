"""Cross-site boilerplate lines: HyperLogLog spread per line, exact counts near the threshold.

Method: every line that is not blank (or, with ``least_chars``, of so many characters at least) is hashed (128 bits). Sketches of the sites that carry a
line merge by aggregation, map-side first. A line whose estimate is clearly above or below ``least_sites`` is
decided by it; lines within three standard errors (and at least one) of the threshold get an exact distinct
count. A line on that many sites is boilerplate: it stays in the document with the smallest doc_id that has it
and is taken out of all others.

Scale: DataFrame functions only. A very common line is one partial row a task. Only hashes and positions are
shuffled for the decision; the text is shuffled once, to be joined with the positions to drop. Nothing is collected
or broadcast by hand.

Defined results: a null text stays null and has no lines; a null source is a site of its own; a null doc_id comes
after all others; repeated rows share their fate; an empty table gives no rows; blank lines (and those under
``least_chars``) always stay; other columns pass through unchanged.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, let, materialize, read


def _text_key() -> Column:
    return F.xxhash64(F.lit(7), "text")


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, site, text_key, pos, h1, h2 of every line that is long enough."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    split = docs.select("doc_id", site.alias("site"), _text_key().alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    cut = split.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter(F.length("line") >= least_chars)
    return cut.select("doc_id", "site", "text_key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def spread_lines(docs: DataFrame, least_sites: int, least_chars: int, lg_k: int = 10) -> DataFrame:
    """h1, h2, first (the smallest doc_id) of the lines on least_sites sites or more."""
    rows = _lines(docs, least_chars)
    band = 3 * 1.04 / 2 ** (lg_k / 2)
    low, high = min(least_sites - 1, floor(least_sites * (1 - band))), max(least_sites + 1, ceil(least_sites * (1 + band)))
    sketched = rows.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("first"))
    spread = materialize(sketched.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= low), "spread")
    near = spread.filter(F.col("sites") <= high)
    exact = rows.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("exact"))
    near = near.join(exact.filter(F.col("exact") >= least_sites), ["h1", "h2"]).select("h1", "h2", "first")
    return spread.filter(F.col("sites") > high).select("h1", "h2", "first").unionByName(near)


def dedup_lines(docs: DataFrame, least_sites: int = 5, least_chars: int = 1) -> DataFrame:
    """doc (all columns of docs), clean (its text without boilerplate), n_lines, n_spread, n_removed."""
    spread = spread_lines(docs, least_sites, least_chars)
    hits = _lines(docs, least_chars).join(spread, ["h1", "h2"])
    away = ~F.col("doc_id").eqNullSafe(F.col("first"))
    drop = hits.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.when(away, F.col("pos"))).alias("drop"), F.countDistinct("pos").alias("n_spread")
    ).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "drop", "n_spread")
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("i"), _text_key().alias("t"))
    both = doc.join(drop, F.col("i").eqNullSafe(F.col("d")) & (F.col("t") == F.col("k")), "left")
    n = F.coalesce(F.size(F.col("drop")), F.lit(0))

    def kept(lines: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
        return F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n")

    text = F.col("doc.text")
    lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    return both.select(
        "doc",
        F.when(n > 0, let(F.split(text, "\n"), kept)).otherwise(text).alias("clean"),
        F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n_spread", F.lit(0)).cast("long").alias("n_spread"),
        n.cast("long").alias("n_removed"),
    )


def strip_boilerplate(docs: DataFrame) -> DataFrame:
    """The rows of docs with their boilerplate lines taken out of text; n_chars follows it."""
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return dedup_lines(docs).select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def _columns(cleaned: DataFrame) -> DataFrame:
    clean = F.coalesce("clean", F.lit(""))
    return cleaned.select("doc.doc_id", "n_lines", "n_spread", "n_removed", F.length(clean).cast("long").alias("n_chars"), F.sha2(clean, 256).alias("clean_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that is not blank, as in the pipeline."""
    return _columns(dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "source", "text")))


ORACLE_OP2 = r"""
WITH l AS (
  SELECT doc_id, coalesce('s' || source, '') AS site, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents
), t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
s AS (SELECT line, min(doc_id) AS first FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 5),
m AS (SELECT t.*, s.line IS NOT NULL AS spread, s.line IS NOT NULL AND t.doc_id IS DISTINCT FROM s.first AS gone FROM t LEFT JOIN s ON t.line = s.line),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (spread) AS n_spread, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS clean
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_spread, 0) AS n_spread, coalesce(n_removed, 0) AS n_removed,
       CAST(length(coalesce(clean, '')) AS BIGINT) AS n_chars, sha256(coalesce(clean, '')) AS clean_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
