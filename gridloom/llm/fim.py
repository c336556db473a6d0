"""Fill-in-middle: texts cut into prefix, middle and suffix and written in the order a model is trained on.

A table-driven DFA runs over the UTF-8 bytes. Its classes tell continuation bytes, letters, the letters of sentinels and the
two brackets apart; its transitions are counted, which gives a text's units, code points and sentinels in one scan. The
second pass looks up the byte at which the drawn number of units is reached. As the state depends on the last two classes
only, a whole batch of texts steps through the table at once, with a byte between texts that resets it.

Null texts count as empty, which stay plain. A null id is drawn for like the empty string. Repeated rows give repeated
rows, an empty table none, other columns are dropped. Units are runs of ASCII letters or single code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import read

SENTINELS = (b"<P>", b"<S>", b"<M>")  # fixed values: before prefix, suffix, middle
OTHER, CONTINUED, LETTER, NAMED, OPEN, CLOSE, RESET = range(7)  # classes of bytes
IDLE, WORD, OPENED, NAMING = range(4)  # states: nothing pending, in letters, after <, after < and a sentinel's letter
BETWEEN = b"\xff"  # never part of UTF-8
BLOCK = 8 << 20  # bytes of text in one scan


def byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[0x80:0xC0] = CONTINUED
    for a, z in (("A", "Z"), ("a", "z")):
        out[ord(a) : ord(z) + 1] = LETTER
    out[[s[1] for s in SENTINELS]] = NAMED
    out[ord("<")], out[ord(">")], out[BETWEEN[0]] = OPEN, CLOSE, RESET
    return out


def transitions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """next state, and whether a code point, a unit and a whole sentinel are counted, each by state and class."""
    to = np.zeros((4, 7), np.uint8)
    to[:, [LETTER, NAMED]] = WORD
    to[:, OPEN] = OPENED
    to[OPENED, NAMED] = NAMING
    point = np.ones((4, 7), bool)
    point[:, [CONTINUED, RESET]] = False
    unit = point.copy()
    unit[np.ix_([WORD, NAMING], [LETTER, NAMED])] = False
    sentinel = np.zeros((4, 7), bool)
    sentinel[NAMING, CLOSE] = True
    return to, point, unit, sentinel


CLASSES = byte_classes()
TO, POINT, UNIT, SENTINEL = transitions()
#: The state after two classes, whatever it was before them.
AFTER = TO[TO[IDLE][:, None], np.arange(7)[None, :]]
assert all((TO[TO[s][:, None], np.arange(7)[None, :]] == AFTER).all() for s in range(4))


class Scan:
    """One scan over a batch of texts: where units begin, where sentinels end, and code points before any byte."""

    def __init__(self, texts: list[bytes]):
        self.data = BETWEEN + BETWEEN + BETWEEN.join(texts) + BETWEEN
        kinds = CLASSES[np.frombuffer(self.data, np.uint8)]
        state = AFTER[kinds[:-2], kinds[1:-1]]
        now = kinds[2:]
        self.ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) + 1
        self.starts = self.ends - [len(t) for t in texts]
        self.units = np.flatnonzero(UNIT[state, now]) + 2
        self.closed = np.flatnonzero(SENTINEL[state, now]) + 3
        points = POINT[state, now]
        self.points = np.concatenate([np.zeros(2, np.int32), np.cumsum(points, dtype=np.int32)])  # [i]: in the bytes before i + 1
        self.first_unit, end_unit = np.searchsorted(self.units, self.starts), np.searchsorted(self.units, self.ends)
        self.n_units = end_unit - self.first_unit
        self.first_closed = np.searchsorted(self.closed, self.starts, "right")
        self.n_sentinels = np.searchsorted(self.closed, self.ends, "right") - self.first_closed

    def cut(self, n: np.ndarray) -> np.ndarray:
        """Second pass: the byte before which each text has n units."""
        at = np.append(self.units, 0)[np.minimum(self.first_unit + n, len(self.units))]
        return np.where(n < self.n_units, at, self.ends)

    def chars(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.points[high - 1].astype(np.int64) - self.points[low - 1]


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of some BLOCK bytes of text, a longer text on its own."""
    texts = batch.column(column).cast(pa.binary()).fill_null(b"")
    low = held = 0
    for i, n in enumerate([*pc.binary_length(texts).to_pylist(), BLOCK + 1]):
        if i > low and held + n > BLOCK:
            yield batch.slice(low, i - low), texts.slice(low, i - low).to_pylist()
            low, held = i, 0
        held += n


def _write(plain_percent: int, spm_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in blocks(batch, 1):
                scan = Scan(texts)
                n = scan.n_units
                h1, h2, h3, h4 = (rows.column(c).to_numpy() for c in range(2, 6))
                one, two = h1 % (n + 1), h2 % (n + 1)
                left, right = scan.cut(np.minimum(one, two)), scan.cut(np.maximum(one, two))
                plain = (n == 0) | (scan.n_sentinels > 0) | (h3 % 100 >= 100 - plain_percent)
                spm = ~plain & (h4 % 100 < spm_percent)
                p, s, m = SENTINELS
                out = []
                for d, (a, b, c, e) in enumerate(zip(scan.starts.tolist(), left.tolist(), right.tolist(), scan.ends.tolist(), strict=True)):
                    if plain[d]:
                        out.append(texts[d])
                    elif spm[d]:
                        out.append(b"".join((s, scan.data[c:e], p, scan.data[a:b], m, scan.data[b:c])))
                    else:
                        out.append(b"".join((p, scan.data[a:b], s, scan.data[c:e], m, scan.data[b:c])))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                count = lambda low, high: pa.array(scan.chars(low, high), pa.int64(), mask=plain)  # noqa: E731,B023
                cols = [rows.column(0), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), count(scan.starts, left), count(left, right), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: str = "1:", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output of all rows of docs (doc_id, text).

    Cuts and form are drawn from the SHA-256 of seed and id. A text with a sentinel of its own stays plain.
    """
    ship(docs.sparkSession)
    draw = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("draw", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    given = docs.select("doc_id", "text", draw.alias("draw")).select("doc_id", "text", *drawn)
    return given.mapInArrow(_write(plain_percent, spm_percent), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _restore(schema: list[str], output: int, form: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in blocks(batch, output):
                scan, wide = Scan(texts), len(SENTINELS[0])
                data = scan.data
                out = []
                for d, kind in enumerate(rows.column(form).to_pylist()):
                    if kind == "plain":
                        out.append(texts[d])
                        continue
                    one, two, three = scan.closed[scan.first_closed[d] : scan.first_closed[d] + 3].tolist()
                    first, second, middle = data[one : two - wide], data[two : three - wide], data[three : scan.ends[d]]
                    out.append(first + middle + second if kind == "psm" else second + middle + first)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary()).cast(pa.string())], names=[*schema, "restored"])

    return run


def restored(outputs: DataFrame) -> DataFrame:
    """Adds restored: the text rebuilt from output and form alone, by the places of the three sentinels."""
    ship(outputs.sparkSession)
    names = outputs.columns
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in outputs.schema.fields)
    return outputs.mapInArrow(_restore(names, names.index("output"), names.index("form")), f"{types}, restored string")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restored(fill_in_middle(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_OP12 = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid, coalesce(array_to_string(w[b + 1:], ''), '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(pre || mid || suf) AS restored_sha256
FROM p"""
