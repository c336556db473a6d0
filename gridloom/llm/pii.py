"""Personal data in texts: anchors by Aho-Corasick, boundaries by local parsers.

Method: one automaton pass finds at-signs, schemes, plus-signs, digits and identifier cues. Each anchor is given
to a parser that only looks at the run of characters the kind allows around it, and then validates the span
(octets of an address, Luhn digits of a card, digit counts, the checksum of a bank account number, which may be spaced;
other account values have six signs or more and a digit). Schemes and cues count in any case. The base kinds are found exactly as a leftmost,
non-overlapping scan of the whole text by their patterns would find them; ``url`` and ``account`` come on top.

Scale: one pass over each row in Arrow batches, nothing shuffled, memory of one batch.

Defined results: a null text is the empty text; a null doc_id stays null; repeated rows are each reported; other
columns are ignored. A failing candidate is dropped and scanning goes on behind it. No text length is special:
every parser is linear in the run it looks at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import read

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
CUES = ("account", "acct", "iban", "passport", "ssn", "token", "api_key", "apikey", "secret", "password")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED_RUN = re.compile(r"[0-9.]+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"(?i:https?|ftp)://[^\s<>\"'`]+")
_LEAD = re.compile(r"[ \t]{0,3}(?i:no\.?|number|id|key)?[ \t]{0,3}[:=#]?[ \t]{0,3}[\"']?")
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9-]{5,}")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")  # 34 signs at most, by its standard
_LOWER = {c: c + 32 for c in range(65, 91)}


def _iban_end(text: str, at: int) -> int:
    """Where the longest account number of that form whose checksum holds ends; 0 if none starts here."""
    m = _IBAN.match(text, at)
    if not m:
        return 0
    ends = [i + 1 for i in range(at, m.end()) if text[i] != " "]
    signs = m[0].replace(" ", "").upper()
    for n in range(len(signs), 14, -1):
        if (n == len(ends) or text[ends[n - 1] : ends[n - 1] + 1] == " ") and int("".join(str(int(c, 36)) for c in signs[4:n] + signs[:4])) % 97 == 1:
            return ends[n - 1]
    return 0


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        if i % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") < 256


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for d in "0123456789":
        a.add_word(d, ("0", 1))
    for s in ("http://", "https://", "ftp://"):
        a.add_word(s, ("url", len(s)))
    for c in CUES:
        a.add_word(c, ("cue", len(c)))
    a.make_automaton()
    return a


def spans_of(text: str, automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text, in order of start and kind."""
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys((*KINDS, "dotted", "no digit"), 0)
    low = text.lower()
    if len(low) != len(text):  # a sign became two
        low = text.translate(_LOWER)
    for last, (what, size) in automaton.iter(low):
        at = last - size + 1
        if what == "0":
            if at >= done["dotted"]:  # a run of digits and dots, seen once
                run = _DOTTED_RUN.match(text, at)
                done["dotted"] = run.end()
                for m in _IP.finditer(text, at, run.end()):
                    if all(map(_octet, m[0].split("."))):
                        out.append(("ip", m.start(), m.end()))
            if at >= done["card"]:
                m = _CARD.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
                    out.append(("card", m.start(), m.end()))
        elif what == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append(("email", start, m.end()))
                done["email"] = m.end()
        elif what == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
        elif what == "url":
            if at >= done["url"] and (m := _URL.match(text, at)):
                end = at + len(m[0].rstrip(".,;:!?)]}"))
                out.append(("url", at, end))
                done["url"] = end
        elif at >= done["account"] and (at == 0 or not text[at - 1].isalnum()):
            start = _LEAD.match(text, last + 1).end()
            if start == last + 1:  # the cue is part of a longer word
                continue
            if end := _iban_end(text, start):
                out.append(("account", start, end))
                done["account"] = end
            elif start >= done["no digit"] and (m := _VALUE.match(text, start)):
                if any("0" <= c <= "9" for c in m[0]):
                    out.append(("account", start, m.end()))
                    done["account"] = m.end()
                else:
                    done["no digit"] = m.end()  # what starts within has none either
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t.as_py() or "", automaton)] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, kind)], names=["doc_id", "found"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and found: array of (kind, start, end), offsets in code points, end exclusive."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_finder, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def joined(found: Column, kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(F.filter(found, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
    )
    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.size("found").cast("long").alias("n_spans"), F.sha2(joined(F.col("found"), BASE_KINDS), 256).alias("base_sha256"), joined(F.col("found"), KINDS).alias("spans"))
