"""Records of actors and their schedules: one declared layout from which reader and writer are made.

Places, sizes and bits below are fixed values of the format. A file is a row with its bytes in ``content``; a record that is
cut short is left out; null contents and empty tables give no rows; repeated rows are written and read as often as they come.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bytes_of, little_endian
from .records import _cut, _joined

SUPERCHUNK, ACROSS = 256, 12


class Field(NamedTuple):
    name: str
    at: int
    size: int = 1
    low: int = 0  # its lowest bit in those bytes
    bits: int = 0  # 0: all
    signed: bool = False

    def width(self) -> int:
        return self.bits or 8 * self.size


NPC_SIZE, NAME_AT, NAME_SIZE = 117, 101, 16
NPC = [
    Field("x", 0), Field("y", 1), Field("shape", 2, 2, 0, 10), Field("frame", 2, 2, 10, 6), Field("contents", 4, 2, 0, 1), Field("script_name", 4, 2, 1, 1), Field("script_set", 4, 2, 2, 1), Field("script_named", 4, 2, 3, 1),
    Field("wide_skin", 4, 2, 4, 1), Field("sid", 6), Field("map_id", 7), Field("function", 8, 2, 0, 12), Field("lift", 8, 2, 12, 4), Field("health", 10, 1, signed=True), Field("used", 14, 2),
    Field("alignment", 16, 2, 3, 2), Field("temporary", 16, 2, 6, 1), Field("asleep", 16, 2, 7, 1), Field("charmed", 16, 2, 8, 1), Field("cursed", 16, 2, 9, 1), Field("aboard", 16, 2, 10, 1), Field("in_party", 16, 2, 11, 1),
    Field("paralyzed", 16, 2, 12, 1), Field("poisoned", 16, 2, 13, 1), Field("protection", 16, 2, 14, 1), Field("dead", 16, 2, 15, 1), Field("strength", 18, 1, 0, 6), Field("skin", 18, 1, 6, 2), Field("dexterity", 19),
    Field("intelligence", 20, 1, 0, 5), Field("read", 20, 1, 5, 1), Field("tournament", 20, 1, 6, 1), Field("polymorph", 20, 1, 7, 1), Field("combat", 21, 1, 0, 7), Field("petra", 21, 1, 7, 1), Field("schedule", 22),
    Field("attack_mode", 23, 1, 0, 4), Field("combat_protected", 23, 1, 4, 1), Field("attack_chosen", 23, 1, 5, 1), Field("charmed_alignment", 24), Field("magic", 25, 1, 0, 7), Field("magic_stored", 25, 1, 7, 1), Field("mana", 26),
    Field("temperature", 27), Field("met", 28, 1, 0, 1), Field("no_spells", 28, 1, 1, 1), Field("zombie", 28, 1, 2, 1), Field("ident", 28, 1, 3, 5), Field("face", 29, 2), Field("experience", 32, 4), Field("training", 36),
    Field("oppressor", 41, 2), Field("place_tx", 47, 2), Field("place_ty", 49, 2), Field("type_flags", 51, 2), Field("next_schedule", 58), Field("shape16", 64, 2), Field("polymorph16", 66, 2, signed=True), Field("flags", 68, 4),
    Field("place_tz", 72), Field("flags2", 74, 4), Field("skin_stored", 78), Field("food", 93, 1, signed=True),
]


def read_field(content: Column, f: Field) -> Column:
    value = F.shiftright(little_endian(content, f.at, f.size), f.low).bitwiseAND((1 << f.width()) - 1)
    return F.when(value >= 1 << (f.width() - 1), value - (1 << f.width())).otherwise(value) if f.signed else value


def record_of(fields: list[Field], size: int) -> Column:
    """The bytes of a record from a column a field; what no field covers is 0, bits beyond a field's width are cut off."""
    words: dict[tuple[int, int], Column] = {}
    for f in fields:
        part = F.shiftleft(F.coalesce(F.col(f.name).cast("long"), F.lit(0).cast("long")).bitwiseAND((1 << f.width()) - 1), f.low)
        words[f.at, f.size] = words[f.at, f.size].bitwiseOR(part) if (f.at, f.size) in words else part
    out, at = [], 0
    for (start, n), word in sorted(words.items(), key=lambda w: w[0]):
        out += [F.unhex(F.lit("00" * (start - at)))] * (start > at) + [bytes_of(word, n)]
        at = start + n
    return F.concat(*out, F.unhex(F.lit("00" * (size - at))))


def write_npcs(rows: DataFrame, each: int = 100) -> DataFrame:
    """file, content: records of actors (npc, name, and a column a field of NPC), `each` to a file; nulls are written as 0."""
    name = F.rpad(F.hex(F.substring(F.encode(F.coalesce("name", F.lit("")), "ISO-8859-1"), 1, NAME_SIZE - 1)), 2 * NAME_SIZE, "0")
    rows = rows.withColumn("file", F.call_function("div", F.col("npc"), F.lit(each)))
    return _joined(rows, ["file"], ["npc"], F.concat(record_of(NPC, NAME_AT), F.unhex(name)))


def npcs(files: DataFrame, each: int = 100) -> DataFrame:
    """npc, tx, ty (world tiles of x and y in the superchunk), name, and the fields of NPC; actors are counted on from file to file."""
    rows = _cut(files, NPC_SIZE, ["file"])
    rows = rows.select((F.col("file") * each + F.col("place")).alias("npc"), "record", *[read_field(F.col("record"), f).alias(f.name) for f in NPC])
    name = F.decode(F.unhex(F.regexp_extract(F.hex(F.substring("record", NAME_AT + 1, NAME_SIZE)), "^((?:(?!00)[0-9A-F]{2})*)", 1)), "ISO-8859-1")
    tile = lambda step, own: (step * SUPERCHUNK + F.col(own)).alias(f"t{own}")
    return rows.select("npc", tile(F.col("sid") % ACROSS, "x"), tile(F.call_function("div", F.col("sid"), F.lit(ACROSS)), "y"), name.alias("name"), *[f.name for f in NPC])


SHORT, LONG, NAMED = 4, -1, -2  # forms of a schedule file: entries of four bytes, of eight, of eight behind names of scripts
ALL_DAYS = 0x7F
MOST_ENTRIES = 0xFFFF


def _word(content: str, at: str, size: int = 2) -> Column:
    """A little-endian number at a place that is an expression."""
    bytes_ = [f"CAST(conv(hex(substring({content}, CAST({at} AS INT) + {i + 1}, 1)), 16, 10) AS BIGINT) * {256**i}" for i in range(size)]
    return F.expr(" + ".join(bytes_))


def write_schedules(rows: DataFrame, each: int, form: int = SHORT, scripts: tuple[str, ...] = ()) -> DataFrame:
    """file, content: schedules of actors (npc, time, kind, tx, ty, tz, days), those of file * each on in a file.

    A count, where the entries of each actor end, then entries: time, kind, the tile in its superchunk and the superchunk in
    four bytes (on the ground, every day), or tile, time, kind and days in eight. One without rows has no entries. More than
    65,535 entries in a file are an error: the places of two bytes cannot hold them.
    """
    c = F.col
    if form == SHORT:
        sid = F.call_function("div", c("ty"), F.lit(SUPERCHUNK)) * ACROSS + F.call_function("div", c("tx"), F.lit(SUPERCHUNK))
        entry = F.concat(bytes_of(c("time").bitwiseOR(F.shiftleft(c("kind"), 3)), 1), *[bytes_of(v, 1) for v in (c("tx") % SUPERCHUNK, c("ty") % SUPERCHUNK, sid)])
    else:
        entry = F.concat(bytes_of(c("tx"), 2), bytes_of(c("ty"), 2), *[bytes_of(c(k), 1) for k in ("tz", "time", "kind", "days")])
    rows = rows.withColumn("file", F.call_function("div", c("npc"), F.lit(each)))
    body = _joined(rows, ["file"], ["npc", "time", "kind", "tx", "ty"], entry, "body")
    counts = rows.groupBy("file", (c("npc") % each).alias("i")).agg(F.count("*").alias("k")).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("i", "k"))).alias("of"), F.sum("k").alias("n"))
    counts = counts.withColumn("of", F.when(c("n") <= MOST_ENTRIES, c("of")).otherwise(F.raise_error(F.lit("a schedule file holds 65,535 entries at most"))))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(each - 1).cast("long")), lambda i: F.coalesce(c("of")[i], F.lit(0).cast("long")))
    ends = F.aggregate(places, F.array(F.lit(0).cast("long")), lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + k)))
    offsets = F.transform(F.slice(ends, 2, each), lambda n: F.concat(F.lpad(F.hex(n.bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(n, 8)), 2, "0")))
    head = each.to_bytes(4, "little")
    names = b"".join(len(s.encode()).to_bytes(2, "little") + s.encode() for s in scripts)
    if form != SHORT:
        head = (form % 2**32).to_bytes(4, "little") + head + (len(scripts).to_bytes(2, "little") if form == NAMED else b"")
    block = len(names).to_bytes(2, "little") + names if form == NAMED and scripts else b""
    literal = lambda b: F.unhex(F.lit(b.hex()))
    return body.join(counts, "file").select("file", F.concat(literal(head), F.unhex(F.array_join(offsets, "")), literal(block), "body").alias("content"))


def _opened(files: DataFrame) -> DataFrame:
    """Adds size of an entry, n actors, k names, at (of the places), data (of the entries)."""
    first = _word("content", "0", 4)
    files = files.filter("length(content) >= 4").withColumn("_first", first)
    named, long_ = F.col("_first") == 2**32 + NAMED, F.col("_first") >= 2**32 + NAMED
    files = files.withColumns({"size": F.when(long_, 8).otherwise(4), "n": F.when(long_, _word("content", "4", 4)).otherwise(F.col("_first")), "k": F.when(named, _word("content", "8")).otherwise(0)})
    files = files.withColumn("at", F.when(named, 10).when(long_, 8).otherwise(4))
    return files.withColumn("data", F.expr("at + 2 * n") + F.when(F.col("k") > 0, 2 + _word("content", "at + 2 * n")).otherwise(0))


def schedules(files: DataFrame) -> DataFrame:
    """npc, time, kind, tx, ty, tz, days of files (file, content) of any form: an actor's entries lie between the end of those before
    it and its own. Actors are counted on from file to file, as many in each."""
    of = _opened(files).withColumn("i", F.explode(F.expr("filter(sequence(0L, greatest(n, 1L) - 1), i -> i < n AND length(content) >= at + 2 * (i + 1))")))
    of = of.withColumn("end", _word("content", "at + 2 * i")).withColumn("start", F.when(F.col("i") == 0, 0).otherwise(_word("content", "at + 2 * (i - 1)")))
    r = of.filter("end > start").withColumn("e", F.explode(F.expr("sequence(start, end - 1)")))
    r = r.select((F.col("file") * F.col("n") + F.col("i")).alias("npc"), "size", F.expr("substring(content, CAST(data + size * e + 1 AS INT), size)").alias("r")).filter("length(r) = size")
    short = F.col("size") == 4
    b = lambda i, n=1: little_endian(F.col("r"), i, n)
    either = lambda name, four, eight: F.when(short, four).otherwise(eight).cast("long").alias(name)
    sx, sy = b(3) % ACROSS * SUPERCHUNK, F.call_function("div", b(3), F.lit(ACROSS)) * SUPERCHUNK
    wide = [either("time", b(0).bitwiseAND(7), b(5)), either("kind", F.shiftright(b(0), 3), b(6)), either("tx", sx + b(1), b(0, 2)), either("ty", sy + b(2), b(2, 2)), either("tz", F.lit(0), b(4)), either("days", F.lit(ALL_DAYS), b(7))]
    return r.select("npc", *wide)


def schedule_scripts(files: DataFrame) -> DataFrame:
    """file, place, name of the scripts that files name."""
    start = F.struct((F.expr("at + 2 * n") + 2).cast("long").alias("at"), F.array().cast("array<string>").alias("names"))
    size = lambda acc: F.conv(F.hex(F.concat(F.substring("content", acc["at"].cast("int") + 2, F.lit(1)), F.substring("content", acc["at"].cast("int") + 1, F.lit(1)))), 16, 10).cast("long")
    step = lambda acc, i: F.struct((acc["at"] + 2 + size(acc)).alias("at"), F.concat(acc["names"], F.array(F.substring("content", acc["at"].cast("int") + 3, F.coalesce(size(acc), F.lit(0)).cast("int")).cast("string"))).alias("names"))
    listed = F.when(F.col("k") > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest("k", F.lit(1))), start, step))
    named = _opened(files).withColumn("_a", listed)
    return named.select("file", F.posexplode("_a.names").alias("place", "name"))
