"""Queries that write table rows as archives and records and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import actors, archives, records, snapshots, streams
from ..storage import new_path
from ..shipping import ship
from .queries import _table, query
from .world import having, view

_PARTS = "SELECT p_partkey // 100 AS archive, CAST(p_partkey % 100 AS INTEGER) AS num, length(p_name) AS size, md5(p_name) AS digest FROM part"


def _archives(spark, d, write):
    ship(spark)
    objects = _table(spark, d, "part").select(F.call_function("div", F.col("p_partkey"), F.lit(100)).cast("string").alias("path"), (F.col("p_partkey") % 100).cast("int").alias("num"), F.col("p_name").cast("binary").alias("data"))
    return archives.decoded(write(objects))


def _shown(found):
    return found.select(F.col("path").cast("long").alias("archive"), "num", F.length("data").cast("long").alias("size"), F.md5("data").alias("digest"))


@query("s1_k1_flex", _PARTS)
def s1(spark, d):
    return _shown(_archives(spark, d, archives.as_flex).filter("kind = 'flex'"))


@query("s2_table", _PARTS)
def s2(spark, d):
    return _shown(_archives(spark, d, archives.as_table).filter("kind = 'table'"))


@query("s3_iff", _PARTS)
def s3(spark, d):
    return _shown(_archives(spark, d, archives.as_iff).filter("kind = 'iff'"))


@query("s4_s5_flat", "SELECT p_partkey AS archive, 0 AS num, length(p_name) AS size, md5(p_name) AS digest FROM part")
def s4(spark, d):
    """A file of no known format is one object."""
    ship(spark)
    files = _table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").cast("binary").alias("content"))
    return _shown(archives.decoded(files).filter("kind = 'flat'"))


@query("s6_latest", "WITH b AS (SELECT p_partkey % 500 AS num, p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS data FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY num ORDER BY p_partkey // 500 DESC) AS k FROM b WHERE data <> '') SELECT CAST(num AS INTEGER) AS num, md5(data) AS digest FROM r WHERE k = 1")
def s6(spark, d):
    """Of several sources the last one that holds an object that is not empty."""
    k = F.col("p_partkey")
    rows = _table(spark, d, "part").select((k % 500).cast("int").alias("num"), F.call_function("div", k, F.lit(500)).alias("rank"), F.when(k % 3 == 0, F.lit("")).otherwise(F.col("p_name")).cast("binary").alias("data"))
    return archives.latest_of(rows).select("num", F.md5("data").alias("digest"))


_IFIX = "SELECT id, tx, ty, tz, shape, frame FROM obj"


@query("s7_k2_fixed_objects", f"{having('obj')} SELECT tx, ty, tz, shape, frame, count(*) AS n FROM obj GROUP BY ALL")
def s7(spark, d):
    """Objects written as four-byte records of their chunk and read again."""
    obj = view(spark, d, "obj")
    chunks = records.write_fixed(obj)
    return records.fixed_objects(chunks).groupBy("tx", "ty", "tz", "shape", "frame").agg(F.count("*").alias("n"))


@query("s7_fixed_objects_v2", f"{having('obj')} SELECT tx, ty, tz, shape * 60 AS shape, frame, count(*) AS n FROM obj GROUP BY ALL")
def s7_v2(spark, d):
    """The five-byte form holds shapes of sixteen bits."""
    obj = view(spark, d, "obj").withColumn("shape", F.col("shape") * 60)
    return records.fixed_objects(records.write_fixed(obj, 2), 2).groupBy("tx", "ty", "tz", "shape", "frame").agg(F.count("*").alias("n"))


@query("s15_equipment", "SELECT p_partkey AS record, CAST(e AS INTEGER) AS elem, (p_partkey * 3 + e) % 65536 AS shape, CAST(p_size % 100 AS BIGINT) AS probability, CAST((p_size + e) % 256 AS BIGINT) AS quantity FROM part, range(0, 10) r(e)")
def s15(spark, d):
    k, size, e = F.col("p_partkey"), F.col("p_size"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("elem")
    rows = _table(spark, d, "part").select(k.alias("record"), size, e).select("record", "elem", ((F.col("record") * 3 + F.col("elem")) % 65536).alias("shape"), (size % 100).alias("probability"), ((size + F.col("elem")) % 256).alias("quantity"))
    return records.equipment(records.write_equipment(rows))


_SLOTS = """SELECT c_custkey AS npc, c_custkey * m % 8 AS time, CAST(m AS BIGINT) AS kind, c_custkey * 7 % 3072 AS tx, c_custkey * 31 % 3072 AS ty, {tz} AS tz, {days} AS days, count(*) AS n
 FROM customer, (VALUES (1), (3), (5)) v(m) WHERE m <= 1 + c_custkey % 5 GROUP BY ALL"""


def _slots(spark, d, form, scripts=()):
    k, m = F.col("npc"), F.col("kind")
    rows = _table(spark, d, "customer").select(F.col("c_custkey").alias("npc"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("kind")).filter(m <= 1 + k % 5)
    rows = rows.select("npc", (k * m % 8).alias("time"), "kind", (k * 7 % 3072).alias("tx"), (k * 31 % 3072).alias("ty"), (k % 16).alias("tz"), (k % 128).alias("days"))
    return actors.write_schedules(rows, 1000, form, scripts)


def _slots_read(files):
    return actors.schedules(files).groupBy("npc", "time", "kind", "tx", "ty", "tz", "days").agg(F.count("*").alias("n"))


@query("s11_k3_schedules", _SLOTS.format(tz="CAST(0 AS BIGINT)", days="CAST(127 AS BIGINT)"))
def s11(spark, d):
    """Schedules of four-byte entries behind a table of offsets, written for each thousand customers and read again."""
    return _slots_read(_slots(spark, d, actors.SHORT))


@query("s11_schedules_named", _SLOTS.format(tz="c_custkey % 16", days="c_custkey % 128"))
def s11_named(spark, d):
    """Entries of eight bytes with height and days, behind names of scripts."""
    return _slots_read(_slots(spark, d, actors.NAMED, ("patrol", "sleep at the inn")))


def _npc_value(f, i, key="c_custkey"):
    """A field's value, in SQL that both read: some number of its width."""
    return f"({key} * {2 * i + 7} + {i * i}) % {1 << f.width()} - {(1 << f.width()) // 2 if f.signed else 0}"


_NPC_FIELDS = ", ".join(f"{'c_custkey % 144' if f.name == 'sid' else _npc_value(f, i)} AS {f.name}" for i, f in enumerate(actors.NPC))


@query("s10_k3_npcs", f"""WITH n AS (SELECT c_custkey AS npc, left(c_name, 15) AS name, {_NPC_FIELDS} FROM customer)
SELECT npc, sid % 12 * 256 + x AS tx, sid // 12 * 256 + y AS ty, name, {', '.join(f.name for f in actors.NPC)} FROM n""")
def s10(spark, d):
    """Actors with all bit-packed fields, written for each hundred customers and read again."""
    rows = _table(spark, d, "customer").selectExpr("c_custkey AS npc", "c_name AS name", *_NPC_FIELDS.split(", "))
    return actors.npcs(actors.write_npcs(rows))


@query("s14_k6_messages", "SELECT 'names' || p_partkey // 200 AS section, CAST(p_partkey AS INTEGER) AS idx, p_name AS text FROM part WHERE p_partkey % 10 > 0")
def s14(spark, d):
    """Names written as lines of a section for every two hundred, in a file for every thousand, and read again; some are comments."""
    k = F.col("p_partkey")
    line = F.when(k % 10 == 0, F.concat(F.lit("# "), "p_name")).when(k % 10 < 4, F.concat(F.lit("  0x"), F.lower(F.hex(k)), F.lit(":"), "p_name")).otherwise(F.concat(k.cast("string"), F.lit(":"), "p_name"))
    part = lambda n: F.call_function("div", k, F.lit(n)).cast("string")
    return archives.messages(archives.message_files(_table(spark, d, "part").select(part(1000).alias("path"), F.concat(F.lit("names"), part(200)).alias("section"), k.alias("place"), line.alias("line"))))


@query("s13_text_tables", "SELECT 'warmth' AS section, CAST(p_partkey AS INTEGER) AS entry, [CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR), p_brand] AS fields FROM part")
def s13(spark, d):
    """Lines of one section of one file with fields parted by slashes, written in parts of a thousand lines and read again."""
    lines = _table(spark, d, "part").select(F.lit("table").alias("path"), F.lit("warmth").alias("section"), F.col("p_partkey").alias("place"), F.concat(F.lit(":"), F.concat_ws("/", "p_partkey", "p_size", "p_brand")).alias("line"))
    found = archives.messages(archives.message_parts(lines, 1000))
    return found.select("section", F.col("idx").alias("entry"), F.split("text", "/").alias("fields"))


@query("s12_k4_attributes", """WITH t AS (SELECT p_partkey // 512 AS file, p_partkey % 512 AS shape, CAST(p_size AS BIGINT) AS value, p_partkey % 3 = 0 AS modified FROM part)
SELECT file, shape, value + CASE WHEN modified THEN 100 ELSE 0 END AS value FROM t""")
def s12(spark, d):
    """Binary records keyed by shape, a file for every 512 parts, base then patch: the patch holds only what was modified."""
    k = F.col("p_partkey")
    base = _table(spark, d, "part").select(F.call_function("div", k, F.lit(512)).alias("file"), (k % 512).alias("shape"), F.col("p_size").cast("long").alias("value"), (k % 3 == 0).alias("modified"))
    patch = base.filter("modified").withColumn("value", F.col("value") + 100)
    return records.patched(*[records.attributes(records.write_attributes(t)) for t in (base, patch)])


_SAVED = "SELECT 'save' || p_partkey // 100 AS archive, 'u7/' || p_name || p_partkey AS name, md5(p_name || p_type) AS digest FROM part"


def _saved(spark, d, form):
    part = _table(spark, d, "part")
    files = part.select(F.concat(F.lit("save"), F.call_function("div", F.col("p_partkey"), F.lit(100))).alias("archive"), F.concat(F.lit("u7/"), "p_name", "p_partkey").alias("name"), F.concat("p_name", "p_type").cast("binary").alias("data"))
    path = new_path(spark, "saves")
    snapshots.save(files.filter("archive = 'save0'"), path, form)
    snapshots.save(files, path, form)
    return snapshots.restore(spark, path).select("archive", "name", F.md5("data").alias("digest"))


@query("s18_k5_saved_flex", _SAVED)
def s18_flex(spark, d):
    """Two versions of a saved state as Flex archives of a hundred files each; the later one is read."""
    return _saved(spark, d, "flex")


@query("s18_k5_saved_zip", _SAVED)
def s18_zip(spark, d):
    return _saved(spark, d, "zip")


@query("s16_functions", """WITH r AS (SELECT p_partkey % 700 * 150 AS id, p_partkey // 500 % 4 AS rank, p_partkey // 500 % 4 >= 2 AS patch, p_partkey AS place, p_name || p_partkey AS body FROM part WHERE p_partkey % 700 < 500 OR p_partkey % 3 = 0)
SELECT id, md5(arg_max(body, (CASE WHEN patch THEN 4 ELSE 0 END + rank) * 10000000 + place)) AS digest,
 CASE WHEN count(*) FILTER (patch) > 0 AND count(*) FILTER (NOT patch) > 0 THEN md5(arg_max(body, rank * 10000000 + place) FILTER (NOT patch)) WHEN count(*) FILTER (patch) > 1 THEN md5(arg_min(body, rank * 10000000 + place) FILTER (patch)) END AS original FROM r GROUP BY id""")
def s16(spark, d):
    """Functions in two files and two patches, with ids of two and of four bytes; a patch keeps what it replaces."""
    k = F.col("p_partkey")
    rank = F.call_function("div", k, F.lit(500)) % 4
    rows = _table(spark, d, "part").filter((k % 700 < 500) | (k % 3 == 0)).select(rank.alias("rank"), (rank >= 2).alias("patch"), k.alias("place"), (k % 700 * 150).alias("id"), F.concat("p_name", k.cast("string")).cast("binary").alias("data"))
    found = streams.in_force(streams.functions(streams.write_functions(rows)))
    return found.select("id", F.md5("data").alias("digest"), F.md5("original").alias("original"))


@query("s20_feed", "SELECT user_id AS file, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS place, event_id % 58 AS kind, md5(props) AS digest FROM events")
def s20(spark, d):
    """Messages of each user, recorded as a feed and read again."""
    rows = _table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), (F.col("event_id") % 58).alias("kind"), F.col("props").cast("binary").alias("data"))
    return streams.feed(streams.write_feed(rows)).select("file", "place", "kind", F.md5("data").alias("digest"))
