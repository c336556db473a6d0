"""Queries over scalar rules: comparisons, distances, names, properties, arrays, flags, bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from .queries import _table, query
from .world import having, view

_INT = "coalesce(TRY_CAST(regexp_extract({0}, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0)"


@query("f2_comparisons", f"""WITH t AS (SELECT o_orderkey AS id, o_orderkey % 9 - 4 AS a, o_custkey % 5 - 2 AS b, o_orderpriority AS s FROM orders)
SELECT id, a < b AS less, a >= b AS not_less, a < {_INT.format('s')} AS less_text, a <> 0 AND b <> 0 AS both, a <> 0 OR b <> 0 AS either, a = 0 AS neither, true AS text_holds FROM t""")
def f2(spark, d):
    """Order is of whole numbers, texts by the number they begin with; 0 is false, every text is true."""
    t = _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 9 - 4).alias("a"), (F.col("o_custkey") % 5 - 2).alias("b"), F.col("o_orderpriority").alias("s"))
    a, b = F.col("a"), F.col("b")
    return t.select("id", (a < b).alias("less"), (a >= b).alias("not_less"), (a < E.leading_int(F.col("s"))).alias("less_text"), ((a != 0) & (b != 0)).alias("both"), ((a != 0) | (b != 0)).alias("either"), (a == 0).alias("neither"), F.col("s").isNotNull().alias("text_holds"))


_NEXT = "p.id, p.tx AS x0, p.ty AS y0, p.tz AS z0, o.tx AS x1, o.ty AS y1, o.tz AS z1"


def _ways(spark, d):
    obj = view(spark, d, "obj")
    to = obj.select((F.col("id") - 1).alias("id"), F.col("tx").alias("x1"), F.col("ty").alias("y1"), F.col("tz").alias("z1"))
    return obj.select("id", F.col("tx").alias("x0"), F.col("ty").alias("y0"), F.col("tz").alias("z0")).join(to, "id")


@query("f4_squared_distances", f"""{having('obj')}, w AS (SELECT {_NEXT} FROM obj p JOIN obj o ON o.id = p.id + 1), g AS (SELECT id, least(abs(x1 - x0), 3072 - abs(x1 - x0)) AS x, least(abs(y1 - y0), 3072 - abs(y1 - y0)) AS y, z1 - z0 AS z FROM w)
SELECT id, x * x + y * y AS flat, x * x + y * y + z * z AS solid, ((2 * x - z) * (2 * x - z) + (2 * y - z) * (2 * y - z)) // 4 AS screen FROM g""")
def f4(spark, d):
    x0, y0, z0, x1, y1, z1 = (F.col(c) for c in ("x0", "y0", "z0", "x1", "y1", "z1"))
    return _ways(spark, d).select("id", E.square_distance(x0, y0, x1, y1).alias("flat"), E.square_distance(x0, y0, x1, y1, z0, z1).alias("solid"), E.screen_distance(x0, y0, z0, x1, y1, z1).alias("screen"))


_WRAP = "CASE WHEN {0} >= 1536 THEN {0} - 3072 WHEN {0} <= -1536 THEN {0} + 3072 ELSE {0} END"


@query("f5_footprint_distance", f"""{having('obj')}, w AS (SELECT {_NEXT}, p.id % 4 + 1 AS s0, o.id % 4 + 1 AS s1 FROM obj p JOIN obj o ON o.id = p.id + 1), v AS (SELECT *, {_WRAP.format('(x1 - x0)')} AS dx, {_WRAP.format('(y1 - y0)')} AS dy FROM w),
e AS (SELECT *, CASE WHEN dx > 0 THEN (x1 - s1 + 1 + 3072) % 3072 ELSE x1 END AS ex1, CASE WHEN dx < 0 THEN (x0 - s0 + 1 + 3072) % 3072 ELSE x0 END AS ex0, CASE WHEN dy > 0 THEN (y1 - s1 + 1 + 3072) % 3072 ELSE y1 END AS ey1, CASE WHEN dy < 0 THEN (y0 - s0 + 1 + 3072) % 3072 ELSE y0 END AS ey0,
 CASE WHEN z0 < z1 AND z0 + s0 <= z1 THEN z1 - z0 - s0 WHEN z0 > z1 AND z1 + s1 <= z0 THEN z0 - z1 - s1 ELSE 0 END AS dz FROM v)
SELECT id, greatest(least(abs(ex1 - ex0), 3072 - abs(ex1 - ex0)), least(abs(ey1 - ey0), 3072 - abs(ey1 - ey0)), dz) AS far FROM e""")
def f5(spark, d):
    """From edge to edge of two things of one to four tiles a side."""
    t = _ways(spark, d).withColumn("s0", F.col("id") % 4 + 1).withColumn("s1", (F.col("id") + 1) % 4 + 1)
    of = lambda f, c: f(F.col(f"{c}0"), F.col(f"{c}1"), F.col("s0"), F.col("s1"))
    return t.select("id", F.greatest(of(E.footprint_gap, "x"), of(E.footprint_gap, "y"), of(E.height_gap, "z")).alias("far"))


@query("f6_not_before", f"{having('obj')}, w AS (SELECT {_NEXT} FROM obj p JOIN obj o ON o.id = p.id + 1) SELECT id, CASE WHEN x0 - x1 >= 0 THEN x0 - x1 < 1536 ELSE x0 - x1 < -1536 END AS x_after, CASE WHEN y0 - y1 >= 0 THEN y0 - y1 < 1536 ELSE y0 - y1 < -1536 END AS y_after FROM w")
def f6(spark, d):
    return _ways(spark, d).select("id", E.not_before(F.col("x0"), F.col("x1")).alias("x_after"), E.not_before(F.col("y0"), F.col("y1")).alias("y_after"))


@query("f8_neighbours", f"{having('obj')} SELECT id, dir, (tx + dx + 3072) % 3072 AS x, (ty + dy + 3072) % 3072 AS y FROM obj, (VALUES (0, 0, -1), (1, 1, -1), (2, 1, 0), (3, 1, 1), (4, 0, 1), (5, -1, 1), (6, -1, 0), (7, -1, -1)) v(dir, dx, dy)")
def f8(spark, d):
    return view(spark, d, "obj").select("id", F.explode(E.neighbours(F.col("tx"), F.col("ty"))).alias("n")).select("id", "n.dir", "n.x", "n.y")


@query("f9_rectangles", f"""{having('obj')}, r AS (SELECT {_NEXT}, p.shape % 700 AS w0, o.shape % 900 AS w1 FROM obj p JOIN obj o ON o.id = p.id + 1), i AS (SELECT *, greatest(x0, x1) AS x, greatest(y0, y1) AS y, least(x0 + w0, x1 + w1) AS ex, least(y0 + w0, y1 + w1) AS ey FROM r)
SELECT id, ex > x AND ey > y AS meet, CASE WHEN ex > x AND ey > y THEN (ex - x) * (ey - y) END AS common, (x1 - x0 + 3072) % 3072 < w0 AND (y1 - y0 + 3072) % 3072 < w0 AS holds FROM i""")
def f9(spark, d):
    """Whether two squares meet, in what area, and whether the first holds the corner of the second round the world."""
    obj = view(spark, d, "obj")
    t = _ways(spark, d).join(obj.select("id", (F.col("shape") % 700).alias("w0")), "id").join(obj.select((F.col("id") - 1).alias("id"), (F.col("shape") % 900).alias("w1")), "id")
    square = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"), F.col(f"w{i}").alias("w"), F.col(f"w{i}").alias("h"))
    t = t.withColumn("c", E.intersection(square(0), square(1)))
    meet = (F.col("c.w") > 0) & (F.col("c.h") > 0)
    return t.select("id", meet.alias("meet"), F.when(meet, F.col("c.w") * F.col("c.h")).alias("common"), (E.in_strip(F.col("x0"), F.col("w0"), F.col("x1")) & E.in_strip(F.col("y0"), F.col("w0"), F.col("y1"))).alias("holds"))


@query("f13_names", """WITH t AS (SELECT p_partkey AS id, p_size % 4 AS n, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'a/' || p_name || '/f/ves' WHEN 2 THEN '/' || p_name || '//s' ELSE 'some/' || p_name END AS s FROM part),
u AS (SELECT id, n, s, string_split(s, '/') AS p FROM t)
SELECT id, CASE WHEN len(p) = 1 THEN CASE WHEN n <= 1 THEN s ELSE n || ' ' || s END WHEN len(p) < 4 THEN '?' WHEN n <= 1 THEN CASE WHEN p[1] = '' THEN '' ELSE p[1] || ' ' END || p[2] || p[3] ELSE n || ' ' || p[2] || p[4] END AS name FROM u""")
def f13(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    text = F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.lit("a/"), name, F.lit("/f/ves"))).when(k % 4 == 2, F.concat(F.lit("/"), name, F.lit("//s"))).otherwise(F.concat(F.lit("some/"), name))
    return _table(spark, d, "part").select(k.alias("id"), E.display_name(text, F.col("p_size") % 4).alias("name"))


@query("f14_prefix", "WITH p AS (SELECT DISTINCT left(n_name, k) AS prefix FROM nation, range(1, 5) r(k)) SELECT prefix, count(*) AS found, CASE WHEN count(*) = 1 THEN max(n_name) END AS name FROM p JOIN nation ON starts_with(n_name, prefix) GROUP BY prefix")
def f14(spark, d):
    """Which name a prefix of one to four letters stands for; none if it is ambiguous. Names are joined by their own prefixes."""
    names = _table(spark, d, "nation").select("n_name", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).select("n_name", F.expr("left(n_name, k)").alias("prefix")).distinct()
    return names.groupBy("prefix").agg(F.count("*").alias("found"), F.max("n_name").alias("n")).select("prefix", "found", F.when(F.col("found") == 1, F.col("n")).alias("name"))


_STRONG = "{0} + CASE WHEN might THEN least({0}, 15) ELSE 0 END - CASE WHEN cursed THEN 3 ELSE 0 END"
_SMART = "CASE WHEN charmed OR asleep THEN v - 1 ELSE v END"


@query("f18_f20_effective", f"""WITH t AS (SELECT o_orderkey AS id, o_custkey % 25 AS v, o_orderkey % 7 = 0 AS helpless, o_orderkey % 5 = 0 AS asleep, o_orderkey % 11 = 0 AS dead, o_orderkey % 3 = 0 AS charmed, o_orderkey % 4 = 0 AS might, o_custkey % 4 = 0 AS cursed FROM orders)
SELECT id, {_STRONG.format('v')} AS strength, 2 * ({_STRONG.format('v')}) AS most_weight, CASE WHEN dead THEN 1 ELSE {_STRONG.format('(' + _SMART + ')')} END AS intelligence,
 CASE WHEN helpless OR asleep THEN 0 WHEN dead THEN 0 ELSE {_STRONG.format('(' + _SMART + ')')} END AS dexterity, CASE WHEN helpless OR asleep THEN 1 WHEN dead THEN 1 ELSE {_STRONG.format('(' + _SMART + ')')} END AS combat, v AS mana FROM t""")
def f18(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    flags = {"helpless": k % 7 == 0, "asleep": k % 5 == 0, "dead": k % 11 == 0, "charmed": k % 3 == 0, "might": k % 4 == 0, "cursed": c % 4 == 0}
    of = lambda p: E.effective(p, c % 25, flags)
    return _table(spark, d, "orders").select(k.alias("id"), of("strength").alias("strength"), (2 * of("strength")).alias("most_weight"), *[of(p).alias(p) for p in ("intelligence", "dexterity", "combat", "mana")])


@query("f15_so2_set_and_splice", """WITH t AS (SELECT l_orderkey AS id, list_sort(list(CAST(l_quantity AS BIGINT))) AS v FROM lineitem GROUP BY 1), u AS (SELECT id, v, id % 9 - 1 AS i FROM t),
s AS (SELECT id, v, i, CASE WHEN i < 1 THEN v ELSE list_transform(range(1, greatest(i, len(v)) + 1), lambda k: CASE WHEN k = i THEN 99 WHEN k <= len(v) THEN v[k] ELSE 0 END) END AS w FROM u)
SELECT id, len(w)::BIGINT AS n, list_sum(w)::BIGINT AS total, list_position(w, 99)::BIGINT AS place, (len(v) + 1)::BIGINT AS spliced FROM s""")
def f15_set(spark, d):
    """Set an element by its place, from 1: arrays grow with zeros; and splice an array and an empty one into a list of values."""
    t = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("long"))).alias("v"))
    t = t.withColumn("w", E.with_item(F.col("v"), F.col("id") % 9 - 1, F.lit(99).cast("long")))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, b: a + b)
    spliced = F.flatten(F.array(F.col("v"), F.array().cast("array<bigint>"), F.array(F.lit(1).cast("long"))))
    return t.select("id", F.size("w").cast("long").alias("n"), total.alias("total"), F.nullif(F.array_position("w", 99), F.lit(0)).cast("long").alias("place"), F.size(spliced).cast("long").alias("spliced"))


@query("f16_for_each", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def f16(spark, d):
    """A loop over an array gives each element with its place, from 1, and the size."""
    own = view(spark, d, "queue").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("due", "event_id"))).alias("v"))
    return own.select(F.col("k").alias("user_id"), F.posexplode("v").alias("i", "x"), F.size("v").alias("n")).select("user_id", "x.event_id", (F.col("i") + 1).cast("long").alias("i"), F.col("n").cast("long").alias("n"))


@query("so3_key_set", f"{having('obj')}, k AS (SELECT DISTINCT quality AS code FROM obj WHERE id % 7 = 0 AND quality NOT IN (SELECT quality FROM obj WHERE id % 70 = 0)) SELECT id, quality IN (SELECT code FROM k) AS opens FROM obj")
def so3(spark, d):
    """A ring of keys: add, remove, then check the lock of every object."""
    obj = view(spark, d, "obj")
    added, removed = obj.filter("id % 7 = 0").select("quality").distinct(), obj.filter("id % 70 = 0").select("quality")
    ring = added.join(removed, "quality", "left_anti").withColumn("opens", F.lit(True))
    return obj.select("id", "quality").join(ring, "quality", "left").select("id", F.coalesce("opens", F.lit(False)).alias("opens"))


@query("so4_answers", """WITH a AS (SELECT user_id, event_type, min(row_number) AS first, max(row_number) AS last FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_number FROM events) GROUP BY 1, 2)
SELECT user_id, list(event_type ORDER BY last) AS answers FROM a WHERE event_type <> 'view' GROUP BY user_id""")
def so4(spark, d):
    """Answers added in turn: each moves to the end when it is added again; then one is removed."""
    said = view(spark, d, "queue").groupBy(F.col("k").alias("user_id")).agg(F.array_sort(F.collect_list(F.struct("due", "event_id", "kind"))).alias("v"))
    added = E.answers_after(F.array().cast("array<string>"), add=F.transform("v", lambda x: x["kind"]))
    return said.select("user_id", E.answers_after(added, remove=F.array(F.lit("view"))).alias("answers")).filter(F.size("answers") > 0)


@query("so7_flags", f"{having('obj')} SELECT id, frame & 12 AS held, frame | 3 AS added, frame & ~5 AS cleared, (frame & 4) <> 0 AS is_set FROM obj")
def so7(spark, d):
    f = F.col("frame")
    return view(spark, d, "obj").select("id", f.bitwiseAND(12).alias("held"), f.bitwiseOR(3).alias("added"), f.bitwiseAND(F.bitwise_not(F.lit(5).cast("long"))).alias("cleared"), (f.bitwiseAND(4) != 0).alias("is_set"))


@query("f23_bytes", "SELECT o_orderkey AS id, (o_orderkey % 256 & 15) * 16 + (o_orderkey % 256) // 16 AS swapped, o_orderkey % 65536 AS short, o_custkey % 4294967296 AS long FROM orders")
def f23(spark, d):
    """Nibbles swapped, and numbers written as little-endian bytes and read again."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = _table(spark, d, "orders").select(k.alias("id"), E.swapped_nibbles(k % 256).alias("swapped"), F.concat(E.bytes_of(k % 65536, 2), E.bytes_of(c, 4)).alias("b"))
    return t.select("id", "swapped", E.little_endian(F.col("b"), 0, 2).alias("short"), E.little_endian(F.col("b"), 2, 4).alias("long"))


@query("f12_text", "SELECT n_nationkey AS id, CASE WHEN n_regionkey - 2 >= 0 THEN n_name || (n_regionkey - 2) ELSE n_name END AS appended, replace('to %s!', '%s', n_name) AS told FROM nation")
def f12(spark, d):
    n = F.col("n_regionkey") - 2
    return _table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(n >= 0, F.concat("n_name", n.cast("string"))).otherwise(F.col("n_name")).alias("appended"), F.format_string("to %s!", "n_name").alias("told"))
