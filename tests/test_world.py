"""Every world query against its SQL, and units of the rules that differ from SQL."""


import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions import exprs as E
from gridloom.functions.registry import Registry
from gridloom.operators import graph, hierarchy, scripts, spatial
from gridloom.plans import queries as world
from gridloom.sources import archives

DIR = "/root/testdata/sf0.001"


def rows(columns, records):
    plain = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted((tuple(str(plain(r[c])) for c in sorted(columns)) for r in records))


@pytest.mark.parametrize("name", sorted(world.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = [r.asDict() for r in world.QUERIES[name](spark, DIR).collect()]
    rel = con.sql(world.ORACLES[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert rows(rel.columns, got) == rows(rel.columns, want)


def test_division_rules(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (-3, 0), (3, 0), (None, 5), (None, 0), (4, None)], "a long, b long")
    assert [r[0] for r in df.select(E.divided(df.a, df.b)).collect()] == [3, -3, E.SHORTEST, E.LONGEST, 0, E.LONGEST, 0]
    assert [r[0] for r in df.select(E.plus(df.a, df.b)).collect()] == [9, -5, -3, 3, 5, 0, 4]


def test_leading_int(spark):
    df = spark.createDataFrame([("12ab",), ("-3",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(E.leading_int(df.s)).collect()] == [12, -3, 0, 0]


def test_seam(spark):
    a = spark.createDataFrame([(1, 1, 3070)], "id long, tx long, ty long")
    b = spark.createDataFrame([(2, 3071, 2), (3, 40, 40)], "id long, tx long, ty long")
    assert [(r.id, r.dist) for r in spatial.near(a, b, 4).collect()] == [(2, 4)]
    with pytest.raises(ValueError):
        spatial.near(a, b, 1528)


def test_archives(spark, tmp_path):
    (tmp_path / "a.flx").write_bytes(archives.write_flex([b"one", b"", b"three"], "t"))
    (tmp_path / "b.flat").write_bytes(b"plain text")
    table = b"\x03\x00\x0e\x00\x00\x00\x02\x00\x11\x00\x00\x00\xff\xff" + b"abcde"
    (tmp_path / "c.tab").write_bytes(table)
    (tmp_path / "d.iff").write_bytes(b"FORM\x00\x00\x00\x10TEXTDATA\x00\x00\x00\x03xyz\x00")
    got = {(r.path.rsplit("/", 1)[1], r.kind, r.num, bytes(r.data)) for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert got == {("a.flx", "flex", 0, b"one"), ("a.flx", "flex", 1, b""), ("a.flx", "flex", 2, b"three"), ("b.flat", "flat", 0, b"plain text"), ("c.tab", "table", 0, b"abc"), ("c.tab", "table", 1, b"de"), ("d.iff", "iff", 0, b"xyz")}


def test_messages(spark, tmp_path):
    (tmp_path / "m.txt").write_text("7:outside\n%%section one\n# note\n:zero\n5:five\n\n  :one\n0x10:sixteen\n010:eight\n5:five again\nnothing\n%%endsection\n%%section two\n:a:b\n%%endsection\n")
    (tmp_path / "n.txt").write_text("%%section three\n:first\n%%endsection\n")
    got = sorted((str(r.section), r.idx, r.text) for r in archives.read_messages(spark, str(tmp_path)).collect())
    # one counter a file, moved by unnumbered lines alone, through all sections
    assert got == [("None", 7, "outside"), ("one", 0, "zero"), ("one", 1, "one"), ("one", 5, "five again"), ("one", 8, "eight"), ("one", 16, "sixteen"), ("three", 0, "first"), ("two", 2, "a:b")]


def test_edge_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridloom.operators.temporal import edges
    from gridloom.streaming.edges import edge_stream

    df = spark.createDataFrame([(k, 10 * k + i, i, (i * k) % 3 == 1) for k in (1, 2, 4) for i in range(6)], "k long, event_id long, due long, inside boolean")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    q = edge_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("edge_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = edges(df, "k", ["due", "event_id"], F.col("inside")).select("k", "event_id", "entered", "left").collect()
    assert sorted(spark.table("edge_out").collect()) == sorted(want)


def stepped(a, b):
    """The steps of a straight walk, one after the other."""
    d = [v - 3072 if v >= 1536 else v + 3072 if v <= -1536 else v for v in (q - p for p, q in zip(a, b, strict=True))]
    cur, sums, major = list(a), [0, 0, 0], max(map(abs, d))
    for _ in range(major):
        for k in range(3):
            sums[k] += abs(d[k])
            cur[k] = (cur[k] + (1 if d[k] >= 0 else -1) * (sums[k] // major)) % 3072
            sums[k] %= major
        yield tuple(cur)


def test_walk(spark):
    ends = [((0, 0, 0), (5, 2, 1)), ((3070, 1, 3), (2, 3069, 0)), ((7, 7, 7), (7, 7, 7)), ((10, 10, 15), (12, 9, 0)), ((0, 0, 0), (1536, 1535, 2)), ((1536, 9, 0), (0, 9, 0)), ((100, 900, 4), (63, 2, 9))]
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(ends)], "id long, a long, b long, c long, d long, e long, f long")
    got = graph.walked(df, ["id"], ("a", "b", "c"), ("d", "e", "f")).orderBy("id", "step").collect()
    assert [(r.id, r.step, (r.x, r.y, r.z)) for r in got] == [(i, k, t) for i, (a, b) in enumerate(ends) for k, t in enumerate(stepped(a, b), 1)]


def test_every_object_walks(spark):
    obj = {r.id: (r.tx, r.ty, r.tz) for r in world.view(spark, DIR, "obj").collect()}
    got = {r.id: (r.n, (r.last.x, r.last.y, r.last.z)) for r in world.QUERIES["g3_straight_walk_whole"](spark, DIR).groupBy("id").agg(F.count("*").alias("n"), F.max_by(F.struct("x", "y", "z"), "step").alias("last")).collect()}
    gap = lambda p, q: max(min(abs(u - v), 3072 - abs(u - v)) for u, v in zip(p, q, strict=True))
    assert got == {i: (gap(p, obj[i + 1]), obj[i + 1]) for i, p in obj.items() if i + 1 in obj}


def test_walks_are_dealt_to_all_tasks(spark):
    tiles = world.QUERIES["g3_straight_walk_whole"](spark, DIR)
    assert tiles.select(F.spark_partition_id()).distinct().count() == 4  # one, where the objects were only read by the size of their file


def test_walk_from_outside_the_world(spark):
    rows = [(1, -3, 6000, 2, 4, 6001, 0), (2, 3071, 0, 0, 3075, -4, 0), (3, 0, 0, 3000, 4000, 0, 3071)]
    got = graph.walked(spark.createDataFrame(rows, "id long, a long, b long, c long, d long, e long, f long"), ["id"], ("a", "b", "c"), ("d", "e", "f")).collect()
    wrap = lambda d: d - 3072 if d >= 1536 else d + 3072 if d <= -1536 else d
    want = set()
    for i, *ends in rows:
        d = [wrap(b - a) for a, b in zip(ends[:3], ends[3:], strict=True)]
        n = max(map(abs, d))
        want |= {(i, k, *[(a + (1 if v > 0 else -1) * (k * abs(v) // n)) % 3072 for a, v in zip(ends[:3], d, strict=True)]) for k in range(1, n + 1)}
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_every_name_and_text_is_searched(spark):
    got = sorted(map(tuple, world.QUERIES["p8_substring"](spark, DIR).collect()))
    sql = "SELECT 'part', p_partkey, instr(lower(p_name), 'a') FROM '{0}/part.parquet' WHERE contains(lower(p_name), 'a') UNION ALL SELECT 'document', doc_id, instr(lower(text), 'a') FROM '{0}/documents.parquet' WHERE contains(lower(text), 'a')"
    assert got == sorted(duckdb.sql(sql.format(DIR)).fetchall()) and len(got) > 40 and {r[0] for r in got} == {"part", "document"}


def test_closure_of_any_depth(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "node long, parent long")
    got = hierarchy.closure(chain).collect()
    assert sorted((r.ancestor, r.node, r.depth) for r in got) == [(a, n, n - a) for a in range(40) for n in range(a, 40)]
    assert hierarchy.closure(chain.limit(0)).count() == 0


@pytest.mark.parametrize("circle", [[(1, 1)], [(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1)]])
def test_closure_of_a_circle_is_an_error(spark, circle):
    chain = [(i, i - 1 if i > 10 else None) for i in range(10, 40)] + [(50, 1)]
    with pytest.raises(ValueError, match="lies in itself"):
        hierarchy.closure(spark.createDataFrame(chain + circle, "node long, parent long"))


def test_closure_of_odd_edges(spark):
    got = hierarchy.closure(spark.createDataFrame([(1, 9), (2, 1), (2, 1), (None, 1), (3, None)], "node long, parent long")).collect()
    want = [(1, 1, 0), (2, 2, 0), (2, 2, 0), (None, None, 0), (3, 3, 0), (9, 1, 1), (1, 2, 1), (1, 2, 1), (1, None, 1), (9, 2, 2), (9, 2, 2), (9, None, 2)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_sha1_of_known_values(spark):
    got = spark.createDataFrame([("abc",), ("",)], "s string").select(F.sha1("s")).collect()
    assert [r[0] for r in got] == ["a9993e364706816aba3e25717850c26c9cd0d89d", "da39a3ee5e6b4b0d3255bfef95601890afd80709"]


def test_truncated_flex():
    whole = archives.write_flex([b"one", b"two"])
    assert list(archives.DECODERS["flex"](whole[:136])) == [b""]  # an index cut after its first entry, nothing behind it


def test_scripts():
    play = lambda *a: list(scripts.play(*a))
    assert play([70, scripts.CONT, 71, 72], 0, 9) == [(0, 0, 70), (0, 1, 1), (0, 2, 71), (1, 3, 72)]
    assert play([70, scripts.REPEAT2, -1, 1, 1, 71], 0, 9) == [(0, 0, 70), (1, 1, 12), (1, 0, 70), (2, 1, 12), (2, 5, 71)]
    assert [t for t, *_ in play([70, scripts.REPEAT, -1, 255], 0, 5)] == [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]  # for ever
    assert [s for s in play([scripts.WAIT_NEAR, 5, 71], 3, 9) if s[2] == 71] == [(4, 2, 71)]
    assert play([scripts.DELAY_MINUTES, 2, 70], 0, 99) == [(0, 0, 40), (50, 2, 70)]
    assert len(play([scripts.CONT, scripts.RESET], 0, 3)) == 4000 and len(play([scripts.REPEAT, 0, 255], 0, 1)) == 2000


def test_registry():
    known = Registry()
    known.add("f", 1, lambda x: x)
    with pytest.raises(ValueError):
        known.add("f", 1, lambda x: x)
    with pytest.raises(KeyError):
        known.override("g", 1, lambda before, x: x)
    with pytest.raises(KeyError):
        known.call("g")


def test_small_files_are_decoded_together():
    """Before, each file was a table of its own."""
    import pandas as pd

    from gridloom.sources import archives

    files = pd.DataFrame({"path": [str(i) for i in range(1000)], "content": [b"x"] * 1000})
    out = list(archives._decode(iter([files])))
    assert len(out) == 1 and list(out[0].path) == list(files.path) and set(out[0].kind) == {"flat"}
    large = files.head(3).assign(content=[bytes(archives.BATCH_BYTES)] * 3)
    assert [len(t) for t in archives._decode(iter([large]))] == [1, 1, 1]


def test_a_file_in_parts_keeps_its_section_and_count(spark):
    from gridloom.sources import archives

    lines = spark.createDataFrame([("f", s, i, f":{s}{i}" if i % 4 else f"# {i}") for s in "ab" for i in range(25)], "path string, section string, place long, line string")
    whole, parts = archives.message_files(lines), archives.message_parts(lines, 4)
    assert parts.count() == 14  # before, a file was one row however long
    read = lambda files: sorted(map(tuple, archives.messages(files).collect()))
    assert read(parts) == read(whole) and len(read(whole)) == 36


def test_dense_objects_do_not_multiply_the_pairs_of_the_nearest(spark, monkeypatch):
    from gridloom.operators import spatial

    objects = spark.range(4000).select("id", (F.col("id") % 60).alias("tx"), (F.col("id") * 7 % 61).alias("ty"), (F.col("id") % 5).alias("tz"))
    probes = objects.filter("id % 100 = 0")
    tried, near = [], spatial.near
    monkeypatch.setattr(spatial, "near", lambda p, o, r, keys=(): tried.append(r) or near(p, o, r, keys))
    got = sorted((r.p_id, r.place, r.id, r.d) for r in spatial.k_nearest(probes, objects, 96, 3).collect())
    assert tried[0] < 96 and tried[-1] == 96  # before, all within 96 were paired at once
    rows = objects.collect()
    gap = lambda a, b: min(abs(a - b), 3072 - abs(a - b))
    want = []
    for p in (r for r in rows if r.id % 100 == 0):
        far = sorted((max(gap(p.tx, o.tx), gap(p.ty, o.ty), abs(p.tz - o.tz)), o.id) for o in rows if o.id != p.id)[:3]
        want += [(p.id, i, o, d) for i, (d, o) in enumerate(far, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["s9_terrains", "s9_terrains_wide"])
def test_tiles_of_terrains_are_not_shuffled(spark, name):
    """Before, the tiles of a part were dealt out one by one."""
    plan = world.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("Generate explode(") < plan.index("Exchange hashpartitioning")


def test_walks_that_repeat_each_other_are_written_together(spark, tmp_path):
    """Before, walks came in the order of a hash, and the same rows took up twice the disk."""
    d = "/root/testdata/sf0.01"
    world.QUERIES["g3_straight_walk_whole"](spark, d).write.parquet(str(tmp_path / "together"))
    world._tiles_to_next(world._to_next(world.view(spark, d, "obj"))).write.parquet(str(tmp_path / "apart"))
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / name).rglob("*.parquet"))
    assert size("together") < 0.75 * size("apart")
    together, apart = (spark.read.parquet(str(tmp_path / name)).agg(F.count("*"), F.sum(F.xxhash64("id", "step", "x", "y", "z").cast("decimal(38, 0)"))).head() for name in ("together", "apart"))
    assert together == apart
