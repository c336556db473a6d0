"""The corpus operators against brute force on small fixtures, and their edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import jaccard, lines, mixing, order_minhash, packing, pii, quality, queries, toxicity, urls, weak_labels
from gridloom.llm.components import components, extended

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, kept string, key string"
ODD = [
    (1, None, "en", "a", 0, "x", "y", "z"),
    (2, "", None, None, 0, None, None, None),
    (3, " \n\t ", "en", "a", 4, "x", "y", "z"),
    (4, "one", "en", "a", 3, "x", "y", "z"),
    (None, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", None, None, "x", "y", "z"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "b", 70, "x", "y", "z"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "b", 70, "x", "y", "z"),
    (6, "word " * 30000, "de", "a", 150000, "x", "y", "z"),
    (7, "plain text with mail a@b.co and 10.0.0.1 and +1 (555) 010-9999 inside it", "fr", "a", 70, "x", "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{DIR}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    cols = rel.columns
    got = queries.QUERIES[name](spark, DIR).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rel.fetchall()))


def check_pieces(rows, docs):
    ids = packing.WordIds(packing.default_tokenizer())
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for doc_id, text in docs:
        want = np.array(ids.tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(want[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(want)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing(spark):
    rows = packing.op1_packing(spark, DIR).collect()
    check_pieces(rows, [(d, t) for d, t, _ in texts()])
    total, n = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert n * 2048 - total < 2048 * len({r.sequence_id >> 40 for r in rows})


def test_packing_odd(spark, odd, empty):
    rows = packing.pack_sequences(odd, packing.default_tokenizer(), block_tokens=4096).collect()
    check_pieces([r for r in rows if r.doc_id not in (5, None)], [(r[0], r[1]) for r in ODD if r[0] not in (5, None)])
    assert sum(r.length for r in rows if r.doc_id == 5) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 5)
    assert packing.pack_sequences(empty, packing.default_tokenizer()).count() == 0


def brute_pack(lengths, capacity, linear, quadratic):
    cost = lambda n: linear * n + quadratic * n * n
    out, n_seq, rest = [], 0, []
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((d, start, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    bins = -(-sum(r[0] for r in rest) // capacity)
    load = dict.fromkeys(range(n_seq, n_seq + bins), 0.0)
    used = dict.fromkeys(load, 0)
    while rest:
        rest.sort(key=lambda r: (-cost(r[0]), r[1], r[2]))
        n, d, start = rest.pop(0)
        fit = [s for s in load if capacity - used[s] >= n] or [s for s in load if used[s] < capacity]
        s = min(fit, key=lambda s: (load[s], s))
        part = min(n, capacity - used[s])
        out.append((d, start, part, s, used[s]))
        used[s] += part
        load[s] += cost(part)
        if part < n:
            rest.append((n - part, d, start + part))
    return out, n_seq + bins


def test_pack_block_takes_the_lowest_sequence_with_room():
    r = random.Random(0)
    for _ in range(60):
        lengths = [int(r.lognormvariate(3, 1.2)) + 1 for _ in range(r.randint(0, 80))]
        lengths += lengths[:5]  # ties
        assert packing.pack_block(lengths, 64, 1.0, 1 / 64) == brute_pack(lengths, 64, 1.0, 1 / 64)
    out, n = packing.pack_block([1000] * 1000, 2048, 1.0, 1 / 2048)
    loads = defaultdict(float)
    for _, _, length, s, _ in out:
        loads[s] += length + length * length / 2048
    assert max(loads.values()) < 1.5 * sum(loads.values()) / n


def test_word_ids_equal_the_tokenizer():
    ids, r = packing.WordIds(packing.default_tokenizer()), random.Random(3)
    signs = [*"abcXYZ''sted.,;:!?()-_  \n\t0123éÉßĄıΣς中🙂́\u0085\xa0\x1c\x00²ºµ<|>", "<|endoftext|>", "'ll"]
    for _ in range(3000):
        t = "".join(r.choice(signs) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(next(ids.ids([t])), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


def sets_of(docs):
    out = {}
    for k, t in docs:
        w = (t or "").encode().lower().split()
        out[k] = frozenset() if not w else frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])
    return out


def components_of(sets):
    keys, up = list(sets), {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def test_jaccard_components(spark):
    r = random.Random(1)
    base = [f"w{r.randint(0, 300)}" for _ in range(120)]
    docs = [(d, t) for d, t, _ in texts()]
    docs += [(5_000 + i, " ".join(base[:100])) for i in range(150)]  # a component of many rows
    for i in range(60):  # near copies at all distances
        words = list(base)
        for _ in range(r.randint(0, 8)):
            words[r.randrange(len(words))] = f"x{r.randint(0, 50)}"
        docs.append((10_000 + i, " ".join(words)))
    docs += [(20_000 + i, " ".join(r.choice("abc") for _ in range(r.randint(0, 9)))) for i in range(150)]
    sets = sets_of(docs)
    want = components_of(sets)
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == {k: (len(sets[k]), want[k]) for k in sets}


def test_components(spark):
    """Chains, a star and two rings against union and find; repeated edges and loops do not matter."""
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + i) for i in range(80)] + [(900 + i, 900 + (i + 1) % 30) for i in range(30)] + [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(70)] + [(7, 7), (100, 101)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x.node: x.label for x in got} == {k: top(k) for k in up} and len(got) == len(up)
    none = spark.createDataFrame([], "u long, v long")
    assert components(none).count() == 0
    cut = len(edges) // 2  # the rest after a first half, and after nothing
    for first in (edges[:cut], []):
        more = extended(components(spark.createDataFrame(first, "u long, v long")), spark.createDataFrame(edges[len(first):], "u long, v long")).collect()
        assert sorted(map(tuple, more)) == sorted(map(tuple, got))
    star = [(5000, k) for k in range(5001, 6000)] + [(k, k + 1000) for k in range(5001, 5400)] + [(1, 6100)]  # a centre of many nodes
    found = dict(map(tuple, extended(components(spark.createDataFrame(star, "u long, v long")), spark.createDataFrame([(6399, 3)], "u long, v long")).collect()))
    assert set(found.values()) == {1} and {1, 3, 5000, 5999, 6001, 6399} <= found.keys()


def test_pipeline_of_odd_tables(spark, odd, empty):
    """Nulls, blanks, repeated rows, a very long text and clashing columns through every stage; and no rows at all."""
    import corpus_pipeline

    for docs in (odd, empty):
        before = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns, docs = docs.columns, stage(spark, docs, DIR)
            docs = spark.createDataFrame(docs.collect(), odd.schema)
            assert docs.columns == columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
        assert out.count() >= docs.count() and (before > 0) == (out.count() > 0)


def test_jaccard_odd(spark, odd, empty):
    got = sorted(map(tuple, jaccard.near_duplicates(odd).collect()), key=str)
    assert len(got) == len(ODD)
    assert (None, 10, 5) in got and got.count((5, 10, 5)) == 2 and (6, 1, 6) in got and (1, 0, 1) in got and (3, 0, 3) in got
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7"]
    assert jaccard.near_duplicates(empty).count() == 0


def counts(t):
    w = WORD.findall(t or "")
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    ls = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered)


def test_quality(spark, odd, empty):
    got = {r.doc_id: r for r in quality.op5_quality_rules(spark, DIR).collect()}
    for d, t, _ in texts():
        r, c = got[d], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 10 or 100 * c[4] > 20 * c[0])
        assert not (r.base_failed and r.kept)
    good = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DIR}/labels.parquet'").fetchall())
    assert all(got[d].kept or got[d].base_failed for d, q in good.items() if q == 1)
    judged = quality.judge_quality(odd).collect()
    assert len(judged) == len(ODD) and {r.doc.doc_id for r in judged if r.kept} == {None, 5, 7}
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(empty).count() == 0


def brute_mcd(x, share=0.75, most_steps=30):
    """Mean, lower triangle and scale of the rows of x, by the rules of the operator."""
    floors = np.array(list(quality.FEATURES.values()))
    q1, q2, q3 = np.percentile(np.round(x, 2), [25, 50, 75], axis=0)
    w = np.maximum((q3 - q1) / 1.349, floors)
    z = (x - q2) / w
    t, u = np.tanh(z), z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)
    kinds = [np.zeros((quality.D, quality.D)), t.T @ t / len(x) - np.outer(t.mean(0), t.mean(0)), u.T @ u / len(x)]

    def lower(cov):
        out = np.zeros_like(cov)
        for i in range(quality.D):
            for j in range(i + 1):
                v = cov[i, j] + (floors[i] ** 2 if i == j else 0) - out[i, :j] @ out[j, :j]
                out[i, j] = np.sqrt(max(v, 1e-9)) if i == j else v / out[j, j]
        return out

    def distance(m, tri):
        y = np.zeros_like(x)
        for i in range(quality.D):
            y[:, i] = (x[:, i] - m[i] - y[:, :i] @ tri[i, :i]) / tri[i, i]
        return (y * y).sum(1)

    def step(m, tri):
        bins = np.floor(np.log2(distance(m, tri) + 1e-6) * quality.BINS)
        names, counts = np.unique(bins, return_counts=True)
        before = np.cumsum(counts) - counts
        near = x[np.isin(bins, names[before < share * len(x)])]
        mid = names[before + counts >= 0.5 * len(x)].min()
        return mid, near.mean(0), lower(near.T @ near / len(near) - np.outer(near.mean(0), near.mean(0)))

    logdet = lambda tri: 2 * np.log(np.diag(tri)).sum()
    starts = []
    for k in kinds:
        r = k / np.maximum(np.sqrt(np.maximum(np.outer(np.diag(k), np.diag(k)), 0)), 1e-9)
        np.fill_diagonal(r, 1)
        m, tri = q2, lower(np.outer(w, w) * r)
        for _ in range(2):
            _, m, tri = step(m, tri)
        starts.append((logdet(tri), len(starts), m, tri))
    _, _, m, tri = min(starts, key=lambda s: s[:2])
    for _ in range(most_steps):
        mid, m2, tri2 = step(m, tri)
        if logdet(tri2) >= logdet(tri) - 1e-4:
            break
        m, tri = m2, tri2
    return distance(m, tri) / max(1.0, 2 ** ((mid + 0.5) / quality.BINS) / quality.chi2_quantile(0.5, quality.D))


def brute_quality(rows, least_rows=50, quantile=0.9999):
    """doc_id -> (distance, kept) of rows (doc_id, text, lang, source)."""
    vectors, groups = {}, defaultdict(list)
    for d, t, lang, source in rows:
        n, chars, symbols, dups, repeats = counts(t)
        if n < 10 or 100 * repeats > 20 * n:
            continue
        lines_ = sum(1 for x in t.split("\n") if WORD.search(x))
        vectors[d] = [np.log1p(chars / n), np.sqrt(symbols / chars), np.sqrt(dups / lines_), np.sqrt(repeats / n), np.log1p(n)]
        groups[lang, source].append(d)
    judged = defaultdict(list)
    small = defaultdict(list)
    for (lang, source), ds in groups.items():
        (judged[lang, source] if len(ds) >= least_rows else small[lang]).extend(ds)
    for lang, ds in small.items():
        judged[(lang,) if len(ds) >= least_rows else ()].extend(ds)
    out = {d: (None, False) for d, *_ in rows}
    for ds in judged.values():
        far = brute_mcd(np.array([vectors[d] for d in ds])) if len(ds) >= least_rows else [None] * len(ds)
        out |= {d: (f, f is None or f <= quality.chi2_quantile(quantile, quality.D)) for d, f in zip(ds, far, strict=True)}
    return out


@pytest.mark.parametrize("directory", [DIR, "/root/testdata/sf0.01"])
def test_quality_verdict_equals_brute_force(spark, directory):
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{directory}/documents.parquet'").fetchall()
    want = brute_quality(rows, 50)
    got = {r.doc_id: r for r in quality.op5_quality_rules(spark, directory).collect()}
    for d, (far, kept) in want.items():
        assert got[d].kept == kept and (far is None or np.isclose(got[d].distance2, far, rtol=1e-6)), d


def test_quality_groups_by_language_and_source(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    rows = [(i, " ".join(word(r.randint(3, 8)) for _ in range(r.randint(30, 200))), "en" if i % 2 else "de", "big" if i % 3 else f"s{i % 7}") for i in range(400)]
    rows += [(1000 + i, " ".join(word(60) for _ in range(40)), "en", "big") for i in range(3)]  # outliers by word length alone
    got = {x.doc_id: x for x in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), with_doc=False).select("doc.doc_id", "kept", "d2").collect()}
    want = brute_quality(rows)
    assert all(got[d].kept == kept for d, (_, kept) in want.items()) and not any(got[1000 + i].kept for i in range(3))


def test_chi_square_quantiles():
    assert abs(quality.chi2_quantile(0.5, 5) - 4.35146) < 1e-4 and abs(quality.chi2_quantile(0.975, 2) - 7.37776) < 1e-4


def test_repeated_words_of_a_long_text(spark):
    r = random.Random(9)
    words = [f"w{r.randint(0, 10**9)}" for _ in range(60_000)] + ["a", "b", "c", "d", "e", "f"]
    text = " ".join([*words, "a", "b", "c", "d", "e"])
    docs = spark.createDataFrame([(1, text, "en", "a")], SCHEMA.split(", n_chars")[0].replace("lang string, source string", "lang string, source string"))
    assert quality.base_counts(docs).head().n_repeat_words == counts(text)[4] == 10


def test_lines_odd(spark, odd, empty):
    shared = "this very long line stands on every site"
    docs = spark.createDataFrame([(i, f"own line number {i} of this site\n{shared}", f"s{i}") for i in range(6)] + [(9, None, None)], "doc_id long, text string, source string")
    got = {r.doc.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert got[0].clean.endswith(shared) and all(got[i].clean == f"own line number {i} of this site" for i in range(1, 6)) and got[9].clean is None
    out = lines.strip_boilerplate(odd)
    assert out.columns == odd.columns and sorted(str(r.text) for r in out.collect()) == sorted(str(r[1]) for r in ODD)
    assert lines.dedup_lines(empty).count() == 0


def test_short_lines(spark):
    docs = spark.createDataFrame([(i, f"own line number {i} of this site\nLes.\n \nOf.", f"s{i}" if i < 6 else "s0") for i in range(8)] + [(8, "Hm.\nOf.", "s1"), (9, "Hm.", "s2")], "doc_id long, text string, source string")
    got = {r.doc.doc_id: (r.clean, r.n_spread, r.n_removed) for r in lines.dedup_lines(docs).collect()}
    want = {i: (f"own line number {i} of this site\n ", 2, 2) for i in range(1, 8)}
    assert got == want | {0: ("own line number 0 of this site\nLes.\n \nOf.", 2, 0), 8: ("Hm.", 1, 1), 9: ("Hm.", 0, 0)}


def test_mixing(spark, odd, empty):
    rows = mixing.op6_mixing(spark, DIR).collect()
    source = {d: s for d, _, s in texts()}
    by = defaultdict(list)
    for r in rows:
        assert r.size == len(WORD.findall(next(t for d, t, _ in texts() if d == r.doc_id) or "")) and 0 <= r.taken <= 3 * r.size
        by[source[r.doc_id]].append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(5, 0.05 * rs[0].target) and rs[0].target <= 3 * rs[0].source_size + 1e-6
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op6_mixing(spark, DIR).collect()))
    assert mixing.mix_sources(odd).count() == len(ODD) and mixing.mix_sources(empty).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def brute_flow(capacity, members, quota, most=3):
    """(words, cost) of a maximum flow of least cost, by shortest ways over all arcs."""
    nodes, arcs, out = {"from": 0, "to": 1}, [], [[], []]

    def node(key):
        if key not in nodes:
            nodes[key] = len(out)
            out.append([])
        return nodes[key]

    def arc(a, b, n, cost):
        for x, y, r, c in ((a, b, n, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, r, c])

    for p, n in capacity.items():
        for k in range(most):
            arc(0, node(("p", p)), n, k)
        for s in members[p]:
            arc(node(("p", p)), node(("s", s)), most * n, 0)
    for s, n in quota.items():
        arc(node(("s", s)), 1, n, 0)
    words = cost = 0
    while True:
        far, via, moved = {0: 0}, {}, True
        while moved:
            moved = False
            for a in list(far):
                for i in out[a]:
                    b, n, c = arcs[i]
                    if n and far[a] + c < far.get(b, 1 << 60):
                        far[b], via[b], moved = far[a] + c, i, True
        if 1 not in far:
            return words, cost
        way, b = [], 1
        while b:
            way.append(via[b])
            b = arcs[via[b] ^ 1][0]
        n = min(arcs[i][1] for i in way)
        for i in way:
            arcs[i][1] -= n
            arcs[i ^ 1][1] += n
        words, cost = words + n, cost + n * far[1]


def flow_cost(given, capacity):
    total = 0
    for p, g in given.items():
        for k in range(3):
            use = min(g, capacity[p])
            total, g = total + use * k, g - use
        assert g == 0
    return total


def test_flow_equals_brute_force():
    r = random.Random(1)
    for _ in range(200):
        names = list("abcdef")[: r.randint(1, 6)]
        capacity = {p: r.randint(0, 20) for p in range(r.randint(1, 9))}
        members = {p: tuple(sorted(r.sample(names, r.randint(1, len(names))))) for p in capacity}
        quota = {s: r.randint(0, 40) for s in names}
        got = mixing.flow(capacity, members, quota)
        assert (sum(got.values()), flow_cost(got, capacity)) == brute_flow(capacity, members, quota)


def test_mixing_overlapping_sources(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        names = r.sample(["zz", "a", "m", None], r.randint(0, 3))
        rows.append((i, " ".join(["w"] * r.randint(1, 40)), names + names[:1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, names array<string>")
    got = mixing.mix_sources(docs, sources=F.col("names")).collect()
    by = defaultdict(list)
    for x in got:
        by[tuple(x.sources)].append(x)
        assert x.taken <= 3 * x.size and x.taken % x.size == 0
    assert set(by) == {tuple(sorted(set(n), key=lambda s: (s is None, s or ""))) for *_, n in rows}
    assert all(x.taken == 0 and x.target is None for x in by[()])
    words = {k: sum(x.size for x in v) for k, v in by.items() if k}
    sizes = {s: sum(n for k, n in words.items() if s in k) for s in {s for k in words for s in k}}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = mixing.targets_of(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)})
    quota = {s: round(share[s] * sum(words.values()) / sum(sizes.values())) for s in names}
    best = brute_flow(words, {k: k for k in words}, quota)
    assert abs(sum(x.taken for x in got) - best[0]) <= 0.02 * best[0]
    again = mixing.mix_sources(docs.repartition(5), sources=F.reverse("names")).collect()
    assert sorted((x.doc_id, x.taken) for x in got) == sorted((x.doc_id, x.taken) for x in again)
    folded = mixing.mix_sources(docs, sources=F.col("names"), max_patterns=3).collect()
    assert len(folded) == len(rows) and abs(sum(x.taken for x in folded) - sum(words.values())) <= 0.05 * sum(words.values())


def test_mixing_repeated_rows_and_ties(spark):
    docs = spark.createDataFrame([(None, "one two three", s) for s in "ab" for _ in range(40)] + [(i, "x y", "c") for i in range(30)], "doc_id long, text string, source string")
    runs = [sorted(map(tuple, mixing.mix_sources(docs.repartition(n)).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str) for n in (1, 4)]
    assert runs[0] == runs[1]
    for source_size in (120, 60):
        mine = [r for r in runs[0] if r[2] == source_size]
        assert len({r[3] for r in mine}) <= 2 and abs(sum(r[4] for r in mine) - sum({r[3] for r in mine})) <= 6


def test_flow_prefers_fresh_words():
    got = mixing.flow({0: 10, 1: 10, 2: 10}, {0: ("a",), 1: ("a", "b"), 2: ("b",)}, {"a": 15, "b": 15})
    assert got == {0: 10, 1: 10, 2: 10}
    assert mixing.flow({0: 10}, {0: ("a",)}, {"a": 50}) == {0: 30}
    assert mixing.targets_of({"a": 10, "b": 90}, {"a": 2, "b": 1}) == {"a": 30.0, "b": 70.0}


def test_toxicity(spark, odd):
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = [(d, y) for d, y in duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet'").fetchall() if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d].held_out for d, _ in labels) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    hits = sum(got[d].predicted and y for d, y in labels)
    assert hits / max(1, sum(got[d].predicted for d, _ in labels)) > 0.7 and hits / sum(y for _, y in labels) > 0.6  # a tenth of the labels are noise
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_toxicity(odd, none).collect()] == [0.0] * len(ODD)


def test_pooling_in_blocks():
    net, r = toxicity.Net(), np.random.default_rng(0)
    some = [r.integers(1, toxicity.BUCKETS, n).astype(np.int32) for n in (0, 1, 2, 700, 5)]
    assert np.allclose(net.pooled(some, block=64), np.concatenate([net.pooled([t]) for t in some]), atol=1e-6)


def base_spans(t):
    P = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for i, (k, p) in enumerate(P.items()):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum(int(c) if j % 2 == 0 else sum(divmod(2 * int(c), 10)) for j, c in enumerate(reversed(digits)))
            if {"email": True, "ip": k == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and double % 10 == 0, "phone": 10 <= len(digits) <= 15}[k]:
                out.append((m.start(), i, f"{k}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


def test_pii(spark, odd, empty):
    got = {r.doc_id: r for r in pii.op8_pii(spark, DIR).collect()}
    for d, t, _ in texts():
        assert got[d].base_sha256 == hashlib.sha256(base_spans(t or "").encode()).hexdigest()
    r, automaton = random.Random(2), pii._automaton()
    for _ in range(3000):
        t = "".join(r.choice("0123456789 -.+()@ab.") for _ in range(r.randint(0, 40)))
        assert ",".join(f"{k}:{s}:{e}" for k, s, e in pii.spans_of(t, automaton) if k in pii.BASE_KINDS) == base_spans(t)
    found = pii.find_personal_data(odd)
    assert found.count() == len(ODD) and pii.find_personal_data(empty).count() == 0
    hidden = odd.filter("doc_id = 7").select("text").join(found.filter("doc_id = 7")).select(pii.redact(F.col("text"), F.col("found")).alias("t")).head().t
    assert hidden == "plain text with mail [email] and [ip] and [phone] inside it"


def test_pii_accounts_and_urls():
    automaton = pii._automaton()
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.spans_of(t, automaton) if k in ("url", "account")]
    for scheme in ("http", "HTTP", "Http"):
        for lead in ("see", "sée", "😀", "İİ"):
            assert found(f"{lead} {scheme}://a.b/c, and") == [("url", f"{scheme}://a.b/c")]
    for n in (6, 60, 64, 65, 80, 5000):
        value = ("a1" * n)[:n]
        assert found(f"Token: {value}.") == [("account", value)]
    assert found("IBAN: DE89 3704 0044 0532 0130 00 and") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("iban GB82WEST12345698765432, x") == [("account", "GB82WEST12345698765432")]
    assert found("iban DE88 3704 0044 0532 0130 00") == []  # its checksum fails
    assert found("tokens 123456 and secretary99999") == [] and found("ACCOUNT NO. 12345678") == [("account", "12345678")]
    times = []
    for n in (4000, 32000):
        start = time.perf_counter()
        pii.spans_of("HTTP://x " * n + "token-" * n + "password secret " * n, automaton)
        times.append(time.perf_counter() - start)
    assert times[1] < 40 * times[0]  # eight times the text; a quadratic scan takes 64 times as long


def test_urls_odd(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (None, "HTTP://A.Example.ORG/es/x?q#f"), (3, "x://com/fr/"), (4, "x://com"), (5, "x://bad.net/p?utm_x=1&b=2&a=1"), (5, "x://bad.net/p?utm_x=1&b=2&a=1"), (6, "x://ok.net/")], "page_id long, url string")
    listed = spark.createDataFrame([("http://www.bad.net/p/?a=1&b=2",), ("http://www.bad.net/p/?a=1&b=2",)], "url string")
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, listed, urls.RULES).collect())
    assert got == [("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "com", "/fr/", "com/fr/", "allow"), ("4", "com", "", None, "allow"), ("5", "bad.net", "/p", None, "block"), ("5", "bad.net", "/p", None, "block"), ("6", "ok.net", "/", None, "allow"), ("None", "a.example.org", "/es/x", "example.org/es/", "block")]


def test_urls_false_positives(spark):
    """A filter of 16 blocks lets most unlisted URLs through; the join removes them. Extra and clashing columns do not matter."""
    pages = spark.createDataFrame([(i, f"https://h{i}.net/p/{i}", "x", "y", "z") for i in range(3000)], "page_id long, url string, name string, block string, listed string")
    listed = spark.createDataFrame([(f"http://www.h{i}.net/p/{i}/?utm_source=k",) for i in range(0, 3000, 2)], "url string")
    got = urls.judge_urls(pages, listed, urls.RULES, max_block_bits=4).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(0, 3000, 2)) and len(got) == 3000
    none = spark.createDataFrame([], "url string")
    assert {r.verdict for r in urls.judge_urls(pages, none, []).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), listed, urls.RULES).count() == 0
    many = [("block", f"h{i}.net/p/") for i in range(1500)]
    assert sum(r.verdict == "block" for r in urls.judge_urls(pages, none, many).collect()) == 1500


MASK = (1 << 64) - 1


def xx64_long(value, seed):
    """xxHash64 of one long, as Spark takes it."""
    return xxhash.xxh64_intdigest((value & MASK).to_bytes(8, "little"), seed & MASK)


def brute_signature(mers, m=order_minhash.SIZE):
    """From hashes of k-mers in text order: numbered, two drawn by each hash function, hashed in text order."""
    seen, numbered = defaultdict(int), []
    for at, h in enumerate(mers):
        numbered.append((h if not seen[h] else xxhash.xxh64_intdigest(seen[h].to_bytes(4, "little"), xx64_long(h, 42)), at))
        seen[h] += 1
    if not numbered:
        return []
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    out = []
    for j in range(m):
        drawn = [(signed(xxhash.xxh64_intdigest(j.to_bytes(4, "little"), xx64_long(h, 42))) >> 30, at) for h, at in numbered]
        classes = [sorted(x for x in drawn if (x[0] < 0) == c) for c in (True, False)]
        two = [(c or classes[1 - i])[0] for i, c in enumerate(classes)]
        first, second = two if two[0][1] <= two[1][1] else two[::-1]
        out.append(xx64_long(second[0], xx64_long(first[0], 42)) & 0x7FFFFFFF)
    return out


def brute_mers(text, k=3):
    w = (text or "").encode().split()
    digest = lambda words: __import__("functools").reduce(lambda seed, x: xxhash.xxh64_intdigest(x, seed), words, 42)
    return [digest(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [digest(w)] if w else []


def test_order_minhash_equals_brute_force(spark, odd):
    r = random.Random(6)
    docs = [(d, t) for d, t, _ in texts()][:60]
    docs += [(10_000 + i, " ".join(r.choice("abc") for _ in range(r.randint(0, 40)))) for i in range(60)]  # many repeated k-mers
    docs += [(20_000, None), (20_001, ""), (20_002, "one"), (20_003, "word " * 30000), (20_004, " ".join(f"w{i}" for i in range(40000)))]
    got = {x.doc_id: list(x.signature) for x in order_minhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        assert got[d] == brute_signature(brute_mers(t)), d
    assert order_minhash.fingerprints(odd).count() == len(ODD)


def check_edits(got, docs):
    sig = {}
    of = lambda t: sig.setdefault(t, brute_signature(brute_mers(t)))
    text = lambda s: "".join(f"{v:08x}" for v in s)
    like = lambda a, b: 1.0 if not a and not b else sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))
    for i, (d, t) in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), text(of(t)), text(of(edited)), like(of(t), of(edited)), like(of(t), of(nxt)))
        assert tuple(got[d][1:]) == want, d


def test_order_minhash(spark, empty):
    docs = [(d, t) for d, t, _ in texts()]
    rows = order_minhash.op10_order_minhash(spark, DIR).collect()
    check_edits({r.doc_id: r for r in rows}, docs)
    long = [r for r in rows if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.08 > 0.01 > np.mean([r.near_next for r in long])
    small = order_minhash.edited_fingerprints(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), range_bytes=20_000).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, rows))  # however many ranges
    assert order_minhash.edited_fingerprints(empty.select("doc_id", "text")).count() == 0
    one = spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")
    assert [r.near_next for r in order_minhash.edited_fingerprints(one).collect()] == [1.0]
    a = [f"w{i}" for i in range(300)]
    sets = [(0, a), (1, a[150:] + a[:150]), (2, a[:100] + ["new"] + a[101:])]
    sig = {r.doc_id: r.signature for r in order_minhash.fingerprints(spark.createDataFrame([(k, " ".join(w)) for k, w in sets], "doc_id long, text string")).collect()}
    like = lambda x, y: np.mean([p == q for p, q in zip(sig[x], sig[y], strict=True)])
    assert like(0, 2) > 0.85 > like(0, 1)  # the moved passage keeps its k-mers but not their order


def test_order_minhash_hot_ids(spark):
    """Null and repeated ids that fill several ranges: every row is there once and its next one follows it."""
    docs = [(None, f"text {i} without an id " * 5) for i in range(60)] + [(3, f"text {i} of one id " * 5) for i in range(60)] + [(i, f"plain {i} " * 20) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = order_minhash.with_next(df, range_bytes=700).filter("guest = 0").collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in rows))) == sorted(map(str, docs))
    assert len({r.range for r in rows if r.doc_id is None}) > 3 and len({r.range for r in rows if r.doc_id == 3}) > 3
    follow = {r.text: r.next_text for r in rows}
    at, seen = rows[0].text, []
    for _ in rows:
        seen.append(at)
        at = follow[at]
    assert len(set(seen)) == len(docs) and at == seen[0]
    ids = {t: d for d, t in docs}
    turns = sum((10**9 if ids[a] is None else ids[a]) > (10**9 if ids[b] is None else ids[b]) for a, b in zip(seen, seen[1:] + seen[:1], strict=True))
    assert turns == 1  # ascending, and back to the first once


def test_weak_labels(spark, odd, empty):
    got = {r.doc_id: r for r in weak_labels.op4_weak_labels(spark, "/root/testdata/sf0.01").collect()}
    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    assert np.mean([got[d].kept for d, q in labels if q == 1]) > 0.98 and np.mean([not got[d].kept for d, q in labels if q == 0]) > 0.8
    assert weak_labels.score_quality(odd).count() == len(ODD) and weak_labels.score_quality(empty).count() == 0
    assert weak_labels.keep_good(odd).columns == odd.columns


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, DIR)
        assert docs.columns == before.columns, name
        docs = spark.createDataFrame(docs.collect(), before.schema)
        assert 0 < docs.count(), name
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert len({r.sequence_id for r in rows}) * 2048 - sum(r.length for r in rows) < 2048 * len({r.sequence_id >> 40 for r in rows})


def test_mixing_of_few_sources_grows_with_its_rows(spark):
    """Two sources: eight times the rows take no more than some eight times as long (they took the square of it once)."""
    took = []
    for n in (4000, 4000, 32_000):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 90 + 1).cast("int")).alias("text"))
        start = time.time()
        rows = mixing.mix_sources(docs).groupBy("target").agg(F.sum("taken").alias("n")).collect()
        took.append(time.time() - start)
        assert all(abs(r.n - r.target) <= 1 for r in rows) and len(rows) == 2
    assert took[2] < 9 * took[1] + 5


@pytest.mark.parametrize("seed", range(3))
def test_labellers_accuracies_are_recovered_from_votes_alone(seed):
    rng, n, size = np.random.default_rng(seed), 20_000, len(weak_labels.LABELLERS)
    share, bad = np.array([0.8, 0.1, 0.06, 0.04]), np.full((4, size), 0.01)
    bad[1, [0, 1]], bad[2, [2, 3, 4]], bad[3, [5, 6]] = (0.9, 0.8), (0.85, 0.7, 0.6), (0.95, 0.9)
    kind = rng.choice(4, n, p=share)
    cast = np.where(rng.random((n, size)) < 0.05, weak_labels.ABSTAIN, np.where(rng.random((n, size)) < bad[kind], weak_labels.BAD, weak_labels.GOOD))
    patterns, at, counts = np.unique((cast * 3 ** np.arange(size)).sum(axis=1), return_inverse=True, return_counts=True)
    prior, prob, post = weak_labels.learn_labellers(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.03
    assert np.abs(prob[:, 0, weak_labels.BAD] - bad[0]).max() < 0.01
    assert np.abs(prob[:, 1, weak_labels.BAD] - share[1:] @ bad[1:] / 0.2).max() < 0.04
    assert ((post[at] >= 0.5) == (kind == 0)).mean() > 0.95


def test_labellers_of_odd_votes():
    none, one = np.zeros(0, np.int64), np.array([0])
    assert weak_labels.learn_labellers(none, none.astype(float))[2].shape == (0,)
    prior, prob, post = weak_labels.learn_labellers(one, np.array([5.0]))  # everyone abstains
    assert 0 < prior < 1 and post[0] > 0.49 and np.isfinite(prob).all()
