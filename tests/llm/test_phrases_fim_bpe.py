"""Collocations, fill-in-middle and byte-level BPE against brute force, and their edge cases."""

import base64
import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest

from gridloom.llm import bpe, collocations, fim

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, ids string, n long, phrase string, form string"
MORE = ("x", 7, "p", "f")


def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{DIR}/documents.parquet' ORDER BY doc_id").fetchall()


def frame(spark, rows):
    return spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA)


ODD = [
    (1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (None, "naïve CAFÉ – don't we'll <P", "en"), (5, "a<S>b", "fr"), (6, "<", "fr"), (6, "<", "fr"),
    (7, "word " * 3000, "de"), (8, "ab1é漢字😀 <M", "und"), (9, "one,two;three. One,two one two\ttwo\x0bone", None), (10, "<P" + ">", "en"), (11, "x<S<S", "en"),
]


# Collocations


def phrases(docs, max_n, least, contained, top):
    f, total = Counter(), Counter()
    for _, text, lang in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, max_n + 1):
                f.update((lang or "und", *words[i : i + n]) for i in range(len(words) - n + 1))
    frequent = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *p), a in frequent.items():
        held = any(q[0] == lang and len(q) > len(p) + 1 and 100 * b >= contained * a and any(list(q[1 + i : 1 + i + len(p)]) == p for i in range(len(q) - len(p))) for q, b in frequent.items())
        if not held:
            cuts = [(2_000_000 * a // (f[(lang, *p[:k])] + f[(lang, *p[k:])]), k, f[(lang, *p[:k])], f[(lang, *p[k:])]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((" ".join(p), a, left, right, total[lang], score))
    return sorted((lang, i, *r) for lang, rows in out.items() for i, r in enumerate(sorted(rows, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top], 1))


@pytest.mark.parametrize("block,bits", [(1 << 24, 1 << 20), (300, 64)])
def test_collocations_equal_brute_force(spark, monkeypatch, block, bits):
    docs = [(i, t[:900], lang) for i, t, lang in documents()] + ODD
    monkeypatch.setattr(collocations.texts_in_blocks, "__defaults__", (block,))
    got = collocations.collocations(frame(spark, docs), max_n=4, least=5, contained=80, top=40, bits=bits).collect()
    assert sorted(map(tuple, got)) == phrases(docs, 4, 5, 80, 40)


def test_blocks_of_words_cut_where_pieces_end():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ,") for _ in range(n)).encode() for n in (0, 1, 50, 400)] + [b"a " * 100]
    for text in texts:
        parts = list(collocations._parts(text, 20))
        assert b"".join(parts) == text and all(p[-1:] == b"," for p in parts[:-1])


def test_collocations_of_three_words_ties_and_nothing(spark):
    docs = [(1, "b a, b a, a b, a b", "en"), (2, "c d e, c d e", "en")]
    got = collocations.collocations(frame(spark, docs), max_n=3, least=2, top=None).collect()
    assert sorted(map(tuple, got)) == phrases(docs, 3, 2, 80, None)
    assert [r.phrase for r in sorted(got, key=lambda r: r.rank)] == ["c d e", "a b", "b a"]
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None)])).count() == 0


# Fill-in-middle


def middle(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("block", [fim.BLOCK, 64])
def test_fill_in_middle_equals_brute_force(spark, monkeypatch, block):
    docs = ODD + [(100 + i, t, None) for i, t in enumerate(["é", "<<P>", "aA<S", "<P<S<M", "漢字" * 40, "a" * 500, "<M>"] * 5)] + documents()
    monkeypatch.setattr(fim, "BLOCK", block)
    parts = [fim.Scan([(t or "").encode() for _, t, _ in docs[i : i + 7]]).n_units.tolist() for i in range(0, len(docs), 7)]
    assert [n for p in parts for n in p] == [middle(d, t)[0] for d, t, _ in docs]
    rows = fim.restored(fim.fill_in_middle(frame(spark, docs))).collect()
    want = sorted(str((d, *middle(d, t), t or "")) for d, t, _ in docs)
    assert sorted(str(tuple(r)) for r in rows) == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(spark):
    assert fim.restored(fim.fill_in_middle(frame(spark, []))).count() == 0


def test_dfa_counts_as_a_walk_byte_by_byte():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("<>PSMaZé漢 \n1") for _ in range(rng.randrange(30)))
        state = points = units = sentinels = 0
        for byte in text.encode():
            kind = fim.CLASSES[byte]
            points, units, sentinels = points + fim.POINT[state, kind], units + fim.UNIT[state, kind], sentinels + fim.SENTINEL[state, kind]
            state = fim.TO[state, kind]
        assert (points, units, sentinels) == (len(text), len(re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)), len(re.findall("<[PSM]>", text)))
        scan = fim.Scan([b"<", text.encode(), b"P>"])
        assert (scan.n_units[1], scan.n_sentinels.tolist()) == (units, [0, sentinels, 0])


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    rng = random.Random(11)
    kinds = ["ab", "a b", "'s ll", "  \n", "漢字かな", "1 2", "don't we'll", "!?. ", "é́ñ ", "՘֋ x", "😀  ", "'", "a' 'l"]
    out = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(400))) for _ in range(120)]
    return out + [" " * 300, "a" * 300, " " * 150 + "x" + "\n" * 150, "漢" * 300, "'" * 300, "'ll" * 100, "", "<|endoftext|>" * 20]


@pytest.mark.parametrize("chunk,overlap", [(16, 16), (50, 12), (1 << 16, 1 << 11)])
def test_chunked_encoding_equals_the_library(spark, library, chunk, overlap):
    docs = [(i, t, "en") for i, t in enumerate(hard_texts())] + ODD
    got = bpe.decoded(bpe.encoded(frame(spark, docs), bpe.default_ranks(), chunk, overlap), bpe.default_ranks()).collect()
    want = sorted(str((d, library.encode_ordinary(t or ""), (t or "").encode())) for d, t, _ in docs)
    assert sorted(str((r.doc_id, r.ids, bytes(r.bytes))) for r in got) == want


def test_whole_query_equals_the_library(spark, library):
    rows = bpe.op13_bpe(spark, DIR).collect()
    ids = {d: library.encode_ordinary(t or "") for d, t, _ in documents()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(d, len(ids[d]), sha(" ".join(map(str, ids[d])).encode()), sha((t or "").encode())) for d, t, _ in documents()}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_long_blanks_that_the_library_cannot_take(spark, library):
    text = "x" + " " * 400_000 + "y" + "\n" * 5000 + "z"
    got = bpe.decoded(bpe.encoded(frame(spark, [(1, text, None)]), bpe.default_ranks(), 1 << 14, 1 << 10), bpe.default_ranks()).head()
    assert bytes(got.bytes).decode() == text
    blank = lambda n, c=" ": library._encode_single_piece(c * n)
    assert got.ids == [*library.encode_ordinary("x"), *blank(399_999), *library.encode_ordinary(" y"), *blank(4999, "\n"), *library.encode_ordinary("\nz")]


def test_encoding_of_nothing(spark):
    assert bpe.decoded(bpe.encoded(frame(spark, []), bpe.default_ranks()), bpe.default_ranks()).count() == 0
    with pytest.raises(ValueError):
        bpe.encoded(frame(spark, []), bpe.default_ranks(), 10, 20)
