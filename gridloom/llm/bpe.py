"""Byte-level BPE encoding and decoding of texts of any length by a public rank file.

Texts of up to `chunk` characters are encoded where they are. Longer ones are cut into overlapping chunks, rows that Spark
deals out; each chunk is pre-tokenised from its own start. Neighbours are stitched at the first place in their overlap at
which both have a pre-token end, first of all at one that no reading can miss: where white space follows something else.
An end that only both readings agree on counts if the chunk before it is itself stitched to the start of the text. Chunks
without such a place join the run before them, so the ids are exact for every text. Runs are encoded in parallel and their
ids joined in order. Decoding concatenates the bytes of the ids.

Null texts count as empty and have no ids. Ids may be null or repeated, each row has its own result; other columns are
dropped; an empty table gives none.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shipping import ship
from .common import read

#: How far a decision of the pattern looks ahead ('ll, and the end of a run of one kind).
AHEAD = 4
#: Runs of white space from here on are not given to the library whole: its own pre-tokeniser would exhaust its stack.
LONG_BLANK = 2000
_CODECS: dict[str, Codec] = {}


class Codec:
    """Pre-tokeniser and ranks of a file, held once a worker."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.blank = regex.compile(rf"\s{{{LONG_BLANK}}}")
        self.pattern, self.newer = self._patterns(public_tokenizers.PATTERN, regex, tiktoken)
        self.known: dict[str, list[int]] = {}

    @staticmethod
    def _patterns(pattern: str, regex, tiktoken):
        """The pattern; and where letters or digits are of a newer Unicode than the library knows, a class of those."""
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([i]): i for i in range(256)}
        newer = []
        for kind in (r"\p{L}", r"\p{N}"):
            there = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={})
            known = set(there.decode_bytes(there.encode_ordinary(every)).decode())
            newer += [c for c in regex.findall(kind, every) if c not in known]
        return regex.compile(pattern), regex.compile(f"[{''.join(map(regex.escape, newer))}]") if newer else None

    def ends(self, text: str) -> np.ndarray:
        """Where the pre-tokens of a text end."""
        if not text.isascii() and self.newer:  # such code points count as signs
            text = self.newer.sub("§", text)
        return np.fromiter((m.end() for m in self.pattern.finditer(text)), np.int64)

    def ids(self, text: str) -> np.ndarray:
        if not self.blank.search(text):
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        out, low = [], 0
        for high in self.ends(text).tolist():
            out += self._piece(text[low:high])
            low = high
        return np.asarray(out, np.uint32)

    def _piece(self, piece: str) -> list[int]:
        if piece.isspace() and len(piece) >= LONG_BLANK:
            return self.encoding._encode_single_piece(piece)
        return self.encoding.encode_ordinary(piece)


def codec(ranks_path: str) -> Codec:
    return _CODECS.get(ranks_path) or _CODECS.setdefault(ranks_path, Codec(ranks_path))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _encoder(ranks_path: str, text_at: int, names: list[str], step: int = 4 << 20):
    """Other columns as they are, then the ids of the text column; batches of some step characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            low = held = 0
            done: list[np.ndarray] = []
            for i in range(batch.num_rows):
                text = batch.column(text_at)[i].as_py() or ""
                done.append(own.ids(text))
                held += len(text)
                if held >= step or i + 1 == batch.num_rows:
                    part = batch.slice(low, len(done))
                    yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(part.columns) if k != text_at), _lists(done)], names=names)
                    low, held, done = i + 1, 0, []

    return run


def _chunked(chunk: int, overlap: int):
    """Overlapping chunks of long texts, each with its place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, doc_id, text in frame.itertuples(index=False):
                for idx, low in enumerate(range(0, max(len(text) - overlap, 1), chunk)):
                    yield pd.DataFrame({"key": [key], "doc_id": pd.array([doc_id], "Int64"), "idx": [idx], "low": [low], "text": [text[low : low + chunk + overlap]]})

    return run


def _pretokenised(ranks_path: str, chunk: int, overlap: int):
    """Adds left and right: pre-token ends in the overlap with the chunk before and after, and sure: those at a blank."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(ranks_path)
        for frame in frames:
            left, right, sure = [], [], []
            for text, low in zip(frame["text"], frame["low"], strict=True):
                ends = own.ends(text)
                head = ends[ends <= overlap - AHEAD]
                tail = ends[(ends >= chunk) & (ends <= chunk + overlap - AHEAD)]
                left.append(head + low)
                right.append(tail + low)
                sure.append(np.array([e + low for e in head.tolist() if e < len(text) and text[e].isspace() and not text[e - 1].isspace()], np.int64))
            yield frame.assign(left=left, right=right, sure=sure)

    return run


def stitched(docs: DataFrame, ranks_path: str, chunk: int, overlap: int) -> DataFrame:
    """key, doc_id, run, text: long texts in runs that begin and end with pre-tokens."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    chunks = rows.mapInPandas(_chunked(chunk, overlap), "key long, doc_id long, idx long, low long, text string").repartition("key", "idx")
    cut = chunks.mapInPandas(_pretokenised(ranks_path, chunk, overlap), "key long, doc_id long, idx long, low long, text string, left array<long>, right array<long>, sure array<long>")
    order = W.partitionBy("key").orderBy("idx")
    both = F.array_intersect("left", F.lag("right").over(order))
    found = cut.withColumn("both", both).withColumn("certain", F.array_min(F.array_intersect("both", "sure")))
    found = found.withColumn("agreed", F.coalesce("certain", F.array_min("both")))
    kind = F.when((F.col("idx") == 0) | F.col("certain").isNotNull(), 2).when(F.col("agreed").isNull(), 0)
    anchored = F.last(kind, ignorenulls=True).over(order) == 2
    start = F.when(F.col("idx") == 0, 0).when(F.col("anchored"), F.col("agreed"))
    found = found.withColumn("anchored", anchored).withColumn("start", start)
    found = found.withColumn("begin", F.coalesce("start", "low")).withColumn("run", F.count("start").over(order)).withColumn("end", F.lead("begin").over(order))
    part = F.when(F.col("end").isNull(), F.expr("substring(text, CAST(begin - low + 1 AS INT))")).otherwise(F.expr("substring(text, CAST(begin - low + 1 AS INT), CAST(end - begin AS INT))"))
    parts = found.select("key", "doc_id", "run", "idx", part.alias("part")).repartition("key", "run")
    joined = parts.groupBy("key", "run").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("idx", "part"))).alias("parts"))
    return joined.select("key", "doc_id", "run", F.array_join("parts.part", "").alias("text"))


def encoded(docs: DataFrame, ranks_path: str, chunk: int = 1 << 16, overlap: int = 1 << 11) -> DataFrame:
    """doc_id, ids of all rows of docs (doc_id, text), special tokens being ordinary text. overlap is at most chunk."""
    if not AHEAD < overlap <= chunk:
        raise ValueError("the overlap lies between a few characters and the chunk")
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    long_ = F.length("text") > chunk + overlap
    short = docs.filter(F.coalesce(~long_, F.lit(True))).mapInArrow(_encoder(ranks_path, 1, ["doc_id", "ids"]), "doc_id long, ids array<int>")
    runs = stitched(docs.filter(long_), ranks_path, chunk, overlap).select("key", "doc_id", "run", "text")
    runs = runs.mapInArrow(_encoder(ranks_path, 3, ["key", "doc_id", "run", "ids"]), "key long, doc_id long, run long, ids array<int>")
    whole = runs.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("run", "ids"))).alias("runs"))
    return short.unionByName(whole.select("doc_id", F.flatten("runs.ids").alias("ids")))


def _decoder(ranks_path: str, ids_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            ids = batch.column(ids_at)
            at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
            taken = pc.take(own.tokens, ids.flatten())
            ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
            data = taken.buffers()[2] or pa.py_buffer(b"")
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends[at].astype(np.int64).tobytes()), data])
            yield pa.RecordBatch.from_arrays([*batch.columns, out.cast(pa.binary())], names=names)

    return run


def decoded(encodings: DataFrame, ranks_path: str) -> DataFrame:
    """Adds bytes: what the ids stand for, concatenated (a text's bytes may be cut anywhere). Null ids count as none."""
    ship(encodings.sparkSession)
    names = encodings.columns
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encodings.schema.fields)
    return encodings.mapInArrow(_decoder(ranks_path, names.index("ids"), [*names, "bytes"]), f"{types}, bytes binary")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = default_ranks()
    out = decoded(encoded(read(spark, sf_dir, "documents"), ranks), ranks)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
