"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Method: the cost of a piece of n tokens is ``linear * n + quadratic * n**2`` (projections, and attention within
the document). Pieces are taken in descending cost (equal ones in the order of the rows); each goes to the sequence of
lowest cost that has room for it, found by a tree over the tokens of room. Only a piece that no sequence can hold is cut:
the lowest sequence takes what it has room for. So every sequence but the last few of a block is full.

Scale: nothing is shuffled. Each task tokenises its own rows and packs them in blocks of at most
``block_tokens`` tokens (a longer document is a block of its own), so memory is bounded by the block and padding
by one sequence a block. Sequence ids are (partition, counter); a retried task makes the same ids again.

Defined results: a null or empty text is the end token alone; a null doc_id stays null and its row is packed like
any other; repeated rows are packed once each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import gc
import heapq
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from .common import read

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"

# The tokenizer's own split pattern, for lower-case ASCII (fixed values).
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_TOUCHING = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s][.,])|(?<=_[.,]))")
_CACHES: dict[str, "WordIds"] = {}


class WordIds(dict):
    """Blank-delimited chunk -> its ids as little-endian uint32 bytes.

    The tokenizer never merges across blanks, so a text's ids are those of its chunks in turn. Where it makes no
    difference to the tokenizer's pieces, texts are lower-cased and full stops and commas set apart first, so that
    most chunks are one piece and go to the tokenizer's own merges; all others go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.model = self.tokenizer.model
        # Byte-level BPE writes bytes as characters: printable ones as themselves, the others from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.table = {b: 256 + i for i, b in enumerate(hidden)}

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, text: str) -> bytes:
        """The ids of one lower-case piece."""
        if not (text.isascii() and text.isprintable()):
            text = text.encode().decode("latin-1").translate(self.table)
        ids = [t.id for t in self.model.tokenize(text)]
        return pack(f"<{len(ids)}I", *ids)

    def learn(self, chunks: set[str]) -> None:
        piece = self.piece
        for chunk in chunks:
            if chunk.isalpha() and (chunk.isascii() and chunk.islower() or _latin_lower(chunk)):
                self[chunk] = piece(chunk)
            elif chunk.isascii() and "<|" not in chunk:
                self[chunk] = b"".join([self.get(p) or piece(p) for p in _ASCII_PIECES.findall(chunk.lower())])
            else:
                self[chunk] = self.encode(chunk)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, learning what is new in groups of texts of about a million characters."""
        for group in _groups(texts, 1 << 20):
            chunks = [None if _SEPARATORS.search(t) else _plain(t).split() for t in group]
            if len(self) > self.most:
                self.clear()
            self.learn(set().union(*filter(None, chunks)) - self.keys())
            for text, words in zip(group, chunks, strict=True):
                if words is None:
                    yield self.encode(text)
                elif len(words) < 2:
                    yield b"".join([self[w] for w in words])
                else:
                    yield b"".join(itemgetter(*words)(self))


def _latin_lower(chunk: str) -> bool:
    return max(chunk) < "\u0100" and chunk.islower()


def _plain(text: str) -> str:
    """Lower-cased, full stops and commas set apart, if these touch no other sign and all is Latin-1; else as it is."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    if "<|" in text or _TOUCHING.search(text):
        return text
    return text.lower().replace(",", " ,").replace(".", " .")


def _groups(texts: list[str], most: int) -> Iterator[list[str]]:
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


class _Open:
    """Sequences with room left: the lowest (load, sequence) of those with at least n tokens of room, by a tree over rooms."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.none = (float("inf"), -1)
        self.tree = [self.none] * (2 * self.size)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]

    def _climb(self, room: int) -> None:
        tree, heap, i = self.tree, self.heaps[room], room + self.size
        tree[i] = heap[0] if heap else self.none
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(self, room: int, load: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (load, sequence))
        self._climb(room)

    def take(self, room: int) -> None:
        """Remove the lowest of those with just this room."""
        heapq.heappop(self.heaps[room])
        self._climb(room)

    def lowest(self, n: int) -> tuple[float, int]:
        tree, best, low, high = self.tree, self.none, n + self.size, 2 * self.size
        while low < high:
            if low & 1:
                best = min(best, tree[low])
                low += 1
            low >>= 1
            high >>= 1
        return best


def pack_block(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of one block, and how many sequences it fills."""
    out, n_seq, rest = [], 0, []
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((d, start, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            rest.append((-(linear * (n % capacity) + quadratic * (n % capacity) ** 2), d, n - n % capacity, n % capacity))
    bins = -(-sum(r[3] for r in rest) // capacity)
    used = dict.fromkeys(range(n_seq, n_seq + bins), 0)
    open_ = _Open(capacity)
    for s in reversed(used):
        open_.heaps[capacity].append((0.0, s))
    heapq.heapify(open_.heaps[capacity])
    open_._climb(capacity)
    heapq.heapify(rest)
    while rest:
        cost, d, start, n = heapq.heappop(rest)
        load, s = open_.lowest(n)
        if s < 0:  # cut: the lowest sequence takes what it has room for
            load, s = open_.lowest(1)
        open_.take(capacity - used[s])
        part = min(n, capacity - used[s])
        out.append((d, start, part, s, used[s]))
        used[s] += part
        if used[s] < capacity:
            open_.put(capacity - used[s], load + linear * part + quadratic * part * part, s)
        if part < n:
            left = n - part
            heapq.heappush(rest, (-(linear * left + quadratic * left * left), d, start + part, left))
    return out, n_seq + bins


def _packer(tokenizer: str, capacity: int, linear: float, quadratic: float, block_tokens: int, end_id: int, with_ids: bool):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def emit(block: list[tuple[int | None, bytes]], first: int) -> tuple[pa.RecordBatch, int]:
        pieces, n = pack_block([len(b) // 4 for _, b in block], capacity, linear, quadratic)
        cols: list[list] = [[] for _ in range(9)]
        for d, start, length, seq, offset in pieces:
            doc_id, ids = block[d]
            part = ids[4 * start : 4 * (start + length)]
            for col, v in zip(cols, (doc_id, start, length, zlib.crc32(part), len(ids) // 4, first + seq, offset, linear * length + quadratic * length * length, part if with_ids else None), strict=True):
                col.append(v)
        kinds = [pa.int64()] * 7 + [pa.float64(), pa.binary()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names), first + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _CACHES.get(tokenizer) or _CACHES.setdefault(tokenizer, WordIds(tokenizer))
        collects = gc.isenabled()
        gc.disable()  # millions of live strings and no cycles
        try:
            yield from blocks(batches, ids)
        finally:
            if collects:
                gc.enable()

    def blocks(batches: Iterator[pa.RecordBatch], ids: WordIds) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        block, held = [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, got in zip(batch.column(0).to_pylist(), ids.ids(texts), strict=True):
                got += end
                if held and held + len(got) > 4 * block_tokens:
                    out, sequence = emit(block, sequence)
                    block, held = [], 0
                    yield out
                block.append((doc_id, got))
                held += len(got)
        if block:
            yield emit(block, sequence)[0]

    return run


def pack_sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048, block_tokens: int = 1 << 22, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text); with_ids adds each piece's ids as little-endian uint32."""
    ship(docs.sparkSession)
    out = docs.select("doc_id", "text").mapInArrow(_packer(tokenizer, capacity, linear, quadratic, block_tokens, end_id, with_ids), SCHEMA)
    return out if with_ids else out.drop("ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(read(spark, sf_dir, "documents"), default_tokenizer())
