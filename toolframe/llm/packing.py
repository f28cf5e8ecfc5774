"""Packing in the order of a space-filling curve.

Each document's hashed bag of words is projected by signs to a few
coordinates; the Hilbert index of their cell is its key. Documents are
range-sorted by (key, tie-break of the id), so neighbours on the curve lie
together and a key that a third of all documents share is still split. Every
range is one stream of ids, cut every ``length`` ids; the rest of a stream is
cut into powers of two, which need no padding. Texts are shuffled once and
tokenised once, after the shuffle, in bounded memory.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolframe.llm.common import MAX_CHARS, WHITE, mix64, ship, slices, text_words, word_hashes

DIMENSIONS, BITS = 4, 8  # coordinates, and binary digits of each
END_ID = 1


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of points (n, dims) with ``bits`` binary digits each."""
    x = points.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the rotations and reflections of each level, top down
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for d in range(dims):
            on = (x[d] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one != 0, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << one | (x[d] >> np.uint64(b) & one)
    return key


def word_cells(texts: pa.Array, dims: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Each text's cell. Every whole word is hashed; the hash's bits are the signs with which each distinct word adds
    1 + ln(count) to the coordinates, which are scaled by the vector's length, so that frequent words don't push long texts to the cube's faces. One pass over the batch's bytes, long texts in runs."""
    _, at, body = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(at, wide)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    if edges[-1] - edges[0] > 2 * MAX_CHARS:
        each = [text_words(t or "", lower=False) for t in texts.to_pylist()]
        hashes, owner = np.concatenate(each), np.repeat(np.arange(len(texts)), [len(x) for x in each])
    else:
        data = np.frombuffer(body, np.uint8)[edges[0]: edges[-1]] if body is not None else np.empty(0, np.uint8)
        edges -= edges[0]
        data = np.insert(data, edges[1:-1], 32)  # texts are borders of words too
        hashes, starts = word_hashes(data, WHITE[data])
        owner = np.searchsorted(edges[:-1] + np.arange(len(texts)), starts, side="right") - 1
    order = np.lexsort((hashes, owner))
    hashes, owner, fresh = hashes[order], owner[order], np.ones(len(order), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    weight = 1 + np.log(np.diff(first, append=len(order)))
    hashes, owner = hashes[first], owner[first]
    signs = [2 * (hashes >> np.uint64(d) & np.uint64(1)).astype(np.float64) - 1 for d in range(dims)]
    total = np.stack([np.bincount(owner, weights=weight * x, minlength=len(texts)) for x in signs], axis=1)
    size = np.bincount(owner, weights=weight ** 2, minlength=len(texts)) ** 0.5
    return np.clip((total / np.maximum(size, 1)[:, None] + 4) / 8 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)


#: How a byte-level tokenizer splits a text before its merges, and the order of its printable bytes (fixed values).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Tokens:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Reads a byte-level BPE file of the tokenizers library and runs its
    vocabulary through tiktoken, which gives the same ids several times faster
    (the tests hold them against the library). Added tokens' strings in a text
    become their ids, as in the library.
    """

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters = {chr(b): b for b in _PRINTABLE}
        letters |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
        added = {t["content"]: t["id"] for t in said["added_tokens"]}
        vocab = said["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
        if said["pre_tokenizer"]["type"] != "ByteLevel" or [vocab["".join(m)] for m in pairs] != list(range(256, 256 + len(pairs))):
            raise ValueError("this packer needs a byte-level BPE file whose ids are the order of its merges")
        self.own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> bytes:
        return self.own.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One encoder per worker process and file."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def _powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Stream:
    """One range's stream: gives out pieces as sequences fill; what hangs over is cut by powers of two at the end."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence, self.filled = length, first, 0
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the sequence that isn't full

    def _rows(self, parts: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, n in parts:
            size = len(ids) // 4
            yield doc, start, size, zlib.crc32(ids), n, self.sequence, at
            at += size
        self.sequence += 1

    def add(self, doc: int, ids: bytes) -> Iterator[tuple]:
        n, at = len(ids) // 4, 0
        while at < n:
            take = min(n - at, self.length - self.filled)
            self.open.append((doc, at, ids[4 * at: 4 * (at + take)], n))
            self.filled += take
            at += take
            if self.filled == self.length:
                yield from self._rows(self.open)
                self.open, self.filled = [], 0

    def close(self) -> Iterator[tuple]:
        for size in _powers(self.filled):
            now = []
            while size:
                doc, start, ids, n = self.open.pop(0)
                take = min(size, len(ids) // 4)
                now.append((doc, start, ids[: 4 * take], n))
                if 4 * take < len(ids):
                    self.open.insert(0, (doc, start + take, ids[4 * take:], n))
                size -= take
            yield from self._rows(now)
        self.filled = 0


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; whole texts are packed. Every
    row is a document of its own, repeated rows and null ids too (their
    pieces carry the id, or null). Other columns are ignored; no rows give no
    rows. Sequence ids are unique, not dense: range number << 40 plus a count.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            ids = b.column(0)
            spread = mix64(np.asarray(ids.fill_null(0)).astype(np.uint64)) >> np.uint64(64 - 62 + DIMENSIONS * BITS)
            curve = hilbert(word_cells(b.column(1)), BITS)
            key = curve << np.uint64(62 - DIMENSIONS * BITS) | spread
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *b.columns], names=["k", "i", "t"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = tokens(tokenizer), np.asarray([end_id], "<u4").tobytes()
        stream, out = Stream(length, TaskContext.get().partitionId() << 40), []
        for b in slices(batches, "t"):
            for i, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out.extend(stream.add(i, (own.encode(t) if t else b"") + end))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_ARROW)
                out = []
        out = list(stream.close())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_ARROW)

    ship(docs.sparkSession)
    slim: list[Column] = [F.col(id_col).cast("long").alias("i"), F.col(text).alias("t")]
    keyed = docs.select(*slim).mapInArrow(keys, "k long, i long, t string")
    return keyed.repartitionByRange("k").sortWithinPartitions("k", "i").mapInArrow(cut, PIECE)
