"""Target-distribution importance resampling over hashed n-grams, with prefix CRCs.

A document is scanned once: its words, joined by one space, run through CRC-32,
and the running value behind every word is stored. The CRC of any run of words
follows from two of these by cancelling the first, shifted by the run's length
over GF(2): crc(ab) = shift(crc(a), len(b)) xor crc(b). Both passes (counting
buckets, weighing documents) read that table; no n-gram is ever a string.

Passes are narrow Arrow work. Counts of buckets combine per task and have as
many rows as there are buckets; that table alone reaches the driver. The draw
is an exact rank over slim rows by range partitions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolframe.llm.common import ship, slices, written
from toolframe.operators.rank import range_rank

BUCKETS = 10_000
ORDERS = 3
RUN_BYTES = 1 << 18  # of stored CRCs (a quarter as many words) that are worked on at once: tables of n-grams stay small
NEAR = 256  # shifts below this many bytes have a table each; longer ones are made of powers of two
SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_NORMAL = bytes.maketrans(SEPARATORS + bytes(range(65, 91)), b" " * len(SEPARATORS) + bytes(range(97, 123)))


def _crc_table() -> np.ndarray:
    """What CRC-32 adds for each byte that leaves the register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _crc_table()
_UNSTEP = np.empty(256, np.int64)  # the table entries' leading bytes are all different
_UNSTEP[_TABLE >> np.uint32(24)] = np.arange(256)


def _shifted(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values on the four bytes (4 x 256), applied to x."""
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


class Shifts:
    """CRCs as if zero bytes followed, for any number of them."""

    def __init__(self):
        each = (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
        near = [each]
        for _ in range(NEAR):
            near.append((near[-1] >> np.uint32(8)) ^ _TABLE[near[-1] & 255])
        self.near = np.stack(near[:NEAR])
        self.powers = [near[NEAR]]  # by 256, 512, 1024 ... bytes

    def apply(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """x shifted by n bytes, element by element."""
        low = (n & (NEAR - 1)).astype(np.int64)
        out = self.near[low, 0, x & 255] ^ self.near[low, 1, (x >> 8) & 255] ^ self.near[low, 2, (x >> 16) & 255] ^ self.near[low, 3, x >> 24]
        high, k = n // NEAR, 0
        while high.any():
            if k == len(self.powers):
                self.powers.append(_shifted(self.powers[-1], self.powers[-1]))
            at = np.flatnonzero(high & 1)
            out[at] = _shifted(self.powers[k], out[at])
            high, k = high >> 1, k + 1
        return out


_SHIFTS: Shifts | None = None


def shifts() -> Shifts:
    global _SHIFTS
    if _SHIFTS is None:
        _SHIFTS = Shifts()
    return _SHIFTS


def running(text: str | None) -> tuple[int, bytes, bytes]:
    """(words, CRC behind each word and its space, bytes of each word) of a text; CRCs in 4 bytes, lengths in 1 or 4 each."""
    crc, crcs, run = 0, [], zlib.crc32
    words = (text or "").encode().translate(_NORMAL).split()
    for w in words:
        crc = run(b" ", run(w, crc))
        crcs.append(crc)
    sizes = list(map(len, words))
    return len(words), np.array(crcs, np.uint32).tobytes(), np.array(sizes, np.uint8 if max(sizes, default=0) < 256 else np.uint32).tobytes()


def prefixes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as (doc_id, h, n_words, crcs, sizes): the running CRCs of every text. Null has no words. h: hash of the text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n, crcs, sizes = zip(*map(running, b.column(2).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(crcs, pa.binary()), pa.array(sizes, pa.binary())],
                                             names=["doc_id", "h", "n_words", "crcs", "sizes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, n_words long, crcs binary, sizes binary")


def gram_crcs(counts: np.ndarray, crcs: list[bytes], sizes: list[bytes], orders: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (document of each n-gram, CRC-32 of each n-gram) over documents given by ``running``."""
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(doc):
        return
    behind = np.frombuffer(b"".join(crcs), np.uint32)
    length = np.concatenate([np.frombuffer(s, np.uint8 if len(s) == n else np.uint32).astype(np.int64) for n, s in zip(counts, sizes, strict=True) if n])
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    start = np.where(first, np.uint32(0), np.concatenate([[np.uint32(0)], behind[:-1]]))  # before each word
    register = ~behind  # one step back over the space: the CRC at the word's end
    byte = _UNSTEP[register >> np.uint32(24)]
    end = ~(((register ^ _TABLE[byte]) << np.uint32(8)) | (byte.astype(np.uint32) ^ np.uint32(32)))
    stops = np.cumsum(length + 1) - 1
    at = stops - length
    for m in range(1, min(orders, int(counts.max())) + 1):
        i = np.flatnonzero(doc[: len(doc) - m + 1] == doc[m - 1:])
        j = i + m - 1
        yield doc[i], end[j] ^ shifts().apply(start[i], stops[j] - at[i])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[bytes], list[bytes]]]:
    for b in slices(batches, "crcs", RUN_BYTES):
        column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: E731,B023
        yield b, column("n_words").to_numpy(zero_copy_only=False).astype(np.int64), column("crcs").to_pylist(), column("sizes").to_pylist()


def bucket_counts(table: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """(bucket, n): how many n-grams of all documents fall into each bucket; empty buckets are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, n, crcs, sizes in _batches(batches):
            for _, crc in gram_crcs(n, crcs, sizes, orders):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], names=["bucket", "n"])

    return table.select("n_words", "crcs", "sizes").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 * log of the ratio of a bucket's smoothed shares, target over source), by bucket. What reaches the driver: two numbers per bucket."""
    s, t = [0.0] * buckets, [0.0] * buckets
    for counts, out in ((source, s), (target, t)):
        for r in counts.collect():
            out[r["bucket"]] = float(r["n"])
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return [math.floor(1000 * math.log((t[i] + 1) * all_s / ((s[i] + 1) * all_t))) for i in range(buckets)]


def weights(table: DataFrame, gain: list[int], orders: int = ORDERS) -> DataFrame:
    """(doc_id, h, n_words, n_features, weight): the sum of gains over each document's n-grams."""
    value = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, n, crcs, sizes in _batches(batches):
            features, weight = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for doc, crc in gram_crcs(n, crcs, sizes, orders):
                per = np.bincount(doc, minlength=len(n))
                features += per
                sums = np.concatenate([[0], np.cumsum(value[crc % np.uint32(len(value))])])
                ends = np.cumsum(per)
                weight += sums[ends] - sums[ends - per]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(features), pa.array(weight)], names=["doc_id", "h", "n_words", "n_features", "weight"])

    return table.select("doc_id", "h", "n_words", "crcs", "sizes").mapInArrow(run, "doc_id long, h long, n_words long, n_features long, weight long")


def score(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = BUCKETS, orders: int = ORDERS, seed: int = 42) -> DataFrame:
    """A row per document: doc_id, h, n_features, weight, score, rank.

    docs: doc_id, text; target: text; other columns aren't read. Features: all
    runs of 1 to ``orders`` words, repeats counted; weight: the sum of their
    buckets' gains; score: weight plus Gumbel noise from (seed, doc_id). Of the
    N documents with at least ``min_words`` words the floor(percent * N / 100)
    highest scores are drawn and ranked from 1, ties to the smaller doc_id (a
    null id, hashed as an empty one, first); rank is null for the rest. Null and
    empty texts have no features and weight 0. Rows that repeat an id are
    documents of their own, ranked by text hash where all else is equal. No
    documents give no rows; an empty target leaves every bucket its smoothed
    share.
    """
    table = written(prefixes(docs), "crc-prefixes")
    wanted = prefixes(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    gain = gains(bucket_counts(table, buckets, orders), bucket_counts(wanted, buckets, orders), buckets)
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((head + 0.5) / 4294967296.0)))
    scored = written(weights(table, gain, orders).withColumn("score", F.col("weight") + noise), "scores")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first(), F.col("h")]
    ranked = range_rank(able, order)
    names = ["doc_id", "h", "n_features", "weight", "score"]
    place = F.when(F.col("rank") <= drawn, F.col("rank").cast("long")).alias("rank")
    return ranked.select(*names, place).unionByName(scored.where(F.col("n_words") < min_words).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, all columns, with ``weight``, ``score`` and ``rank``; options as in ``score``. Rows that repeat id and text come together."""
    drawn = score(docs, target, **options).where("rank is not null").groupBy("doc_id", "h").agg(F.min("rank").alias("rank"), F.first("weight").alias("weight"), F.first("score").alias("score"))
    made = ("weight", "score", "rank")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"))
    found = keyed.join(drawn, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("h")))
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in made], *made)


def digests(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "n_features", "weight", "score", "rank")
