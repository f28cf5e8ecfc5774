"""Document fingerprints by SimHash, and search within a Hamming radius.

Terms are pairs of neighbouring words (the word itself where there is only
one), A-Z lower-cased. Each distinct term votes on the sign of 64 bits with
weight 1 + ln(count). Fingerprints within the radius are found by block
tables: the bits are cut into blocks, and for every choice of blocks that must
agree (all but ``radius`` of them) a table is keyed by those blocks; two
fingerprints within the radius agree in at least one table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolframe.llm.common import mix64, ship, slices, text_words, written

RADIUS, BLOCKS = 3, 5
_LAST = -(1 << 63)  # the place of null ids in descending order


def fingerprint(text: str) -> int:
    """64 bits; 0 for a text without words."""
    words = text_words(text)
    if len(words) > 1:
        with np.errstate(over="ignore"):
            words = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    if not len(words):
        return 0
    terms, n = np.unique(words, return_counts=True)
    weights, votes = 1 + np.log(n), np.zeros(64)
    for at in range(0, len(terms), 1 << 16):
        bits = np.unpackbits(terms[at: at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w = weights[at: at + (1 << 16)]
        votes += 2 * (w @ bits) - w.sum()
    return int.from_bytes(np.packbits(np.round(votes, 6) > 0, bitorder="little").tobytes(), "little")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of the next (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bucket(ids: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below an id, by halving an array of them."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # a constant

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = ids < table[mid]
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(below, s["low"]).otherwise(mid + 1).alias("low"), F.when(below, mid).otherwise(s["high"]).alias("high")))

    whole = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), whole, halve, lambda s: s["low"])


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The contract's row per document (see OUT).

    docs: doc_id, text. The next document has the next smaller doc_id, ties
    in order of text; null ids come last; after the last comes the first. Null
    text is empty. Other columns are ignored; no rows give no rows; a single
    document is its own next.

    Ids are dealt into ranges by approximate quantiles (one number per range
    on the driver). A range also gets a copy of the first document of the
    range that follows, so texts are shuffled once and read in order.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("o"), F.coalesce("text", F.lit("")).alias("text"))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.select("o").agg(F.percentile_approx("o", [(i + 1) / n for i in range(n - 1)] or [1.0], max(10_000, 20 * n)).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    rows = rows.withColumn("b", _bucket(F.col("o"), bounds))
    heads = sorted(((r["b"], r["o"]) for r in rows.groupBy("b").agg(F.max("o").alias("o")).collect()), reverse=True)
    guards = [(o, heads[i - 1][0]) for i, (_, o) in enumerate(heads)]  # the first of a range closes the range before it; the first of all the last
    spread = spark.createDataFrame(guards, "go long, gb int")
    guard = rows.join(F.broadcast(spread), F.col("o") == F.col("go")).select("doc_id", "o", "text", F.col("gb").alias("b"), F.lit(1).alias("g"))
    dealt = rows.select("doc_id", "o", "text", "b", F.lit(0).alias("g")).unionByName(guard)
    dealt = dealt.repartition(n, "b").sortWithinPartitions("b", "g", F.desc("o"), "text").select("b", "g", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in OUT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before: tuple | None = None  # (bucket, doc_id, text, fingerprint) that waits for its next
        for b in slices(batches, "text"):
            out = []
            for bucket, guards_, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if before and before[0] != bucket:
                    before = None
                own = fingerprint(text) if not guards_ or before else 0
                if before:
                    changed = edited(before[2], text)
                    other = fingerprint(changed)
                    out.append((before[1], len(before[2]), hashlib.sha256(changed.encode()).hexdigest(), f"{before[3]:016x}", f"{other:016x}",
                                likeness(before[3], other), likeness(before[3], own)))
                before = None if guards_ else (bucket, doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, OUT)


def tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks of the blocks that must agree, one per table."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(masks[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]


def near(fingerprints_: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All (query, fp) of distinct fingerprints (column ``fp``, long) within the radius, each pair once, the equal one too.

    Null fingerprints take no part; repeated ones count once. A pair that
    agrees in several tables is kept in the first of them.
    """
    if not radius < blocks <= 64:
        raise ValueError("more blocks than the radius are needed")
    signed = [m - (1 << 64) if m >> 63 else m for m in tables(radius, blocks)]
    masks = F.array(*[F.lit(m).cast("long") for m in signed])

    def dealt(df: DataFrame, name: str) -> DataFrame:
        own = df.select("fp").where(F.col("fp").isNotNull()).distinct()
        return own.select(F.col("fp").alias(name), F.posexplode(masks).alias("t", "m")).select(name, "t", F.col(name).bitwiseAND(F.col("m")).alias("key"))

    pairs = dealt(queries, "query").join(dealt(fingerprints_, "fp"), ["t", "key"])
    diff = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.lit(True)
    for i, m in enumerate(signed):
        first = first & ((F.col("t") <= i) | (diff.bitwiseAND(F.lit(m).cast("long")) != 0))
    return pairs.where((F.bit_count(diff) <= radius) & first).select("query", "fp")


def _bits(hexed: Column) -> Column:
    """Sixteen hexadecimal digits as a signed long."""
    half = lambda at: F.conv(F.substring(hexed, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def search(prints: DataFrame, is_query: Column, radius: int = RADIUS) -> DataFrame:
    """prints with n_near: for query rows, how many other rows have a fingerprint within the radius; null for the rest."""
    table = prints.withColumn("fp", _bits(F.col("fingerprint"))).withColumn("__q", F.coalesce(is_query, F.lit(False)))
    counts = table.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    hits = near(table, table.where("__q"), radius).join(counts, "fp").groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    asked = table.where("__q").join(hits, F.col("fp") == F.col("query"), "left")
    names = [*prints.columns, "n_near"]
    return table.where(~F.col("__q")).withColumn("n_near", F.lit(None).cast("long")).select(*names).unionByName(asked.select(*names))


def evaluate(docs: DataFrame) -> DataFrame:
    """The contract's row per document, and n_near for documents whose id is divisible by 100."""
    return search(written(fingerprints(docs), "fingerprints"), F.col("doc_id") % 100 == 0)
