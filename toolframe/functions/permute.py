"""A shuffled order as an expression.

A keyed Feistel network over Z_a x Z_b, the smallest such box that holds n
numbers, permutes the box; a number that leaves 0..n-1 walks on along its
cycle until it is back inside. That permutes 0..n-1 for any n: each row knows
its place in an epoch's order from its own number, so nothing is ranked, joined
or shuffled. Round values are md5, so other engines get the same order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolframe.session import written_counted

ROUNDS = 4
WALK = 64  # steps outside 0..n-1 after which a row raises; fewer than 1 in 4 numbers of the box are outside


def box(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n, both about the root of n."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, -(-max(n, 1) // a)


def _round(value: Column, seed: Column, number: int) -> Column:
    digest = F.md5(F.concat_ws("|", seed.cast("string"), F.lit(str(number)), value.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _through(x: Column, seed: Column, a: int, b: int) -> Column:
    """Once through the network. As nested transforms of one-element arrays, so that no half is computed twice."""
    state = F.array(F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r")))

    def step(i: int):
        return lambda s: F.struct(s["r"].alias("l"), F.pmod(s["l"] + _round(s["r"], seed, i), F.lit(a if i % 2 else b)).alias("r"))

    for i in range(1, ROUNDS + 1):
        state = F.transform(state, step(i))
    return F.transform(state, lambda s: s["l"] + s["r"] * a)[0]


def permuted(index: Column, n: int, seed: Column | int = 42) -> Column:
    """Place (0-based) of row number ``index`` in the order given by the seed: a bijection of 0..n-1 for every seed. Null or outside 0..n-1 raises or stays null."""
    a, b = box(n)
    key = seed if isinstance(seed, Column) else F.lit(seed)
    start = F.when(index.isNull() | index.between(0, n - 1), index.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no row number below "), F.lit(str(n)), F.lit(": "), index.cast("string"))))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _through(start, key, a, b), lambda x, _: F.when(x < n, x).otherwise(_through(x, key, a, b)))
    return F.when(index.isNotNull(), F.transform(F.array(walk), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a number did not come back"))))[0])


def number_rows(df: DataFrame, out: str = "index") -> tuple[DataFrame, int]:
    """(df with dense row numbers from 0, their count); df is written once, and no row moves.

    Numbers follow the written partitions: Spark's own ids tell partition and
    place, rows are counted per partition, and a partition's offset (one row
    each) is added. The same input split in another way is numbered in another
    way; the written table keeps its numbers.
    """
    rows, n = written_counted(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    numbered = rows.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(out, F.col("_o") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.drop("_p", "_o", "_id"), n
