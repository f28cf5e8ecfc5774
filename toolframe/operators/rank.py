"""Exact shuffled rank without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row to one task, and a
window per group puts a dominant group (a third of all rows) in one task too.
Instead rows get a 60-bit hash key; its top bits pick one of ``n_buckets``
order-preserving buckets. Counting rows per (group, bucket) gives a small table
whose prefix sums are each bucket's rank offset; the rank inside a bucket is a
``row_number`` over a partition holding about ``1 / n_buckets`` of a group.
The number of buckets grows with the rows, so a bucket's size doesn't.

The hash is md5-based so the same ranks can be computed in other engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolframe.session import written, written_counted

KEY_BITS = 60  # 15 hex digits of md5


def order_key(*parts: Column, seed: int | str = 42) -> Column:
    """Deterministic 60-bit non-negative shuffle key of ``(seed, *parts)``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def unit_draw(*parts: Column, seed: int | str = 42) -> Column:
    """Deterministic uniform double in [0, 1) from 52 bits of ``md5(seed|parts)``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


BUCKET_ROWS = 65_536  # rows that a bucket holds on average, however many there are in all


def bucketed_rank(df: DataFrame, key: str, tiebreak: list[str], group: list[str] | None = None,
                  n_buckets: int | None = None, out: str = "rank", max_rank: int | None = None) -> DataFrame:
    """Add ``out`` = ``row_number() over (partition by group order by key, tiebreak)``.

    ``key`` must be a non-negative 60-bit long (see ``order_key``). Unless
    ``n_buckets`` (a power of two) is given, the rows are counted and dealt into
    buckets of about BUCKET_ROWS. Rows whose group is null are a group. The
    offsets table has ``groups x n_buckets`` rows; AQE broadcasts it when small.
    With ``max_rank`` only rows that
    can rank ``<= max_rank`` are kept: buckets whose offset is already past it
    are dropped before the window, so a cap sorts a few buckets, not all rows.
    """
    group = list(group or [])
    if n_buckets is None:
        n_buckets = 1 << max(0, df.count() // BUCKET_ROWS).bit_length()
    shift = KEY_BITS - (n_buckets.bit_length() - 1)
    if n_buckets & (n_buckets - 1):
        raise ValueError("n_buckets must be a power of two")
    staged = df.withColumn("_bk", F.shiftright(F.col(key), shift))
    counts = staged.groupBy(*group, "_bk").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*group).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_bk", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*group, "_bk").orderBy(F.col(key), *[F.col(c) for c in tiebreak])
    if max_rank is not None:
        offsets = offsets.filter(F.col("_off") < max_rank)
    named = offsets.select(*[F.col(g).alias(f"_off_{g}") for g in group], F.col("_bk").alias("_off_bk"), "_off")
    same = F.col("_bk") == F.col("_off_bk")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_off_{g}"))
    ranked = (staged.join(named, same, "inner")
              .withColumn(out, F.row_number().over(inner) + F.col("_off"))
              .drop("_bk", "_off", *named.columns))
    return ranked.filter(F.col(out) <= max_rank) if max_rank is not None else ranked


def shuffled(df: DataFrame, key_cols: list[str], seed: int = 42, n_buckets: int | None = None,
             group: list[str] | None = None, out: str = "rank", max_rank: int | None = None) -> DataFrame:
    """Seeded shuffle order as an exact 1-based rank (per group if given)."""
    k = df.withColumn("_u", order_key(*[F.col(c) for c in key_cols], seed=seed))
    return bucketed_rank(k, "_u", key_cols, group, n_buckets, out, max_rank).drop("_u")


CUT_BITS = 16  # leading key bits that one count looks at
BROADCAST_GROUPS = 100_000  # more groups than this and their cut points are joined, not broadcast


def with_cuts(df: DataFrame, key: str, tie: str, wanted: DataFrame, names: list[str], group: str | None = None) -> DataFrame:
    """df with a boolean per name: is the row among its group's first ``at`` rows in order of (key, tie)?

    wanted: (group,) name, at. For labels (splits, caps) only the cut points
    are needed, not everyone's rank: rows are counted by the key's leading bits,
    the boundary bucket of each cut is ranked on (key, tie) alone, and a narrow
    comparison labels the rows. No row with its texts is shuffled or sorted.
    (key, tie) must identify a row of its group. A cut that is absent, or at 0,
    is false; one beyond the group is true. key: see ``order_key``. Without a
    group the cuts are two numbers per name and become constants; the table of
    a grouped one is written and counted in one job.
    """
    g = group or "_g"
    base = df if group else df.withColumn(g, F.lit(0))
    slim = base.select(g, F.col(key).alias("_k"), F.col(tie).alias("_t"), F.shiftright(F.col(key), KEY_BITS - CUT_BITS).alias("_b"))
    counts = slim.groupBy(g, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = counts.withColumn("_hi", F.sum("_c").over(Window.partitionBy(g).orderBy("_b")))
    want = wanted if group else wanted.withColumn(g, F.lit(0))
    edge = (upto.join(want, g).where((F.col("at") > F.col("_hi") - F.col("_c")) & (F.col("at") <= F.col("_hi")))
                .select(g, "_b", "name", (F.col("at") - F.col("_hi") + F.col("_c")).alias("_r")))
    ranked = slim.join(edge, [g, "_b"]).withColumn("_n", F.row_number().over(Window.partitionBy(g, "_b", "name").orderBy("_k", "_t")))
    cut = ranked.where(F.col("_n") == F.col("_r")).select(g, "name", F.struct("_k", "_t").alias("_cut"))
    size = counts.groupBy(g).agg(F.sum("_c").alias("_size"))
    table = want.join(size, g).join(cut, [g, "name"], "left").select(
        g, "name", F.struct((F.col("at") > F.col("_size")).alias("all"), F.col("_cut").alias("cut")).alias("_x"))
    here = F.struct(F.col(key).alias("_k"), F.col(tie).alias("_t"))
    if not group:
        cuts = {r["name"]: r["_x"] for r in table.select("name", "_x").collect()}  # a row per name
        for n in names:
            x = cuts.get(n)
            at = x and x["cut"]
            inside = here <= F.struct(F.lit(at["_k"]).alias("_k"), F.lit(at["_t"]).alias("_t")) if at else F.lit(False)
            df = df.withColumn(n, F.lit(True) if x and x["all"] else inside)
        return df
    table, groups = written_counted(table.groupBy(g).pivot("name", names).agg(F.first("_x")).select(g, *[F.col(n).alias(f"_cut_{n}") for n in names]), "cuts")
    out = base.join(F.broadcast(table) if groups <= BROADCAST_GROUPS else table, g, "left")
    for n in names:
        x = F.col(f"_cut_{n}")
        out = out.withColumn(n, F.coalesce(x["all"] | (here <= x["cut"]), x["all"], F.lit(False)))
    return out.drop(*[f"_cut_{n}" for n in names])


def range_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Exact 1-based rank over all rows in the order given, without a one-task window.

    Rows are range-partitioned and written with their range's number; rows are
    counted per range, and the rank is the range's offset plus the place in it.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    offsets = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).select(
        "_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_p")  # one row per range
            .withColumn(out, F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_off")).drop("_p", "_off"))
