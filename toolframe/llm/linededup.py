"""Line dedup by overlapping three-line windows. Only DataFrame functions.

Each line gets two independent 64-bit hashes, each three consecutive lines one
128-bit window hash. A window's first occurrence (smallest doc_id, text hash,
position) stays; every later one covers its three lines, except those that
also belong to that first occurrence. Covered positions of a document are
merged and their lines removed.

Windows are rows of about 40 bytes; texts are shuffled once, for the last
join. Counting a window combines before its shuffle; the join of windows to
first occurrences has one row per hash on the small side, so a very frequent
window is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """(d, h, pos, w1, w2) of every window that holds at least one line that isn't blank."""
    line = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), (F.trim(x) == "").alias("z"))
    hashed = docs.select("d", "h", F.transform(F.split("text", "\n", -1), line).alias("l")).where(F.size("l") >= width)
    zipped = F.arrays_zip(*[F.slice("l", i + 1, F.size("l")).alias(f"l{i}") for i in range(width)])
    rows = hashed.select("d", "h", F.posexplode(zipped).alias("pos", "w")).where(F.col("w")[f"l{width - 1}"].isNotNull())
    part = lambda i, k: F.col("w")[f"l{i}"][k]
    blank: Column = F.lit(True)
    for i in range(width):
        blank = blank & part(i, "z")
    return rows.where(~blank).select("d", "h", "pos", F.xxhash64(*[part(i, "a") for i in range(width)]).alias("w1"),
                                     F.xxhash64(*[part(i, "b") for i in range(width)]).alias("w2"))


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) with later copies of repeated windows removed.

    Returns all columns of docs, text replaced, plus n_lines and n_removed.
    Every row stays, with an empty text where all lines were copies. Null text
    stays null (no lines); texts of under three lines have no window and stay;
    windows of blank lines only are left alone. Rows that repeat both doc_id
    and text are one document and get the same result; equal doc_ids with
    different texts are different documents. A null doc_id comes first in the
    order. No rows give no rows.
    """
    keyed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("doc_id").alias("d"),
                        F.xxhash64("text").alias("h"), F.col("text"))
    rows = _windows(keyed.select("d", "h", "text").where(F.col("text").isNotNull()), width)
    firsts = (rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "h", "pos")).alias("first"))
                  .where("n > 1").drop("n"))
    found = rows.join(firsts.hint("shuffle_merge"), ["w1", "w2"])
    same = F.col("d").eqNullSafe(F.col("first.d")) & (F.col("h") == F.col("first.h"))
    lines = F.array(*[F.col("pos") + i for i in range(width)])
    covered = F.when(same, F.filter(lines, lambda p: (p < F.col("first.pos")) | (p >= F.col("first.pos") + width))).otherwise(lines)
    gone = (found.where(~(same & (F.col("pos") == F.col("first.pos"))))
                 .select("d", "h", F.explode(covered).alias("p"))
                 .groupBy("d", "h").agg(F.collect_set("p").alias("gone"))
                 .select(F.col("d").alias("gd"), F.col("h").alias("gh"), "gone"))
    split = keyed.select("row", "d", "h", F.split("text", "\n", -1).alias("l"))
    out = split.join(gone, F.col("d").eqNullSafe(F.col("gd")) & (F.col("h") == F.col("gh")), "left")
    index = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.array_join("l", "\n")).otherwise(
        F.array_join(F.transform(index, lambda i: F.col("l")[i]), "\n"))
    cols = [kept.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*cols, F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
