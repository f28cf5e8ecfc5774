"""X7 inside longer texts: evaluation passages that training texts contain.

An item's passage is contained as far as its word n-grams occur in a text.
Inverted lists hold the texts' n-grams that any item has. Prefix filtering
finds candidates: a text that contains at least a share t of an item's n grams
has at least one of any n - ceil(t * n) + 1 of them, so only the lists of the
rarest so many are joined. Candidates are then counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolframe.operators.neardup import normalized
from toolframe.session import written

SMALL = 200_000  # counted rows up to which the items' grams are broadcast


def _grams(words: Column, n: Column | int) -> Column:
    """All runs of n words; none where there are fewer."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))


def contained_passages(items: DataFrame, texts: DataFrame, item_key: str = "item_id", text_key: str = "doc_id", text: str = "text",
                       n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(item_key, text_key, n_grams, n_found, containment) of all pairs whose containment reaches the threshold.

    Texts are compared in lower case with whitespace collapsed. An item of
    fewer than n words is one gram of its own length; items and texts without
    words take no part. Keys must be unique; rows with equal texts are found
    each. No rows on either side give no rows.
    """
    words = F.split(normalized(F.col(text)), " ")
    own = items.select(F.col(item_key).alias("_i"), words.alias("_w")).where(F.size(F.array_remove("_w", "")) > 0)
    own = own.withColumn("_n", F.least(F.lit(n), F.size("_w")))
    grams = written(own.select("_i", "_n", F.explode(F.array_distinct(_grams(F.col("_w"), F.col("_n")))).alias("g")), "item-grams")
    lengths = sorted(r[0] for r in grams.select("_n").distinct().collect())  # at most n numbers
    asked = grams.select("g").distinct()
    split = texts.select(F.col(text_key).alias("_t"), words.alias("_w"))
    every = split.select("_t", F.explode(F.array_distinct(F.concat(*[_grams(F.col("_w"), k) for k in lengths] or [F.array().cast("array<string>")]))).alias("g"))
    lists = written(every.join(F.broadcast(asked) if asked.count() <= SMALL else asked, "g", "left_semi"), "lists")
    rare = grams.join(lists.groupBy("g").agg(F.count(F.lit(1)).alias("df")), "g", "left").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("_i")))
    rank = F.row_number().over(Window.partitionBy("_i").orderBy(F.col("df").asc_nulls_first(), "g"))
    needed = F.ceil(F.col("size") * F.lit(threshold) - 1e-9)
    prefix = rare.withColumn("r", rank).where(F.col("r") <= F.col("size") - needed + 1).where("df is not null").select("_i", "g")
    pairs = lists.join(prefix, "g").select("_i", "_t").distinct()
    found = pairs.join(rare.select("_i", "g", "size"), "_i").join(lists, ["_t", "g"]).groupBy("_i", "_t").agg(F.first("size").alias("n_grams"), F.count(F.lit(1)).alias("n_found"))
    out = found.withColumn("containment", F.col("n_found") / F.col("n_grams")).where(F.col("n_found") >= F.ceil(F.col("n_grams") * F.lit(threshold) - 1e-9))
    return out.select(F.col("_i").alias(item_key), F.col("_t").alias(text_key), "n_grams", "n_found", "containment")
