"""Corpus preparation: tagging, completeness, normalisation, text unification
(P1-P6), dedup (A1), source balancing (A3), splits and caps (L1-L3, L8-L12,
A15, A16) and the length / language / leakage extensions (X1-X7).

All sampling is hash-seeded (md5), so results do not depend on partitioning
and other engines can reproduce them exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolframe.functions.text import md5_bucket, py_split_join, truthy
from toolframe.functions.permute import number_rows, permuted
from toolframe.operators.rank import bucketed_rank, order_key, unit_draw, with_cuts
from toolframe.session import written

# Fields whose truthiness makes a row "complete" (P2).
CONTENT_FIELDS = ["text", "messages", "conversations", "id", "instruction", "question", "domain",
                  "api_call", "function"]
BALANCE_FLOOR = 500


def tag_source(df: DataFrame, name: str, col: str = "source") -> DataFrame:
    """Tag rows with a constant source name."""
    return df.withColumn(col, F.lit(name))


def _truthy_any(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType.simpleString()
    if dt.startswith("array"):
        return truthy(F.col(c), "array")
    if dt in ("string",):
        return truthy(F.col(c))
    if dt in ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean"):
        return truthy(F.col(c), "number") if dt != "boolean" else F.coalesce(F.col(c), F.lit(False))
    return F.col(c).isNotNull()


def complete_rows(df: DataFrame, fields: list[str] = CONTENT_FIELDS) -> DataFrame:
    """Keep rows with at least one present and truthy content field."""
    present = [c for c in fields if c in df.columns]
    if not present:
        return df.limit(0)
    cond = None
    for c in present:
        t = F.coalesce(_truthy_any(df, c), F.lit(False))
        cond = t if cond is None else cond | t
    return df.filter(cond)


def normalize_whitespace(df: DataFrame, col: str = "text") -> DataFrame:
    """``" ".join(text.split())`` on a string column (newlines collapse too)."""
    if col not in df.columns:
        return df
    return df.withColumn(col, py_split_join(F.col(col)))


def render_messages(messages: Column) -> Column:
    """P7 (array form): ``role: content`` lines joined by newlines, missing -> ''."""
    return F.array_join(F.transform(messages, lambda m: F.concat(
        F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def unify_text(df: DataFrame, passthrough: tuple[str, ...] = ()) -> DataFrame:
    """P4 + P5: one ``text`` column by the cascade text -> messages -> instruction -> JSON dump,
    then keep only ``text`` and ``source`` (plus bookkeeping ``passthrough`` columns such as
    a row key or split, which are never part of the dumped content)."""
    cands = []
    if "text" in df.columns:
        cands.append(F.when(truthy(F.col("text")), F.col("text")))
    if "messages" in df.columns and df.schema["messages"].dataType.simpleString().startswith("array"):
        cands.append(F.when(F.col("messages").isNotNull(), render_messages(F.col("messages"))))
    if "instruction" in df.columns:
        cands.append(F.when(truthy(F.col("instruction")), F.col("instruction")))
    rest = [c for c in df.columns if c != "source" and c not in passthrough and c != "_corrupt_record"]
    cands.append(F.to_json(F.struct(*[F.col(c) for c in rest])))
    keep = [F.col(c) for c in passthrough] + [F.coalesce(*cands).alias("text")]
    if "source" in df.columns:
        keep.append(F.col("source"))
    return df.select(*keep)


def content_key(df: DataFrame, cols: list[str]) -> Column:
    """Canonical md5 of the key columns (sorted names, JSON of their values)."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])))


def dedup_key(df: DataFrame, cols: tuple[str, ...] = ()) -> Column:
    """A1's key of a row: md5 of the chosen columns, or of the whole row where none is chosen.

    The whole row leaves out the numbering (row_id, row_key) and the parser's
    audit column. A row that has none of the chosen columns (the tag ``source``
    doesn't count) would be a copy of all others like it: it is keyed by its
    whole content instead.
    """
    content = [c for c in df.columns if c not in ("row_id", "row_key", "_corrupt_record")]
    chosen = [c for c in cols if c in df.columns]
    whole = content_key(df, content)
    if not chosen:
        return whole
    filled = F.lit(False)
    for c in chosen:
        if c != "source":
            filled = filled | F.col(c).isNotNull()
    return F.when(filled, content_key(df, chosen)).otherwise(whole)


def with_row_ids(df: DataFrame) -> DataFrame:
    """Add ``row_key`` and ``row_id`` and write the rows once.

    row_key is 128 bits of (source, the source's own row id, content): a
    function of the row alone, so seeded draws don't depend on partitioning.
    row_id is row_key and the row's number in the written table: unique whatever
    ids the sources carry, even for rows that are equal in every column. Both
    keep the order of the source's own ids, numbers before rows without one.
    """
    content = [F.col(c) for c in sorted(df.columns) if c not in ("_corrupt_record", "row_id")]
    own = F.col("row_id").cast("string") if "row_id" in df.columns else F.lit(None).cast("string")
    place = F.coalesce(F.lpad(own, 20, "0"), F.lit("~"))
    key = F.concat(place, F.lit("-"), F.md5(F.to_json(F.struct(own.alias("own"), *content))))
    keyed = df.drop("row_id").withColumn("row_key", key) if "row_id" not in df.columns else df.withColumn("row_key", key).drop("row_id")
    return written(keyed.withColumn("row_id", F.concat("row_key", F.lit("-"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))), "rows")


def dedup_first(df: DataFrame, key: Column, order: str = "row_id") -> DataFrame:
    """A1: keep the first row (lowest ``order``) of every key.

    The smallest order per key is a hash aggregate over two slim columns,
    combined on the map side (a key shared by a third of all rows is one row per
    map task); rows are then semi-joined to it. ``order`` must be unique and not
    null.
    """
    firsts = df.select(key.alias("_k"), F.col(order).alias("_o")).groupBy("_k").agg(F.min("_o").alias("_o")).select("_o")
    return df.join(firsts, F.col(order) == F.col("_o"), "left_semi")


def source_counts(df: DataFrame, source: str = "source") -> DataFrame:
    """A2: rows per source."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def balance_target(counts: DataFrame, floor_cap: int = BALANCE_FLOOR) -> int:
    """A3 target: ``max(median, min(floor_cap, max(counts)))``, even-size median = integer mean.

    One aggregate over the per-source count table; two numbers reach the driver.
    """
    row = counts.agg(F.expr("percentile(n, 0.5)").alias("median"), F.max("n").alias("top")).first()
    return 0 if row["top"] is None else max(math.floor(row["median"]), min(floor_cap, row["top"]))


def balance_sources(df: DataFrame, source: str = "source", key: str = "row_id", seed: int = 42,
                    floor_cap: int = BALANCE_FLOOR, n_buckets: int | None = None, tie: str | None = None) -> DataFrame:
    """A3: median-target resampling; adds ``draw`` (0 = kept by undersampling).

    Sources with at least ``target`` rows keep their ``target`` first rows in a
    seeded shuffle: one cut point per source, no rank. Smaller sources (all
    their rows together are fewer than target times their number) draw
    ``target`` rows with replacement: draws come from a distributed ``range``
    over (small source, draw), each picks a rank ``floor(u * n) + 1`` and is
    equi-joined to the ranked rows (J8).

    Runs two small jobs over the counts per source while it is built (target,
    number of small sources), and what ``with_cuts`` needs. Equal keys are told
    apart by ``tie``. Rows without a source are a source of their own.
    """
    spark, tie, given = df.sparkSession, tie or key, df.columns
    df = df.withColumn("_g", F.to_json(F.struct(F.col(source).alias("g"))))  # never null
    counts = written(df.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.first(source).alias(source)), "counts")
    target = balance_target(counts, floor_cap)
    k = counts.where(F.col("n") < target).count()
    keyed = df.withColumn("_u", order_key(F.col(source), F.col(key), seed=seed))
    large = counts.where(F.col("n") >= target).select("_g", F.lit("keep").alias("name"), F.lit(target).cast("long").alias("at"))
    under = with_cuts(keyed, "_u", tie, large, ["keep"], "_g").where("keep").withColumn("draw", F.lit(0).cast("long")).select(*given, "draw")
    if k == 0:
        return under
    small = counts.filter(F.col("n") < target)
    ranked = bucketed_rank(keyed.join(small.select("_g"), "_g", "left_semi"), "_u", [tie], ["_g"], n_buckets, "_rank").drop("_u")
    small_idx = bucketed_rank(small.withColumn("_u", order_key(F.col(source), seed=seed)),
                              "_u", ["_g"], None, n_buckets, "_sidx").drop("_u")
    draws = (spark.range(0, k * target)
             .select((F.floor(F.col("id") / target) + 1).cast("long").alias("_sidx"),
                     (F.pmod(F.col("id"), F.lit(target)) + 1).alias("draw"))
             .join(small_idx, "_sidx", "inner"))
    picks = draws.select("_g", "draw",
                         (F.floor(unit_draw(F.col(source), F.col("draw"), seed=seed) * F.col("n")) + 1)
                         .cast("long").alias("_rank"))
    over = picks.join(ranked, ["_g", "_rank"], "inner").select(*given, "draw")
    return under.unionByName(over)


# --------------------------------------------------------------------------
# Splits, caps, batches
# --------------------------------------------------------------------------

def split_sizes(n: int, train: float = 0.8, val: float = 0.1) -> tuple[int, int, int]:
    """L8 sizes in the reference's float order: ``< 3`` rows -> all train;
    then ``test_size = max(1 - train, 1/n)``, ``n_test = ceil(test_size * n)``;
    ``< 2`` remaining -> all validation; then the same on the remainder with
    ``1 - val / (1 - train)``."""
    if n < 3:
        return n, 0, 0
    n_rest = math.ceil(max(1 - train, 1 / n) * n)
    n_train = n - n_rest
    if n_rest < 2:
        return n_train, n_rest, 0
    ratio = val / (1 - train)
    n_test = math.ceil(max(1 - ratio, 1 / n_rest) * n_rest)
    return n_train, n_rest - n_test, n_test


def split_exact(df: DataFrame, key: str = "row_id", seed: int = 42, train: float = 0.8, val: float = 0.1,
                n: int | None = None, tie: str | None = None) -> DataFrame:
    """Exact 3-way split in seeded order; adds ``split`` in {train, validation, test}.

    Two cut points label the rows (``with_cuts``); no row is shuffled. Counts
    the rows unless ``n`` is given. Equal keys are told apart by ``tie``.
    """
    n = df.count() if n is None else n
    n_train, n_val, _ = split_sizes(n, train, val)
    wanted = df.sparkSession.createDataFrame([("_train", n_train), ("_val", n_train + n_val)], "name string, at long")
    cut = with_cuts(df.withColumn("_u", order_key(F.col(key), seed=seed)), "_u", tie or key, wanted, ["_train", "_val"])
    return (cut.withColumn("split", F.when(F.col("_train"), "train").when(F.col("_val"), "validation").otherwise("test"))
            .drop("_train", "_val", "_u"))


def split_by_hash(df: DataFrame, key: Column, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """L8 (cheap form): split by md5 bucket thresholds; no count, no rank, no shuffle."""
    b = md5_bucket(key)
    return df.withColumn("split", F.when(b < int(train * 100), "train")
                         .when(b < int((train + val) * 100), "validation").otherwise("test"))


def holdout(df: DataFrame, key: Column, ratio: float = 0.1) -> DataFrame:
    """Stable hold-out, rows with ``md5 bucket < floor(ratio * 100)`` (Q19)."""
    return df.filter(md5_bucket(key) < F.lit(int(ratio * 100)))


def cap_rows(df: DataFrame, limit: int, key: str = "row_id", seed: int = 42, tie: str | None = None) -> DataFrame:
    """L1 / L3: seeded sample of ``limit`` rows without replacement (all rows if fewer), by one cut point."""
    wanted = df.sparkSession.createDataFrame([("_in", limit)], "name string, at long")
    cut = with_cuts(df.withColumn("_u", order_key(F.col(key), seed=seed)), "_u", tie or key, wanted, ["_in"])
    return cut.where("_in").drop("_in", "_u")


def validation_prefix(df: DataFrame, key: str = "row_id", seed: int = 42, frac: float = 0.1,
                      n: int | None = None) -> DataFrame:
    """``n_val = max(1, int(n * frac))`` first shuffled rows are validation."""
    n = df.count() if n is None else n
    wanted = df.sparkSession.createDataFrame([("_val", max(1, int(n * frac)))], "name string, at long")
    cut = with_cuts(df.withColumn("_u", order_key(F.col(key), seed=seed)), "_u", key, wanted, ["_val"])
    return cut.withColumn("part", F.when(F.col("_val"), "validation").otherwise("train")).drop("_val", "_u")


def steps_per_epoch(n: int, batch_size: int) -> int:
    """``ceil(n / batch)``."""
    return math.ceil(n / batch_size)


def epoch_batches(df: DataFrame, epochs: int, batch_size: int, index: str | None = None, seed: int = 42,
                  n: int | None = None) -> DataFrame:
    """L10 + T7: per epoch a reshuffle with seed ``seed + epoch``, cut in batches.

    A row's place in an epoch is a function of its number (``permute``): rows
    are replicated per epoch with ``explode(sequence)`` and labelled where they
    are; nothing is ranked or shuffled. ``index``: a column of dense row numbers
    from 0; without one the rows are numbered first (written once). Adds
    ``epoch``, ``batch_idx``, ``global_step`` (1-based), ``samples_seen``,
    ``epoch_progress``. A null number has null places.
    """
    if index is None:
        df, n = number_rows(df, "_index")
    else:
        df, n = df.withColumn("_index", F.col(index)), df.count() if n is None else n
    spe = steps_per_epoch(n, batch_size)
    rep = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = rep.withColumn("_place", permuted(F.col("_index"), n, F.lit(seed) + F.col("epoch")))
    batch = F.floor(F.col("_place") / batch_size).cast("long")
    gstep = F.col("epoch") * spe + F.col("batch_idx") + 1
    return (placed.withColumn("batch_idx", batch)
            .withColumn("global_step", gstep)
            .withColumn("samples_seen", F.col("global_step") * batch_size)
            .withColumn("epoch_progress", (F.col("batch_idx") + 1) / F.lit(float(max(spe, 1))))
            .drop("_place", "_index"))


def resume_after(batches: DataFrame, start_step: int) -> DataFrame:
    """Skip work already done (``global_step > start_step``)."""
    return batches.filter(F.col("global_step") > start_step)


def cadence(steps: Column, every: int, zero_based: bool = False, after: bool = False) -> Column:
    """``step % n == 0`` (1-based SFT log/save, 0-based GRPO samples), ``(step+1) % n == 0`` (GRPO saves)."""
    s = steps + 1 if after else steps
    return (F.lit(every) > 0) & (F.pmod(s, F.lit(every)) == 0)


def length_filter(df: DataFrame, col: Column, min_len: int | None = None, max_len: int | None = None) -> DataFrame:
    """X1 (extension): keep rows with ``min_len <= col <= max_len``."""
    cond = F.lit(True)
    if min_len is not None:
        cond = cond & (col >= min_len)
    if max_len is not None:
        cond = cond & (col <= max_len)
    return df.filter(cond)


def leakage(eval_rows: DataFrame, train_rows: DataFrame, key_eval: Column, key_train: Column) -> DataFrame:
    """X7 (extension): evaluation rows whose content hash also occurs in training rows."""
    t = train_rows.select(F.md5(key_train).alias("_h")).distinct()
    return eval_rows.withColumn("_h", F.md5(key_eval)).join(t, "_h", "left_semi").drop("_h")


def split_stratified(df: DataFrame, strata: list[str], key: str = "row_id", seed: int = 42,
                     train: float = 0.8, val: float = 0.1) -> DataFrame:
    """X2 (extension): the L8 split applied inside every stratum.

    Per-stratum sizes come from a count table (one row per stratum) using the
    same float order as ``split_sizes``; two cut points per stratum label the
    rows (``with_cuts``), so a dominant stratum is neither shuffled nor sorted.
    """
    n = F.col("_n").cast("double")
    rest = F.ceil(F.greatest(F.lit(1.0) - F.lit(train), F.lit(1.0) / n) * n)
    ratio = val / (1 - train)
    n_test = F.ceil(F.greatest(F.lit(1.0 - ratio), F.lit(1.0) / rest) * rest)
    named = df.withColumn("_s", F.to_json(F.struct(*strata)))
    sizes = (named.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_train", F.when(F.col("_n") < 3, F.col("_n")).otherwise(F.col("_n") - rest))
             .withColumn("_val", F.when(F.col("_n") < 3, F.lit(0))
                         .when(rest < 2, rest).otherwise(rest - n_test)))
    wanted = sizes.select("_s", F.explode(F.array(
        F.struct(F.lit("_train").alias("name"), F.col("_train").cast("long").alias("at")),
        F.struct(F.lit("_val").alias("name"), (F.col("_train") + F.col("_val")).cast("long").alias("at")))).alias("x")).select("_s", "x.*")
    keyed = named.withColumn("_u", order_key(*[F.col(c) for c in (*strata, key)], seed=seed))
    cut = with_cuts(keyed, "_u", key, wanted, ["_train", "_val"], "_s")
    return (cut.withColumn("split", F.when(F.col("_train"), "train").when(F.col("_val"), "validation").otherwise("test"))
            .drop("_train", "_val", "_u", "_s"))
