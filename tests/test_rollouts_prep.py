"""W1, A10-A14, T5, J7 and preparation properties."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_ORACLE, SF_SMALL
from toolframe.operators import prep, rank, rollouts
from toolframe.plans import catalog
from toolframe.plans import fixtures as fx


@pytest.fixture(scope="module")
def adv(spark):
    return catalog.scored_rollouts(spark, SF_SMALL).cache()


def test_advantages_sum_to_zero_per_group(adv):
    g = adv.groupBy("step", "slot").agg(F.sum("advantage").alias("s")).collect()
    assert g and all(abs(r["s"]) < 1e-9 for r in g)


def test_degenerate_iff_all_equal(adv):
    pdf = adv.select("step", "slot", "reward", "degenerate").toPandas()
    for _, grp in pdf.groupby(["step", "slot"]):
        assert grp["degenerate"].iloc[0] == (grp["reward"].nunique() == 1)


def test_step_metrics_against_pandas(spark, adv):
    sm = {r["step"]: r for r in rollouts.step_metrics(adv).collect()}
    pdf = adv.select("step", "slot", "reward", "advantage", "degenerate",
                     "reward_schema").toPandas()
    for step, grp in pdf.groupby("step"):
        groups = grp.groupby("slot")
        r = sm[step]
        assert r["reward_mean"] == pytest.approx(groups["reward"].mean().mean())
        assert r["n_groups"] == groups.ngroups
        assert r["n_datums"] == int((~grp["degenerate"]).sum())
        assert r["reward_schema"] == pytest.approx(grp["reward_schema"].mean())
        assert r["advantage_std"] == pytest.approx(grp["advantage"].std(ddof=1), abs=1e-12)
        assert r["advantage_max"] == pytest.approx(grp["advantage"].max())


def test_datum_arrays_aligned(adv):
    d = rollouts.datum_arrays(adv).select(
        F.size("target_tokens").alias("a"), F.size("padded_logprobs").alias("b"),
        F.size("padded_advantages").alias("c"), "prompt_len", F.size("tokens").alias("n")).collect()
    assert d
    for r in d:
        assert r["a"] == r["b"] == r["c"] == r["prompt_len"] - 1 + r["n"]


def test_normalized_advantage_option(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 1, 0.0), (0, 2, 0.5), (0, 2, 0.5)],
                               "step int, slot long, reward double")
    out = {(r["slot"], r["reward"]): r["advantage"]
           for r in rollouts.group_advantages(df, normalize=True).collect()}
    assert out[(1, 1.0)] == pytest.approx(0.5 / math.sqrt(0.5))
    assert out[(2, 0.5)] == 0.0


def test_cyclic_batches(spark):
    prompts = spark.range(5).withColumnRenamed("id", "prompt_pos")
    b = rollouts.cyclic_batches(prompts, 5, steps=3, batch_size=4).orderBy("step", "slot").collect()
    assert [r["prompt_pos"] for r in b] == [0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 0, 1]


# --------------------------------------------------------------------------
# preparation
# --------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10, 201, 1000])
def test_split_sizes_sum(n):
    a, b, c = prep.split_sizes(n)
    assert a + b + c == n and min(a, b, c) >= 0
    if n < 3:
        assert (a, b, c) == (n, 0, 0)


def test_split_exact_disjoint_and_sized(spark):
    f1 = fx.corpus_f1(spark, SF_ORACLE)
    s = prep.split_exact(f1).groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in s}
    n_train, n_val, n_test = prep.split_sizes(1000)
    assert sizes == {"train": n_train, "validation": n_val, "test": n_test}


def test_rank_is_exact_and_partition_independent(spark):
    f1 = fx.corpus_f1(spark, SF_ORACLE).select("row_id", "source")
    a = rank.shuffled(f1.repartition(1), ["row_id"], n_buckets=64).select("row_id", "rank")
    b = rank.shuffled(f1.repartition(7), ["row_id"], n_buckets=64).select("row_id", "rank")
    pa, pb = a.toPandas().sort_values("row_id"), b.toPandas().sort_values("row_id")
    assert list(pa["rank"]) == list(pb["rank"])
    assert sorted(pa["rank"]) == list(range(1, len(pa) + 1))


def test_rank_matches_plain_sort(spark):
    f1 = fx.corpus_f1(spark, SF_ORACLE).select("row_id", "source")
    keyed = f1.withColumn("u", rank.order_key(F.col("source"), F.col("row_id")))
    got = rank.bucketed_rank(keyed, "u", ["row_id"], ["source"], n_buckets=16).toPandas()
    pdf = keyed.toPandas().sort_values(["source", "u", "row_id"])
    pdf["want"] = pdf.groupby("source").cumcount() + 1
    m = got.merge(pdf[["row_id", "want"]], on="row_id")
    assert (m["rank"] == m["want"]).all()


def test_dedup_keeps_lowest_id(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (5, "y"), (4, "z")], "row_id long, text string")
    got = sorted(r["row_id"] for r in prep.dedup_first(df, F.md5("text")).collect())
    assert got == [1, 2, 4]


def test_q14_whitespace_twins_survive_dedup(spark):
    df = spark.createDataFrame([(1, "a  b"), (2, "a b")], "row_id long, text string")
    kept = prep.dedup_first(df, F.md5("text"))
    assert kept.count() == 2
    assert {r["text"] for r in prep.normalize_whitespace(kept).collect()} == {"a b"}


def test_whitespace_like_python(spark):
    texts = ["  a\tb\n\nc  ", "x\x0by\x1cz", "é f　g", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in prep.normalize_whitespace(df).collect()]
    assert got == [" ".join(t.split()) for t in texts]


def test_balance_counts_equal_target(spark):
    f1 = fx.corpus_f1(spark, SF_ORACLE)
    counts = prep.source_counts(f1)
    target = prep.balance_target(counts)
    assert target == 500  # FIXTURES F1: median 137, floor min(500, 620)
    got = {r["source"]: r["count"] for r in prep.balance_sources(f1).groupBy("source").count().collect()}
    assert set(got.values()) == {500}


def test_balance_target_even_median_integer_mean(spark):
    c = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4), ("d", 1000)], "source string, n long")
    assert prep.balance_target(c) == max((2 + 4) // 2, min(500, 1000))
    c2 = spark.createDataFrame([("a", 3), ("b", 7)], "source string, n long")
    assert prep.balance_target(c2) == 7


def test_complete_rows_truthiness(spark):
    df = spark.createDataFrame([("", None, 0), ("x", None, 0), ("", [1], 0), ("", [], 5)],
                               "text string, messages array<int>, id int")
    assert prep.complete_rows(df).count() == 3


def test_epoch_batches_cover_each_row_once_per_epoch(spark):
    df = spark.range(37).withColumnRenamed("id", "row_id")
    b = prep.epoch_batches(df, epochs=2, batch_size=8).toPandas()
    assert len(b) == 74
    for _, g in b.groupby("epoch"):
        assert sorted(g["row_id"]) == list(range(37))
        assert g.groupby("batch_idx").size().tolist() == [8, 8, 8, 8, 5]
    assert b["global_step"].max() == 10


def test_union_by_name_tags_sources(spark):
    from toolframe.sources import readers
    specs = [readers.SourceSpec("d", f"{SF_SMALL}/documents.parquet", "parquet"),
             readers.SourceSpec("bad", "/nonexistent/x.parquet", "parquet"),
             readers.SourceSpec("off", f"{SF_SMALL}/documents.parquet", "parquet", enabled=False)]
    errors = {}
    df = readers.load_all(spark, specs, errors)
    assert {r[0] for r in df.select("source").distinct().collect()} == {"d"}
    assert list(errors) == ["bad"]
    with pytest.raises(readers.SourceError):
        readers.load_all(spark, [specs[1]])



def test_capped_rank_is_prefix_of_full_rank(spark):
    f1 = fx.corpus_f1(spark, SF_ORACLE).select("row_id")
    full = {r["row_id"]: r["rank"] for r in rank.shuffled(f1, ["row_id"], n_buckets=256).collect()}
    capped = {r["row_id"]: r["rank"] for r in rank.shuffled(f1, ["row_id"], n_buckets=256, max_rank=37).collect()}
    assert capped == {k: v for k, v in full.items() if v <= 37}


def test_stratified_split_sizes_per_stratum(spark):
    f1 = fx.corpus_f1(spark, SF_ORACLE)
    got = prep.split_stratified(f1, ["source"]).groupBy("source", "split").count().collect()
    per = {}
    for r in got:
        per.setdefault(r["source"], {})[r["split"]] = r["count"]
    counts = {r["source"]: r["n"] for r in prep.source_counts(f1).collect()}
    for src, n in counts.items():
        a, b, c = prep.split_sizes(n)
        assert per[src] == {k: v for k, v in {"train": a, "validation": b, "test": c}.items() if v}
