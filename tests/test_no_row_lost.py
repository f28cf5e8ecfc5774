"""Rows without a key, a group or an id stay."""

from pyspark.sql import functions as F

from toolframe.operators import convo, prep, rank
from toolframe.plans.prepare import PrepareConfig, prepare_rows
from toolframe.streaming import scoring


def test_default_key_is_the_whole_row(spark):
    calls = spark.createDataFrame([(i, f"do {i % 5}", "[]", "a") for i in range(10)], "row_id long, instruction string, tool_calls string, source string")
    texts = spark.createDataFrame([(i, f"text {i}", "b") for i in range(20)], "row_id long, text string, source string")
    rows = calls.unionByName(texts, allowMissingColumns=True)
    for key in ((), ("instruction", "tool_calls"), ("source", "instruction")):
        got = prepare_rows(rows, PrepareConfig(sources=(), out_dir="", balance_sources=False, dedup_key=key))
        assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == {"a": 5, "b": 20}, key


def test_rows_without_a_source_are_a_source(spark):
    rows = spark.range(1300).selectExpr("id AS row_id", "CASE WHEN id < 600 THEN 'a' WHEN id < 700 THEN 'b' END AS source")
    got = {r["source"]: r["count"] for r in prep.balance_sources(rows).groupBy("source").count().collect()}
    assert got == {"a": 600, "b": 600, None: 600}
    few = spark.range(900).selectExpr("id AS row_id", "CASE WHEN id < 800 THEN 'a' WHEN id < 890 THEN 'b' END AS source")
    drawn = prep.balance_sources(few).where("source is null")
    assert drawn.count() == 500 and drawn.select("row_id").distinct().count() == 10


def test_ranks_in_a_null_group_and_with_counted_buckets(spark, monkeypatch):
    monkeypatch.setattr(rank, "BUCKET_ROWS", 10)
    rows = spark.range(500).selectExpr("id AS row_id", "CASE WHEN id % 3 > 0 THEN id % 3 END AS g")
    got = rank.shuffled(rows, ["row_id"], group=["g"]).toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
    assert len(got) == 500


def test_a_prompt_in_two_slots_of_a_step_keeps_its_samples(spark):
    rows = [(1, s, 7, i, "2024-01-01 00:00:00", "no call here", "t", "{}", "[]") for s in (0, 1) for i in range(4)]
    df = spark.createDataFrame(rows * 2, "step int, slot int, prompt_id long, sample_id int, ts string, completion string, expected_tool string, expected_args string, expected_chain string")
    assert scoring.score_stream(df.withColumn("ts", F.to_timestamp("ts"))).count() == 8


def test_turns_without_a_conversation_id(spark):
    turns = spark.createDataFrame([(None, 0, "user"), (None, 1, "assistant"), (1, 0, "user")], "conv_id long, turn long, role string")
    got = sorted((r.turn, r.weight, r.has_assistant) for r in convo.train_on(turns).where("conv_id is null").collect())
    assert convo.train_on(turns).count() == 3 and got == [(0, 0, True), (1, 1, True)]
