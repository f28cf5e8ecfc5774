"""Stand-in inputs derived from the driver's test tables (FIXTURES.md).

These builders only shape rows into the schemas the jobs expect; they do no
part of any job's work. Every job must be right for any data of that schema.
Each builder has a DuckDB twin in ``toolframe.plans.oracle`` so both engines
see identical input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CALL = """'{"name": "' || event_type || '", "arguments": ' || props || '}'"""
_WRONG = """'{"name": "none", "arguments": ' || props || '}'"""

# Completion text by ``event_id mod 10`` (FIXTURES F2 table), as one SQL expression; every eleventh is hostile.
_COMPLETION_SQL = f"""CASE WHEN pmod(event_id, 11) = 10 THEN CASE pmod(event_id DIV 11, 7)
    WHEN 0 THEN '<tool_call>' || {_CALL} || ']</tool_call>'
    WHEN 1 THEN '<tool_call>' || {_CALL} || '] trailing</tool_call>'
    WHEN 2 THEN '<tool_call>' || {_CALL} || '][</tool_call>'
    WHEN 3 THEN '<tool_call>{{"name": "none", "name": "' || event_type || '", "arguments": ' || props || '}}</tool_call>'
    WHEN 4 THEN '<tool_call>{{"name": "' || event_type || '", "arguments": ' || replace(props, '}}', '.0}}') || '}}</tool_call>'
    WHEN 6 THEN '<tool_call>{{"name": "' || event_type || '", "arguments": {{"k": [1, 2.0]}}}}</tool_call>'
    ELSE '<tool_call>' || {_CALL} || ', ' || {_WRONG} || '</tool_call>' END
  ELSE CASE pmod(event_id, 10)
  WHEN 0 THEN '<tool_call>' || char(10) || {_CALL} || char(10) || '</tool_call>'
  WHEN 1 THEN '<tool_call>' || char(10) || {_CALL} || char(10) || '</tool_call>'
  WHEN 2 THEN '```json' || char(10) || {_CALL} || char(10) || '```'
  WHEN 3 THEN '<|function_call|>' || {_CALL}
  WHEN 4 THEN '<think>' || {_WRONG} || '</think>' || char(10) || '<tool_call>' || {_CALL} || '</tool_call>'
  WHEN 5 THEN '<think>open <tool_call>' || {_CALL} || '</tool_call>'
  WHEN 6 THEN '<tool_call>' || {_WRONG} || '</tool_call>'
  WHEN 7 THEN '<tool_call>{{"name": "' || event_type || '", "arguments": ' || props || '</tool_call>'
  WHEN 8 THEN '<tool_call>' || {_CALL} || '</tool_call>' || char(10) || '<tool_call>' || {_WRONG} || '</tool_call>'
  ELSE 'no call here' END END"""

_F2_EXPRS = [
    "event_id",
    "ts",
    "CAST(event_id DIV 8 AS BIGINT) AS prompt_id",
    "CAST(pmod(event_id, 8) AS INT) AS sample_id",
    "CAST(event_id DIV 128 AS INT) AS step",
    "CAST(pmod(event_id DIV 8, 16) AS INT) AS slot",
    "user_id",
    "event_type AS expected_tool",
    """CASE WHEN pmod(event_id, 11) = 10 AND pmod(event_id DIV 11, 7) = 6 THEN CASE WHEN pmod(event_id, 2) = 0 THEN '{"k": [1.0, 2]}' ELSE '{"k": [1, 2.0]}' END
        WHEN pmod(event_id, 3) = 0 THEN props ELSE replace(props, '}', ', "extra": 1}') END AS expected_args""",
    """CASE WHEN pmod(event_id, 7) < 3 THEN '["' || event_type || '", "none"]' ELSE '[]' END AS expected_chain""",
    "CAST(1 + pmod(event_id, 50) AS INT) AS n_tokens",
    "value / 10 AS elapsed_s",
    "CAST(3 + pmod(event_id DIV 8, 5) AS INT) AS prompt_len",
    f"{_COMPLETION_SQL} AS completion",
]


def completions_f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2: one scored completion per event, with its own expected values."""
    return table(spark, sf_dir, "events").selectExpr(*_F2_EXPRS)


def rollouts_f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROLLOUT_SCHEMA rows: completions with token ids and log-probs, no expectations.

    Slots 5 and 9 of every step are drawn for prompt 0: one prompt is hot, and occurs twice in a step.
    """
    c = completions_f2(spark, sf_dir).withColumn("prompt_id", F.expr("CASE WHEN slot IN (5, 9) THEN 0L ELSE prompt_id END"))
    tokens = "transform(sequence(0, n_tokens - 1), i -> CAST(pmod(user_id * 131 + i * 7, 50000) AS INT))"
    return c.selectExpr("event_id", "step", "prompt_id", "sample_id", "slot", "completion", "prompt_len",
                        f"{tokens} AS tokens",
                        f"transform({tokens}, x -> -CAST(pmod(x, 100) AS DOUBLE) / 100.0) AS logprobs")


def prompts_f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PROMPT_SCHEMA rows: expected values of each prompt, from its sample 0."""
    c = completions_f2(spark, sf_dir)
    return c.filter(F.col("sample_id") == 0).select(
        "prompt_id",
        F.concat(F.lit("Call "), F.col("expected_tool"), F.lit(" for user "),
                 F.col("user_id").cast("string")).alias("user"),
        "expected_tool", "expected_args", "expected_chain")


STAGES = ["baseline", "sft", "grpo"]


def examples_f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 EVAL_SCHEMA rows: one example per event."""
    c = completions_f2(spark, sf_dir)
    eid = F.col("event_id")
    return c.select(
        eid.alias("example_id"),
        F.concat(F.lit("Use "), F.col("expected_tool"), F.lit(" now")).alias("prompt"),
        "expected_tool",
        F.parse_json(F.col("expected_args")).alias("expected_args"),
        F.when(F.pmod(eid, F.lit(7)) < 3, F.array(F.col("expected_tool"), F.lit("none")))
        .otherwise(F.array().cast("array<string>")).alias("expected_chain"),
        F.lit("synthetic").alias("source"),
        F.lit(None).cast("string").alias("tools_context"))


def stage_completions_f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 COMPLETION_SCHEMA rows: the stage is ``(event_id div 10) mod 3``."""
    c = completions_f2(spark, sf_dir)
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]),
                         (F.pmod(F.floor(F.col("event_id") / 10), F.lit(3)) + 1).cast("int"))
    return c.select(stage.alias("stage"), F.col("event_id").alias("example_id"),
                    F.col("completion").alias("output"), "n_tokens", "elapsed_s")


def raw_rows_f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw loaded rows (JSON strings for nested fields) to exercise P8-P10."""
    e = table(spark, sf_dir, "events")
    eid, t, p = F.col("event_id"), F.col("event_type"), F.col("props")
    m4, m5, m3 = F.pmod(eid, F.lit(4)), F.pmod(eid, F.lit(5)), F.pmod(eid, F.lit(3))
    return e.select(
        eid.alias("example_id"),
        F.when(m4 == 0, F.lit("")).when(m4 == 1, F.lit("   "))
        .when(m4 == 2, F.concat(F.lit("Check "), t)).alias("instruction"),
        F.when((m4 == 0) | (m4 == 3), F.concat(F.lit("query "), F.col("user_id").cast("string"))).alias("query"),
        F.when(F.pmod(eid, F.lit(6)) == 0, F.lit("")).otherwise(F.lit("fallback")).alias("text"),
        F.when(m5 == 0, F.lit("[]")).when(m5 == 1, F.lit(""))
        .when(m5 == 2, F.concat(F.lit('[{"tool": "'), t, F.lit('", "parameters": '), p, F.lit("}]")))
        .when(m5 == 3, F.concat(F.lit('[{"name": "'), t, F.lit('", "arguments": '), p,
                                F.lit('}, {"name": "none"}, {"name": ""}]')))
        .otherwise(F.concat(F.lit('["'), t, F.lit('"]'))).alias("tool_calls"),
        F.lit('[{"name": "backup", "arguments": {"x": 1}}, {"name": "b2"}]').alias("expected_calls"),
        F.when(m3 == 0, F.lit('[{"description": "x", "name": "a"}, {"description": "no name"}, {"name": ""}]'))
        .when(m3 == 1, F.lit("not json")).alias("tools"),
        F.concat(F.lit('[{"name": "'), t, F.lit('"}]')).alias("api_list"))


def corpus_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 corpus rows: ``row_id = doc_id``, ``instruction = text``, ``source = lang``."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.col("text").alias("instruction"), "text",
                    F.col("lang").alias("source"), F.col("source").alias("category"), "n_chars")
