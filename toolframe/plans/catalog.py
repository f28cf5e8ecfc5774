"""Registered queries: one per SURVEY section 2 operator, with a DuckDB oracle.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole of the given tables. Doubles are rounded to 9 places in both engines
so the order-insensitive value hash compares values, not summation order.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from toolframe.functions import extract, jsonx
from toolframe.operators import rewards, rollouts
from toolframe.plans import fixtures as fx
from toolframe.plans import oracle as o
from toolframe.session import scratch_path, spread, written

QueryFn = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            jsonx.last_key_wins(spark)
            return fn(spark, sf_dir)
        run.__doc__ = fn.__doc__
        CATALOG[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r9(df: DataFrame) -> DataFrame:
    """Round every double column to 9 places (oracle comparison)."""
    return df.select(*[F.round(F.col(f.name), 9).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# --------------------------------------------------------------------------
# E: extraction over F2 completions
# --------------------------------------------------------------------------

def _calls_f2(spark, sf_dir):
    return rewards.with_calls(spread(fx.completions_f2(spark, sf_dir)))


_EX = f"WITH {o.F2}, {o.extract_cte('f2')}"


@query("e01_strip_think", f"{_EX} SELECT event_id, clean FROM ex")
def e01(spark, sf_dir):
    c = fx.completions_f2(spark, sf_dir)
    return c.select("event_id", extract.strip_think(F.col("completion")).alias("clean"))


@query("e02_extract_call", f"""{_EX}
SELECT event_id, {o.name_of('call')} AS call_name,
       {o.fold(f"CAST({o.args_of('call')} AS VARCHAR)")} AS call_args
FROM ex""")
def e02(spark, sf_dir):
    c = _calls_f2(spark, sf_dir)
    return c.select("event_id", extract.call_name(F.col("call")).alias("call_name"),
                    F.to_json(jsonx.call_arguments(F.col("call"))).alias("call_args"))


@query("e03_extract_calls", f"""{_EX}
SELECT event_id, CAST(len(calls) AS INTEGER) AS n_calls,
       array_to_string(list_transform(calls, lambda x: {o.name_of('x')}), ',') AS call_names
FROM ex""")
def e03(spark, sf_dir):
    c = _calls_f2(spark, sf_dir)
    return c.select("event_id", F.size("calls").alias("n_calls"),
                    F.array_join(extract.call_names(F.col("calls")), ",").alias("call_names"))


@query("e04_flat_objects", f"""{_EX}
SELECT event_id, CAST(len(regexp_extract_all(clean, {o.FLAT}, 0)) AS INTEGER) AS n_flat FROM ex""")
def e04(spark, sf_dir):
    c = fx.completions_f2(spark, sf_dir)
    clean = extract.strip_think(F.col("completion"))
    return c.select("event_id", F.size(extract.flat_objects(clean)).alias("n_flat"))


# --------------------------------------------------------------------------
# R / A9: rewards over F2 completions (each row its own expectations)
# --------------------------------------------------------------------------

_RW = f"WITH {o.F2}, {o.extract_cte('f2')}, {o.rewards_cte('ex')}"


def _scored_f2(spark, sf_dir, gating="intended"):
    return rewards.score(spread(fx.completions_f2(spark, sf_dir)), gating=gating)


def _reward_query(rid: str, col: str):
    @query(rid, f"{_RW} SELECT event_id, {o.r9(col)} AS {col} FROM rw")
    def q(spark, sf_dir):
        return r9(_scored_f2(spark, sf_dir).select("event_id", col))
    return q


_reward_query("r01_schema_reward", "reward_schema")
_reward_query("r02_tool_name_reward", "reward_tool_name")
_reward_query("r03_argument_f1_reward", "reward_argument_f1")
_reward_query("r04_full_chain_reward", "reward_chain")
_reward_query("r05_chain_partial_reward", "reward_chain_partial")


def _composite_query(qid: str, gating: str):
    n, rew = o.composite(gating)

    @query(qid, f"{_RW} SELECT event_id, {n} AS n_components, {o.r9(rew)} AS reward FROM rw")
    def q(spark, sf_dir):
        return r9(_scored_f2(spark, sf_dir, gating).select("event_id", "n_components", "reward"))
    return q


_composite_query("a09_composite_reward", "intended")
_composite_query("a09_composite_reward_grpo", "always")


# --------------------------------------------------------------------------
# GRPO rollouts (rollouts x prompts)
# --------------------------------------------------------------------------

def scored_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E3 (map side) -> J2 -> R1-R5 -> A9 (GRPO gating) -> W1."""
    extracted = rewards.with_calls(spread(fx.rollouts_f2(spark, sf_dir)))
    joined = rollouts.join_prompts(extracted, rewards.with_expected(fx.prompts_f2(spark, sf_dir)))
    scored = rewards.score(joined, gating="always")
    return rollouts.group_advantages(scored)


_n5, _rew5 = o.composite("always")
_RO = f"""WITH {o.F2}, {o.ROLLOUTS},
j AS (SELECT r.*, p."user", p.expected_tool, p.expected_args, p.expected_chain
      FROM rollouts r JOIN prompts p USING (prompt_id)),
{o.extract_cte('j')}, {o.rewards_cte('ex')},
sc AS (SELECT *, {_rew5} AS reward FROM rw),
adv AS (
  SELECT *, avg(reward) OVER g AS group_mean, count(*) OVER g AS group_size,
         max(reward) OVER g = min(reward) OVER g AS degenerate,
         reward - avg(reward) OVER g AS advantage
  FROM sc WINDOW g AS (PARTITION BY step, slot)
)"""

_GROUPS = """grp AS (SELECT step, slot, any_value(group_mean) AS group_mean,
                    count(*) AS group_size, any_value(degenerate) AS degenerate
             FROM adv GROUP BY step, slot)"""


@query("j02_rollout_prompt_join", f"""WITH {o.F2}, {o.ROLLOUTS}
SELECT r.step, r.slot, r.prompt_id, r.sample_id, p.expected_tool, p.expected_chain
FROM rollouts r JOIN prompts p USING (prompt_id)""")
def j02(spark, sf_dir):
    j = rollouts.join_prompts(fx.rollouts_f2(spark, sf_dir), fx.prompts_f2(spark, sf_dir))
    return j.select("step", "slot", "prompt_id", "sample_id", "expected_tool", "expected_chain")


@query("j03_explode_samples", f"""WITH {o.F2}, {o.ROLLOUTS}
SELECT step, slot, sample_id, completion, array_to_string(tokens, ',') AS tokens FROM rollouts""")
def j03(spark, sf_dir):
    """Completions and token arrays of each batch slot, taken apart by position."""
    rows = fx.rollouts_f2(spark, sf_dir).groupBy("step", "slot").agg(F.array_sort(F.collect_list(F.struct("sample_id", "completion", "tokens"))).alias("g"))
    groups = rows.select("step", "slot", F.transform("g", lambda x: x["completion"]).alias("completions"), F.transform("g", lambda x: x["tokens"]).alias("token_lists"))
    out = rollouts.explode_samples(groups, "completions", ("token_lists",))
    return out.select("step", "slot", "sample_id", "completion", F.array_join(F.col("token_list").cast("array<string>"), ",").alias("tokens"))


@query("w01_group_advantage", f"""{_RO}
SELECT step, slot, sample_id, {o.r9('reward')} AS reward, {o.r9('advantage')} AS advantage FROM adv""")
def w01(spark, sf_dir):
    return r9(scored_rollouts(spark, sf_dir).select("step", "slot", "sample_id", "reward", "advantage"))


@query("w01_stream_advantages", f"""{_RO}
SELECT step, slot, sample_id, {o.r9('reward')} AS reward, {o.r9('group_mean')} AS group_mean, group_size, degenerate, {o.r9('advantage')} AS advantage FROM adv""")
def w01_stream(spark, sf_dir):
    """W1 and A11 from a stream of scored samples, a fifth of them delivered twice, equal to the window over all rows."""
    from toolframe.streaming import groups
    scored = written(scored_rollouts(spark, sf_dir).select("step", "slot", "sample_id", "reward", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, step)").alias("ts")), "scored")
    rows = written(scored.unionByName(scored.where("(step + slot) % 5 = 0")).repartitionByRange(8, "step"), "stream-in")
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)
    out = groups.run_available(groups.stream_advantages(stream, 8), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state"))
    return r9(out.where("complete and not late").select("step", "slot", F.col("sample_id").cast("int").alias("sample_id"), "reward", "group_mean", F.col("group_size").cast("long").alias("group_size"), "degenerate", "advantage"))


@query("a10_group_mean_reward", f"""{_RO}, {_GROUPS}
SELECT step, slot, {o.r9('group_mean')} AS group_mean, group_size, degenerate FROM grp""")
def a10(spark, sf_dir):
    return r9(rollouts.group_means(scored_rollouts(spark, sf_dir)))


@query("a11_degenerate_groups", f"""{_RO}, {_GROUPS}
SELECT step, count(*) AS n_groups, CAST(sum(CAST(degenerate AS INTEGER)) AS BIGINT) AS n_degenerate,
       {o.r9('sum(CAST(degenerate AS INTEGER)) / count(*)')} AS frac_degenerate
FROM grp GROUP BY step""")
def a11(spark, sf_dir):
    return r9(rollouts.degenerate_summary(scored_rollouts(spark, sf_dir)))


_COMPS = ["reward_schema", "reward_tool_name", "reward_argument_f1", "reward_chain", "reward_chain_partial"]
_STEP_SQL = f"""{_RO}, {_GROUPS},
pg AS (SELECT step, avg(group_mean) AS reward_mean, count(*) AS n_groups,
              CAST(sum(CAST(degenerate AS INTEGER)) AS BIGINT) AS n_degenerate,
              CAST(sum(CASE WHEN NOT degenerate THEN group_size ELSE 0 END) AS BIGINT) AS n_datums
       FROM grp GROUP BY step),
pr AS (SELECT step, {', '.join(f'avg({c}) AS {c}' for c in _COMPS)},
              avg(advantage) AS advantage_mean, stddev_samp(advantage) AS advantage_std,
              max(advantage) AS advantage_max, min(advantage) AS advantage_min
       FROM adv GROUP BY step),
sm AS (SELECT pg.*, CAST(n_degenerate AS DOUBLE) / n_groups AS frac_degenerate,
              {', '.join(f'pr.{c}' for c in _COMPS)}, advantage_mean, advantage_std, advantage_max, advantage_min
       FROM pg JOIN pr USING (step))"""


def _sel(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(o.r9(c) + f" AS {c}" if c in doubles else c for c in cols)


_A12_COLS = ["step", "reward_mean", "n_groups", "n_degenerate", "n_datums", "frac_degenerate"] + _COMPS + [
    "advantage_mean", "advantage_std", "advantage_max", "advantage_min"]
_A12_DBL = set(_A12_COLS) - {"step", "n_groups", "n_degenerate", "n_datums"}


def step_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(rollouts.step_metrics(scored_rollouts(spark, sf_dir), _COMPS).select(*_A12_COLS))


query("a12_step_metrics", f"{_STEP_SQL} SELECT {_sel(_A12_COLS, _A12_DBL)} FROM sm")(step_metrics_query)


@query("a13_component_means", f"{_STEP_SQL} SELECT step, {_sel(_COMPS, set(_COMPS))} FROM sm")
def a13(spark, sf_dir):
    return step_metrics_query(spark, sf_dir).select("step", *_COMPS)


_A14 = ["advantage_mean", "advantage_std", "advantage_max", "advantage_min"]


@query("a14_advantage_stats", f"{_STEP_SQL} SELECT step, {_sel(_A14, set(_A14))} FROM sm")
def a14(spark, sf_dir):
    return step_metrics_query(spark, sf_dir).select("step", *_A14)


@query("k10_sample_log", f"""{_RO}
SELECT step, slot + 1 AS sample, substr("user", 1, 500) AS prompt, substr(completion, 1, 800) AS completion,
       expected_tool, CAST(reward_tool_name AS DOUBLE) AS reward
FROM adv WHERE step % 10 = 0 AND slot < 2 AND sample_id = 0""")
def k10(spark, sf_dir):
    return rollouts.sample_log(scored_rollouts(spark, sf_dir), every=10, n=2)


@query("t05_datum_arrays", f"""{_RO},
d AS (SELECT step, slot, sample_id, prompt_len - 1 AS ob, tokens, advantage,
             prompt_len + greatest(len(tokens) - 1, 0) AS full_len
      FROM adv WHERE NOT degenerate)
SELECT step, slot, sample_id, CAST(full_len AS INTEGER) AS model_input_len,
       md5(array_to_string(list_concat(list_transform(range(ob), lambda i: 0), tokens), ',')) AS target_md5,
       md5(array_to_string(list_concat(list_transform(range(ob), lambda i: 0), list_transform(tokens, lambda x: x % 100)), ',')) AS logprob_md5,
       md5(array_to_string(list_concat(list_transform(range(ob), lambda i: '0.000000'),
                                       list_transform(range(full_len - ob), lambda i: printf('%.6f', round(advantage, 6) + 0.0))), ',')) AS advantage_md5
FROM d""")
def t05(spark, sf_dir):
    """The three arrays themselves, as digests of their values in order (log-probabilities as hundredths)."""
    d = rollouts.datum_arrays(scored_rollouts(spark, sf_dir))
    joined = lambda c: F.md5(F.array_join(c, ","))
    return d.select(
        "step", "slot", "sample_id", F.col("model_input_len").cast("int").alias("model_input_len"),
        joined(F.col("target_tokens").cast("array<string>")).alias("target_md5"),
        joined(F.transform("padded_logprobs", lambda x: F.round(-x * 100).cast("int").cast("string"))).alias("logprob_md5"),
        joined(F.transform("padded_advantages", lambda x: F.format_string("%.6f", F.round(x, 6) + F.lit(0.0)))).alias("advantage_md5"))


# --------------------------------------------------------------------------
# evaluation
# --------------------------------------------------------------------------

from toolframe.functions.text import md5_bucket  # noqa: E402
from toolframe.operators import evals  # noqa: E402

_EV = o.eval_ctes()
_STAGE_ORDER = {s: i for i, s in enumerate(fx.STAGES)}
_METRIC_RANK = {m: i for i, m in enumerate(evals.METRIC_ORDER)}


def _eval_inputs(spark, sf_dir):
    return fx.examples_f3(spark, sf_dir), spread(fx.stage_completions_f3(spark, sf_dir))


def stage_metrics_f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex, comp = _eval_inputs(spark, sf_dir)
    return evals.stage_metrics(ex, comp)


def _metric_long(spark, sf_dir):
    return evals.metric_table(stage_metrics_f3(spark, sf_dir))


@query("j01_examples_with_completions", f"""{_EV}
SELECT stage, example_id, expected_tool, n_tokens FROM f3c""")
def j01(spark, sf_dir):
    ex, comp = _eval_inputs(spark, sf_dir)
    return evals.join_completions(ex, comp).select("stage", "example_id", "expected_tool", "n_tokens")


def _stage_query(qid: str, cols: list[str], ints: set[str] = frozenset()):
    sel = ", ".join(c if c in ints else f"{o.r9(c)} AS {c}" for c in cols)

    @query(qid, f"{_EV} SELECT stage, {sel} FROM sw")
    def q(spark, sf_dir):
        return r9(stage_metrics_f3(spark, sf_dir).select("stage", *cols))
    return q


_stage_query("a04_tool_selection_accuracy", ["tool_selection_accuracy"])
_stage_query("a05_argument_accuracy", ["argument_accuracy"])
_stage_query("a06_schema_compliance", ["schema_compliance"])
_stage_query("a07_multi_step_taxonomy",
             ["n_multi_step", "multi_step_success", "multi_step_zero_calls", "multi_step_one_call_only",
              "multi_step_wrong_order", "multi_step_partial", "multi_step_other"], {"n_multi_step"})
_stage_query("a08_latency", ["avg_latency_ms", "ms_per_token"])


@query("l04_latency_head", f"{_EV} SELECT stage, example_id, pos FROM lh")
def l04(spark, sf_dir):
    _, comp = _eval_inputs(spark, sf_dir)
    return evals.latency_head(comp).select("stage", "example_id", F.col("pos").cast("bigint").alias("pos"))


_ORDER_SQL = ("min(CASE stage " + " ".join(f"WHEN '{s}' THEN {i}" for s, i in _STAGE_ORDER.items())
              + " END * 1000 + CASE metric " + " ".join(f"WHEN '{m}' THEN {i}" for m, i in _METRIC_RANK.items())
              + " ELSE 999 END)")


@query("c01_stage_comparison", f"""{_EV},
pv AS (SELECT metric, {_ORDER_SQL} AS metric_order,
              {', '.join(f"max(value) FILTER (WHERE stage = '{s}') AS {s}" for s in fx.STAGES)}
       FROM ml GROUP BY metric)
SELECT metric, metric_order, {', '.join(f'{o.r9(s)} AS {s}' for s in fx.STAGES)},
       {', '.join(f'{o.display(s)} AS {s}_display' for s in fx.STAGES)}
FROM pv""")
def c01(spark, sf_dir):
    return r9(evals.compare_stages(_metric_long(spark, sf_dir), fx.STAGES, _METRIC_RANK))


@query("p20_metric_display", f"{_EV} SELECT stage, metric, {o.display('value')} AS display FROM ml")
def p20(spark, sf_dir):
    m = _metric_long(spark, sf_dir)
    return m.select("stage", "metric", evals.display_value(F.col("metric"), F.col("value")).alias("display"))


@query("k08_comparison_sink_table", f"""{_EV}
SELECT b.metric, {o.r9('b.value')} AS baseline,
       {o.r9("coalesce(s.value, 'NaN'::DOUBLE)")} AS sft, {o.r9("coalesce(g.value, 'NaN'::DOUBLE)")} AS grpo
FROM (SELECT * FROM ml WHERE stage = 'baseline') b
LEFT JOIN (SELECT * FROM ml WHERE stage = 'sft') s USING (metric)
LEFT JOIN (SELECT * FROM ml WHERE stage = 'grpo') g USING (metric)""")
def k08(spark, sf_dir):
    return r9(evals.comparison_sink_table(_metric_long(spark, sf_dir), fx.STAGES))


def _wide_long(spark, sf_dir):
    """Long table with the multi-step breakdown too (model card needs multi_step_partial)."""
    sm = stage_metrics_f3(spark, sf_dir)
    return evals.metric_table(sm, evals.METRIC_ORDER + ["multi_step_partial"])


_CARD_VALUES = ", ".join(f"({i}, '{lbl}', '{m}')" for i, (lbl, m) in enumerate(evals.MODEL_CARD_METRICS))


@query("k09_model_card_metrics", f"""{_EV},
ml2 AS (UNPIVOT sw ON tool_selection_accuracy, argument_accuracy, schema_compliance, multi_step_success,
                       avg_latency_ms, ms_per_token, multi_step_partial INTO NAME metric VALUE value),
w(pos, label, metric) AS (VALUES {_CARD_VALUES})
SELECT CAST(w.pos AS INTEGER) AS pos, w.label, w.metric, printf('%.1f%%', 100.0 * coalesce(v.value, 0.0)) AS display
FROM w LEFT JOIN (SELECT * FROM ml2 WHERE stage = 'grpo') v USING (metric)""")
def k09(spark, sf_dir):
    return evals.model_card_table(_wide_long(spark, sf_dir), "grpo")


_ALL_BENCH = list(evals.BENCHMARK_KEYS)
_REQ_VALUES = ", ".join(f"('{s}', '{b}', '{evals.BENCHMARK_KEYS[b]}')" for s in fx.STAGES for b in _ALL_BENCH)


@query("j06_pending_benchmarks", f"""{_EV},
req(stage, benchmark, metric) AS (VALUES {_REQ_VALUES}),
have AS (SELECT stage, metric FROM ml WHERE stage <> 'sft')
SELECT r.stage, r.benchmark, r.metric FROM req r
WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.stage = r.stage AND h.metric = r.metric)""")
def j06(spark, sf_dir):
    have = _metric_long(spark, sf_dir).filter(F.col("stage") != "sft")
    req = evals.requested_table(spark, fx.STAGES, _ALL_BENCH)
    return evals.pending_benchmarks(req, have).select("stage", "benchmark", "metric")


@query("k05_atomic_commits", """
WITH a AS (SELECT event_id, user_id, value FROM events WHERE event_id % 3 <> 0),
b AS (SELECT event_id, user_id, value + 1 AS value FROM events WHERE event_id % 2 = 0),
c AS (SELECT event_id, -1 AS user_id, 0.5 AS value FROM events WHERE event_id % 10 = 7),
ab AS (SELECT * FROM a WHERE event_id NOT IN (SELECT event_id FROM b) UNION ALL SELECT * FROM b)
SELECT 1 AS version, event_id, user_id, round(value, 9) AS value FROM ab
UNION ALL SELECT 3, event_id, user_id, round(value, 9) FROM ab WHERE event_id NOT IN (SELECT event_id FROM c) UNION ALL SELECT 3, event_id, user_id, value FROM c""")
def k05_commits(spark, sf_dir):
    """Two writers that began with the same version, a third after them and a compaction: what readers of versions 1 and 3 see."""
    from toolframe.sources import versions
    events, path = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "value"), scratch_path(spark, "versions")
    first, second = versions.stage(path, events.where("event_id % 3 <> 0"), ["event_id"]), versions.stage(path, events.where("event_id % 2 = 0").withColumn("value", F.col("value") + 1), ["event_id"])
    versions.commit(spark, path, first, ["event_id"])
    pinned = versions.commit(spark, path, second, ["event_id"])
    versions.upsert(path, events.where("event_id % 10 = 7").select("event_id", F.lit(-1).cast("long").alias("user_id"), F.lit(0.5).alias("value")), ["event_id"])
    versions.compact(spark, path)
    both = versions.read(spark, path, pinned).withColumn("version", F.lit(1)).unionByName(versions.read(spark, path).withColumn("version", F.lit(3)))
    return r9(both.select("version", "event_id", "user_id", "value"))


@query("k05_checkpoint_upsert", f"""{_EV},
old AS (SELECT stage, metric, value FROM ml WHERE stage <> 'grpo'),
new AS (SELECT stage, metric, value + 1.0 AS value FROM ml WHERE stage <> 'baseline')
SELECT stage, metric, {o.r9('value')} AS value FROM (
  SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.stage = o.stage AND n.metric = o.metric)
  UNION ALL SELECT * FROM new)""")
def k05(spark, sf_dir):
    m = _metric_long(spark, sf_dir)
    old = m.filter(F.col("stage") != "grpo")
    new = m.filter(F.col("stage") != "baseline").withColumn("value", F.col("value") + 1.0)
    return r9(evals.upsert_metrics(old, new))


_REQUIRED = [(s, m) for s in fx.STAGES + ["dpo"] for m in ("schema_compliance", "multi_step_success")]
_REQUIRED_VALUES = ", ".join(f"('{s}', '{m}')" for s, m in _REQUIRED)


@query("v01_required_metrics", f"""{_EV},
req(stage, metric) AS (VALUES {_REQUIRED_VALUES})
SELECT r.stage, r.metric FROM req r
WHERE NOT EXISTS (SELECT 1 FROM ml h WHERE h.stage = r.stage AND h.metric = r.metric)""")
def v01(spark, sf_dir):
    req = spark.createDataFrame(_REQUIRED, "stage string, metric string")
    return evals.missing_required(_metric_long(spark, sf_dir), req)


# -- raw rows -> examples (P8, P9, P10, P13, P16, H9) --

_RAW = r"""
raw AS (
  SELECT event_id AS example_id,
    CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN 'Check ' || event_type END AS instruction,
    CASE WHEN event_id % 4 IN (0, 3) THEN 'query ' || CAST(user_id AS VARCHAR) END AS query,
    CASE WHEN event_id % 6 = 0 THEN '' ELSE 'fallback' END AS text,
    CASE event_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN ''
      WHEN 2 THEN '[{"tool": "' || event_type || '", "parameters": ' || props || '}]'
      WHEN 3 THEN '[{"name": "' || event_type || '", "arguments": ' || props || '}, {"name": "none"}, {"name": ""}]'
      ELSE '["' || event_type || '"]' END AS tool_calls,
    '[{"name": "backup", "arguments": {"x": 1}}, {"name": "b2"}]' AS expected_calls,
    CASE event_id % 3 WHEN 0 THEN '[{"description": "x", "name": "a"}, {"description": "no name"}, {"name": ""}]'
      WHEN 1 THEN 'not json' END AS tools,
    '[{"name": "' || event_type || '"}]' AS api_list
  FROM events
)"""


def _str_key(x: str, k: str) -> str:
    return f"nullif(CASE WHEN json_type({x}, '$.{k}') = 'VARCHAR' THEN json_extract_string({x}, '$.{k}') END, '')"


def _p9_parts(col: str, i: int) -> str:
    c = (f"(CASE WHEN trim({col}) <> '' AND json_valid(trim({col})) AND json_type(trim({col})) = 'ARRAY' "
         f"AND json_array_length(trim({col})) > 0 THEN CAST(trim({col}) AS JSON) END)")
    return f"{c} AS c{i}"


_P9 = f"""{_RAW},
r1 AS (SELECT *, {_p9_parts('tool_calls', 1)}, {_p9_parts('expected_calls', 2)} FROM raw),
r2 AS (SELECT *, json_extract(c1, '$[0]') AS f1, json_extract(c2, '$[0]') AS f2 FROM r1),
r3 AS (
  SELECT *,
""" + ",\n".join(
    f"""    CASE WHEN coalesce(json_type(f{i}) = 'OBJECT', false) THEN coalesce({_str_key(f'f{i}', 'name')}, {_str_key(f'f{i}', 'tool')}) END AS t{i},
    CASE WHEN c{i} IS NULL THEN NULL
         WHEN NOT coalesce(json_type(f{i}) = 'OBJECT', false)
              OR {o.args_of(f'f{i}')} IS NULL THEN '{{}}'
         WHEN json_type({o.args_of(f'f{i}')}) = 'OBJECT' THEN CAST({o.args_of(f'f{i}')} AS VARCHAR) END AS a{i},
    CASE WHEN c{i} IS NOT NULL THEN nullif(list_transform(list_filter(from_json(c{i}, '["JSON"]'),
           lambda e: json_type(e) = 'OBJECT'),
           lambda e: coalesce({_str_key('e', 'name')}, {_str_key('e', 'tool')}, '')), []) END AS ch{i}"""
    for i in (1, 2)) + """
  FROM r2
),
p9 AS (
  SELECT example_id, coalesce(t1, t2) AS expected_tool, coalesce(a1, a2) AS expected_args,
         list_filter(coalesce(ch1, ch2, CAST([] AS VARCHAR[])), lambda n: n <> '') AS expected_chain
  FROM r3
)"""


@query("p08_prompt_pick", f"""WITH {_RAW}
SELECT example_id, p AS prompt FROM (
  SELECT example_id, coalesce(nullif(instruction, ''), nullif(query, ''), nullif(text, '')) AS p FROM raw)
WHERE trim(p) <> ''""")
def p08(spark, sf_dir):
    raw = fx.raw_rows_f3(spark, sf_dir)
    return raw.select("example_id", evals.pick_prompt(raw).alias("prompt")).filter(F.col("prompt").isNotNull())


@query("p09_expected_fields", f"""WITH {_P9}
SELECT example_id, expected_tool, expected_args, array_to_string(expected_chain, ',') AS expected_chain FROM p9""")
def p09(spark, sf_dir):
    raw = spread(fx.raw_rows_f3(spark, sf_dir))
    e = evals.expected_fields(raw)
    return e.select("example_id", "expected_tool", F.to_json("expected_args").alias("expected_args"),
                    F.array_join("expected_chain", ",").alias("expected_chain"))


def _p10_key(col: str) -> str:
    arr = (f"(CASE WHEN json_valid(trim({col})) AND json_type(trim({col})) = 'ARRAY' "
           f"THEN from_json(trim({col}), '[\"JSON\"]') END)")
    defs = (f"list_filter({arr}[1:20], lambda d: json_type(d) = 'OBJECT' AND json_extract(d, '$.name') IS NOT NULL "
            f"AND CAST(json_extract(d, '$.name') AS VARCHAR) NOT IN ('null', 'false', '0', '\"\"', '[]', '{{}}'))")
    return (f"(CASE WHEN len({defs}) > 0 THEN '[' || array_to_string(list_transform({defs}, "
            f"lambda d: CAST(json(d) AS VARCHAR)), ',') || ']' END)")


@query("p10_tools_context", f"""WITH {_RAW}
SELECT example_id, coalesce({_p10_key('tools')}, {_p10_key('api_list')}) AS tools_context FROM raw""")
def p10(spark, sf_dir):
    raw = spread(fx.raw_rows_f3(spark, sf_dir))
    return raw.select("example_id", evals.tools_context(raw).alias("tools_context"))




_SYS_SQL = "'" + evals.TOOL_USE_SYSTEM_PROMPT.replace("'", "''") + "'"


@query("p13_system_prompt", f"""WITH {_RAW}, p AS (SELECT example_id,
  coalesce({_p10_key('tools')}, {_p10_key('api_list')}) AS tc FROM raw)
SELECT example_id, md5(CASE WHEN tc IS NULL THEN {_SYS_SQL}
                            ELSE {_SYS_SQL} || chr(10) || chr(10) || 'Available tools:' || chr(10) || tc END) AS system_md5 FROM p""")
def p13(spark, sf_dir):
    raw = fx.raw_rows_f3(spark, sf_dir)
    return raw.select("example_id", F.md5(evals.system_prompt(evals.tools_context(raw))).alias("system_md5"))


@query("p16_multi_step_filter", f"""WITH {_P9}
SELECT example_id, CAST(len(expected_chain) AS INTEGER) AS n_steps FROM p9 WHERE len(expected_chain) > 1""")
def p16(spark, sf_dir):
    e = evals.expected_fields(spread(fx.raw_rows_f3(spark, sf_dir)))
    return e.filter(F.size("expected_chain") > 1).select("example_id", F.size("expected_chain").alias("n_steps"))


def _md5_bucket_sql(x: str) -> str:
    acc = "0"
    for i in range(4):
        chunk = f"CAST(('0x' || substr(md5({x}), {8 * i + 1}, 8)) AS BIGINT)"
        acc = f"(({acc}) * 96 + {chunk} % 100) % 100"
    return acc


@query("h09_holdout_bucket", f"""WITH {_RAW},
b AS (SELECT example_id, {_md5_bucket_sql("CAST(example_id AS VARCHAR) || '|' || coalesce(tool_calls, '')")} AS bucket
      FROM raw)
SELECT example_id, CAST(bucket AS BIGINT) AS bucket FROM b WHERE bucket < 10""")
def h09(spark, sf_dir):
    raw = fx.raw_rows_f3(spark, sf_dir)
    key = F.concat_ws("|", F.col("example_id").cast("string"), F.coalesce(F.col("tool_calls"), F.lit("")))
    b = raw.select("example_id", md5_bucket(key).alias("bucket"))
    return b.filter(F.col("bucket") < F.lit(int(0.1 * 100)))


# --------------------------------------------------------------------------
# preparation
# --------------------------------------------------------------------------

from toolframe.functions.permute import permuted  # noqa: E402
from toolframe.operators import prep, rank  # noqa: E402
from toolframe.sources import readers  # noqa: E402

_F1 = """f1 AS (SELECT doc_id AS row_id, text AS instruction, text, lang AS source, source AS category, n_chars
        FROM documents)"""


def _u(key_sql: str) -> str:
    """SQL twin of ``rank.order_key``: 60-bit key from md5."""
    return f"CAST(('0x' || substr(md5({key_sql}), 1, 15)) AS BIGINT)"


def _unit(key_sql: str) -> str:
    """SQL twin of ``rank.unit_draw``."""
    return f"(CAST(('0x' || substr(md5({key_sql}), 1, 13)) AS BIGINT) / {float(1 << 52)!r})"


def _k(*parts: str, seed: str = "'42'") -> str:
    return " || '|' || ".join([seed] + [f"CAST({p} AS VARCHAR)" for p in parts])


@query("s02_multi_source_load", """
SELECT source, count(*) AS n_rows, count(text) AS n_text FROM (
  SELECT 'docs' AS source, text FROM documents
  UNION ALL SELECT 'convs' AS source, text FROM conversations) GROUP BY source""")
def s02(spark, sf_dir):
    specs = [readers.SourceSpec("docs", f"{sf_dir}/documents.parquet", "parquet"),
             readers.SourceSpec("convs", f"{sf_dir}/conversations.parquet", "parquet"),
             readers.SourceSpec("missing", f"{sf_dir}/no_such_table.parquet", "parquet")]
    df = readers.load_all(spark, specs)
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("n_text"))


@query("a01_dedup_first", f"""WITH {_F1}
SELECT row_id, source FROM f1 QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1""")
def a01(spark, sf_dir):
    # hash first, so the shuffle carries (hash, id, source), not the texts
    f1 = fx.corpus_f1(spark, sf_dir).select("row_id", "source", F.md5("text").alias("text_md5"))
    return prep.dedup_first(f1, F.col("text_md5")).select("row_id", "source")


@query("a01_dedup_removed", f"""WITH {_F1}
SELECT count(*) AS n_in, count(DISTINCT text) AS n_out, count(*) - count(DISTINCT text) AS n_removed FROM f1""")
def a01r(spark, sf_dir):
    counts = fx.corpus_f1(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_in"), F.count_distinct(F.md5("text")).alias("n_out"))
    return counts.withColumn("n_removed", F.col("n_in") - F.col("n_out"))


@query("k03_prepare_two_sources", """
WITH a AS (SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'turns', text FROM conversations
           UNION ALL SELECT 'items', text FROM benchmark UNION ALL SELECT 'items', text FROM benchmark WHERE item_id % 3 = 0),
d AS (SELECT DISTINCT source, text FROM a WHERE text IS NOT NULL AND text <> ''),
t AS (SELECT source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM d)
SELECT source, count(*) AS n_rows, count(*) AS n_ids,
       CAST(sum(least(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END, 2048)) AS BIGINT) AS n_tokens, count(*) AS n_known FROM t GROUP BY source""")
def k03(spark, sf_dir):
    """Three sources whose row ids clash, one without the key's column, through dedup, split and encoding: no row lost, merged or doubled."""
    from toolframe.plans.prepare import PrepareConfig, prepare_rows
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", F.lit("documents").alias("source"))
    turns = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("row_id"), "text", F.lit("turns").alias("source"))
    bench = fx.table(spark, sf_dir, "benchmark")
    items = bench.unionByName(bench.where("item_id % 3 = 0")).select(F.col("item_id").alias("row_id"), F.col("text").alias("instruction"), F.lit("items").alias("source"))
    cfg = PrepareConfig(sources=(), out_dir="", balance_sources=False, dedup_key=("source", "text"))
    split = prepare_rows(docs.unionByName(turns).unionByName(items, allowMissingColumns=True), cfg)
    flat = prep.unify_text(split.drop("row_key"), passthrough=("row_id", "split"))
    enc = tokens.encode(flat, tokens.build_vocabulary(flat), ["row_id", "source", "split"])
    n = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda s, m: s + m)
    unk = F.exists("input_ids", lambda i: i == 1)
    return enc.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_ids"), F.sum(n).alias("n_tokens"),
                                     F.count(F.when(~unk, 1)).alias("n_known"))


@query("a01_dedup_history", """
SELECT doc_id, doc_id % 3 AS run FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id % 3, doc_id) = 1""")
def a01_history(spark, sf_dir):
    """Three runs over parts of the documents, the second one repeated after a crash behind its keys: together one row per text."""
    from toolframe.operators import history
    docs, kept, path = fx.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k")), {}, scratch_path(spark, "key-history")
    for run in (0, 1, 1, 2):
        seen = history.KeyHistory(spark, path, buckets=16)
        part = docs.where(F.col("doc_id") % 3 == run)
        kept[run] = written(history.dedup_against(part, F.col("k"), seen, run, order="doc_id").select("doc_id", F.lit(run).cast("long").alias("run")), "run")
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query("a02_source_counts", f"WITH {_F1} SELECT source, count(*) AS n FROM f1 GROUP BY source")
def a02(spark, sf_dir):
    return prep.source_counts(fx.corpus_f1(spark, sf_dir))


_BAL_TAIL = f"""
c AS (SELECT source, count(*) AS n FROM b1 GROUP BY source),
s AS (SELECT list_sort(list(n)) AS l, count(*) AS k FROM c),
t AS (SELECT greatest(CASE WHEN k % 2 = 1 THEN l[k // 2 + 1] ELSE (l[k // 2] + l[k // 2 + 1]) // 2 END,
                      least(500, l[k])) AS target FROM s),
r AS (SELECT row_id, source,
             row_number() OVER (PARTITION BY source ORDER BY {_u("concat_ws('|', '42', source, row_id)")}, source, row_id) AS rk
      FROM b1),
under AS (SELECT r.source, r.row_id, 0 AS draw FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source, t
          WHERE c.n >= t.target AND r.rk <= t.target),
draws AS (SELECT c.source, c.n, unnest(range(1, t.target + 1)) AS draw FROM c, t WHERE c.n < t.target),
over AS (SELECT d.source, r.row_id, d.draw FROM draws d JOIN r
         ON r.source IS NOT DISTINCT FROM d.source AND r.rk = CAST(floor({_unit("concat_ws('|', '42', d.source, d.draw)")} * d.n) AS BIGINT) + 1),
bal AS (SELECT * FROM under UNION ALL SELECT * FROM over)"""
_SOME = "CASE WHEN row_id % 9 = 0 THEN NULL ELSE source END"  # some rows without a source
_BAL = f"WITH {_F1}, b1 AS (SELECT row_id, {_SOME} AS source FROM f1), {_BAL_TAIL}"


@query("a03_balance_sources", f"{_BAL} SELECT source, row_id, CAST(draw AS BIGINT) AS draw FROM bal")
def a03(spark, sf_dir):
    b = prep.balance_sources(fx.corpus_f1(spark, sf_dir).withColumn("source", F.expr(_SOME)))
    return b.select("source", "row_id", "draw")


@query("x03_balance_by_category", f"WITH {_F1}, b1 AS (SELECT row_id, CASE WHEN row_id % 11 = 0 THEN NULL ELSE category END AS source FROM f1), {_BAL_TAIL} SELECT source AS category, row_id, CAST(draw AS BIGINT) AS draw FROM bal")
def x03(spark, sf_dir):
    some = F.expr("CASE WHEN row_id % 11 = 0 THEN NULL ELSE category END")
    b = prep.balance_sources(fx.corpus_f1(spark, sf_dir).withColumn("category", some), source="category")
    return b.select("category", "row_id", "draw")


def _feistel_sql(source: str, x: str, keep: str) -> str:
    """SQL twin of one pass of ``permute``: ``source`` has the columns ``keep``, seed, a, b and the number ``x``; gives keep, seed, a, b, y."""
    text = f"SELECT {keep}, seed, a, b, {x} % a AS l, {x} // a AS r FROM {source}"
    for i in range(1, 5):
        value = f"CAST('0x' || substr(md5(CAST(seed AS VARCHAR) || '|{i}|' || CAST(r AS VARCHAR)), 1, 13) AS BIGINT)"
        text = f"SELECT {keep}, seed, a, b, r AS l, (l + {value}) % {'a' if i % 2 else 'b'} AS r FROM ({text})"
    return f"SELECT {keep}, seed, a, b, l + r * a AS y FROM ({text})"


def _places_sql(source: str, index: str) -> str:
    """CTEs up to ``places`` (the columns of ``source``, seed among them, and place): the permutation of ``index`` over all rows of f1."""
    keep = "row_id, epoch, n"
    return f"""size AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM f1),
start AS (SELECT row_id, epoch, n, seed, a, CAST(ceil(n / CAST(a AS DOUBLE)) AS BIGINT) AS b, {index} AS i FROM {source}, size),
walk AS ({_feistel_sql('start', 'i', keep)} UNION ALL {_feistel_sql('(SELECT * FROM walk WHERE y >= n)', 'y', keep)}),
places AS (SELECT row_id, epoch, y AS place FROM walk WHERE y < n)"""


@query("w04_shuffled_rank", f"""WITH RECURSIVE {_F1}, {_places_sql('(SELECT row_id, 0 AS epoch, 42 AS seed FROM f1)', 'row_id')}
SELECT row_id, place + 1 AS rank FROM places""")
def w04(spark, sf_dir):
    """A global shuffled rank as an expression over row numbers: no sort, no join, no shuffle."""
    f1 = fx.corpus_f1(spark, sf_dir)
    return f1.select("row_id", (permuted(F.col("row_id"), f1.count()) + 1).alias("rank"))


@query("w04_ranked_by_key", f"""WITH {_F1}
SELECT row_id, row_number() OVER (ORDER BY {_u(_k('row_id'))}, row_id) AS rank FROM f1""")
def w04_key(spark, sf_dir):
    """The same by hash keys, for rows without dense numbers: exact ranks from counted buckets."""
    return rank.shuffled(fx.corpus_f1(spark, sf_dir), ["row_id"]).select("row_id", F.col("rank").cast("bigint"))


@query("w03_rank_in_source", f"""WITH {_F1}
SELECT source, row_id, row_number() OVER (PARTITION BY source ORDER BY {_u("concat_ws('|', '42', source, row_id)")}, source, row_id)
       AS rank FROM (SELECT row_id, {_SOME} AS source FROM f1)""")
def w03(spark, sf_dir):
    f1 = fx.corpus_f1(spark, sf_dir).withColumn("source", F.expr(_SOME))
    r = rank.shuffled(f1, ["source", "row_id"], group=["source"])
    return r.select("source", "row_id", F.col("rank").cast("bigint"))


_SPLIT = f"""WITH {_F1},
n AS (SELECT count(*) AS n FROM f1),
a AS (SELECT n, CAST(ceil(greatest(1.0::DOUBLE - 0.8::DOUBLE, 1.0 / n) * n) AS BIGINT) AS n_rest FROM n),
b AS (SELECT n, CASE WHEN n < 3 THEN n ELSE n - n_rest END AS n_train,
             CASE WHEN n < 3 THEN 0 WHEN n_rest < 2 THEN n_rest
                  ELSE n_rest - CAST(ceil(greatest(1.0::DOUBLE - 0.1::DOUBLE / (1.0::DOUBLE - 0.8::DOUBLE),
                                                   1.0 / n_rest) * n_rest) AS BIGINT) END AS n_val FROM a),
r AS (SELECT row_id, row_number() OVER (ORDER BY {_u(_k('row_id'))}, row_id) AS rk FROM f1),
sp AS (SELECT row_id, CASE WHEN rk <= n_train THEN 'train' WHEN rk <= n_train + n_val THEN 'validation'
                           ELSE 'test' END AS split FROM r, b)"""


@query("l08_split_exact", f"{_SPLIT} SELECT row_id, split FROM sp")
def l08(spark, sf_dir):
    return prep.split_exact(fx.corpus_f1(spark, sf_dir)).select("row_id", "split")


@query("a15_split_counts", f"{_SPLIT} SELECT split, count(*) AS n FROM sp GROUP BY split")
def a15(spark, sf_dir):
    s = prep.split_exact(fx.corpus_f1(spark, sf_dir))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("l08_split_by_hash", f"""WITH {_F1},
b AS (SELECT row_id, {_md5_bucket_sql('CAST(row_id AS VARCHAR)')} AS bk FROM f1)
SELECT row_id, CASE WHEN bk < 80 THEN 'train' WHEN bk < 90 THEN 'validation' ELSE 'test' END AS split FROM b""")
def l08h(spark, sf_dir):
    f1 = fx.corpus_f1(spark, sf_dir)
    return prep.split_by_hash(f1, F.col("row_id").cast("string")).select("row_id", "split")


@query("l01_sample_cap", f"""WITH {_F1}
SELECT row_id FROM f1 QUALIFY row_number() OVER (ORDER BY {_u(_k('row_id'))}, row_id) <= 300""")
def l01(spark, sf_dir):
    return prep.cap_rows(fx.corpus_f1(spark, sf_dir), 300).select("row_id")


@query("l03_eval_cap", f"""WITH {_RAW}
SELECT example_id FROM raw QUALIFY row_number() OVER (ORDER BY {_u(_k('example_id'))}, example_id) <= 1000""")
def l03(spark, sf_dir):
    return prep.cap_rows(fx.raw_rows_f3(spark, sf_dir), 1000, key="example_id").select("example_id")


@query("l09_validation_prefix", f"""WITH {_F1},
n AS (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) AS n_val FROM f1)
SELECT row_id, CASE WHEN row_number() OVER (ORDER BY {_u(_k('row_id'))}, row_id) <= n_val
                    THEN 'validation' ELSE 'train' END AS part FROM f1, n""")
def l09(spark, sf_dir):
    return prep.validation_prefix(fx.corpus_f1(spark, sf_dir)).select("row_id", "part")


_EPOCHS, _BATCH = 2, 32
_EB = f"""WITH RECURSIVE {_F1},
ep AS (SELECT row_id, epoch, 42 + epoch AS seed FROM (SELECT row_id, unnest(range(0, {_EPOCHS})) AS epoch FROM f1)),
{_places_sql('ep', 'row_id')},
eb AS (SELECT epoch, row_id, CAST(place // {_BATCH} AS BIGINT) AS batch_idx, epoch * spe + place // {_BATCH} + 1 AS global_step, spe
       FROM places, (SELECT CAST(ceil(count(*) / {_BATCH}) AS BIGINT) AS spe FROM f1))"""


@query("l10_epoch_batches", f"""{_EB}
SELECT CAST(epoch AS INTEGER) AS epoch, row_id, batch_idx, CAST(global_step AS BIGINT) AS global_step,
       CAST(global_step * {_BATCH} AS BIGINT) AS samples_seen,
       {o.r9('(batch_idx + 1) / CAST(greatest(spe, 1) AS DOUBLE)')} AS epoch_progress FROM eb""")
def l10(spark, sf_dir):
    b = prep.epoch_batches(fx.corpus_f1(spark, sf_dir), _EPOCHS, _BATCH, index="row_id")
    return r9(b.select("epoch", "row_id", "batch_idx", "global_step", "samples_seen", "epoch_progress"))


@query("l11_resume_after", f"""{_EB}
SELECT CAST(epoch AS INTEGER) AS epoch, row_id, CAST(global_step AS BIGINT) AS global_step FROM eb WHERE global_step > 40""")
def l11(spark, sf_dir):
    b = prep.resume_after(prep.epoch_batches(fx.corpus_f1(spark, sf_dir), _EPOCHS, _BATCH, index="row_id"), 40)
    return b.select("epoch", "row_id", "global_step")


@query("l12_cadence", f"""{_EB}
SELECT DISTINCT CAST(global_step AS BIGINT) AS global_step, global_step % 10 = 0 AS do_log,
       global_step % 25 = 0 AS do_save, (global_step + 1) % 25 = 0 AS do_save_after FROM eb""")
def l12(spark, sf_dir):
    b = prep.epoch_batches(fx.corpus_f1(spark, sf_dir), _EPOCHS, _BATCH, index="row_id").select("global_step").distinct()
    g = F.col("global_step")
    return b.select("global_step", prep.cadence(g, 10).alias("do_log"), prep.cadence(g, 25).alias("do_save"),
                    prep.cadence(g, 25, after=True).alias("do_save_after"))


@query("a16_steps_per_epoch", f"""WITH {_F1}
SELECT count(*) AS n, {_BATCH} AS batch_size, CAST(ceil(count(*) / {_BATCH}) AS BIGINT) AS steps_per_epoch,
       CAST(ceil(count(*) / {_BATCH}) * {_EPOCHS} AS BIGINT) AS total_steps FROM f1""")
def a16(spark, sf_dir):
    c = fx.corpus_f1(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    spe = F.ceil(F.col("n") / F.lit(_BATCH)).cast("bigint")
    return c.select("n", F.lit(_BATCH).alias("batch_size"), spe.alias("steps_per_epoch"),
                    (spe * _EPOCHS).cast("bigint").alias("total_steps"))


@query("p02_complete_rows", f"""WITH {_RAW}
SELECT example_id FROM raw WHERE coalesce(text <> '', false) OR coalesce(instruction <> '', false)""")
def p02(spark, sf_dir):
    return prep.complete_rows(fx.raw_rows_f3(spark, sf_dir)).select("example_id")


@query("p03_whitespace_normalize", f"""WITH {_F1}
SELECT row_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM f1""")
def p03(spark, sf_dir):
    return prep.normalize_whitespace(fx.corpus_f1(spark, sf_dir)).select("row_id", "text")


@query("p04_unify_text", f"""WITH {_F1}
SELECT CASE WHEN row_id % 4 <> 0 THEN text ELSE 'inst ' || CAST(row_id AS VARCHAR) END AS text, source FROM f1""")
def p04(spark, sf_dir):
    f1 = fx.corpus_f1(spark, sf_dir)
    shaped = f1.select(F.when(F.pmod("row_id", F.lit(4)) == 0, F.lit("")).otherwise(F.col("text")).alias("text"),
                       F.concat(F.lit("inst "), F.col("row_id").cast("string")).alias("instruction"), "source")
    return prep.unify_text(shaped)


@query("h10_md5", f"WITH {_F1} SELECT row_id, md5(text) AS text_md5 FROM f1")
def h10(spark, sf_dir):
    return fx.corpus_f1(spark, sf_dir).select("row_id", F.md5("text").alias("text_md5"))


@query("x01_length_filter", f"WITH {_F1} SELECT row_id FROM f1 WHERE n_chars BETWEEN 100 AND 5000")
def x01(spark, sf_dir):
    return prep.length_filter(fx.corpus_f1(spark, sf_dir), F.col("n_chars"), 100, 5000).select("row_id")


@query("x05_language_filter", f"WITH {_F1} SELECT row_id FROM f1 WHERE source = 'en'")
def x05(spark, sf_dir):
    return fx.corpus_f1(spark, sf_dir).filter(F.col("source") == "en").select("row_id")


@query("x07_leakage", f"""WITH {_F1},
b AS (SELECT *, {_md5_bucket_sql('CAST(row_id AS VARCHAR)')} AS bk FROM f1)
SELECT e.row_id FROM b e WHERE e.bk < 10
  AND EXISTS (SELECT 1 FROM b t WHERE t.bk >= 10 AND md5(t.text) = md5(e.text))""")
def x07(spark, sf_dir):
    """Held-out rows (stable md5 hold-out, S6/H9) whose content also occurs in the training rows."""
    f1 = fx.corpus_f1(spark, sf_dir)
    key = F.col("row_id").cast("string")
    ev = prep.holdout(f1, key, 0.1)
    tr = f1.filter(md5_bucket(key) >= 10)
    return prep.leakage(ev, tr, F.col("text"), F.col("text")).select("row_id")


@query("x07_contained_passages", r"""
WITH b AS (SELECT item_id, string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ') AS ws FROM benchmark WHERE trim(text) <> ''),
d AS (SELECT doc_id, string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ') AS ws FROM documents),
g AS (SELECT DISTINCT item_id, least(5, len(ws)) AS k, unnest(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' '))) AS gram FROM b),
x AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS gram FROM d, (SELECT DISTINCT k FROM g) WHERE len(ws) >= k),
n AS (SELECT item_id, count(*) AS n FROM g GROUP BY item_id),
m AS (SELECT item_id, doc_id, count(*) AS f FROM g JOIN x USING (gram) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, n AS n_grams, f AS n_found, round(f / CAST(n AS DOUBLE), 9) AS containment FROM m JOIN n USING (item_id) WHERE f >= ceil(n * 0.8 - 1e-9)""")
def x07_passages(spark, sf_dir):
    """Benchmark passages inside documents, each found by its rarest n-grams and counted exactly."""
    from toolframe.operators import containment
    return r9(containment.contained_passages(fx.table(spark, sf_dir, "benchmark"), fx.table(spark, sf_dir, "documents").select("doc_id", "text")))


# --------------------------------------------------------------------------
# Conversations and token arrays
# --------------------------------------------------------------------------

from toolframe.operators import convo, tokens  # noqa: E402

_CONV = "conversations"


@query("p07_render_conversation", f"""
SELECT conv_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text,
       CAST(count(*) AS INTEGER) AS n_turns
FROM {_CONV} GROUP BY conv_id""")
def p07(spark, sf_dir):
    return convo.render_turns(fx.table(spark, sf_dir, "conversations"))


@query("p17_train_on_weights", f"""
WITH c AS (SELECT nullif(conv_id, 3) AS conv_id, turn, role FROM {_CONV}),
la AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS la FROM c GROUP BY conv_id)
SELECT c.conv_id, c.turn, CASE WHEN la IS NULL OR c.turn = la THEN 1 ELSE 0 END AS weight,
       la IS NOT NULL AS has_assistant
FROM c JOIN la ON c.conv_id IS NOT DISTINCT FROM la.conv_id""")
def p17(spark, sf_dir):
    t = convo.train_on(fx.table(spark, sf_dir, "conversations").withColumn("conv_id", F.nullif("conv_id", F.lit(3))))
    return t.select("conv_id", "turn", "weight", "has_assistant")


@query("t04_last_assistant_message", f"""
SELECT conv_id, arg_max(role, turn) AS last_role,
       length(arg_max(text, turn)) AS last_len,
       length(arg_max(CASE WHEN role = 'assistant' THEN text END, CASE WHEN role = 'assistant' THEN turn END))
         AS last_assistant_len,
       max(CASE WHEN role = 'assistant' THEN turn END) AS last_assistant_turn,
       count(*) AS n_turns
FROM {_CONV} GROUP BY conv_id""")
def t04(spark, sf_dir):
    s = convo.conversation_summary(fx.table(spark, sf_dir, "conversations"))
    return s.select("conv_id", "last_role", F.length("last_text").alias("last_len"),
                    F.length("last_assistant_text").alias("last_assistant_len"),
                    "last_assistant_turn", "n_turns")


_T4_SQL = f"""c AS (SELECT nullif(conv_id, 3) AS conv_id, turn, role, text FROM {_CONV}),
la AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS la FROM c GROUP BY conv_id),
w AS (SELECT c.conv_id, c.turn, coalesce(role, '') || ': ' || coalesce(text, '') AS line, CASE WHEN la IS NULL OR c.turn = la THEN 1 ELSE 0 END AS weight,
             list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS body,
             list_filter(string_split(trim(regexp_replace(coalesce(role, '') || ':', '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS head
      FROM c JOIN la ON c.conv_id IS NOT DISTINCT FROM la.conv_id),
tw4 AS (SELECT conv_id, flatten(list(head || body ORDER BY turn, line)) AS toks,
               flatten(list(list_transform(head, lambda x: 0) || list_transform(body, lambda x: weight) ORDER BY turn, line)) AS ws FROM w GROUP BY conv_id)"""


@query("t04_token_weights", f"""WITH {_T4_SQL},
k AS (SELECT conv_id, unnest(toks) AS token, unnest(ws) AS weight, unnest(range(0, len(toks))) AS i FROM tw4)
SELECT conv_id, count(*) AS n_tokens, CAST(sum(weight) AS BIGINT) AS n_weighted, md5(coalesce(string_agg(token, ' ' ORDER BY i) FILTER (WHERE weight = 1), '')) AS weighted_md5
FROM k GROUP BY conv_id""")
def t04_tokens(spark, sf_dir):
    """Weights per token of the rendered conversations, held against the trained turns' own texts."""
    turns = fx.table(spark, sf_dir, "conversations").withColumn("conv_id", F.nullif("conv_id", F.lit(3)))
    kept = F.array_sort(F.collect_list(F.when(F.col("weight") == 1, F.struct("i", "token"))))
    rows = convo.token_weights(turns).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("weight").alias("n_weighted"), kept.alias("kept"))
    return rows.select("conv_id", "n_tokens", "n_weighted", F.md5(F.array_join(F.transform("kept", lambda x: x["token"]), " ")).alias("weighted_md5"))


@query("t04_loss_weights", f"""WITH {_T4_SQL}
SELECT conv_id, md5(array_to_string(list_transform(ws[1:256] || list_transform(range(greatest(0, 256 - len(ws))), lambda x: 0), lambda x: CAST(x AS VARCHAR)), '')) AS weights_md5 FROM tw4""")
def t04_loss(spark, sf_dir):
    """One weight per position of the encoded conversation, cut and padded as its ids are."""
    turns = fx.table(spark, sf_dir, "conversations").withColumn("conv_id", F.nullif("conv_id", F.lit(3)))
    return convo.loss_weights(turns, 256).select("conv_id", F.md5(F.array_join("loss_weights", "")).alias("weights_md5"))


_MAXLEN = 2048
_TOK = f"""WITH rc AS (
  SELECT conv_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text
  FROM {_CONV} GROUP BY conv_id),
tw AS (SELECT conv_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN CAST([] AS VARCHAR[])
                  ELSE string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') END AS toks FROM rc),
vc AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(toks) AS token FROM tw) GROUP BY token),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 2 AS INTEGER) AS id, cnt
          FROM vc)"""


@query("t01_vocabulary", f"""{_TOK}
SELECT token, id, CAST(cnt AS BIGINT) AS count FROM vocab
UNION ALL SELECT * FROM (VALUES ('<pad>', 0, CAST(0 AS BIGINT)), ('<unk>', 1, 0), ('<eos>', 2, 0)) v(token, id, count)""")
def t01(spark, sf_dir):
    rc = convo.render_turns(fx.table(spark, sf_dir, "conversations"))
    return tokens.build_vocabulary(rc)


@query("t01_encode", f"""{_TOK},
tk AS (SELECT conv_id, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos FROM tw),
ids AS (SELECT tk.conv_id, list(coalesce(v.id, 1) ORDER BY tk.pos) AS l
        FROM tk LEFT JOIN vocab v USING (token) WHERE tk.pos <= {_MAXLEN} GROUP BY tk.conv_id),
fl AS (SELECT tw.conv_id, coalesce(ids.l, CAST([] AS INTEGER[])) AS l FROM tw LEFT JOIN ids USING (conv_id))
SELECT conv_id,
       list_concat(l, list_transform(range({_MAXLEN} - len(l)), lambda x: 2)) AS input_ids,
       list_concat(list_transform(l, lambda x: 1), list_transform(range({_MAXLEN} - len(l)), lambda x: 0))
         AS attention_mask,
       list_transform(list_concat(l, list_transform(range({_MAXLEN} - len(l)), lambda x: 2)),
                      lambda t: CASE WHEN t = 2 THEN -100 ELSE t END) AS labels
FROM fl""")
def t01e(spark, sf_dir):
    rc = convo.render_turns(fx.table(spark, sf_dir, "conversations"))
    vocab = tokens.build_vocabulary(rc)
    return tokens.encode(rc, vocab, "conv_id", max_length=_MAXLEN)




@query("p11_example_to_conversation", f"""WITH {_RAW},
a AS (SELECT example_id, instruction,
        CASE WHEN json_valid(trim(tools)) AND json_type(trim(tools)) = 'ARRAY' AND json_array_length(trim(tools)) > 0
             THEN CAST(json(trim(tools)) AS VARCHAR) END AS tools_text,
        CASE WHEN trim(tool_calls) <> '' AND json_valid(trim(tool_calls)) AND json_type(trim(tool_calls)) = 'ARRAY'
                  AND json_array_length(trim(tool_calls)) > 0
             THEN from_json(trim(tool_calls), '["JSON"]') END AS calls
      FROM raw)
SELECT example_id,
       md5({_SYS_SQL} || CASE WHEN tools_text IS NULL THEN '' ELSE chr(10) || chr(10) || 'Available tools:' || chr(10) || tools_text END) AS system_md5,
       instruction AS user_content,
       CAST(list_sum(list_transform(calls, lambda c: length(CAST(json(c) AS VARCHAR)) + 25)) + len(calls) - 1 AS INTEGER)
         AS assistant_len,
       CAST(len(calls) AS INTEGER) AS n_blocks
FROM a WHERE instruction IS NOT NULL AND instruction <> '' AND calls IS NOT NULL""")
def p11(spark, sf_dir):
    raw = spread(fx.raw_rows_f3(spark, sf_dir))
    conv = raw.select("example_id", convo.example_to_conversation(raw).alias("m")).filter(F.col("m").isNotNull())
    asst = F.col("m")[2]["content"]
    return conv.select("example_id", F.md5(F.col("m")[0]["content"]).alias("system_md5"),
                       F.col("m")[1]["content"].alias("user_content"), F.length(asst).alias("assistant_len"),
                       (F.size(F.split(asst, "<tool_call>")) - 1).alias("n_blocks"))


@query("p12_grpo_prompts", f"""WITH {_RAW},
a AS (SELECT example_id,
        coalesce(nullif(instruction, ''), nullif(query, ''), nullif(text, '')) AS u,
        md5(CASE WHEN tools IS NOT NULL AND tools <> '' THEN {_SYS_SQL} || chr(10) || chr(10) || 'Available tools:' || chr(10) || tools ELSE {_SYS_SQL} END) AS system_md5,
        CASE WHEN trim(tool_calls) <> '' AND json_valid(trim(tool_calls)) THEN CAST(trim(tool_calls) AS JSON) END AS tc
      FROM raw),
b AS (SELECT *, CASE WHEN json_type(tc) = 'ARRAY' THEN from_json(tc, '["JSON"]') END AS arr,
             CASE WHEN json_type(tc) = 'ARRAY' THEN json_extract(tc, '$[0]')
                  WHEN json_type(tc) = 'OBJECT' THEN tc END AS first FROM a),
c AS (SELECT *, {o.args_of('first')} AS args FROM b)
SELECT example_id, system_md5, u AS "user",
       CASE WHEN first IS NOT NULL THEN coalesce({o.name_of('first')}, '') ELSE '' END AS expected_tool,
       CASE WHEN first IS NOT NULL THEN coalesce(CASE WHEN json_type(args) = 'VARCHAR' THEN json_extract_string(args, '$') END,
                                               CAST(args AS VARCHAR), '{{}}') ELSE '' END AS expected_args,
       CASE WHEN len(arr) > 1 THEN CAST(to_json(list_transform(arr, lambda x: coalesce({o.name_of('x')}, ''))) AS VARCHAR)
            ELSE '[]' END AS expected_chain
FROM c WHERE u IS NOT NULL""")
def p12(spark, sf_dir):
    raw = spread(fx.raw_rows_f3(spark, sf_dir))
    p = convo.build_prompts(raw)
    return p.select("example_id", F.md5("system").alias("system_md5"), "user", "expected_tool",
                    "expected_args", "expected_chain")


# --------------------------------------------------------------------------
# Streaming scorer, run here on the static table (same code path)
# --------------------------------------------------------------------------

from toolframe.streaming import scoring as stream_scoring  # noqa: E402


@query("x08_stream_step_rewards", f"""{_RW},
sc AS (SELECT *, {_rew5} AS reward FROM rw)
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, step,
       count(*) AS n_samples, {o.r9('avg(reward)')} AS reward_mean,
       {', '.join(f'{o.r9(f"avg({c})")} AS {c}' for c in _COMPS)}
FROM sc GROUP BY 1, 2""")
def x08(spark, sf_dir):
    twice = F.expr("CASE WHEN slot IN (5, 9) THEN 0L ELSE prompt_id END")  # one prompt in two slots of a step
    c = spread(fx.completions_f2(spark, sf_dir).withColumn("prompt_id", twice))
    return r9(stream_scoring.step_rewards(stream_scoring.score_stream(c)))


# --------------------------------------------------------------------------
# Synthetic corpus, one example per event
# --------------------------------------------------------------------------

from toolframe.operators import synth, synth_catalog  # noqa: E402


def _gen_base(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"))
    return spread(e)


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.generate(_gen_base(spark, sf_dir))


def _weights_sql() -> str:
    total = sum(t.weight for t in synth_catalog.TEMPLATES)
    rows, acc = [], 0
    for i, t in enumerate(synth_catalog.TEMPLATES):
        rows.append(f"({i}, '{t.name}', '{t.category}', {len(t.calls)}, CAST({acc / total!r} AS DOUBLE), "
                    f"CAST({(acc + t.weight) / total!r} AS DOUBLE))")
        acc += t.weight
    return ", ".join(rows)


_GEN = f"""WITH tw(template_idx, template, category, num_steps, lo, hi) AS (VALUES {_weights_sql()}),
d AS (SELECT event_id AS row_id, {_unit(_k('event_id', "'template'"))} AS u FROM events),
ch AS (SELECT d.row_id, tw.* FROM d JOIN tw ON d.u >= tw.lo AND d.u < tw.hi)"""


@query("j10_weighted_template_choice", f"{_GEN} SELECT row_id, template, category, num_steps FROM ch")
def j10(spark, sf_dir):
    return synth.choose_templates(_gen_base(spark, sf_dir)).select("row_id", "template", "category", "num_steps")


@query("g02_template_shares", f"{_GEN} SELECT template, count(*) AS n FROM ch GROUP BY template")
def g02(spark, sf_dir):
    return generated(spark, sf_dir).groupBy("template").agg(F.count(F.lit(1)).alias("n"))


@query("g01_generate_corpus")
def g01(spark, sf_dir):
    return synth.generate(_gen_base(spark, sf_dir), as_text=True)


@query("g09_tools_exposed", f"{_GEN} SELECT row_id, 25 AS n_tools, 25 AS n_distinct, true AS calls_exposed FROM ch")
def g09(spark, sf_dir):
    g = generated(spark, sf_dir)
    names = F.transform("tools", lambda t: F.try_variant_get(t, "$.name", "string"))
    called = F.transform("tool_calls", lambda c: F.try_variant_get(c, "$.name", "string"))
    return g.select("row_id", F.size("tools").alias("n_tools"), F.size(F.array_distinct(names)).alias("n_distinct"),
                    F.forall(called, lambda n: F.array_contains(names, n)).alias("calls_exposed"))


@query("x04_undersample_majority_tool", f"""{_EX},
c AS (SELECT event_id, {o.name_of('calls[1]')} AS t FROM ex WHERE len(calls) > 0),
top AS (SELECT t AS most FROM c GROUP BY t ORDER BY count(*) DESC, t LIMIT 1)
SELECT event_id AS row_id, t AS tool FROM c, top WHERE t <> most OR {_unit(_k('event_id', "'undersample'"))} < 0.5""")
def x04(spark, sf_dir):
    """Half of the rows whose first call names the most frequent tool, and all others."""
    rows = _calls_f2(spark, sf_dir).where(F.size("calls") > 0).select(F.col("event_id").alias("row_id"), F.col("calls").alias("tool_calls"))
    kept = synth.undersample_majority_tool(rows, 0.5)
    return kept.select("row_id", extract.call_name(F.col("tool_calls")[0]).alias("tool"))


# --------------------------------------------------------------------------
# J7 cyclic batches over the GRPO prompts; X2 stratified split
# --------------------------------------------------------------------------

_BATCH_PROMPTS = 16


@query("j07_cyclic_batches", f"""WITH {o.F2}, {o.ROLLOUTS},
pp AS (SELECT prompt_id, row_number() OVER (ORDER BY {_u(_k('prompt_id'))}, prompt_id) - 1 AS prompt_pos FROM prompts),
n AS (SELECT count(*) AS n FROM pp),
g AS (SELECT unnest(range(0, CAST(2 * ceil(n / {_BATCH_PROMPTS}) * {_BATCH_PROMPTS} AS BIGINT))) AS id, n FROM n)
SELECT CAST(g.id // {_BATCH_PROMPTS} AS BIGINT) AS step, CAST(g.id % {_BATCH_PROMPTS} AS BIGINT) AS slot, pp.prompt_id
FROM g JOIN pp ON pp.prompt_pos = g.id % g.n""")
def j07(spark, sf_dir):
    prompts = fx.prompts_f2(spark, sf_dir).select("prompt_id")
    n = prompts.count()
    ranked = rank.shuffled(prompts, ["prompt_id"], out="_r").withColumn("prompt_pos", F.col("_r") - 1)
    steps = 2 * -(-n // _BATCH_PROMPTS)  # two epochs of cyclic batches
    b = rollouts.cyclic_batches(ranked, n, steps, _BATCH_PROMPTS)
    return b.select("step", "slot", "prompt_id")


@query("x02_stratified_split", f"""WITH {_F1},
c AS (SELECT source, count(*) AS n FROM f1 GROUP BY source),
a AS (SELECT source, n, CAST(ceil(greatest(1.0::DOUBLE - 0.8::DOUBLE, 1.0 / n) * n) AS BIGINT) AS r FROM c),
b AS (SELECT source, CASE WHEN n < 3 THEN n ELSE n - r END AS n_train,
             CASE WHEN n < 3 THEN 0 WHEN r < 2 THEN r
                  ELSE r - CAST(ceil(greatest(1.0::DOUBLE - 0.1::DOUBLE / (1.0::DOUBLE - 0.8::DOUBLE), 1.0 / r) * r)
                                AS BIGINT) END AS n_val FROM a),
rk AS (SELECT row_id, source, row_number() OVER (PARTITION BY source
         ORDER BY {_u(_k('source', 'row_id'))}, source, row_id) AS rk FROM f1)
SELECT row_id, source, CASE WHEN rk <= n_train THEN 'train' WHEN rk <= n_train + n_val THEN 'validation'
                            ELSE 'test' END AS split
FROM rk JOIN b USING (source)""")
def x02(spark, sf_dir):
    return prep.split_stratified(fx.corpus_f1(spark, sf_dir), ["source"]).select("row_id", "source", "split")


# --------------------------------------------------------------------------
# Near-duplicate clusters over the whole documents table (checked by brute force in tests)
# --------------------------------------------------------------------------

from toolframe.operators import neardup  # noqa: E402


_X6_PERM = neardup.coefficients(64, 42)
_X6_MINS = ", ".join(f"min(({a} * h + {b}) % 2147483647) AS m{i}" for i, (a, b) in enumerate(_X6_PERM))
_X6_BANDS = " UNION ALL ".join(f"SELECT doc_id AS a, {b} AS band, concat_ws(',', {', '.join(f'm{4 * b + i}' for i in range(4))}) AS bucket FROM sig" for b in range(16))


# The documents, and a family of texts on one template: each shares an item's text with one other, the template alone with the rest.
_X6_DOCS = """docs AS (SELECT doc_id, text FROM documents UNION ALL
  SELECT 1000000000 + i.item_id + 1000 * k, {join} || ' ' || i.text || ' tail ' || k || ' of ' || i.item_id FROM (SELECT * FROM benchmark WHERE item_id >= 8) i, (SELECT {unnest} AS k),
         (SELECT {agg} AS {t} FROM benchmark WHERE item_id < 8) h)"""
def _x6_sql(pairs: str) -> str:
    """CTEs up to ``v``: the verified ones of the given pairs (a, b) of bucket members (``bk``)."""
    return rf"""{_X6_DOCS.format(join='h.t', unnest='unnest([0, 1])', agg="string_agg(text, ' ' ORDER BY item_id)", t='t')},
t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS s FROM docs),
w AS (SELECT doc_id, s, string_split(s, ' ') AS ws FROM t WHERE s <> ''),
g AS (SELECT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [s] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM w),
x AS (SELECT DISTINCT doc_id, substr(md5(gram), 1, 16) AS gram FROM g),
hx AS (SELECT doc_id, CAST(('0x' || substr(gram, 1, 7)) AS BIGINT) AS h FROM x),
sig AS (SELECT doc_id, {_X6_MINS} FROM hx GROUP BY doc_id),
bk AS ({_X6_BANDS}),
cand AS (SELECT DISTINCT a, b FROM ({pairs})),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
i AS (SELECT c.a, c.b, count(*) AS k FROM cand c JOIN x p ON p.doc_id = c.a JOIN x q ON q.doc_id = c.b AND q.gram = p.gram GROUP BY c.a, c.b),
e AS (SELECT i.a, i.b, CAST(k AS DOUBLE) / (na.n + nb.n - k) AS s FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b),
v AS (SELECT a, b, s FROM e WHERE s >= 0.8)"""


def _x06_documents(spark, sf_dir):
    fx.table(spark, sf_dir, "documents").createOrReplaceTempView("_x06_documents")
    fx.table(spark, sf_dir, "benchmark").createOrReplaceTempView("_x06_benchmark")
    agg = "array_join(transform(array_sort(collect_list(struct(item_id, text))), x -> x.text), ' ')"
    sql = _X6_DOCS.format(join="h.t", unnest="explode(array(0, 1))", agg=agg, t="t").replace("FROM documents", "FROM _x06_documents").replace("FROM benchmark", "FROM _x06_benchmark")
    return spread(spark.sql(f"WITH {sql} SELECT * FROM docs"))


@query("x06_near_duplicates", rf"""WITH RECURSIVE {_x6_sql('SELECT p.a, q.a AS b FROM bk p JOIN bk q ON p.band = q.band AND p.bucket = q.bucket AND p.a > q.a')},
l AS (SELECT a AS x, b AS y FROM v UNION SELECT b, a FROM v),
r AS (SELECT x, x AS y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS cluster FROM r GROUP BY x)
SELECT doc_id, coalesce(cluster, doc_id) AS cluster, coalesce(cluster <> doc_id, false) AS is_near_dup FROM docs LEFT JOIN c ON c.x = doc_id""")
def x06(spark, sf_dir):
    """Clusters of all verified pairs of all buckets; the twin compares every pair of every bucket."""
    return neardup.near_duplicates(_x06_documents(spark, sf_dir)).select("doc_id", "cluster", "is_near_dup")


@query("x06_head_edges", rf"""WITH {_x6_sql('SELECT a, min(a) OVER (PARTITION BY band, bucket) AS b FROM bk')}
SELECT a, b, round(s, 9) AS similarity FROM v WHERE a <> b""")
def x06_heads(spark, sf_dir):
    """Each document and the smallest keys of its buckets, with their exact similarity."""
    sigs = written(neardup.signatures(_x06_documents(spark, sf_dir)), "signatures")
    return r9(neardup.head_edges(sigs, "doc_id", 0.8, 16))


# --------------------------------------------------------------------------
# S9 / S10 on table-derived input: an append log and a run summary
# --------------------------------------------------------------------------

_LOG_SQL = """
log AS (
  SELECT event_id AS seq,
    CASE WHEN event_id % 11 = 0 THEN ''
         WHEN event_id % 11 = 1 THEN '{oops'
         WHEN event_id % 11 = 2 THEN '{"sampler_path": ""}'
         WHEN event_id % 11 = 3 THEN '{"state_path": "s/' || CAST(event_id AS VARCHAR) || '"}'
         ELSE '{"sampler_path": "ckpt://' || event_type || '/' || CAST(event_id AS VARCHAR) || '"}' END AS line,
    user_id
  FROM events)"""


def _log_lines(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return e.selectExpr("event_id AS seq", """CASE WHEN pmod(event_id, 11) = 0 THEN ''
         WHEN pmod(event_id, 11) = 1 THEN '{oops'
         WHEN pmod(event_id, 11) = 2 THEN '{"sampler_path": ""}'
         WHEN pmod(event_id, 11) = 3 THEN '{"state_path": "s/' || CAST(event_id AS STRING) || '"}'
         ELSE '{"sampler_path": "ckpt://' || event_type || '/' || CAST(event_id AS STRING) || '"}' END AS line""",
                        "user_id")


@query("s09_last_sampler_path", f"""WITH {_LOG_SQL}
SELECT user_id % 7 AS run, arg_max(json_extract_string(line, '$.sampler_path'), seq) AS sampler_path
FROM log WHERE trim(line) <> '' AND json_valid(line) AND json_type(line) = 'OBJECT'
  AND json_type(line, '$.sampler_path') = 'VARCHAR' AND json_extract_string(line, '$.sampler_path') <> ''
GROUP BY 1""")
def s09(spark, sf_dir):
    """One append log per run (runs keyed by ``user_id mod 7``), line order = ``seq``."""
    lines = _log_lines(spark, sf_dir).withColumn("run", F.pmod(F.col("user_id"), F.lit(7)))
    return readers.last_sampler_path_of(lines, "line", ["seq"], group=["run"])


@query("s10_run_summary_metrics", f"""{_EV},
summ AS (SELECT stage || '/' || metric AS key, CAST(value AS VARCHAR) AS value FROM ml
         UNION ALL SELECT 'other', '1' UNION ALL SELECT 'sft/notes', 'n/a')
SELECT 'sft' AS stage, substr(key, 5) AS metric, {o.r9('TRY_CAST(value AS DOUBLE)')} AS value
FROM summ WHERE starts_with(key, 'sft/') AND TRY_CAST(value AS DOUBLE) IS NOT NULL""")
def s10(spark, sf_dir):
    m = _metric_long(spark, sf_dir)
    summary = m.select(F.concat_ws("/", "stage", "metric").alias("key"), F.col("value").cast("string").alias("value"))
    extra = spark.createDataFrame([("other", "1"), ("sft/notes", "n/a")], "key string, value string")
    return r9(readers.metrics_from_run_summary(summary.unionByName(extra), "sft"))


@query("s08_stage_result_documents", f"{_EV} SELECT stage, metric, {o.r9('value')} AS value FROM ml")
def s08(spark, sf_dir):
    """Stage-result documents written from the metric table and read back: one with a BOM, all with a value and an entry that are no numbers."""
    return r9(readers.stage_results_of(_stage_documents(spark, sf_dir), "doc"))


def _stage_documents(spark, sf_dir):
    m = _metric_long(spark, sf_dir)
    parts = F.array_join(F.collect_list(F.concat(F.lit('"'), "metric", F.lit('": '), F.col("value").cast("string"))), ", ")
    docs = m.groupBy("stage").agg(parts.alias("p"))
    return docs.select("stage", F.concat(F.when(F.col("stage") == "baseline", F.lit("\ufeff")).otherwise(F.lit("")),
                                         F.lit('{"'), "stage", F.lit('": {"note": "n/a", '), "p", F.lit('}, "other": "oops"}')).alias("doc"))


@query("s11_compare_saved", f"{_EV} SELECT stage, metric, {o.r9('value')} AS value FROM ml WHERE stage IN ('baseline', 'grpo')")
def s11(spark, sf_dir):
    docs = _stage_documents(spark, sf_dir)
    return r9(readers.compare_documents([readers.stage_results_of(docs.where(F.col("stage") == n), "doc", n) for n in ("baseline", "grpo")]))


# Raw lines of a JSON-lines source, as texts of a table: blank, malformed and whole ones with every accepted name.
_LINES_SPARK = """CASE pmod(event_id, 9) WHEN 0 THEN '  ' WHEN 1 THEN '{oops'
  WHEN 2 THEN '{"query": "find ' || event_type || '", "expected_calls": [{"name": "' || event_type || '", "arguments": ' || props || '}], "source": "hub"}'
  WHEN 3 THEN ' {"instruction": "do ' || event_type || '", "tool_calls": [{"tool": "' || event_type || '"}], "num_steps": 1} '
  WHEN 4 THEN '{"text": "plain ' || CAST(user_id AS STRING) || '", "num_steps": 2}'
  ELSE '{"instruction": "call ' || event_type || '", "tools": [{"name": "t"}], "tool_calls": [{"name": "' || event_type || '", "arguments": ' || props || '}]}' END"""
_LINES_SQL = f"""ln AS (SELECT event_id, trim({_LINES_SPARK.replace('pmod(event_id, 9)', 'event_id % 9').replace('AS STRING', 'AS VARCHAR')}) AS line FROM events),
js AS (SELECT event_id, line, json_valid(line) AS good, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j FROM ln WHERE line <> '')"""


def _parsed_lines(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "events").selectExpr("event_id", f"{_LINES_SPARK} AS line")
    return readers.parse_lines(lines, "line")


@query("s01_json_lines", f"""WITH {_LINES_SQL}
SELECT event_id, json_extract_string(j, '$.instruction') AS instruction, json_extract_string(j, '$.query') AS "query",
       json_extract_string(j, '$.source') AS source, CAST(json_extract(j, '$.expected_calls') AS VARCHAR) AS expected_calls,
       CAST(json_extract(j, '$.num_steps') AS INTEGER) AS num_steps, CASE WHEN NOT good THEN line END AS corrupt FROM js""")
def s01(spark, sf_dir):
    """S1 and S5 share the parser: one line, one row, whichever file it came from."""
    rows = _parsed_lines(spark, sf_dir)
    calls = F.regexp_replace("expected_calls", r"\s", "")
    return rows.select("event_id", "instruction", "query", "source", calls.alias("expected_calls"), "num_steps", F.col("_corrupt_record").alias("corrupt"))


@query("s04_flat_strings", f"""WITH {_LINES_SQL}
SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(json_extract_string(j, '$.instruction'), '') AS instruction,
       coalesce(CAST(json_extract(j, '$.num_steps') AS VARCHAR), '') AS num_steps, coalesce(json_extract_string(j, '$.text'), '') AS text FROM js WHERE good""")
def s04(spark, sf_dir):
    rows = _parsed_lines(spark, sf_dir).where(F.col("_corrupt_record").isNull())
    return readers.flatten_to_strings(rows.select("text", "num_steps", "instruction", "event_id"))


@query("s06_eval_examples", f"""WITH {_LINES_SQL},
e AS (SELECT event_id, coalesce(json_extract_string(j, '$.instruction'), json_extract_string(j, '$.query'), json_extract_string(j, '$.text')) AS prompt,
             coalesce(json_extract(j, '$.tool_calls[0]'), json_extract(j, '$.expected_calls[0]')) AS c,
             coalesce(json_extract_string(j, '$.source'), 'prepared') AS source FROM js WHERE good)
SELECT event_id AS example_id, prompt, source, coalesce(json_extract_string(c, '$.name'), json_extract_string(c, '$.tool')) AS expected_tool,
       CASE WHEN c IS NOT NULL THEN coalesce(CAST(json_extract(c, '$.arguments') AS VARCHAR), '{{}}') END AS expected_args FROM e""")
def s06(spark, sf_dir):
    """Raw lines to evaluation examples: no accepted name is lost, a row's own source stays."""
    rows = _parsed_lines(spark, sf_dir).where(F.col("_corrupt_record").isNull()).withColumnRenamed("event_id", "example_id")
    return readers.eval_examples_of(rows, "prepared").select("example_id", "prompt", "source", "expected_tool", F.to_json("expected_args").alias("expected_args"))


@query("s07_sft_conversations", f"""WITH {_LINES_SQL}
SELECT event_id, json_extract_string(j, '$.instruction') AS user_content, json_extract_string(j, '$.tool_calls[0].name') AS call_name,
       CAST(json_extract(j, '$.tool_calls[0].arguments') AS VARCHAR) AS call_args
FROM js WHERE good AND json_extract_string(j, '$.instruction') IS NOT NULL AND json_extract(j, '$.tool_calls[0].name') IS NOT NULL""")
def s07(spark, sf_dir):
    """Raw lines to conversations; the assistant's call is read back from its text."""
    rows = _parsed_lines(spark, sf_dir).where(F.col("_corrupt_record").isNull() & F.col("tools").isNotNull())
    conv = readers.conversations_of(rows, ("event_id",))
    block = extract.tool_call_blocks(F.col("messages")[2]["content"])[0]
    return conv.select("event_id", F.col("messages")[1]["content"].alias("user_content"), F.get_json_object(block, "$.name").alias("call_name"),
                       F.get_json_object(block, "$.arguments").alias("call_args"))


@query("k01_split_by_kind", f"""WITH {_LINES_SQL},
k AS (SELECT event_id, CASE WHEN json_extract(j, '$.num_steps') = 1 THEN 'single' ELSE 'multistep' END AS kind FROM js WHERE good)
SELECT kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM k GROUP BY kind""")
def k01(spark, sf_dir):
    """The two kinds written as JSON lines (K1, K2) and read back."""
    from toolframe.session import scratch_path
    path = scratch_path(spark, "by-kind")
    rows = _parsed_lines(spark, sf_dir).where(F.col("_corrupt_record").isNull()).select("event_id", "instruction", "num_steps")
    readers.write_by_kind(rows, path)
    back = spark.read.schema("event_id long, kind string").json(path)
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("e05_text_after_assistant", f"""WITH {o.F2}
SELECT event_id, CASE WHEN event_id % 5 > 0 THEN md5(regexp_replace(completion, '^\\s+|\\s+$', '', 'g')) END AS after_md5 FROM f2""")
def e05(spark, sf_dir):
    """The text after the first marker, whole; null without one."""
    text = F.concat(F.lit("USER: x\n"), F.when(F.col("event_id") % 5 > 0, F.lit("ASSISTANT: ")).otherwise(F.lit("")), "completion", F.lit(" \n"))
    c = fx.completions_f2(spark, sf_dir).select("event_id", text.alias("t"))
    return c.select("event_id", F.md5(extract.after_marker(F.col("t"))).alias("after_md5"))


@query("p19_token_budget", f"""{_EV},
req(stage, benchmark, metric) AS (VALUES {_REQ_VALUES}),
have AS (SELECT stage, metric FROM ml WHERE NOT (stage = 'sft' OR (stage = 'grpo' AND metric = 'tool_selection_accuracy'))),
pend AS (SELECT r.* FROM req r WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.stage = r.stage AND h.metric = r.metric))
SELECT stage, CAST(greatest(1024, max(CASE WHEN benchmark = 'multi_step' THEN 2048 ELSE 1024 END),
                            max(CASE WHEN benchmark = 'tool_selection' THEN 4096 ELSE 1024 END)) AS INTEGER)
       AS max_new_tokens
FROM pend GROUP BY stage""")
def p19(spark, sf_dir):
    """Token budget per stage from the benchmarks still pending (sft not run; grpo lacks tool selection)."""
    m = _metric_long(spark, sf_dir)
    have = m.filter(~((F.col("stage") == "sft")
                      | ((F.col("stage") == "grpo") & (F.col("metric") == "tool_selection_accuracy"))))
    pend = evals.pending_benchmarks(evals.requested_table(spark, fx.STAGES, _ALL_BENCH), have)
    return evals.token_budget(pend)


# --------------------------------------------------------------------------
# Keys nobody listed, JSON text with its numbers kept
# --------------------------------------------------------------------------

from toolframe.sources import openjson  # noqa: E402

# A key per event type, each with its own nested keys; mixed kinds, nulls, blank and malformed lines. Nested keys stand sorted.
_OPEN = """CASE event_id % 8 WHEN 0 THEN ' ' WHEN 1 THEN '{"' || event_type || '": 1' WHEN 2 THEN '[1]'
  WHEN 3 THEN '{"id": ' || event_id || ', "' || event_type || '": ' || props || ', "mixed": ' || user_id || ', "none": null}'
  WHEN 4 THEN '{"id": ' || event_id || ', "' || event_type || '": {"k":1,"of_' || event_type || '":"x"}, "mixed": "text", "list": [1,2]}'
  WHEN 5 THEN '{"' || event_type || '": null, "list": [], "flag": true, "mixed": ["a"]}'
  ELSE '{"id": null, "text": "line ' || user_id || '", "list": [3]}' END"""
_OPEN_SQL = f"""ln AS (SELECT event_id, trim({_OPEN}) AS line FROM events),
js AS (SELECT event_id, CAST(line AS JSON) AS j FROM (SELECT * FROM ln WHERE line <> '' AND json_valid(line)) WHERE json_type(line) = 'OBJECT'),
ky AS (SELECT event_id, k, json_extract(j, '$."' || k || '"') AS v FROM (SELECT event_id, j, unnest(json_keys(j)) AS k FROM js)),
tp AS (SELECT event_id, k, v, json_type(v) AS t FROM ky)"""


def _open_documents(spark, sf_dir):
    return openjson.parse_documents(fx.table(spark, sf_dir, "events").selectExpr("event_id", f"{_OPEN} AS line"), "line")


@query("s04_open_schema", f"""WITH {_OPEN_SQL},
nk AS (SELECT k, n, CASE WHEN bool_and(json_type(x) = 'VARCHAR') THEN 'STRING' ELSE 'BIGINT' END AS nt
       FROM (SELECT k, n, json_extract(v, '$."' || n || '"') AS x FROM (SELECT k, v, unnest(json_keys(v)) AS n FROM tp WHERE t = 'OBJECT')) GROUP BY k, n),
st AS (SELECT k, 'STRUCT<' || string_agg(n || ': ' || nt, ', ' ORDER BY n) || '>' AS s FROM nk GROUP BY k),
ag AS (SELECT k, count(*) AS n_rows, min(event_id) AS first_seen, list_sort(list(DISTINCT t) FILTER (WHERE t <> 'NULL')) AS ts FROM tp GROUP BY k)
SELECT ag.k AS key, CASE WHEN ts IS NULL THEN 'VOID' WHEN len(list_filter(ts, lambda x: x NOT IN ('BIGINT', 'UBIGINT'))) = 0 THEN 'BIGINT' WHEN ts = ['VARCHAR'] THEN 'STRING'
            WHEN ts = ['BOOLEAN'] THEN 'BOOLEAN' WHEN ts = ['OBJECT'] THEN s WHEN ts = ['ARRAY'] THEN 'ARRAY<BIGINT>' ELSE 'VARIANT' END AS type, n_rows, first_seen
FROM ag LEFT JOIN st ON st.k = ag.k""")
def s04_open(spark, sf_dir):
    """The union of all keys with their merged types, as one aggregate over the lines."""
    return openjson.schema_of(_open_documents(spark, sf_dir), order="event_id")


_OPEN_KEYS = ["click", "error", "flag", "id", "list", "mixed", "none", "purchase", "signup", "text", "view"]  # what the oracle looks for; the query finds them


def _open_text(k: str) -> str:
    v = f"json_extract(j, '$.{k}')"
    return f"coalesce(CASE json_type({v}) WHEN 'NULL' THEN '' WHEN 'VARCHAR' THEN json_extract_string(j, '$.{k}') ELSE CAST({v} AS VARCHAR) END, '') AS {k}"


@query("u04_open_columns", f"WITH {_OPEN_SQL} SELECT event_id, {', '.join(map(_open_text, _OPEN_KEYS))} FROM js")
def u04_open(spark, sf_dir):
    """Every key a column, found by the query itself; gaps and nulls are empty, nested values JSON text."""
    documents = _open_documents(spark, sf_dir).where("doc is not null")
    return openjson.flat_columns_of(documents, openjson.schema_of(documents), keep=("event_id",))


@query("u04_open_types", f"""WITH {_OPEN_SQL}
SELECT event_id, CAST(json_extract(j, '$.id') AS BIGINT) AS id, CAST(json_extract(j, '$.' || e || '.k') AS BIGINT) AS k, json_extract_string(j, '$.' || e || '.of_' || e) AS own,
       coalesce(CAST(json_array_length(j, '$.list') AS INTEGER), -1) AS n_list, CAST(json_extract(j, '$.flag') AS BOOLEAN) AS flag
FROM js JOIN (SELECT event_id, event_type AS e FROM events) USING (event_id)""")
def u04_types(spark, sf_dir):
    """The same keys with their own types: numbers, structs with the keys of all rows, arrays."""
    documents = _open_documents(spark, sf_dir).where("doc is not null")
    typed = openjson.columns_of(documents, openjson.schema_of(documents), keep=("event_id",))
    kinds = [c for c, t in typed.dtypes if t.startswith("struct<k:")]
    return typed.select("event_id", "id", F.coalesce(*[F.col(f"{c}.k") for c in kinds]).alias("k"), F.coalesce(*[F.col(f"{c}.of_{c}") for c in kinds]).alias("own"),
                        F.coalesce(F.size("list"), F.lit(-1)).alias("n_list"), "flag")


@query("h08_sorted_json_text", r"""
SELECT event_id, '{"a":{"x":100.0,"y":' || replace(props, ' ', '') || '},"z":[2.0,{"a":0,"b":' || user_id || ',"é":"é' || event_type || '"}]}' AS exact,
       '{"a": {"x": 100.0, "y": ' || props || '}, "z": [2.0, {"a": 0, "b": ' || user_id || ', "\u00e9": "\u00e9' || event_type || '"}]}' AS dumped FROM events""")
def h08(spark, sf_dir):
    """Sorted keys, the last of two equal ones, numbers as written: compact, and as Python prints it."""
    raw = F.expr("""concat('{"z": [1, ', user_id, '.0], "a": {"y": ', props, ', "x": 1e2}, "z": [2.0, {"é": "\\\\u00e9', event_type, '", "b": ', user_id, ', "a": -0}]}')""")
    return fx.table(spark, sf_dir, "events").select("event_id", jsonx.exact_json(raw).alias("exact"), jsonx.python_json(raw).alias("dumped"))


# --------------------------------------------------------------------------
# J4 / J5 / J10 / L7 / U3 / P14 / H4 / H12 / H13 over given tables; K2 / K4 / K6 / K7 written and read back
# --------------------------------------------------------------------------

from toolframe.operators import toolsets  # noqa: E402

_NEEDS = "SELECT o_orderkey AS row_id, n_name AS own, 'NATION_' || CAST(o_orderkey % 30 AS {text}) AS other FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey JOIN {nation} n ON c_nationkey = n_nationkey"
_TOOLS_SQL = f"""WITH ex AS ({_NEEDS.format(text='VARCHAR', orders='orders', customer='customer', nation='nation')}),
k AS (SELECT row_id, own, other, n_name AS name, n_regionkey AS region, {_u("'42|' || CAST(row_id AS VARCHAR) || '|' || n_name")} AS u FROM ex, nation),
m AS (SELECT row_id, CASE WHEN other NOT IN (SELECT n_name FROM nation) THEN other ELSE '' END AS missing FROM ex)"""


def _tool_inputs(spark, sf_dir):
    t = lambda n: fx.table(spark, sf_dir, n)
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    other = F.concat(F.lit("NATION_"), (F.col("o_orderkey") % 30).cast("string"))
    examples = orders.select(F.col("o_orderkey").alias("row_id"), F.array("n_name", other).alias("needed"))
    return examples, t("nation").select(F.col("n_name").alias("name"), F.concat(F.lit('{"region": '), F.col("n_regionkey").cast("string"), F.lit("}")).alias("definition"))


def _shown(df):
    text = F.array_join(F.transform("tools", lambda t: F.concat(t["name"], t["definition"])), ",")
    return df.select("row_id", F.size("tools").alias("n_tools"), F.md5(text).alias("tools_md5"), F.array_join("missing", ",").alias("missing"))


@query("j05_tools_exposed", f"""{_TOOLS_SQL}
SELECT k.row_id, CAST(count(*) AS INTEGER) AS n_tools, md5(string_agg(name || '{{"region": ' || region || '}}', ',' ORDER BY u, name)) AS tools_md5, any_value(missing) AS missing
FROM k JOIN m ON m.row_id = k.row_id GROUP BY k.row_id""")
def j05(spark, sf_dir):
    """Every order sees the whole catalogue of nations in an order of its own; needed names that don't exist are told."""
    return _shown(toolsets.expose_tools(*_tool_inputs(spark, sf_dir)))


@query("j04_needed_and_distractors", f"""{_TOOLS_SQL},
d AS (SELECT *, name = own OR name = other AS need, row_number() OVER (PARTITION BY row_id, name = own OR name = other ORDER BY u, name) AS r FROM k)
SELECT d.row_id, CAST(count(*) AS INTEGER) AS n_tools, md5(string_agg(name || '{{"region": ' || region || '}}', ',' ORDER BY u, name)) AS tools_md5, any_value(missing) AS missing
FROM d JOIN m ON m.row_id = d.row_id WHERE need OR r <= 5 GROUP BY d.row_id""")
def j04(spark, sf_dir):
    """The needed tools and five others."""
    return _shown(toolsets.expose_tools(*_tool_inputs(spark, sf_dir), distractors=5))


@query("j10_weighted_choice", f"""
WITH w AS (SELECT n_name AS name, count(*) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
l AS (SELECT name, sum(weight) OVER (ORDER BY name) - weight AS low, sum(weight) OVER (ORDER BY name) AS high FROM w),
d AS (SELECT event_id, floor({_unit("'42|' || CAST(event_id AS VARCHAR) || '|choice'")} * (SELECT sum(weight) FROM w)) AS place FROM events)
SELECT event_id, name AS choice FROM d JOIN l ON place >= low AND place < high""")
def j10_choice(spark, sf_dir):
    """A nation for every event, as likely as it has customers."""
    joined = fx.table(spark, sf_dir, "customer").join(fx.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    weights = joined.groupBy(F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("weight"))
    return toolsets.weighted_choice(fx.table(spark, sf_dir, "events").select("event_id"), weights, key="event_id")


@query("p14_training_text", """
SELECT event_id, '[' || event_type || '] USER: do ' || user_id || chr(10) || 'ASSISTANT: ' || '<tool_call>' || chr(10) || '{"name": "' || event_type || '", "arguments": ' || props || '}' || chr(10) || '</tool_call>'
       || CASE WHEN event_id % 2 = 0 THEN chr(10) || '<tool_call>' || chr(10) || '{"name": "none"}' || chr(10) || '</tool_call>' ELSE '' END AS text FROM events""")
def p14(spark, sf_dir):
    calls = F.array(F.concat(F.lit('{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}")), F.when(F.col("event_id") % 2 == 0, '{"name": "none"}'))
    text = toolsets.training_text(F.col("event_type"), F.concat(F.lit("do "), F.col("user_id").cast("string")), calls)
    return fx.table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query("h12_draws_and_times", f"""
SELECT event_id, round(value + {_unit("'42|' || CAST(event_id AS VARCHAR) || '|h12'")} * 2 * value, 2) AS drawn, strftime(ts, '%Y-%m-%d') || 'T' || strftime(ts, '%H:%M') || ':00' AS said FROM events""")
def h12(spark, sf_dir):
    """Rounded uniform draws between a row's own bounds, and its date and clock texts as one."""
    said = toolsets.local_time(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm"))
    drawn = toolsets.rounded_draw(F.col("value"), 3 * F.col("value"), 2, F.col("event_id"), F.lit("h12"))
    return fx.table(spark, sf_dir, "events").select("event_id", drawn.alias("drawn"), said.alias("said"))


@query("k02_raw_test_split", f"{_SPLIT} SELECT sp.row_id, md5(text) AS text_md5, source FROM sp JOIN f1 ON f1.row_id = sp.row_id WHERE split = 'test'")
def k02(spark, sf_dir):
    """The raw test rows written as JSON lines, before any text is unified, and read back."""
    path = scratch_path(spark, "test-raw")
    split = prep.split_exact(fx.corpus_f1(spark, sf_dir))
    readers.write_json(split.where("split = 'test'").drop("split"), path)
    return spark.read.schema("row_id long, text string, source string").json(path).select("row_id", F.md5("text").alias("text_md5"), "source")


@query("k04_result_documents", f"{_EV} SELECT stage, metric, {o.r9('value')} AS value FROM ml")
def k04(spark, sf_dir):
    """All stages' metrics written as JSON lines and read back."""
    path = scratch_path(spark, "results")
    readers.write_json(_metric_long(spark, sf_dir), path)
    return r9(spark.read.schema("stage string, metric string, value double").json(path).where("value is not null"))


@query("k06_step_history", f"{_STEP_SQL} SELECT step, {_sel(['reward_mean', 'frac_degenerate', 'n_datums'], {'reward_mean', 'frac_degenerate'})} FROM sm")
def k06(spark, sf_dir):
    """Step metrics appended to a log in three goes and read back as one."""
    path = scratch_path(spark, "history")
    steps = written(step_metrics_query(spark, sf_dir), "steps")
    for part in range(3):
        readers.write_json(steps.where(F.col("step") % 3 == part).select("step", "reward_mean", "frac_degenerate", "n_datums"), path, append=True)
    return r9(spark.read.schema("step int, reward_mean double, frac_degenerate double, n_datums long").json(path))


_MANIFEST_ROWS = 32_768  # of a file on average: files grow in number, not in size


@query("k07_manifest", "SELECT count(*) AS n_rows, true AS sized, true AS ordered FROM documents")
def k07(spark, sf_dir):
    """The files of a written corpus with their sizes and rows, all rows accounted for."""
    path = scratch_path(spark, "manifest")
    docs = fx.table(spark, sf_dir, "documents")
    readers.write_json(docs.repartition(max(3, -(-docs.count() // _MANIFEST_ROWS))), path)
    files = readers.manifest(spark, path)
    return files.agg(F.sum("rows").alias("n_rows"), (F.min("size_kb") > 0).alias("sized"), (F.count_distinct("file_name") == F.count(F.lit(1))).alias("ordered"))
