"""DuckDB SQL twins of the fixtures and of the scoring expressions.

Used only to build ``oracle_sql()`` strings for the correctness gate. The
fragments restate each operator's *definition* in plain SQL over the same
input; they share no code with the Spark implementation.
"""

from __future__ import annotations

F2 = r"""
f2 AS (
  SELECT event_id, ts,
         event_id // 8 AS prompt_id,
         CAST(event_id % 8 AS INTEGER) AS sample_id,
         CAST(event_id // 128 AS INTEGER) AS step,
         CAST((event_id // 8) % 16 AS INTEGER) AS slot,
         user_id,
         event_type AS expected_tool,
         CASE WHEN event_id % 11 = 10 AND (event_id // 11) % 7 = 6 THEN CASE WHEN event_id % 2 = 0 THEN '{"k": [1.0, 2]}' ELSE '{"k": [1, 2.0]}' END
              WHEN event_id % 3 = 0 THEN props ELSE replace(props, '}', ', "extra": 1}') END AS expected_args,
         CASE WHEN event_id % 7 < 3 THEN '["' || event_type || '", "none"]' ELSE '[]' END AS expected_chain,
         CAST(1 + event_id % 50 AS INTEGER) AS n_tokens,
         value / 10 AS elapsed_s,
         CAST(3 + (event_id // 8) % 5 AS INTEGER) AS prompt_len,
         CASE WHEN event_id % 11 = 10 THEN CASE (event_id // 11) % 7
           WHEN 0 THEN '<tool_call>' || '{"name": "' || event_type || '", "arguments": ' || props || '}' || ']</tool_call>'
           WHEN 1 THEN '<tool_call>' || '{"name": "' || event_type || '", "arguments": ' || props || '}' || '] trailing</tool_call>'
           WHEN 2 THEN '<tool_call>' || '{"name": "' || event_type || '", "arguments": ' || props || '}' || '][</tool_call>'
           WHEN 3 THEN '<tool_call>{"name": "none", "name": "' || event_type || '", "arguments": ' || props || '}</tool_call>'
           WHEN 4 THEN '<tool_call>{"name": "' || event_type || '", "arguments": ' || replace(props, '}', '.0}') || '}</tool_call>'
           WHEN 6 THEN '<tool_call>{"name": "' || event_type || '", "arguments": {"k": [1, 2.0]}}</tool_call>'
           ELSE '<tool_call>' || '{"name": "' || event_type || '", "arguments": ' || props || '}' || ', ' || '{"name": "none", "arguments": ' || props || '}' || '</tool_call>' END
         ELSE CASE event_id % 10
           WHEN 0 THEN '<tool_call>' || chr(10) || '{"name": "' || event_type || '", "arguments": ' || props || '}' || chr(10) || '</tool_call>'
           WHEN 1 THEN '<tool_call>' || chr(10) || '{"name": "' || event_type || '", "arguments": ' || props || '}' || chr(10) || '</tool_call>'
           WHEN 2 THEN '```json' || chr(10) || '{"name": "' || event_type || '", "arguments": ' || props || '}' || chr(10) || '```'
           WHEN 3 THEN '<|function_call|>' || '{"name": "' || event_type || '", "arguments": ' || props || '}'
           WHEN 4 THEN '<think>' || '{"name": "none", "arguments": ' || props || '}' || '</think>' || chr(10) || '<tool_call>' || '{"name": "' || event_type || '", "arguments": ' || props || '}' || '</tool_call>'
           WHEN 5 THEN '<think>open <tool_call>' || '{"name": "' || event_type || '", "arguments": ' || props || '}' || '</tool_call>'
           WHEN 6 THEN '<tool_call>' || '{"name": "none", "arguments": ' || props || '}' || '</tool_call>'
           WHEN 7 THEN '<tool_call>{"name": "' || event_type || '", "arguments": ' || props || '</tool_call>'
           WHEN 8 THEN '<tool_call>' || '{"name": "' || event_type || '", "arguments": ' || props || '}' || '</tool_call>' || chr(10) || '<tool_call>' || '{"name": "none", "arguments": ' || props || '}' || '</tool_call>'
           ELSE 'no call here'
         END END AS completion
  FROM events
)"""

ROLLOUTS = r"""
rollouts AS (
  SELECT event_id, step, CASE WHEN slot IN (5, 9) THEN 0 ELSE prompt_id END AS prompt_id, sample_id, slot, completion, prompt_len,
         list_transform(range(0, n_tokens), lambda i: CAST((user_id * 131 + i * 7) % 50000 AS INTEGER)) AS tokens
  FROM f2
),
prompts AS (
  SELECT prompt_id, 'Call ' || expected_tool || ' for user ' || CAST(user_id AS VARCHAR) AS "user",
         expected_tool, expected_args, expected_chain
  FROM f2 WHERE sample_id = 0
)"""


def ok(x: str) -> str:
    """SQL: string ``x`` is one JSON object with key ``name``."""
    return (f"(CASE WHEN json_valid({x}) THEN json_type({x}) = 'OBJECT' "
            f"AND json_extract({x}, '$.name') IS NOT NULL ELSE false END)")


def last_name(x: str) -> str:
    """SQL: of two ``name`` keys in a row only the last stays (the JSON functions here take the first)."""
    return f"""regexp_replace({x}, '"name": "[^"]*", ("name": )', '\\1')"""


def fold(x: str) -> str:
    """SQL: ``1.0`` printed as ``1``, where values and not texts are compared."""
    return f"regexp_replace({x}, '\\.0([],}}])', '\\1', 'g')"


# The extraction patterns.
FENCED = r"'(?s)```(?:json)?\s*(\{.*?\})\s*```'"
TAGGED = r"'(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>'"
FUNC = r"'(?s)<\|function_call\|>\s*(\{.*?\})'"
FLAT = r"""'\{[^{}]*"name"\s*:\s*"[^"]+?"[^{}]*\}'"""
BLOCK = r"'(?s)<tool_call>\s*(.*?)\s*</tool_call>'"


def clean(text: str) -> str:
    return (f"regexp_replace(regexp_replace({text}, '(?s)<think>.*?</think>', '', 'g'), "
            f"'(?s)<think>.*$', '', 'g')")


def extract_cte(src: str, name: str = "ex") -> str:
    """CTE adding ``clean``, ``call`` (JSON text or NULL) and ``calls`` (list of JSON text)."""
    p = {k: f"regexp_extract(clean, {v}, 1)" for k, v in (("p1", FENCED), ("p2", TAGGED), ("p3", FUNC))}
    flat = f"list_filter(regexp_extract_all(clean, {FLAT}, 0), lambda x: {ok('x')})"
    tagged = f"list_filter(regexp_extract_all(clean, {BLOCK}, 1), lambda x: {ok('x')})"
    return f"""
{name}_c AS (SELECT *, {clean('completion')} AS clean FROM {src}),
{name}_r AS (
  SELECT *,
    CASE WHEN {ok(p['p1'])} THEN {p['p1']}
         WHEN {ok(p['p2'])} THEN {p['p2']}
         WHEN {ok(p['p3'])} THEN {p['p3']}
         ELSE {flat}[1] END AS call,
    CASE WHEN len({tagged}) > 0 THEN {tagged} ELSE {flat} END AS calls
  FROM {name}_c
),
{name} AS (SELECT * REPLACE ({last_name('call')} AS call, list_transform(calls, lambda x: {last_name('x')}) AS calls) FROM {name}_r)"""


def name_of(x: str) -> str:
    return f"(CASE WHEN json_type({x}, '$.name') = 'VARCHAR' THEN json_extract_string({x}, '$.name') END)"


def args_of(x: str) -> str:
    return f"coalesce(json_extract({x}, '$.arguments'), json_extract({x}, '$.parameters'))"


def kv(a: str) -> str:
    return (f"(CASE WHEN json_type({a}) = 'OBJECT' THEN list_transform(json_keys({a}), "
            f"lambda k: k || '=' || CAST(json_extract({a}, '$.\"' || k || '\"') AS VARCHAR)) END)")


def rewards_cte(src: str, name: str = "rw") -> str:
    """CTE adding the five reward columns to an ``extract_cte`` result."""
    pred_names = f"list_transform(calls, lambda x: lower(trim({name_of('x')})))"
    exp_names = ("(CASE WHEN json_valid(expected_chain) AND json_type(expected_chain) = 'ARRAY' "
                 "THEN list_transform(from_json(expected_chain, '[\"VARCHAR\"]'), lambda e: lower(trim(e))) END)")
    return f"""
{name}_a AS (
  SELECT *, {args_of('call')} AS _args, {pred_names} AS _pred, {exp_names} AS _exp,
         (CASE WHEN json_valid(expected_args) THEN {kv('CAST(expected_args AS JSON)')} END) AS _ekv
  FROM {src}
),
{name}_b AS (
  SELECT *,
    CASE WHEN _args IS NULL THEN CAST([] AS VARCHAR[])
         WHEN json_type(_args) = 'VARCHAR' THEN
           (CASE WHEN json_valid(json_extract_string(_args, '$'))
                 THEN {kv("CAST(json_extract_string(_args, '$') AS JSON)")} END)
         ELSE {kv('_args')} END AS _pkv
  FROM {name}_a
),
{name}_c AS (
  SELECT *,
    CAST(len(list_filter(_pkv, lambda x: list_contains(_ekv, x))) AS DOUBLE) AS _tp,
    CAST(len(_pkv) AS DOUBLE) AS _np, CAST(len(_ekv) AS DOUBLE) AS _ne
  FROM {name}_b
),
{name}_d AS (
  SELECT *,
    CASE WHEN _np > 0 THEN _tp / _np ELSE 0.0 END AS _prec,
    CASE WHEN _ne > 0 THEN _tp / _ne ELSE 0.0 END AS _rec
  FROM {name}_c
),
{name} AS (
  SELECT *,
    CASE WHEN call IS NOT NULL AND {name_of('call')} IS NOT NULL AND length({name_of('call')}) > 0
              AND (_args IS NULL OR json_type(_args) = 'OBJECT') THEN 1.0 ELSE 0.0 END AS reward_schema,
    CASE WHEN call IS NOT NULL AND coalesce(lower(trim({name_of('call')})) = lower(trim(expected_tool)), false)
         THEN 1.0 ELSE 0.0 END AS reward_tool_name,
    CASE WHEN call IS NULL OR _pkv IS NULL OR _ekv IS NULL THEN 0.0
         WHEN _np = 0 AND _ne = 0 THEN 1.0
         WHEN _prec + _rec > 0 THEN 2.0 * _prec * _rec / (_prec + _rec)
         ELSE 0.0 END AS reward_argument_f1,
    CASE WHEN _exp IS NOT NULL AND len(_pred) = len(_exp)
              AND len(list_filter(range(1, len(_exp) + 1), lambda i: coalesce(_pred[i] = _exp[i], false))) = len(_exp)
         THEN 1.0 ELSE 0.0 END AS reward_chain,
    CASE WHEN _exp IS NULL OR len(_exp) = 0 THEN 0.0
         ELSE CAST(len(list_filter(range(1, len(_exp) + 1),
                   lambda i: i <= len(_pred) AND coalesce(_pred[i] = _exp[i], false))) AS DOUBLE) / len(_exp)
    END AS reward_chain_partial
  FROM {name}_d
)"""


def composite(gating: str) -> tuple[str, str]:
    """SQL (n_components, reward) expressions over a ``rewards_cte`` row."""
    if gating == "always":
        n = "5"
        on = {"t": "true", "a": "true", "c": "true"}
    else:
        on = {"t": "(expected_tool IS NOT NULL AND expected_tool <> '')",
              "a": "(expected_args IS NOT NULL AND expected_args <> '')",
              "c": "(expected_chain IS NOT NULL AND expected_chain <> '' AND expected_chain <> '[]')"}
        n = f"(1 + CAST({on['t']} AS INTEGER) + CAST({on['a']} AS INTEGER) + 2 * CAST({on['c']} AS INTEGER))"
    nd = f"CAST({n} AS DOUBLE)"
    reward = (f"reward_schema / {nd}"
              f" + CASE WHEN {on['t']} THEN reward_tool_name / {nd} ELSE 0.0 END"
              f" + CASE WHEN {on['a']} THEN reward_argument_f1 / {nd} ELSE 0.0 END"
              f" + CASE WHEN {on['c']} THEN reward_chain / {nd} ELSE 0.0 END"
              f" + CASE WHEN {on['c']} THEN reward_chain_partial / {nd} ELSE 0.0 END")
    return f"CAST({n} AS INTEGER)", reward


def r9(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 9)"


F3 = r"""
f3c AS (
  SELECT ['baseline', 'sft', 'grpo'][CAST((event_id // 10) % 3 AS INTEGER) + 1] AS stage,
         event_id AS example_id, event_id, completion, n_tokens, elapsed_s, expected_tool, expected_args,
         CASE WHEN event_id % 7 < 3 THEN [expected_tool, 'none'] ELSE CAST([] AS VARCHAR[]) END AS chain
  FROM f2
)"""


def eval_ctes() -> str:
    """CTEs: f2, f3c, extraction, per-row flags (ev), quality (q), latency (lat), wide (sw), long (ml)."""
    name = name_of("call")
    args = args_of("call")
    pred = f"list_transform(calls, lambda x: lower(trim({name_of('x')})))"
    return f"""WITH {F2}, {F3}, {extract_cte('f3c')},
ev0 AS (
  SELECT *, {args} AS _args, {pred} AS _pred, list_transform(chain, lambda n: lower(trim(n))) AS _exp
  FROM ex
),
ev AS (
  SELECT stage, example_id,
    CASE WHEN expected_tool IS NOT NULL AND expected_tool <> '' THEN
      (CASE WHEN {name} IS NOT NULL AND {name} <> '' AND lower({name}) = lower(expected_tool) THEN 1.0 ELSE 0.0 END)
    END AS _sel,
    CASE WHEN expected_args IS NOT NULL THEN
      (CASE WHEN coalesce((CASE WHEN call IS NULL THEN NULL WHEN _args IS NULL THEN '{{}}'
                                ELSE {fold("CAST(_args AS VARCHAR)")} END) = {fold("CAST(json(expected_args) AS VARCHAR)")}, false)
            THEN 1.0 ELSE 0.0 END)
    END AS _arg,
    CASE WHEN call IS NOT NULL AND {name} IS NOT NULL AND (_args IS NULL OR json_type(_args) = 'OBJECT')
         THEN 1.0 ELSE 0.0 END AS _schema,
    CASE WHEN len(chain) > 1 THEN
      CASE WHEN _pred = _exp THEN 'correct'
           WHEN len(_pred) = 0 THEN 'zero_calls'
           WHEN len(_pred) = 1 AND len(_exp) > 1 THEN 'one_call_only'
           WHEN len(list_filter(_exp, lambda n: list_contains(_pred, n))) = len(_exp) THEN 'wrong_order'
           WHEN len(list_filter(_exp, lambda n: list_contains(_pred, n))) > 0 THEN 'partial'
           ELSE 'other' END
    END AS _label
  FROM ev0
),
q AS (
  SELECT stage,
    coalesce(avg(_sel), 0.0) AS tool_selection_accuracy,
    coalesce(avg(_arg), 0.0) AS argument_accuracy,
    coalesce(avg(_schema), 0.0) AS schema_compliance,
    count(_label) AS n_multi_step,
    coalesce(sum(CASE WHEN _label = 'correct' THEN 1 ELSE 0 END) / count(_label), 0.0) AS multi_step_success,
    coalesce(sum(CASE WHEN _label = 'zero_calls' THEN 1 ELSE 0 END) / count(_label), 0.0) AS multi_step_zero_calls,
    coalesce(sum(CASE WHEN _label = 'one_call_only' THEN 1 ELSE 0 END) / count(_label), 0.0) AS multi_step_one_call_only,
    coalesce(sum(CASE WHEN _label = 'wrong_order' THEN 1 ELSE 0 END) / count(_label), 0.0) AS multi_step_wrong_order,
    coalesce(sum(CASE WHEN _label = 'partial' THEN 1 ELSE 0 END) / count(_label), 0.0) AS multi_step_partial,
    coalesce(sum(CASE WHEN _label = 'other' THEN 1 ELSE 0 END) / count(_label), 0.0) AS multi_step_other
  FROM ev GROUP BY stage
),
lh AS (
  SELECT stage, example_id, elapsed_s, n_tokens,
         row_number() OVER (PARTITION BY stage ORDER BY example_id) AS pos
  FROM f3c QUALIFY pos <= 100
),
lat AS (
  SELECT stage,
    CASE WHEN count(*) > 0 AND sum(n_tokens) > 0 THEN sum(elapsed_s) / count(*) * 1000.0 ELSE 0.0 END AS avg_latency_ms,
    CASE WHEN count(*) > 0 AND sum(n_tokens) > 0
         THEN 1000.0 * (sum(elapsed_s) / count(*)) / (sum(n_tokens) / count(*)) ELSE 0.0 END AS ms_per_token
  FROM lh GROUP BY stage
),
sw AS (SELECT * FROM q FULL OUTER JOIN lat USING (stage)),
ml AS (
  UNPIVOT sw ON tool_selection_accuracy, argument_accuracy, schema_compliance, multi_step_success,
                avg_latency_ms, ms_per_token INTO NAME metric VALUE value
)"""


def display(v: str, metric: str = "metric") -> str:
    return (f"CASE WHEN {v} IS NULL THEN '-' WHEN {metric} LIKE '%accuracy%' OR {metric} LIKE '%success%' "
            f"OR {metric} LIKE '%compliance%' THEN printf('%.1f%%', {v} * 100.0) ELSE printf('%.2f', {v}) END")
