"""E1-E5, H6, R1-R5, A9 against results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from toolframe.functions import extract, jsonx
from toolframe.operators import rewards

A = '{"name": "a", "arguments": {"k": 1}}'
EXPECT = ("a", '{"k": 1}', '["a", "b"]')  # tool, arguments, chain that every completion below is scored against
NONE = (None, [], (0, 0, 0, 0, 0))


def tag(body):
    return f"<tool_call>{body}</tool_call>"


# completion -> first call, names of all calls, rewards (schema, tool name, argument F1, chain, chain partial)
TABLE = [
    (tag(f"\n{A}\n"), json.loads(A), ["a"], (1, 1, 1, 0, 0.5)),
    (f"```json\n{A}\n```", json.loads(A), [], (1, 1, 1, 0, 0)),                    # Q5: fences make no call list
    (f"<|function_call|>{A}", *NONE),                                               # Q3: nested braces never parse here
    ("<think>" + tag('{"name": "z"}') + "</think>\n" + tag(A), json.loads(A), ["a"], (1, 1, 1, 0, 0.5)),
    (f"<think>open {tag(A)}", *NONE),                                               # an open think swallows the rest
    (tag(f"{A} trailing"), *NONE),
    (tag(f"{A}]"), *NONE),                                                          # a stray ] is no JSON
    (tag(f"{A}] trailing"), *NONE),
    (tag(f"{A}]["), *NONE),
    (tag(f"{A}, {A}"), *NONE),
    (tag('{"name": "a"} {"name": "b"}'), {"name": "a"}, ["a", "b"], (1, 1, 0, 1, 1)),  # two flat objects instead
    (tag('{"name": "a", "name": "b"}'), {"name": "b"}, ["b"], (1, 0, 0, 0, 0)),      # the last of two keys
    (tag('{"name": "a", "arguments": {"x": NaN}}'), *NONE),
    (tag("{'name': 'a'}"), *NONE),
    (tag('["name"]'), *NONE),                                                       # Q6: only objects are calls
    (tag('"name"'), *NONE),
    (tag("42"), *NONE),
    (tag('{"name": "a", "arguments": null}'), {"name": "a", "arguments": None}, ["a"], (0, 1, 0, 0, 0.5)),
    (tag('{"name": 5, "arguments": {}}'), {"name": 5, "arguments": {}}, [None], (0, 0, 0, 0, 0)),
    (tag('{"name": "", "arguments": {}}'), {"name": "", "arguments": {}}, [""], (0, 0, 0, 0, 0)),
    (tag('{"name": "a", "arguments": {"k": "1"}}'), {"name": "a", "arguments": {"k": "1"}}, ["a"], (1, 1, 0, 0, 0.5)),
    (tag('{"name": "a", "arguments": {"k": 1.0}}'), {"name": "a", "arguments": {"k": 1}}, ["a"], (1, 1, 0, 0, 0.5)),  # 1.0 is not 1
    (tag('{"name": "a", "arguments": {"k": 1, "z": 2}}'), {"name": "a", "arguments": {"k": 1, "z": 2}}, ["a"], (1, 1, 2 / 3, 0, 0.5)),
    ('text {"outer": {"name": "inner", "x": 1}} more', {"name": "inner", "x": 1}, ["inner"], (1, 0, 0, 0, 0)),  # Q4
    (tag('{"name": "a", "parameters": {"k": 1}}'), {"name": "a", "parameters": {"k": 1}}, ["a"], (1, 1, 1, 0, 0.5)),
    (tag('{"name": "a", "arguments": "{\\"k\\": 1}"}'), {"name": "a", "arguments": '{"k": 1}'}, ["a"], (0, 1, 1, 0, 0.5)),
    (tag('{"name": "a", "arguments": "not json"}'), {"name": "a", "arguments": "not json"}, ["a"], (0, 1, 0, 0, 0.5)),
    (tag('{"name": " A ", "arguments": {}}') + tag('{"name": "b", "arguments": {}}'), {"name": " A ", "arguments": {}}, [" A ", "b"], (1, 1, 0, 1, 1)),
    ('{"name": "flat1", "arguments": 1} and {"name": "flat2"}', {"name": "flat1", "arguments": 1}, ["flat1", "flat2"], (0, 0, 0, 0, 0)),
    ("no call here", *NONE),
    ("", *NONE),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, t[0], *EXPECT) for i, t in enumerate(TABLE)],
                               "id int, completion string, expected_tool string, expected_args string, expected_chain string")
    out = rewards.score(df, gating="always", keep_calls=True)
    return {r["id"]: r for r in out.select("*", F.to_json("call").alias("call_json"), extract.call_names(F.col("calls")).alias("names"),
                                           F.size("calls").alias("n")).collect()}


@pytest.mark.parametrize("i", range(len(TABLE)))
def test_calls_and_rewards_by_hand(scored, i):
    text, call, names, values = TABLE[i]
    got = scored[i]
    assert (json.loads(got["call_json"]) if got["call_json"] else None) == call, text
    assert got["n"] == len(names) and got["names"] == names, text
    for name, v in zip(("schema", "tool_name", "argument_f1", "chain", "chain_partial"), values, strict=True):
        assert got[f"reward_{name}"] == pytest.approx(v), (text, name)


ARGUMENTS = [  # predicted, expected, F1
    ("500", "500.0", 0), ("500.0", "500.0", 1), ("500.00", "500.0", 1), ("1e2", "100.0", 1), ("100", "1e2", 0), ("[1.0]", "[1]", 0), ("[1.5]", "[1.5]", 1),
    ('{"x": 2.0}', '{"x": 2}', 0), ('{"x": 1, "y": 2}', '{"y": 2, "x": 1}', 1), ("123456789012345678901234567890", "123456789012345678901234567890", 1), ("true", "1", 0), ("null", "null", 1),
]


def test_arguments_compare_as_json_text(spark):
    rows = [(i, tag('{"name": "a", "arguments": {"k": %s}}' % p), "a", '{"k": %s}' % e, "[]") for i, (p, e, _) in enumerate(ARGUMENTS)]
    df = spark.createDataFrame(rows, "id int, completion string, expected_tool string, expected_args string, expected_chain string")
    got = {r["id"]: r["reward_argument_f1"] for r in rewards.score(df).collect()}
    assert [got[i] for i in range(len(rows))] == [f for *_, f in ARGUMENTS]


def test_composite_always_is_mean_of_five(scored):
    for r in scored.values():
        parts = [r[f"reward_{n}"] for n in ("schema", "tool_name", "argument_f1", "chain", "chain_partial")]
        acc = 0.0
        for p in parts:
            acc += p / 5
        assert r["n_components"] == 5
        assert r["reward"] == acc  # same floating-point order as the reference


def test_q1_gating_intended_vs_always(spark):
    perfect = '<tool_call>{"name": "a", "arguments": {"k": 1}}</tool_call>'
    df = spark.createDataFrame([(perfect, "a", '{"k": 1}', "[]")],
                               "completion string, expected_tool string, expected_args string, expected_chain string")
    intended = rewards.score(df, gating="intended").first()
    always = rewards.score(df, gating="always").first()
    assert intended["n_components"] == 3 and intended["reward"] == pytest.approx(1.0)
    # Q1/Q2: with "[]" the chain scores 0 (one call made) and partial scores 0 -> 3/5.
    assert always["n_components"] == 5 and always["reward"] == pytest.approx(0.6)


def test_q2_empty_chain_full_credit_only_without_calls(spark):
    df = spark.createDataFrame([("nothing", "a", "{}", "[]")],
                               "completion string, expected_tool string, expected_args string, expected_chain string")
    r = rewards.score(df, gating="always").first()
    assert r["reward_chain"] == 1.0 and r["reward_chain_partial"] == 0.0


def test_strict_parse_rejects_garbage(spark):
    jsonx.last_key_wins(spark)
    cases = ['{"a":1} x', '{"a":1}, {"b":2}', '{"a":1}]', '{"a":1}] x', '{"a":1}][', "NaN", "'x'", "", '  {"a": 1}  ', '{"a":1,"a":2}']
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r[0] for r in df.select(jsonx.parse_strict(F.col("s")).isNotNull()).collect()]
    assert got == [False] * 8 + [True, True]


def test_key_presence_vs_null(spark):
    df = spark.createDataFrame([('{"name": null}',), ('{"x": 1}',)], "s string")
    got = [r[0] for r in df.select(jsonx.has_key(jsonx.parse_strict(F.col("s")), "name")).collect()]
    assert got == [True, False]


def test_after_marker(spark):
    df = spark.createDataFrame([("[c] USER: hi\nASSISTANT:  <tool_call>x</tool_call>\n",), ("no marker",)], "t string")
    got = [r[0] for r in df.select(extract.after_marker(F.col("t"))).collect()]
    assert got == ["<tool_call>x</tool_call>", None]


def test_register_custom_reward(spark):
    rewards.register_reward("short", lambda c: F.when(F.length(c.completion) < 10, 1.0).otherwise(0.0))
    try:
        df = spark.createDataFrame([("tiny", "a", "{}", "[]")],
                                   "completion string, expected_tool string, expected_args string, expected_chain string")
        r = rewards.score(df, gating="always").first()
        assert r["reward_short"] == 1.0 and r["n_components"] == 6
    finally:
        rewards._REGISTRY[:] = [x for x in rewards._REGISTRY if x.name != "short"]
        rewards._score_columns.cache_clear()
