"""Reward columns (R1-R5), composite reward (A9) and the reward registry.

Every reward is a pure column expression over a scored frame, so scoring a
billion completions is one narrow projection: no shuffle, no Python per row.

``score`` first projects the think-stripped text, the first call (E2) and all
calls (E3) into named columns exactly once; every reward reads those columns,
so the regexes and JSON parses are not repeated per reward.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolframe.functions import extract, jsonx
from toolframe.functions.text import py_strip, truthy

EMPTY_CHAIN = "[]"


@dataclass(frozen=True)
class Ctx:
    """Columns a reward can read (all staged once by ``score``)."""

    call: Column          # VARIANT first call (E2) or NULL
    calls: Column         # array<variant> all calls (E3)
    completion: Column
    expected_tool: Column
    expected_args: Column
    expected_chain: Column
    call_args: Column     # VARIANT arguments/parameters of ``call``; NULL = neither key
    pred_kv: Column       # key=json(value) pairs of the call's arguments; NULL = not an object
    exp_kv: Column        # same for expected_args; NULL = not a JSON object
    pred_names: Column    # lower/stripped names of ``calls``
    exp_names: Column     # lower/stripped expected chain; NULL = not a JSON array


@dataclass(frozen=True)
class Reward:
    name: str
    fn: Callable[[Ctx], Column]
    # Active-when predicate for ``gating="intended"``; None means always on.
    gate: Callable[[Ctx], Column] | None = None


_REGISTRY: list[Reward] = []


def register_reward(name: str, fn: Callable[[Ctx], Column],
                    gate: Callable[[Ctx], Column] | None = None) -> None:
    """Add (or replace) a reward column. ``fn`` must return a double Column."""
    global _REGISTRY
    _REGISTRY = [r for r in _REGISTRY if r.name != name] + [Reward(name, fn, gate)]
    _score_columns.cache_clear() if "_score_columns" in globals() else None


def registered() -> list[Reward]:
    return list(_REGISTRY)


def _norm(c: Column) -> Column:
    return F.lower(py_strip(c))


def _expected_names(chain_json: Column) -> Column:
    """Expected chain as lower/stripped names; items are strings or ``{name}``.

    NULL when the chain is not valid JSON or not an array. An object item
    without ``name`` counts as ``""``; any other item never matches (NULL).
    """
    arr = jsonx.as_array(jsonx.parse_strict(chain_json))

    def one(e: Column) -> Column:
        name = jsonx.key(e, "name")
        return (F.when(jsonx.is_string(e), _norm(jsonx.as_string(e)))
                .when(jsonx.as_object(e).isNotNull(),
                      F.when(name.isNull(), F.lit("")).otherwise(_norm(jsonx.as_string(name)))))

    return F.transform(arr, one)


def _predicted_names(calls: Column) -> Column:
    return F.transform(calls, lambda c: _norm(extract.call_name(c)))


def schema_validation(ctx: Ctx) -> Column:
    """A call exists, ``name`` is a non-empty string, arguments are an object."""
    name = extract.call_name(ctx.call)
    ok = (ctx.call.isNotNull() & name.isNotNull() & (F.length(name) > 0)
          & (ctx.call_args.isNull() | jsonx.as_object(ctx.call_args).isNotNull()))
    return F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0))


def tool_name(ctx: Ctx) -> Column:
    """R2: lower+strip equality of the first call's name and the expected tool."""
    same = _norm(extract.call_name(ctx.call)) == _norm(ctx.expected_tool)
    return F.when(ctx.call.isNotNull() & F.coalesce(same, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def argument_f1(ctx: Ctx) -> Column:
    """F1 of ``key=json(value)`` pairs; both empty -> 1; anything invalid -> 0."""
    pred, exp = ctx.pred_kv, ctx.exp_kv
    tp = F.size(F.array_intersect(pred, exp)).cast("double")
    n_pred = F.size(pred).cast("double")
    n_exp = F.size(exp).cast("double")
    precision = F.when(n_pred > 0, tp / n_pred).otherwise(F.lit(0.0))
    recall = F.when(n_exp > 0, tp / n_exp).otherwise(F.lit(0.0))
    f1 = (F.when((n_pred == 0) & (n_exp == 0), F.lit(1.0))
          .when(precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall))
          .otherwise(F.lit(0.0)))
    return F.when(ctx.call.isNull() | pred.isNull() | exp.isNull(), F.lit(0.0)).otherwise(f1)


def full_chain(ctx: Ctx) -> Column:
    """Predicted call names equal the expected chain, position by position."""
    exp, pred = ctx.exp_names, ctx.pred_names
    same = (F.size(pred) == F.size(exp)) & F.forall(
        F.zip_with(pred, exp, lambda p, e: F.coalesce(p == e, F.lit(False))), lambda x: x)
    return F.when(exp.isNotNull() & F.coalesce(same, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def chain_partial(ctx: Ctx) -> Column:
    """Share of expected positions holding the expected name; empty -> 0."""
    exp, pred = ctx.exp_names, ctx.pred_names
    hits = F.size(F.filter(F.zip_with(exp, pred, lambda e, p: F.coalesce(e == p, F.lit(False))),
                           lambda x: x))
    return (F.when(exp.isNull() | (F.size(exp) == 0), F.lit(0.0))
            .otherwise(hits.cast("double") / F.size(exp).cast("double")))


def _chain_gate(ctx: Ctx) -> Column:
    return truthy(ctx.expected_chain) & (ctx.expected_chain != F.lit(EMPTY_CHAIN))


register_reward("schema", schema_validation)
register_reward("tool_name", tool_name, lambda c: truthy(c.expected_tool))
register_reward("argument_f1", argument_f1, lambda c: truthy(c.expected_args))
register_reward("chain", full_chain, _chain_gate)
register_reward("chain_partial", chain_partial, _chain_gate)


@functools.lru_cache(maxsize=64)
def _call_stages(completion: str) -> tuple[dict[str, Column], ...]:
    """Column expressions of ``with_calls``, built once per process (they only name columns)."""
    empty = F.array().cast("array<variant>")
    need_flat = (F.size("_named_heads") == 0) | (F.size("_named_blocks") == 0)
    raw = F.col("_call_args")
    reparsed = F.when(jsonx.is_string(raw), jsonx.parse_strict(jsonx.as_string(raw))).otherwise(raw)
    return (
        {"_clean": extract.strip_think(F.col(completion))},
        {"_named_heads": extract.named_calls(extract.first_matches(F.col("_clean"))),
         "_named_blocks": extract.named_calls(extract.tool_call_blocks(F.col("_clean")))},
        {"_named_flat": F.when(need_flat, F.coalesce(
            extract.named_calls(extract.flat_objects(F.col("_clean"))), empty)).otherwise(empty)},
        {"call": F.coalesce(F.try_element_at("_named_heads", F.lit(1)), F.try_element_at("_named_flat", F.lit(1))),
         "calls": F.when(F.size("_named_blocks") > 0, F.col("_named_blocks")).otherwise(F.col("_named_flat"))},
        {"_call_args": jsonx.call_arguments(F.col("call")),
         "_pred_names": _predicted_names(F.col("calls"))},
        {"_pred_kv": F.when(raw.isNull(), F.array().cast("array<string>"))
         .otherwise(jsonx.kv_pairs(jsonx.as_object(reparsed), jsonx.as_object(_exact_arguments(raw))))},
    )


def _exact_arguments(args: Column) -> Column:
    """The first call's arguments parsed from ``jsonx.tagged`` text: of the text itself if they are a string, else of the candidate they came from."""
    clean = F.col("_clean")
    text = F.try_element_at(F.filter(F.concat(extract.first_matches(clean), extract.flat_objects(clean)), lambda c: jsonx.has_key(jsonx.parse_strict(c), "name")), F.lit(1))
    call = jsonx.parse_strict(jsonx.tagged(text))
    return F.when(jsonx.is_string(args), jsonx.parse_strict(jsonx.tagged(jsonx.as_string(args)))).otherwise(
        F.coalesce(jsonx.key(call, "sarguments"), jsonx.key(call, "sparameters")))


def with_calls(df: DataFrame, completion: str = "completion") -> DataFrame:
    """E1-E3 plus the prediction-side inputs of the rewards, as staged projections.

    Adds ``call`` (first call, E2), ``calls`` (all calls, E3) and the staged
    ``_call_args``, ``_pred_kv``, ``_pred_names``. Every regex runs at most once
    per row and every candidate is parsed once. The flat-object scan is a
    fallback of both extractors, so it only runs for rows that need it.
    Row-local: run it on the completions side before any join.
    """
    jsonx.last_key_wins(df.sparkSession)
    s = _call_stages(completion)
    out = df
    for i, stage in enumerate(s):
        if i == 4:
            out = out.drop("_named_heads", "_named_blocks", "_named_flat")
        out = out.withColumns(stage)
    return out.drop("_clean")


def with_expected(df: DataFrame, expected_args: str = "expected_args",
                  expected_chain: str = "expected_chain") -> DataFrame:
    """Parse the expected side once: ``_exp_kv`` and ``_exp_names``.

    Expectations belong to a prompt, not to a sample: run this on the prompt
    table before joining it to its G completions.
    """
    jsonx.last_key_wins(df.sparkSession)
    return df.withColumns(_expected_columns(expected_args, expected_chain))


@functools.lru_cache(maxsize=64)
def _expected_columns(expected_args: str, expected_chain: str) -> dict[str, Column]:
    args = F.col(expected_args).cast("string")
    return {"_exp_kv": jsonx.kv_pairs(jsonx.as_object(jsonx.parse_strict(args)), jsonx.as_object(jsonx.parse_strict(jsonx.tagged(args)))),
            "_exp_names": _expected_names(F.col(expected_chain).cast("string"))}


PRED_STAGED = ["_call_args", "_pred_kv", "_pred_names"]
EXP_STAGED = ["_exp_kv", "_exp_names"]
_STAGED = PRED_STAGED + EXP_STAGED


@functools.lru_cache(maxsize=64)
def _score_columns(names: tuple[str, ...], completion: str, expected_tool: str, expected_args: str,
                   expected_chain: str, gating: str):
    """Reward, component-count and composite columns for a registry state (memoised)."""
    by_name = {r.name: r for r in registered()}
    rewards = [by_name[n] for n in names]
    ctx = Ctx(F.col("call"), F.col("calls"), F.col(completion), F.col(expected_tool).cast("string"),
              F.col(expected_args).cast("string"), F.col(expected_chain).cast("string"),
              F.col("_call_args"), F.col("_pred_kv"), F.col("_exp_kv"), F.col("_pred_names"),
              F.col("_exp_names"))
    comp = {f"reward_{r.name}": r.fn(ctx) for r in rewards}
    active = {r.name: (F.lit(True) if (gating == "always" or r.gate is None)
                       else F.coalesce(r.gate(ctx), F.lit(False))) for r in rewards}
    n = sum((active[r.name].cast("int") for r in rewards), F.lit(0))
    total = None
    for r in rewards:
        term = F.when(active[r.name], F.col(f"reward_{r.name}") / F.col("n_components").cast("double")) \
            .otherwise(F.lit(0.0))
        total = term if total is None else total + term
    return comp, n, total


def score(df: DataFrame, *, completion: str = "completion", expected_tool: str = "expected_tool",
          expected_args: str = "expected_args", expected_chain: str = "expected_chain",
          gating: str = "intended", keep_calls: bool = False) -> DataFrame:
    """Add ``reward_<name>`` per registered reward, ``n_components`` and ``reward``.

    ``gating="intended"`` activates a component when its expected value is
    truthy (the chain also needs to differ from ``"[]"``); ``gating="always"``
    activates all of them, which is what the GRPO loop of the reference
    actually does (its metadata values are one-element lists, always truthy).
    Columns staged earlier by ``with_calls`` (completions side) and
    ``with_expected`` (prompt side) are reused, so extraction and parsing can
    run before the join, each on its own side.
    The sum is taken in registry order, each term divided by ``n`` first,
    matching the reference's floating-point order exactly.
    """
    if gating not in ("intended", "always"):
        raise ValueError(f"unknown gating {gating!r}")
    cols = set(df.columns)
    scored = df if "_pred_kv" in cols else with_calls(df, completion)
    if "_exp_kv" not in cols:
        scored = with_expected(scored, expected_args, expected_chain)
    rewards = registered()
    comp_cols, n_col, total = _score_columns(tuple(r.name for r in rewards), completion, expected_tool,
                                            expected_args, expected_chain, gating)
    scored = (scored.withColumns(comp_cols).withColumn("n_components", n_col).withColumn("reward", total)
              .drop(*[c for c in _STAGED]))
    if not keep_calls:
        scored = scored.drop("call", "calls")
    return scored
