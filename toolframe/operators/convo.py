"""Conversations and training-table shaping.

Conversations arrive exploded, one row per turn ``(conv_id, turn, role,
text)``. Per-conversation facts (has an assistant turn, last assistant turn)
are partial aggregations joined back to the turns, never a collected list;
only rendering a whole conversation into one string gathers its turns, and
that output is one value per conversation by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolframe.functions import extract, jsonx
from toolframe.functions.text import truthy
from toolframe.operators.evals import TOOL_USE_SYSTEM_PROMPT

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def render_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """P7 (exploded form): ``role: content`` lines in turn order, joined by newlines."""
    line = F.concat(F.coalesce(F.col(role), F.lit("")), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    g = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l"))))
                                .alias("_lines"))
    return g.select(conv, F.array_join(F.transform("_lines", lambda x: x["l"]), "\n").alias("text"),
                    F.size("_lines").alias("n_turns"))


def as_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """Exploded turns -> ``array<struct<role, content>>`` per conversation, in turn order."""
    g = turns.groupBy(conv).agg(F.array_sort(F.collect_list(
        F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("_m"))
    return g.select(conv, F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                                               m["content"].alias("content"))).alias("messages"))


def train_on(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """P17 + T4: per-turn loss weight.

    With an assistant turn, only the LAST assistant turn is trained on
    (weight 1, others 0); without one, every turn is (weight 1). The last
    assistant turn is a partial aggregation per conversation joined back.
    """
    last = turns.groupBy(F.col(conv).alias("_conv")).agg(
        F.max(F.when(F.col(role) == "assistant", F.col(turn))).alias("_last_assistant"))
    j = turns.join(last, F.col(conv).eqNullSafe(F.col("_conv")), "inner")  # turns without an id are one conversation
    w = F.when(F.col("_last_assistant").isNull(), F.lit(1)) \
        .when(F.col(turn) == F.col("_last_assistant"), F.lit(1)).otherwise(F.lit(0))
    return j.withColumn("weight", w).withColumn("has_assistant", F.col("_last_assistant").isNotNull()) \
        .drop("_last_assistant", "_conv")


def content_spans(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Where each turn's text stands in ``render_turns``: (conv, start, end, weight), code points, end exclusive; weight as in ``train_on``."""
    head = F.concat(F.coalesce(F.col(role), F.lit("")), F.lit(": "))
    line = F.concat(head, F.coalesce(F.col(text), F.lit("")))
    lines = train_on(turns, conv, turn, role).select(conv, F.col(turn).alias("_t"), line.alias("_l"), F.length(head).alias("_h"), "weight")
    before = Window.partitionBy(conv).orderBy("_t", "_l").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_l") + 1).over(before), F.lit(0))
    return lines.withColumn("_s", start).select(conv, (F.col("_s") + F.col("_h")).alias("start"), (F.col("_s") + F.length("_l")).alias("end"), "weight")


def token_weights(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """T4 per token: (conv, i, token, start, end, weight) over the rendered conversation.

    Tokens of the last assistant turn's text weigh 1; without an assistant
    turn, those of every turn's text. Role names never do. Tokens and order are
    those of ``tokens.encode`` on the rendered text.
    """
    rows = _weighted(turns, conv, turn, role, text).select(conv, F.posexplode("tokens").alias("i", "_token"))
    return rows.select(conv, F.col("i").cast("long").alias("i"), "_token.token", "_token.start", "_token.end", "_token.weight")


def loss_weights(turns: DataFrame, max_length: int = 2048, conv: str = "conv_id", **names) -> DataFrame:
    """T4 as arrays: (conv, loss_weights), one weight per position of ``tokens.encode``: cut at ``max_length``, padding weighs 0."""
    w = F.transform(F.slice("tokens", 1, max_length), lambda x: x["weight"])
    arrays = _weighted(turns, conv, **names).select(conv, w.alias("_w"))
    return arrays.select(conv, F.concat("_w", F.array_repeat(F.lit(0), F.lit(max_length) - F.size("_w"))).alias("loss_weights"))


def _weighted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, tokens): every conversation's tokens with offsets and weights, one array per conversation."""
    from toolframe.operators import tokens
    return tokens.weighted_tokens(render_turns(turns, conv, turn, role, text), content_spans(turns, conv, turn, role, text), conv)


def conversation_summary(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """Last message and last assistant message per conversation (they differ when a user turn ends it)."""
    last_key = F.struct(F.col(turn), F.col(role), F.col(text))
    return turns.groupBy(conv).agg(
        F.max_by(F.col(role), F.col(turn)).alias("last_role"),
        F.max_by(F.col(text), F.col(turn)).alias("last_text"),
        F.max_by(F.when(F.col(role) == "assistant", F.col(text)),
                 F.when(F.col(role) == "assistant", F.col(turn))).alias("last_assistant_text"),
        F.max(F.when(F.col(role) == "assistant", F.col(turn))).alias("last_assistant_turn"),
        F.count(last_key).alias("n_turns"))


def _call_block(call: Column) -> Column:
    return F.concat(F.lit("<tool_call>\n"), F.to_json(call), F.lit("\n</tool_call>"))


def example_to_conversation(df: DataFrame, instruction: str = "instruction", tools: str = "tools",
                            tool_calls: str = "tool_calls", text: str = "text",
                            system: str = TOOL_USE_SYSTEM_PROMPT) -> Column:
    """Raw example -> [system, user, assistant] messages, or NULL.

    NULL without an instruction. The system message lists the tools when
    there are any. The assistant message is one ``<tool_call>`` block per call
    (compact JSON), else the text after ``ASSISTANT:``, else NULL.
    """
    tools_v = jsonx.as_array(jsonx.lenient(F.col(tools).cast("string"))) if tools in df.columns \
        else F.lit(None).cast("array<variant>")
    calls_v = jsonx.as_array(jsonx.lenient(F.col(tool_calls).cast("string"))) if tool_calls in df.columns \
        else F.lit(None).cast("array<variant>")
    sys_msg = F.when(F.size(tools_v) > 0, F.concat(F.lit(system + "\n\nAvailable tools:\n"), F.to_json(tools_v))) \
        .otherwise(F.lit(system))
    after = extract.after_marker(F.col(text)) if text in df.columns else F.lit(None).cast("string")
    assistant = F.when(F.size(calls_v) > 0, F.array_join(F.transform(calls_v, _call_block), "\n")) \
        .otherwise(after)
    msgs = F.array(F.struct(F.lit("system").alias("role"), sys_msg.alias("content")),
                   F.struct(F.lit("user").alias("role"), F.col(instruction).alias("content")),
                   F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))
    return F.when(truthy(F.col(instruction)) & assistant.isNotNull(), msgs)


def build_prompts(df: DataFrame, system: str = TOOL_USE_SYSTEM_PROMPT) -> DataFrame:
    """Prepared rows -> GRPO prompts ``(system, user, expected_tool, expected_args,
    expected_chain, source)``; rows without a prompt are dropped.

    ``expected_args`` is the first call's arguments (``parameters`` fallback)
    as JSON text; ``expected_chain`` lists all call names only when there is
    more than one call, else ``"[]"``.
    """
    fields = [c for c in ("instruction", "user_instruction", "query", "text") if c in df.columns]
    prompt = F.coalesce(*[F.when(truthy(F.col(c)), F.col(c)) for c in fields])
    tools_s = F.col("tools").cast("string") if "tools" in df.columns else F.lit(None).cast("string")
    sys_msg = F.when(truthy(tools_s), F.concat(F.lit(system + "\n\nAvailable tools:\n"), tools_s)).otherwise(F.lit(system))
    parsed = jsonx.lenient(F.col("tool_calls").cast("string")) if "tool_calls" in df.columns \
        else F.lit(None).cast("variant")
    staged = df.withColumn("_prompt", prompt).withColumn("_system", sys_msg).withColumn("_tc", parsed)
    arr = jsonx.as_array(F.col("_tc"))
    first = F.coalesce(F.try_element_at(arr, F.lit(1)),
                       F.when(jsonx.as_object(F.col("_tc")).isNotNull(), F.col("_tc")))
    args = jsonx.call_arguments(first)
    names = F.transform(arr, lambda c: F.coalesce(extract.call_name(c), F.lit("")))
    has_calls = first.isNotNull()
    out = staged.select(
        *[c for c in ("row_id", "example_id") if c in df.columns],
        F.col("_system").alias("system"), F.col("_prompt").alias("user"),
        F.when(has_calls, F.coalesce(extract.call_name(first), F.lit(""))).otherwise(F.lit("")).alias("expected_tool"),
        F.when(has_calls, F.coalesce(F.when(jsonx.is_string(args), jsonx.as_string(args)), F.to_json(args),
                                     F.lit("{}"))).otherwise(F.lit("")).alias("expected_args"),
        F.when(F.size(arr) > 1, F.to_json(names)).otherwise(F.lit("[]")).alias("expected_chain"),
        (F.col("source") if "source" in df.columns else F.lit("unknown")).alias("source"),
    )
    return out.filter(F.col("user").isNotNull())
