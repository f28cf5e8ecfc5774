"""Tool-call extraction from free-text completions (E1-E5), as column expressions.

All functions take and return ``Column`` so the whole extraction fuses into one
projection inside whole-stage codegen; no Python runs per row.

Semantics kept on purpose (see SURVEY quirks):
- Q3: the function-call form has no end marker, so ``\\{.*?\\}`` stops at the
  first closing brace and nested arguments never parse there.
- Q4: the flat-object regex can return an inner object that carries ``name``.
- Q5: the multi-call extractor ignores fenced and function-call forms.
- Q6: a JSON value that is not an object is never a call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolframe.functions import jsonx

# The patterns the reference uses, in its order.
THINK_CLOSED = r"(?s)<think>.*?</think>"
THINK_OPEN = r"(?s)<think>.*$"
FENCED_BLOCK = r"(?sU)```(?:json)?\s*(\{.*?\})\s*```"
TOOL_CALL_TAG = r"(?sU)<tool_call>\s*(\{.*?\})\s*</tool_call>"
FUNCTION_CALL_TAG = r"(?sU)<\|function_call\|>\s*(\{.*?\})"
FLAT_OBJECT = r'(?sU)\{[^{}]*"name"\s*:\s*"[^"]+?"[^{}]*\}'
TOOL_CALL_BLOCK = r"(?sU)<tool_call>\s*(.*?)\s*</tool_call>"
ASSISTANT_MARKER = "ASSISTANT:"


def strip_think(text: Column) -> Column:
    """Drop closed ``<think>..</think>`` spans, then an unclosed tail."""
    return F.regexp_replace(F.regexp_replace(text, THINK_CLOSED, ""), THINK_OPEN, "")


def named_calls(candidates: Column) -> Column:
    """Strictly parsed candidates that are objects with key ``name``, in order."""
    return F.filter(jsonx.parse_strict_all(candidates), lambda v: jsonx.has_key(v, "name"))


def flat_objects(clean: Column) -> Column:
    """Every flat ``{..."name": "..."...}`` match, as strings."""
    return F.regexp_extract_all(clean, F.lit(FLAT_OBJECT), 0)


def first_matches(clean: Column) -> Column:
    """First match of the fenced, tool-call-tag and function-call forms, in that order."""
    return F.array(*[F.regexp_extract(clean, p, 1) for p in (FENCED_BLOCK, TOOL_CALL_TAG, FUNCTION_CALL_TAG)])


def tool_call_blocks(clean: Column) -> Column:
    return F.regexp_extract_all(clean, F.lit(TOOL_CALL_BLOCK), 1)


def after_marker(text: Column, marker: str = ASSISTANT_MARKER) -> Column:
    """E5: text after the first ``marker``, Python-stripped; NULL when absent."""
    from toolframe.functions.text import py_strip
    pos = F.locate(marker, text)
    return F.when(pos > 0, py_strip(F.substr(text, pos + F.lit(len(marker)))))


def call_name(call: Column) -> Column:
    """Name of a call if it is a JSON string, else NULL."""
    return jsonx.as_string(jsonx.key(call, "name"))


def call_names(calls: Column) -> Column:
    """``array<string>`` of call names; a non-string name becomes NULL."""
    return F.transform(calls, call_name)
