"""Tool lists and weighted draws over given tables.

A catalogue and a table of choices are small by nature (every example shows
the whole catalogue); both are counted, and more than their bound raises. Each
becomes a constant of the plan, so examples of any number are labelled where
they are: no join, no shuffle. All draws and orders are md5 of (seed, key).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolframe.operators.rank import order_key, unit_draw

MAX_TOOLS = 10_000
MAX_CHOICES = 100_000


def _constant(rows: list[dict], kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: too many for a constant of the plan")
    return rows


def expose_tools(examples: DataFrame, catalogue: DataFrame, needed: str = "needed", key: str = "row_id", seed: int = 42,
                 distractors: int | None = None) -> DataFrame:
    """examples with ``tools`` (array of name, definition) and ``missing`` (array of names).

    catalogue: name (unique, not null), definition. The tools that an example
    needs are looked up by name (J4); of all others (J5) the first
    ``distractors`` in the example's own order join them, all by default; the
    whole list stands in that order (L7). missing: needed names that the
    catalogue lacks (U3), sorted. A null ``needed`` needs nothing.
    """
    known = sorted((r["name"], r["definition"]) for r in _bounded(catalogue.select("name", "definition").where("name is not null"), MAX_TOOLS))
    if len({n for n, _ in known}) < len(known):
        raise ValueError("a catalogue's names must be unique")
    tools = _constant([{"name": n, "definition": d} for n, d in known], "struct<name:string,definition:string>")
    want = F.coalesce(F.col(needed), F.array().cast("array<string>"))
    ranked = F.array_sort(F.transform(tools, lambda t: F.struct(order_key(F.col(key), t["name"], seed=seed).alias("u"), t["name"].alias("name"), t["definition"].alias("definition"))))
    staged = examples.withColumn("_ranked", ranked).withColumn("_want", want)
    if distractors is None:
        shown = F.col("_ranked")
    else:  # the last distractor that is shown, found once per example
        others = F.filter("_ranked", lambda t: ~F.array_contains("_want", t["name"]))
        staged = staged.withColumn("_edge", F.try_element_at(others, F.least(F.lit(distractors), F.size(others))) if distractors else F.lit(None).cast("struct<u:bigint,name:string,definition:string>"))
        shown = F.filter("_ranked", lambda t: F.array_contains("_want", t["name"]) | F.coalesce(t <= F.col("_edge"), F.lit(False)))
    names = F.transform(tools, lambda t: t["name"])
    return (staged.withColumn("tools", F.transform(shown, lambda t: F.struct(t["name"].alias("name"), t["definition"].alias("definition"))))
                    .withColumn("missing", F.array_sort(F.array_except("_want", names))).drop("_ranked", "_want", "_edge"))


def weighted_choice(rows: DataFrame, choices: DataFrame, key: str = "row_id", seed: int = 42, out: str = "choice") -> DataFrame:
    """A choice per row, each drawn with a chance in proportion to its weight.

    choices: name, weight (whole numbers; none or less is never drawn). The
    draw is a place on the line of all weights, found by halving the array of
    their running sums, names in order. No choices give nulls.
    """
    line, total = [], 0
    for name, weight in sorted((r["name"], int(r["weight"])) for r in _bounded(choices.select("name", "weight").where("weight > 0 and name is not null"), MAX_CHOICES)):
        total += weight
        line.append({"upto": total, "name": name})
    if not line:
        return rows.withColumn(out, F.lit(None).cast("string"))
    table = _constant(line, "struct<upto:bigint,name:string>")
    place = F.floor(unit_draw(F.col(key), F.lit(out), seed=seed) * total)

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        left = place < table[mid]["upto"]
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(left, s["low"]).otherwise(mid + 1).alias("low"), F.when(left, mid).otherwise(s["high"]).alias("high")))

    whole = F.struct(F.lit(0).alias("low"), F.lit(len(line) - 1).alias("high"))
    return rows.withColumn(out, F.aggregate(F.sequence(F.lit(1), F.lit(len(line).bit_length())), whole, halve, lambda s: table[s["low"]]["name"]))


def training_text(category: Column, instruction: Column, calls: Column) -> Column:
    """``[category] USER: ... ASSISTANT: <tool_call>...`` over all calls (array of JSON texts); nulls are empty, a null call is left out."""
    blocks = F.array_join(F.transform(F.filter(calls, lambda c: c.isNotNull()), lambda c: F.format_string("<tool_call>\n%s\n</tool_call>", c)), "\n")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.format_string("[%s] USER: %s\nASSISTANT: %s", empty(category), empty(instruction), empty(blocks))


def rounded_draw(low: Column, high: Column, digits: int, *key: Column, seed: int = 42) -> Column:
    """A uniform draw between two bounds, rounded; the same for the same key."""
    return F.round(low + unit_draw(*key, seed=seed) * (high - low), digits)


def local_time(day: Column, clock: Column) -> Column:
    """A date text and a clock text (``HH:MM``) as one ISO text; null if either is."""
    return F.concat(day, F.lit("T"), clock, F.lit(":00"))
