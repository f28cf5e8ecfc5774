"""The synthetic corpus as one set-based job.

One example per input row (``row_id``): no per-row Python. Every draw is
``md5(seed|row_id|template|slot)``, so the same rows come out for any
partitioning or cluster size.

- J10 / G2: the template is a broadcast range join of a uniform draw against
  the cumulative template weights (45 rows, a fixed bound).
- G3-G8: slots are column expressions over literal pool arrays (pools are
  fixed, small, and travel inside the plan like broadcast constants). Slots
  are staged as columns guarded by the template index, layer by layer in
  dependency order, so each is drawn once and only for its own template;
  phrases and calls then read them by reference in one CASE per output.
- G9 / J4 / J5 / L7: needed tools (catalogue filtered by called names) plus
  distractors (catalogue minus those names), shuffled per row by hash.
- P14: training text with one ``<tool_call>`` block per call.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolframe.operators import synth_catalog as cat
from toolframe.operators.rank import unit_draw

PHRASE = "__phrase"  # the slot name of a phrase's draw
_PLACEHOLDER = re.compile(r"\{([a-z_]+)(?:\.([a-z_]+))?(?:\|(lower))?\}")


def _lit_array(values, dtype: str | None = None) -> Column:
    return F.array(*[F.lit(v) if v is not None else F.lit(None).cast(dtype or "string") for v in values])


@functools.lru_cache(maxsize=None)
def _pool_array(name: str, lo: int, hi: int | None) -> tuple[Column, int]:
    rows = cat.POOLS[name][lo:hi]
    fields = cat.POOL_FIELDS.get(name)
    if fields is None:
        return _lit_array(rows), len(rows)
    structs = [F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, row)]) for row in rows]
    return F.array(*structs), len(rows)


def _value_lit(v) -> Column:
    if isinstance(v, tuple):
        return F.array(*[F.lit(x) for x in v]).cast("array<string>")
    return F.lit(v)


def _choice_array(values: tuple) -> Column:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {tuple}:
        dt = "array<string>"
    elif kinds <= {int}:
        dt = "int"
    elif kinds <= {int, float}:
        dt = "double"
    else:
        dt = "string"
    return F.array(*[(_value_lit(v).cast(dt) if v is not None else F.lit(None).cast(dt)) for v in values])


def _refs(text: str) -> set[str]:
    return {m.group(1) for m in _PLACEHOLDER.finditer(text)}


def _deps(spec) -> set[str]:
    """Slots a slot rule reads."""
    if isinstance(spec, (cat.Coin, cat.NullIf, cat.Map, cat.ListOf)):
        return {spec.slot}
    if isinstance(spec, cat.Rounded):
        return {spec.conv}
    if isinstance(spec, cat.Other):
        return {spec.exclude}
    if isinstance(spec, cat.Fmt):
        return _refs(spec.template)
    if isinstance(spec, cat.FmtChoice):
        return set().union(*[_refs(t) for t in spec.templates])
    if isinstance(spec, cat.FmtPool):
        return set().union(*[_refs(x) for row in cat.POOLS[spec.name] for x in row])
    return set()


def _asked_often(spec) -> bool:
    """Does a slot rule read its draw in more than one place?"""
    return isinstance(spec, (cat.Other, cat.FmtChoice, cat.FmtPool))


def _draw_name(slot: str) -> str:
    return f"_u_{slot}"


def _shared_draws(row: Column, seed: int) -> dict[str, Column]:
    """Draws that are read in more than one place, as columns of all templates: taken once per row."""
    users = {PHRASE: {i for i, t in enumerate(cat.TEMPLATES) if len(t.phrases) > 1}}
    for i, t in enumerate(cat.TEMPLATES):
        for name, spec in t.slots.items():
            if _asked_often(spec):
                users.setdefault(name, set()).add(i)
    return {_draw_name(slot): F.when(F.col("template_idx").isin(sorted(of)), unit_draw(row, F.col("template"), F.lit(slot), seed=seed))
            for slot, of in users.items()}


class _Slots:
    """Slot columns of one template: staged as ``_s<idx>_<slot>`` columns, read by reference."""

    def __init__(self, t: cat.Template, idx: int, row: Column, seed: int):
        self.t, self.idx, self.row, self.seed = t, idx, row, seed

    def colname(self, name: str) -> str:
        return f"_s{self.idx}_{name}"

    def layers(self) -> list[dict[str, Column]]:
        """Slot expressions in dependency layers, each guarded by the template index."""
        done, out, todo = set(), [], dict(self.t.slots)
        while todo:
            ready = [n for n, sp in todo.items() if _deps(sp) <= done]
            if not ready:
                raise ValueError(f"cyclic slots in template {self.t.name}")
            out.append({self.colname(n): F.when(F.col("template_idx") == self.idx, self._build(n, todo[n]))
                        for n in ready})
            done |= set(ready)
            for n in ready:
                del todo[n]
        return out

    def u(self, slot: str, part: str = "") -> Column:
        if not part and slot in self.t.slots and _asked_often(self.t.slots[slot]):
            return F.col(_draw_name(slot))
        return unit_draw(self.row, F.lit(self.t.name), F.lit(slot + part), seed=self.seed)

    def pick(self, arr: Column, n: int, slot: str, part: str = "") -> Column:
        return F.element_at(arr, (F.floor(self.u(slot, part) * n) + 1).cast("int"))

    def pick_lazy(self, options: list[Column], slot: str) -> Column:
        """Choose one of ``options`` by a uniform draw; only the chosen one is evaluated."""
        if len(options) == 1:
            return options[0]
        k = F.floor(F.col(_draw_name(slot)) * len(options))
        out = F.when(k == 0, options[0])
        for i, o in enumerate(options[1:], start=1):
            out = out.when(k == i, o)
        return out

    def get(self, name: str) -> Column:
        return F.col(self.colname(name))

    def field(self, name: str, fld: str | None) -> Column:
        c = self.get(name)
        return c[fld] if fld else c

    def _build(self, name: str, spec) -> Column:
        if isinstance(spec, cat.Pool):
            arr, n = _pool_array(spec.name, spec.lo, spec.hi)
            return self.pick(arr, n, name)
        if isinstance(spec, cat.Pair):
            arr, n = _pool_array(spec.name, spec.lo, spec.hi)
            i = F.floor(self.u(name, ":1") * n)
            j = F.pmod(i + 1 + F.floor(self.u(name, ":2") * (n - 1)), F.lit(n))
            return F.struct(F.element_at(arr, (i + 1).cast("int")).alias("first"),
                            F.element_at(arr, (j + 1).cast("int")).alias("second"))
        if isinstance(spec, cat.Other):
            arr, n = _pool_array(spec.name, spec.lo, spec.hi)
            pos = F.array_position(arr, self.get(spec.exclude))  # 1-based, 0 when absent
            k = F.floor(self.u(name) * F.when(pos > 0, n - 1).otherwise(n)) + 1
            return F.element_at(arr, F.when((pos > 0) & (k >= pos), k + 1).otherwise(k).cast("int"))
        if isinstance(spec, cat.Choice):
            return self.pick(_choice_array(spec.values), len(spec.values), name)
        if isinstance(spec, cat.Int):
            return (F.floor(self.u(name) * (spec.hi - spec.lo + 1)) + spec.lo).cast("int")
        if isinstance(spec, cat.Rounded):
            conv = self.get(spec.conv)
            raw = (conv["lo"] + self.u(name) * (conv["hi"] - conv["lo"])).cast("double")
            digits = sorted({row[4] for row in cat.POOLS["units"]})
            out = None
            for d in digits:  # round() needs a literal scale: one branch per scale in the pool
                out = F.when(conv["digits"] == d, F.round(raw, d)) if out is None \
                    else out.when(conv["digits"] == d, F.round(raw, d))
            return out.cast("double")
        if isinstance(spec, cat.Coin):
            return F.when(self.u(name) > spec.p, self.get(spec.slot))
        if isinstance(spec, cat.NullIf):
            v = self.get(spec.slot)
            return F.when(v != F.lit(spec.value), v)
        if isinstance(spec, cat.Map):
            m = F.create_map(*[F.lit(x) for kv in spec.mapping for x in kv])
            return m[self.get(spec.slot)]
        if isinstance(spec, cat.Fmt):
            text = self.render(spec.template)
            return F.coalesce(text, F.lit("")) if spec.optional else text
        if isinstance(spec, cat.FmtChoice):
            return self.pick_lazy([self.render(t) for t in spec.templates], name)
        if isinstance(spec, cat.FmtPool):
            rows = cat.POOLS[spec.name]
            fields = cat.POOL_FIELDS[spec.name]
            return self.pick_lazy([F.struct(*[self.render(r[k]).alias(f) for k, f in enumerate(fields)])
                                   for r in rows], name)
        if isinstance(spec, cat.ListOf):
            return F.array(self.get(spec.slot))
        if isinstance(spec, cat.Const):
            return F.lit(spec.value)
        raise TypeError(f"unknown slot rule {spec!r}")

    def render(self, template: str) -> Column:
        """Text with ``{slot}``, ``{slot.field}``, ``{slot|lower}`` placeholders filled."""
        parts, pos = [], 0
        for m in _PLACEHOLDER.finditer(template):
            if m.start() > pos:
                parts.append(F.lit(template[pos:m.start()]))
            v = self.field(m.group(1), m.group(2)).cast("string")
            parts.append(F.lower(v) if m.group(3) else v)
            pos = m.end()
        if pos < len(template):
            parts.append(F.lit(template[pos:]))
        return F.concat(*parts) if len(parts) > 1 else (parts[0] if parts else F.lit(""))

    def value(self, spec) -> Column:
        """Argument value: a lone placeholder keeps the slot's type; other text is formatted."""
        if isinstance(spec, str):
            m = _PLACEHOLDER.fullmatch(spec)
            if m and not m.group(3):
                return self.field(m.group(1), m.group(2))
            return self.render(spec)
        return F.lit(spec)


def _template_columns(t: cat.Template, idx: int, row: Column, seed: int) -> dict[str, Column]:
    s = _Slots(t, idx, row, seed)
    instruction = s.pick_lazy([s.render(p) for p in t.phrases], PHRASE)
    calls = [F.to_json(F.struct(F.lit(tool).alias("name"),
                                F.struct(*[s.value(v).alias(k) for k, v in args]).alias("arguments")))
             for tool, args in t.calls]
    return {"instruction": instruction, "call_json": F.array(*calls),
            "call_names": F.array(*[F.lit(tool) for tool, _ in t.calls])}


def template_table(spark, templates=cat.TEMPLATES) -> DataFrame:
    """G2 parameter table: ``(template_idx, template, category, num_steps, weight, lo, hi)``."""
    total = sum(t.weight for t in templates)
    rows, acc = [], 0
    for i, t in enumerate(templates):
        rows.append((i, t.name, t.category, len(t.calls), t.weight, acc / total, (acc + t.weight) / total))
        acc += t.weight
    return spark.createDataFrame(rows, "template_idx int, template string, category string, num_steps int, "
                                       "weight int, lo double, hi double")


def choose_templates(base: DataFrame, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Weighted template choice as a broadcast range join (``lo <= u < hi``)."""
    tt = template_table(base.sparkSession)
    u = unit_draw(F.col(row_id), F.lit("template"), seed=seed)
    drawn = base.select(F.col(row_id).alias("row_id"), u.alias("_u"))
    return drawn.join(F.broadcast(tt), (F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi")), "inner") \
        .drop("lo", "hi", "weight")


@functools.lru_cache(maxsize=8)
def _generation_plan(seed: int):
    """(shared draws and slot layers across templates, CASE columns for instruction / calls / names)."""
    row = F.col("row_id")
    slots = [_Slots(t, i, row, seed) for i, t in enumerate(cat.TEMPLATES)]
    per_layer: list[dict[str, Column]] = []
    for sl in slots:
        for depth, layer in enumerate(sl.layers()):
            while len(per_layer) <= depth:
                per_layer.append({})
            per_layer[depth].update(layer)
    per = [_template_columns(t, i, row, seed) for i, t in enumerate(cat.TEMPLATES)]
    case = {}
    for key in ("instruction", "call_json", "call_names"):
        expr = None
        for i, cols in enumerate(per):
            expr = F.when(F.col("template_idx") == i, cols[key]) if expr is None \
                else expr.when(F.col("template_idx") == i, cols[key])
        case[key] = expr
    return [_shared_draws(row, seed), *per_layer], case


@functools.lru_cache(maxsize=1)
def _catalogue() -> tuple[Column, Column, Column]:
    """(tool names, definition by name as constant VARIANTs, the same as JSON text); parsed and printed once at planning."""
    defs = [F.parse_json(F.lit(t)) for t in cat.TOOLS_JSON]
    names = [F.lit(n) for n in _tool_names()]
    by_name = lambda values: F.create_map(*[x for pair in zip(names, values) for x in pair])
    return F.array(*names), by_name(defs), by_name([F.to_json(d) for d in defs])


def _tool_names() -> list[str]:
    import json
    return [json.loads(t)["name"] for t in cat.TOOLS_JSON]


def expose_tools(needed_names: Column, row: Column, seed: int, as_text: bool = False) -> Column:
    """G9 + J4 + J5 + L7: needed tools then distractors, shuffled per row (array<variant>, or the text ``to_json`` gives for it).

    The shuffle key is ``xxhash64(seed, row, tool)``, ties by name; the sort
    moves keys and names only, definitions are looked up behind it.
    """
    names, defs, texts = _catalogue()
    needed = F.array_intersect(names, needed_names)                                       # J4
    distractors = F.array_except(names, needed_names)                                     # J5
    keyed = F.transform(F.concat(needed, distractors),
                        lambda n: F.struct(F.xxhash64(F.lit(seed), row, n).alias("k"), n.alias("n")))
    ordered = F.sort_array(keyed)                                                           # L7
    if as_text:
        return F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: texts[x["n"]]), ","), F.lit("]"))
    return F.transform(ordered, lambda x: defs[x["n"]])


def generate(base: DataFrame, row_id: str = "row_id", seed: int = 42, as_text: bool = False) -> DataFrame:
    """G1: one generated example per input row.

    Columns: ``row_id, template, category, instruction, tools (array<variant>),
    tool_calls (array<variant>), num_steps, text``. ``as_text``: both arrays as
    the text that ``to_json`` gives for them, without printing the catalogue's
    definitions again for every row.
    """
    chosen = choose_templates(base, row_id, seed)
    layers, case = _generation_plan(seed)
    staged = chosen
    for layer in layers:   # each slot is drawn once per row, only for the row's own template
        staged = staged.withColumns(layer)
    staged = staged.select("row_id", "template", "template_idx", "category",
                           case["instruction"].alias("instruction"), case["call_json"].alias("_calls"),
                           case["call_names"].alias("_names"))
    blocks = F.array_join(F.transform("_calls", lambda j: F.concat(F.lit("<tool_call>\n"), j,
                                                                   F.lit("\n</tool_call>"))), "\n")
    text = F.concat(F.lit("["), F.col("category"), F.lit("] USER: "), F.col("instruction"),
                    F.lit("\nASSISTANT: "), blocks)                                          # P14
    calls = F.transform("_calls", lambda j: F.parse_json(j))
    return staged.select(
        "row_id", "template", "category", "instruction",
        expose_tools(F.col("_names"), F.col("row_id"), seed, as_text).alias("tools"),
        (F.to_json(calls) if as_text else calls).alias("tool_calls"),
        F.size("_calls").alias("num_steps"),
        text.alias("text"))


def undersample_majority_tool(df: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """X4 (extension): keep only ``ratio`` of the rows whose first call is the most frequent tool.

    The top tool comes from one aggregation (a scalar); the kept share is an
    md5 threshold, so no rank or shuffle is needed.
    """
    first = F.get_json_object(F.to_json(F.col("tool_calls")[0]), "$.name")
    most = df.groupBy(first.alias("t")).count().orderBy(F.desc("count"), "t").first()
    if most is None:  # no rows
        return df
    top = most["t"]
    u = unit_draw(F.col("row_id"), F.lit("undersample"), seed=seed)
    return df.filter((first != F.lit(top)) | (u < ratio))
