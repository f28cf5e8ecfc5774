"""Strict JSON on VARIANT, as native Catalyst expressions.

Spark's JSON readers accept trailing garbage (``{"a":1} x``) and do not tell
"one document" from "two documents". A candidate is therefore parsed as the
first of two array elements, the second being an end mark: a candidate that
closes the array itself (``{"a":1}] x``) loses the mark, two documents give
three elements, anything else that isn't one document makes the array invalid.
Single quotes and NaN are not JSON here. Of duplicate keys the last wins, once
``last_key_wins`` has set the session that way (registered queries and the
reward functions do).

Key presence is distinct from a JSON null value: ``try_variant_get(v,
'$.k', 'variant')`` is SQL NULL when the key is missing and a variant null
when the key holds ``null``.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

END_MARK = "end of candidate 6f1d0c"


def last_key_wins(spark: SparkSession) -> None:
    """Let VARIANT parsing accept duplicate keys and keep the last, as Python's ``json`` does."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parse_strict(s: Column) -> Column:
    """VARIANT of a string holding exactly one JSON document, else NULL."""
    return F.try_element_at(parse_strict_all(F.array(s)), F.lit(1))


def parse_strict_all(strings: Column) -> Column:
    """``array<string>`` -> ``array<variant>`` of the strictly valid entries.

    Each candidate is parsed once; invalid ones are dropped, order is kept.
    """
    wrapped = F.transform(strings, lambda s: F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), s, F.lit(f', "{END_MARK}"]'))), "$", "array<variant>"))
    single = F.filter(wrapped, lambda a: (F.size(a) == 2) & F.coalesce(
        F.try_variant_get(F.try_element_at(a, F.lit(2)), "$", "string") == END_MARK, F.lit(False)))
    return F.transform(single, lambda a: F.try_element_at(a, F.lit(1)))


def key(v: Column, name: str) -> Column:
    """Value under ``name`` if ``v`` is an object having that key, else NULL.

    A present key with JSON null yields a variant null (not SQL NULL).
    """
    return F.try_variant_get(v, f"$.{name}", "variant")


def has_key(v: Column, name: str) -> Column:
    """True iff ``v`` is a JSON object that has ``name`` (any value)."""
    return key(v, name).isNotNull()


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == F.lit("STRING"), F.lit(False))


def as_string(v: Column) -> Column:
    """String value of a JSON string, NULL for any other JSON type."""
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


def as_object(v: Column) -> Column:
    """``map<string, variant>`` if ``v`` is a JSON object, else NULL."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_array(v: Column) -> Column:
    """``array<variant>`` if ``v`` is a JSON array, else NULL."""
    return F.try_variant_get(v, "$", "array<variant>")


#: Any JSON text as strings, numbers and what stands between them. Possessive, so no text is scanned twice.
_TOKENS = r'"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'


def number_text(literal: Column) -> Column:
    """A number literal so that equal numbers of one kind have one text: integers of any length as they are, fractions as doubles."""
    return F.when(literal.rlike("[.eE]"), literal.cast("double").cast("string")).otherwise(F.when(literal == "-0", "0").otherwise(literal))


def tagged(text: Column) -> Column:
    """JSON text whose numbers are strings with a leading ``n`` and whose strings, names included, have a leading ``s``.

    Parsing that to VARIANT sorts keys, merges escapes and drops earlier
    duplicates, but leaves every number literal alone. Text that isn't JSON
    gives text that isn't either.
    """
    def one(t: Column) -> Column:
        return F.when(t.startswith('"'), F.concat(F.lit('"s'), F.substr(t, F.lit(2)))).when(
            t.rlike("^[0-9-]"), F.concat(F.lit('"n'), number_text(t), F.lit('"'))).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), 0), one), "")


def _untagged(text: Column) -> Column:
    """The JSON text of a tagged VARIANT: literals and strings without their tags."""
    def one(t: Column) -> Column:
        return F.when(t.startswith('"n'), F.substr(t, F.lit(3), F.length(t) - 3)).when(t.startswith('"s'), F.concat(F.lit('"'), F.substr(t, F.lit(3)))).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*+"|[^"]++'), 0), one), "")


def exact_json(text: Column) -> Column:
    """H8: strictly valid JSON as compact text with sorted keys, in which ``1`` and ``1.0`` stay apart at any depth; else NULL.

    Of duplicate keys the last stays. Keys are sorted as VARIANT sorts them.
    """
    return F.when(parse_strict(text).isNotNull(), _untagged(F.to_json(parse_strict(tagged(text)))))


def _python_double(number: Column) -> Column:
    """A double's text with a point or an exponent where Python's ``repr`` has them (the JVM writes exponents from 1e7 on and below 1e-3)."""
    sign = F.regexp_extract(number, "^-?", 0)
    digits = F.regexp_replace(F.concat(F.regexp_extract(number, r"^-?([0-9])\.", 1), F.regexp_replace(F.regexp_extract(number, r"\.([0-9]+)E", 1), "^0$", "")), "^$", "0")
    exponent = F.regexp_extract(number, "E(-?[0-9]+)$", 1).try_cast("int")
    whole = F.rpad(digits, F.greatest(F.length(digits), exponent + 1), "0")
    point = F.concat(F.substr(whole, F.lit(1), exponent + 1), F.lit("."), F.when(F.length(whole) > exponent + 1, F.substr(whole, exponent + 2)).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    power = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
                     F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), "0"))
    body = F.when(exponent >= 16, power).when(exponent >= 0, point).when(exponent >= -4, small).otherwise(power)
    return F.when(number.contains("E"), F.concat(sign, body)).otherwise(number)


def _escaped(text: Column) -> Column:
    """DEL and characters outside ASCII as ``\\uXXXX``, beyond the first plane as two of them."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))))
        return F.when(n < 127, c).when(n < 0x10000, unit(n)).otherwise(pair)
    return F.when((F.octet_length(text) == F.char_length(text)) & ~text.contains("\x7f"), text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def python_json(text: Column, ascii_only: bool = True) -> Column:
    """``exact_json`` as Python's ``json.dumps(value, sort_keys=True)`` spaces and writes it.

    Blanks behind commas and colons, fractions as ``repr`` writes them and,
    unless ``ascii_only`` is off, escapes outside ASCII. Shortest digits are the
    JVM's, which differ from Python's for a few doubles.
    """
    def one(t: Column) -> Column:
        number = F.when(t.rlike("[.E]"), _python_double(t)).otherwise(t)
        between = F.regexp_replace(t, "([,:])", "$1 ")
        return F.when(t.startswith('"'), _escaped(t) if ascii_only else t).when(t.rlike("^[0-9-]"), number).otherwise(between)
    return F.array_join(F.transform(F.regexp_extract_all(exact_json(text), F.lit(_TOKENS), 0), one), "")


def _inexact(kind: Column) -> Column:
    """Does a value of this schema need its JSON text to be told from others? Fractions inside a nested value, numbers that VARIANT rounds."""
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return kind.rlike("DOUBLE|FLOAT") | (nested & kind.rlike("DECIMAL"))


def value_text(v: Column) -> Column:
    """Text of a JSON value in which ``1.0`` differs from ``1``, as in its JSON text.

    VARIANT prints both as ``1``: a number with a fraction part is printed as a
    double. Integers beyond 64 bits stay integers. Inside arrays and objects
    VARIANT can't tell them apart any more: ``kv_pairs`` takes those values from
    the text itself.
    """
    kind, text = F.schema_of_variant(v), F.to_json(v)
    big = F.coalesce(F.regexp_extract(kind, r"^DECIMAL\((\d+),0\)$", 1).try_cast("int") >= 19, F.lit(False))
    number = (kind.startswith("DECIMAL") & ~big) | kind.isin("DOUBLE", "FLOAT")
    return F.when(number, F.try_variant_get(v, "$", "double").cast("string")).otherwise(text)


def kv_pairs(obj_map: Column, exact: Column | None = None) -> Column:
    """Object as a ``key=text of value`` string array (order unspecified).

    exact: the same object parsed from ``tagged`` text; read where a value's
    VARIANT form is not enough (see ``_inexact``).
    """
    quick = F.transform(F.map_entries(obj_map), lambda e: F.concat(e["key"], F.lit("="), value_text(e["value"])))
    if exact is None:
        return quick
    slow = F.transform(F.map_entries(exact), lambda e: F.concat(F.substr(e["key"], F.lit(2)), F.lit("="), _untagged(F.to_json(e["value"]))))
    needed = F.exists(F.map_values(obj_map), lambda v: _inexact(F.schema_of_variant(v)))
    return F.when(needed, slow).otherwise(quick)


def call_arguments(call: Column) -> Column:
    """``arguments`` if the key exists, else ``parameters`` if it exists, else NULL.

    NULL means "neither key": callers treat it as the empty object ``{}``.
    """
    return F.coalesce(key(call, "arguments"), key(call, "parameters"))


def lenient(c: Column) -> Column:
    """Lenient JSON cell (P18): blank -> NULL, valid -> parsed, invalid -> the string.

    The invalid case is returned as a VARIANT string so the column has one type.
    """
    from toolframe.functions.text import py_strip
    t = py_strip(c)  # Python str.strip(): the full whitespace set, not only spaces
    as_variant_string = F.try_variant_get(F.try_parse_json(F.to_json(F.array(t))), "$[0]", "variant")
    return (F.when(c.isNull() | (t == F.lit("")), F.lit(None).cast("variant"))
            .otherwise(F.coalesce(parse_strict(t), as_variant_string)))
