"""JSON lines whose keys nobody listed.

A line is parsed to VARIANT. The schema is an aggregate over all lines: every
top-level key with its merged type, its rows and where it was first seen, one
row per key, combined on the map side. Columns are made from that table, so
two scans read the lines and nothing but key names and types reaches the
driver; their number is bounded by MAX_KEYS (a table needs a column for each).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolframe.functions import jsonx
from toolframe.functions.text import py_strip

MAX_KEYS = 10_000


def parse_documents(lines: DataFrame, text: str) -> DataFrame:
    """The other columns of ``lines``, ``doc`` (map of key to VARIANT) and ``_corrupt_record``.

    Blank lines give no row. A line that isn't exactly one JSON object keeps
    its text in ``_corrupt_record`` and has a null doc. Of duplicate keys the
    last wins.
    """
    jsonx.last_key_wins(lines.sparkSession)
    line = py_strip(F.col(text))
    parsed = lines.where(line != "").withColumn("doc", jsonx.as_object(jsonx.parse_strict(line)))
    return parsed.select(*[c for c in lines.columns if c != text], "doc", F.when(F.col("doc").isNull(), F.col(text)).alias("_corrupt_record"))


def schema_of(documents: DataFrame, order: str | None = None) -> DataFrame:
    """(key, type, n_rows, first_seen): the union of all documents' keys (U4) with the type that holds all of a key's values.

    Types are Spark's: integers and fractions merge to a fraction, objects to a
    struct with the keys of all, arrays by their elements, anything else that
    differs to VARIANT; a key with nulls only is VOID. n_rows counts documents
    that have the key, nulls included. first_seen: the smallest ``order`` of
    those (null without one).
    """
    seen = F.min(order) if order else F.lit(None).cast("long")
    own = documents.select(*([order] if order else []), F.explode("doc").alias("key", "value"))
    return (own.groupBy("key").agg(F.schema_of_variant_agg("value").alias("type"), F.count(F.lit(1)).alias("n_rows"), seen.alias("first_seen"))
               .withColumn("type", _struct_type(F.col("type"))))


def _struct_type(kind: Column) -> Column:
    """A VARIANT's schema as a column type: objects become structs, quoted names stay."""
    parts = F.regexp_extract_all(kind, F.lit(r"`(?:[^`]|``)*+`|[^`]++"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("`"), p).otherwise(F.regexp_replace(p, r"\bOBJECT<", "STRUCT<"))), "")


def _collected(schema: DataFrame) -> list[tuple[str, str]]:
    keys = [(r["key"], r["type"]) for r in schema.select("key", "type").limit(MAX_KEYS + 1).collect()]
    if len(keys) > MAX_KEYS:
        raise ValueError(f"over {MAX_KEYS} different keys: not a table, keep the documents as they are")
    return sorted(keys)


def _read(value: Column, kind: str) -> Column:
    """A VARIANT as a value of a merged type; VOID reads as a null string."""
    if kind == "VARIANT" or re.search(r"<>|\bVOID\b", kind):
        return F.lit(None).cast("string") if kind == "VOID" else value
    return F.try_variant_get(value, "$", kind)


def columns_of(documents: DataFrame, schema: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A typed column per key, sorted by name, after the kept columns. A key that a document lacks is null.

    Values nested in types without a column form (empty objects, arrays of
    nulls only, mixed kinds) stay VARIANT. Keys that differ in case alone need
    ``spark.sql.caseSensitive``.
    """
    return documents.select(*keep, *[_read(F.element_at("doc", F.lit(k)), t).alias(k) for k, t in _collected(schema)])


def flat_columns_of(documents: DataFrame, schema: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A string column per key, sorted by name: nested values as JSON text, nulls and gaps as ``""``."""
    def text(k: str) -> Column:
        value = F.element_at("doc", F.lit(k))
        return F.coalesce(F.when(jsonx.is_string(value), jsonx.as_string(value)).when(F.is_variant_null(value), F.lit("")).otherwise(jsonx.value_text(value)), F.lit(""))
    return documents.select(*keep, *[text(k).alias(k) for k, _ in _collected(schema)])


def read_open_jsonl(spark: SparkSession, path: str, flat: bool = False) -> DataFrame:
    """S1 with S4's union of keys: a file or a directory of ``*.jsonl`` / ``*.json`` files, every key a column, and ``_corrupt_record``.

    Blank lines are skipped; a missing path and an input without rows raise, as in ``read_jsonl``.
    """
    from toolframe.sources import readers
    documents = parse_documents(readers.read_lines(spark, path), "value")
    if not documents.take(1):
        raise ValueError(f"{path} holds no rows")
    make = flat_columns_of if flat else columns_of
    return make(documents, schema_of(documents), keep=("_corrupt_record",))
