"""The corpus pipeline: language ID, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes what a stage returns to
the shared folder as Parquet and gives the next stage what it reads there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolframe.llm import langid, linededup, minhash, packing, pii
from toolframe.llm.common import written
from toolframe.llm.queries import tokenizer

ROW = "__near_dedup_row"  # beside the columns of documents


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The same columns, n_chars taken anew from the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in columns])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles learned from all labelled documents; texts without a letter, or less like every language than their length lets expect, go."""
    return langid.known(docs, langid.train(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows go; a document that was nothing but copies stays with an empty text."""
    return _counted(linededup.dedup_lines(docs), docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, at a similarity of 0.8 as for any stage on shingles: that with the smallest doc_id (null last), then row.

    Rows are told apart by a number of their own, written with them, so equal
    and missing doc_ids join nothing and lose nothing.
    """
    numbered = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    groups = minhash.near_duplicates(numbered.select(F.col(ROW).alias("doc_id"), "text"), threshold=0.8, close=0.42)
    named = numbered.select(ROW, "doc_id").join(groups.select(F.col("doc_id").alias(ROW), "component_id"), ROW)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return numbered.join(first, ROW, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the rules or the classifier find becomes its kind in brackets."""
    return _counted(pii.redact(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids along the Hilbert curve."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), length=2048)


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_each),
    ("PII", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the first, third, fourth and last stage; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
