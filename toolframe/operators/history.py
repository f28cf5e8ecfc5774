"""A1 against history: rows whose key no earlier run has seen.

Keys of earlier runs live in a bucketed, sorted table that grows by appends.
A run deals its own slim keys into the same buckets and joins bucket by
bucket: the stored side is read where it lies and never shuffled, whatever it
has grown to. Rows of texts don't move at all; they are semi-joined to the
keys that are new.

A run has a number. Keys that the same run has stored before (it crashed
behind that and starts again) don't count as seen, so a run can be repeated.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolframe.session import written
from toolframe.sources import versions


class KeyHistory:
    """The keys of all runs, in ``buckets`` buckets below ``path`` (shared by all machines). The first to open a path fixes the buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        meta = f"{self.path}/buckets.json"
        versions._claim(spark, meta, json.dumps({"buckets": buckets}))
        self.buckets = json.loads(versions._read_text(spark, meta))["buckets"]
        self.name = f"key_history_{hashlib.md5(self.path.encode()).hexdigest()}"
        place = f"{self.path}/keys".replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (k STRING, run BIGINT) USING parquet CLUSTERED BY (k) SORTED BY (k) INTO {self.buckets} BUCKETS LOCATION '{place}'")

    def keys(self, before: int | None = None) -> DataFrame:
        """The stored keys; of all runs but the one given."""
        spark = self.spark
        spark.catalog.refreshTable(self.name)
        return spark.table(self.name) if before is None else spark.table(self.name).where(F.col("run") != before)

    def unseen(self, keys: DataFrame, run: int) -> DataFrame:
        """keys (column ``k``, ...) that no other run has stored: dealt into the buckets, the stored side is not."""
        return keys.repartition(self.buckets, "k").join(self.keys(run).select("k"), "k", "left_anti")

    def add(self, keys: DataFrame, run: int) -> None:
        slim = keys.select("k", F.lit(run).cast("long").alias("run")).repartition(self.buckets, "k")
        slim.write.mode("append").format("parquet").bucketBy(self.buckets, "k").sortBy("k").saveAsTable(self.name)


def dedup_against(df: DataFrame, key: Column, history: KeyHistory, run: int, order: str = "row_id") -> DataFrame:
    """The first row (lowest ``order``, unique and not null) of every key that no earlier run has; the keys are stored.

    Runs over parts of a table, one after another, keep together what one run
    over all keeps: a row per key. Null keys are one key.
    """
    slim = df.select(F.coalesce(key.cast("string"), F.lit("\0null")).alias("k"), F.col(order).alias("_o")).groupBy("k").agg(F.min("_o").alias("_o"))
    fresh = written(history.unseen(slim, run), "fresh-keys")
    history.add(fresh, run)
    return df.join(fresh.select("_o"), F.col(order) == F.col("_o"), "left_semi")
