"""Session construction and cluster-wide settings.

On a cluster the session already exists and carries its own configuration;
``build_session`` only fills in defaults that are unset, so cluster settings
(shuffle partitions, checkpoint directory, AQE knobs) always win.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Defaults tuned for correctness-first local runs; every one is overridable.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


TASKS_PER_CORE = 3  # dealt by ``spread`` where nothing else is set


def build_session(master: str | None = None, app: str = "toolframe",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session or build one with safe defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared directory for lineage cuts, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a private scratch directory (as in
    tests); on a cluster that would be a folder other machines don't see, so it
    raises.
    """
    value = spark.conf.get("spark.checkpoint.dir", None)
    if not value:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        value = tempfile.mkdtemp(prefix="toolframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", value)
    spark.sparkContext.setCheckpointDir(value)
    return value


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared directory; two runs never share one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared directory: computed once, lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``written`` and the number of its rows, counted by the write itself: no job of its own."""
    seen, path = Observation(), scratch_path(df.sparkSession, name)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def spread(df: DataFrame) -> DataFrame:
    """df dealt over as many tasks as the caller sets in ``toolframe.spread``; where that is unset, over several per core if the input has fewer splits.

    For CPU-heavy row-local work: a file with few row groups leaves most of its
    splits empty, however many there are.
    """
    spark = df.sparkSession
    n = spark.conf.get("toolframe.spread", None)
    if n:
        return df.repartition(int(n))
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return df.repartition(tasks) if not df.isStreaming and df.rdd.getNumPartitions() < tasks else df
