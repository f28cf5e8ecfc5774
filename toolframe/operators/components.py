"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolframe.session import written


EDGES = 1 << 16  # of a step's edges for each task, once there are more than the cores need


def _star(edges: DataFrame, both: bool, tasks: int) -> DataFrame:
    """Link neighbours to the smallest one: of all neighbours above a node (large star), or of those below it and itself (small star).

    Works in at most ``tasks`` tasks behind each shuffle, however many partitions that has.
    """
    if both:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = edges.join(least.hint("shuffle_merge"), "u")
    if both:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
    own = least.select("u", F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of the edges with the smallest node it reaches.

    Each step writes its edges to the shared folder. Nodes and edges never
    leave the cluster; the driver sees one checksum per step. Its tasks follow
    the number of edges, not that of the shuffle's partitions: the steps of a
    small graph would else do little but start tasks and write empty files.
    Loops from a node to itself are ignored; no edges give no rows.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, tasks = mark, max(cores, mark[0] // EDGES)
        now = written(_star(_star(now, True, tasks), False, tasks), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
