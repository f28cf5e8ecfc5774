from pyspark.sql import functions as F

from toolframe.functions import permute
from toolframe.operators import prep
from toolframe.session import written_counted


def jobs(spark, name, work):
    """How many Spark jobs a piece of work starts."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    out = work()
    found = len(sc.statusTracker().getJobIdsForGroup(name))
    sc.setLocalProperty("spark.jobGroup.id", None)
    return out, found


def test_the_write_counts(spark):
    (df, n), found = jobs(spark, "write", lambda: written_counted(spark.range(1000).repartition(3), "t"))
    assert n == 1000 == df.count() and written_counted(spark.range(0), "t")[1] == 0
    _, plain = jobs(spark, "plain", lambda: spark.range(1000).repartition(3).write.format("noop").mode("overwrite").save())
    assert found <= plain + 1


def test_numbers_and_splits_count_nothing_after_the_write(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id").withColumn("text", F.lit("x")).repartition(4)
    _, writing = jobs(spark, "number-write", lambda: written_counted(df, "t"))
    (_, n), numbering = jobs(spark, "number", lambda: permute.number_rows(df))
    assert n == 500 and numbering == writing
    rows, n = written_counted(df, "rows")
    out, given = jobs(spark, "given", lambda: prep.split_exact(rows, n=n))
    _, asked = jobs(spark, "asked", lambda: prep.split_exact(rows))
    assert given < asked and {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 400, "validation": 50, "test": 50}
