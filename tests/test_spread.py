import glob

from pyspark.sql import functions as F

from toolframe.plans import catalog
from toolframe.session import TASKS_PER_CORE, checkpoint_dir, spread


def test_few_splits_are_dealt_over_all_cores(spark):
    df = spark.range(1000, numPartitions=2)
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert spread(df).select(F.spark_partition_id().alias("p")).distinct().count() == tasks and spread(df).count() == 1000
    wide = spark.range(1000, numPartitions=tasks)
    assert spread(wide) is wide


def test_a_corpus_has_more_files_the_more_rows_it_has(spark, tmp_dir, monkeypatch):
    spark.range(200).selectExpr("id AS doc_id", "'text ' || id AS text").write.parquet(f"{tmp_dir}/documents.parquet")
    monkeypatch.setattr(catalog, "_MANIFEST_ROWS", 20)
    old = set(glob.glob(f"{checkpoint_dir(spark)}/manifest-*"))
    assert tuple(catalog.k07(spark, tmp_dir).first()) == (200, True, True)
    new, = set(glob.glob(f"{checkpoint_dir(spark)}/manifest-*")) - old
    assert len(glob.glob(f"{new}/*.json")) == 10
