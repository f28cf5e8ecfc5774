import pytest
from pyspark.sql import functions as F

from toolframe.functions import permute
from toolframe.operators import prep


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1023, 4099])
def test_every_seed_permutes(spark, n):
    rows = spark.range(n).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(4))))
    got = rows.select("id", "seed", permute.permuted(F.col("id"), n, F.col("seed")).alias("p")).toPandas()
    orders = set()
    for _, part in got.groupby("seed"):
        assert sorted(part["p"]) == list(range(n))
        orders.add(tuple(part.sort_values("p")["id"]))
    assert n < 16 or len(orders) == 5


def test_the_order_is_spread(spark):
    """Neighbours don't stay neighbours, and every tenth of the places draws from every tenth of the rows."""
    n = 10_000
    got = spark.range(n).select("id", permute.permuted(F.col("id"), n).alias("p")).toPandas().sort_values("id")
    assert (got["p"].diff().abs() == 1).sum() < 20
    table = got.groupby([got["id"] // 1000, got["p"] // 1000]).size()
    assert len(table) == 100 and table.min() > 60 and table.max() < 145


def test_numbers_outside_raise_and_nulls_stay(spark):
    assert spark.range(1).select(permute.permuted(F.lit(None).cast("long"), 5)).first()[0] is None
    with pytest.raises(Exception, match="no row number below 5"):
        spark.range(1).select(permute.permuted(F.lit(5), 5)).collect()


def test_rows_are_numbered_where_they_are(spark):
    df = spark.range(1000).repartition(7).withColumn("text", F.lit("x"))
    numbered, n = permute.number_rows(df)
    assert n == 1000 and sorted(r["index"] for r in numbered.collect()) == list(range(1000))
    assert permute.number_rows(df.where("false"))[1] == 0


def test_batches_without_a_shuffle(spark):
    df = spark.range(103).selectExpr("id AS row_id", "repeat('text', 50) AS text").repartition(5)
    out = prep.epoch_batches(df, 3, 10)
    got = out.select("epoch", "batch_idx", "global_step", "row_id").toPandas()
    assert len(got) == 309 and got["global_step"].max() == 33
    for _, e in got.groupby("epoch"):
        sizes = e.groupby("batch_idx").size()
        assert sorted(e["row_id"]) == list(range(103)) and list(sizes) == [10] * 10 + [3]
    assert got[got.epoch == 0].sort_values("global_step")["row_id"].tolist() != got[got.epoch == 1].sort_values("global_step")["row_id"].tolist()
    plan = prep.epoch_batches(df.select("row_id", "text"), 2, 10, index="row_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Sort" not in plan
    assert prep.epoch_batches(df.where("false"), 2, 10).count() == 0
