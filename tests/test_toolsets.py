import collections

import pytest
from pyspark.sql import functions as F

from toolframe.operators import toolsets


def catalogue(spark, n=25):
    return spark.createDataFrame([(f"t{i}", f'{{"i": {i}}}') for i in range(n)], "name string, definition string")


def test_tools_missing_and_empty(spark):
    ex = spark.createDataFrame([(1, ["t3", "t9", "none"]), (2, None), (3, []), (4, ["t0", "t0"])], "row_id long, needed array<string>")
    full = {r.row_id: r for r in toolsets.expose_tools(ex, catalogue(spark)).collect()}
    assert all(sorted(t.name for t in r.tools) == sorted(f"t{i}" for i in range(25)) for r in full.values())
    assert full[1].missing == ["none"] and full[2].missing == [] and [t.name for t in full[1].tools] != [t.name for t in full[3].tools]
    some = {r.row_id: [t.name for t in r.tools] for r in toolsets.expose_tools(ex, catalogue(spark), distractors=4).collect()}
    assert len(some[1]) == 6 and {"t3", "t9"} <= set(some[1]) and len(some[2]) == 4 and len(some[4]) == 5
    assert some[2] == [n for n in (t.name for t in full[2].tools) if n in some[2]]  # the order stays
    assert {k: len(v) for k, v in ((r.row_id, r.tools) for r in toolsets.expose_tools(ex, catalogue(spark), distractors=0).collect())} == {1: 2, 2: 0, 3: 0, 4: 1}
    with pytest.raises(ValueError):
        toolsets.expose_tools(ex, catalogue(spark).unionByName(catalogue(spark, 1)))


def test_bounds_raise(spark, monkeypatch):
    monkeypatch.setattr(toolsets, "MAX_TOOLS", 3)
    monkeypatch.setattr(toolsets, "MAX_CHOICES", 3)
    with pytest.raises(ValueError):
        toolsets.expose_tools(spark.range(1).selectExpr("id AS row_id", "array('a') AS needed"), catalogue(spark))
    with pytest.raises(ValueError):
        toolsets.weighted_choice(spark.range(1), catalogue(spark).withColumn("weight", F.lit(1)), key="id")


def test_shares_follow_weights(spark):
    weights = spark.createDataFrame([("a", 1), ("b", 0), ("c", 3), (None, 5), ("d", -2), ("e", 6)], "name string, weight int")
    got = collections.Counter(r.choice for r in toolsets.weighted_choice(spark.range(20_000), weights, key="id").collect())
    assert set(got) == {"a", "c", "e"} and all(abs(got[n] / 20_000 - w / 10) < 0.015 for n, w in (("a", 1), ("c", 3), ("e", 6)))
    same = toolsets.weighted_choice(spark.range(50).repartition(7), weights, key="id").exceptAll(toolsets.weighted_choice(spark.range(50), weights, key="id"))
    assert same.count() == 0
    assert toolsets.weighted_choice(spark.range(3), weights.where("false"), key="id").where("choice is null").count() == 3
    assert {r.choice for r in toolsets.weighted_choice(spark.range(9), weights.where("name = 'a'"), key="id").collect()} == {"a"}


def test_texts_and_draws(spark):
    df = spark.createDataFrame([("c", "do", ["{1}", None, "{2}"]), (None, None, None)], "c string, i string, k array<string>")
    assert [r[0] for r in df.select(toolsets.training_text(F.col("c"), F.col("i"), F.col("k"))).collect()] == [
        "[c] USER: do\nASSISTANT: <tool_call>\n{1}\n</tool_call>\n<tool_call>\n{2}\n</tool_call>", "[] USER: \nASSISTANT: "]
    rows = spark.range(500).select(toolsets.rounded_draw(F.lit(2.0), F.lit(5.0), 1, F.col("id")).alias("x")).collect()
    assert all(2 <= r.x <= 5 and round(r.x, 1) == r.x for r in rows) and len({r.x for r in rows}) > 25
    assert spark.range(1).select(toolsets.local_time(F.lit("2024-05-01"), F.lit("09:30"))).first()[0] == "2024-05-01T09:30:00"
