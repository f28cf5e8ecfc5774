import os
import random
import re

import pytest
from pyspark.sql import functions as F

from toolframe.operators import containment, history


def run(spark, path, rows, number, buckets=8):
    df = spark.createDataFrame(rows, "row_id long, text string")
    return {r.row_id for r in history.dedup_against(df, F.col("text"), history.KeyHistory(spark, path, buckets), number).collect()}


def test_runs_over_parts_equal_one_run(spark, tmp_dir):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a", "b", None, *map(str, range(150))])) for i in range(400)]
    first, second = rows[:200], rows[150:]  # half of the second is old
    path = os.path.join(tmp_dir, "h")
    got = run(spark, path, first, 1) | run(spark, path, second, 2, buckets=3)
    assert got == run(spark, os.path.join(tmp_dir, "all"), rows, 1)
    assert run(spark, path, second, 3) == set()
    assert history.KeyHistory(spark, path, 3).buckets == 8


def test_a_run_can_be_repeated(spark, tmp_dir):
    path = os.path.join(tmp_dir, "h")
    run(spark, path, [(1, "a")], 1)
    assert run(spark, path, [(2, "a"), (3, "b"), (4, "b")], 2) == {3} == run(spark, path, [(2, "a"), (3, "b"), (4, "b")], 2)


def test_the_stored_side_is_not_shuffled(spark, tmp_dir):
    seen = history.KeyHistory(spark, os.path.join(tmp_dir, "h"), 8)
    seen.add(spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k")), 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = seen.unseen(spark.range(1500).select(F.md5(F.col("id").cast("string")).alias("k")), 2)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert fresh.count() == 500 and plan.count("Exchange") == 1 and re.search(r"Bucketed: true", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("small", [200_000, 0])
def test_contained_passages_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(containment, "SMALL", small)
    rnd = random.Random(3)
    say = lambda k: [rnd.choice([f"w{j}" for j in range(40)]) for _ in range(k)]
    items = [(i, " ".join(say(rnd.randint(1, 40)))) for i in range(30)] + [(90, None), (91, "  "), (92, "Two\nwords")]
    texts = []
    for i in range(80):
        w = (rnd.choice(items)[1] or "").split()
        if w and rnd.random() < 0.5:
            w[rnd.randrange(len(w))] = "changed"
        texts.append((i, rnd.choice([" ", "\n"]).join(say(rnd.randint(0, 50)) + w + say(rnd.randint(0, 50))).upper()))
    texts += [(200, None), (201, ""), (202, "two WORDS"), (202 + 1, "x " * 20_000 + "two words")]
    grams = lambda w, n: {" ".join(w[i: i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for i, t in items:
        w = (t or "").lower().split()
        own = grams(w, min(5, len(w))) if w else set()
        for d, x in texts:
            both = len(own & grams((x or "").lower().split(), min(5, len(w)))) if own else 0
            if own and both >= 0.8 * len(own):
                want.add((i, d, len(own), both))
    got = containment.contained_passages(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert {tuple(r)[:4] for r in got.collect()} == want and len(want) > 20
    assert containment.contained_passages(spark.createDataFrame(items, "item_id long, text string").where("false"), spark.createDataFrame(texts, "doc_id long, text string")).count() == 0
