import random

import pandas as pd

from toolframe.operators import rollouts
from toolframe.streaming import groups

SCHEMA = "step int, slot int, sample_id int, reward double, ts timestamp"


def feed(spark, base, rows, minute=0):
    df = spark.createDataFrame([(*r, minute) for r in rows], "step int, slot int, sample_id int, reward double, m int")
    df.selectExpr("step", "slot", "sample_id", "reward", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, m, 0) as ts").coalesce(1).write.mode("append").parquet(f"{base}/in")


def run(spark, base, size):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return groups.run_available(groups.stream_advantages(stream, size), f"{base}/out", f"{base}/check")


def test_stream_equals_batch_over_many_triggers(spark, tmp_dir):
    rnd = random.Random(1)
    rows = [(s, t, i, float(rnd.choice([0, 0.25, 1]) if t else 0.5)) for s in range(4) for t in range(5) for i in range(4)]
    rnd.shuffle(rows)
    for at in range(0, len(rows), 30):
        feed(spark, tmp_dir, rows[at: at + 30] + rows[max(0, at - 5): at])  # some redelivered
    got = run(spark, tmp_dir, 4).where("complete and not late")
    want = rollouts.group_advantages(spark.createDataFrame(rows, "step int, slot int, sample_id int, reward double"))
    pick = lambda df: sorted((r.step, r.slot, r.sample_id, round(r.advantage, 9), round(r.group_mean, 9), r.degenerate, r.group_size) for r in df.collect())
    assert pick(got) == pick(want) and got.where("degenerate").count() >= 16


def test_incomplete_groups_leave_and_late_samples_are_flagged(spark, tmp_dir):
    feed(spark, tmp_dir, [(0, 0, 0, 1.0), (0, 0, 1, 0.0), (0, 1, 0, 1.0), (0, 1, 1, 0.0), (0, 1, 2, 0.5), (0, 1, 2, 0.5)])
    feed(spark, tmp_dir, [(0, 1, 2, 0.5), (0, 1, 7, 0.1), (0, 1, 7, 0.1), (None, 0, None, 1.0)], 5)
    feed(spark, tmp_dir, [(9, 9, 0, 1.0)], 31)  # the watermark passes the first group's timer
    feed(spark, tmp_dir, [(9, 9, 1, 1.0)], 31)  # which ends at the next trigger
    feed(spark, tmp_dir, [(0, 0, 2, 1.0), (0, 0, 0, 1.0)], 32)
    out = run(spark, tmp_dir, 3).where("step = 0").collect()
    rows = sorted((r.slot, r.sample_id, r.complete, r.late, r.advantage) for r in out)
    assert rows == [(0, 0, False, False, 0.5), (0, 1, False, False, -0.5), (0, 2, False, True, None),
                    (1, 0, True, False, 0.5), (1, 1, True, False, -0.5), (1, 2, True, False, 0.0), (1, 7, False, True, None)]


def test_a_group_keeps_one_value(spark):
    asked = []

    class Handle:
        def __getattr__(self, name):
            return lambda *a: asked.append((name, a[0]))

    groups.GroupAdvantages(8, 1000).init(Handle())
    assert asked == [("getValueState", "group")]  # one read and one write per group and trigger


def test_neighbouring_groups_share_a_state(spark):
    calls, kept = [], []

    class Handle:
        def getValueState(self, name, schema):
            return self

        def get(self):
            return kept[-1] if kept else None

        def update(self, row):
            kept.append(row)

        def registerTimer(self, at):
            calls.append(("set", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    rows = [(s, t, 0, i, float(i), 1000 * s) for s in range(8) for t in range(16) for i in range(2)]
    frame = pd.DataFrame(rows, columns=["step", "slot", "nulls", "sample_id", "reward", "at_ms"])
    block = groups.GroupAdvantages(2, 500)
    block.init(Handle())
    out = list(block.handleInputRows((0, 0), iter([frame[:100], frame[100:]]), Times()))
    assert len(out) == 1 and len(out[0]) == 256 and out[0]["complete"].all() and set(out[0]["advantage"]) == {-0.5, 0.5}
    assert len(kept) == 1 and calls == [("set", 500)]  # one state and one timer, of the group that ends first, for 128 groups
    assert list(block.handleInputRows((0, 0), iter([frame[:32]]), Times())) == [] and len(kept) == 2  # redelivered


def test_groups_of_a_block_end_at_their_own_times(spark, tmp_dir):
    feed(spark, tmp_dir, [(0, 0, 0, 1.0)])
    feed(spark, tmp_dir, [(1, 3, 0, 2.0)], 5)
    feed(spark, tmp_dir, [(1, 3, 1, 4.0), (9, 9, 0, 1.0)], 20)  # the watermark comes to minute 10, where the first group's timer stands
    feed(spark, tmp_dir, [(9, 9, 1, 1.0)], 20)
    feed(spark, tmp_dir, [(0, 0, 1, 1.0), (1, 3, 2, 0.0)], 20)
    out = run(spark, tmp_dir, 3).where("step < 9").collect()
    assert sorted((r.step, r.slot, r.sample_id, r.group_size, r.complete, r.late) for r in out) == [
        (0, 0, 0, 1, False, False), (0, 0, 1, None, False, True), (1, 3, 0, 3, True, False), (1, 3, 1, 3, True, False), (1, 3, 2, 3, True, False)]


def test_keys_may_be_null_negative_or_text(spark, tmp_dir):
    keys = [(None, "a"), (0, "a"), (0, None), (0, ""), (-1, "a"), (-8, "b")]
    rows = spark.createDataFrame([(s, t, i, float(i)) for s, t in keys for i in range(2)], "step bigint, slot string, sample_id int, reward double").selectExpr("*", "timestamp'2024-01-01' as ts")
    rows.write.parquet(f"{tmp_dir}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_dir}/in")
    out = groups.run_available(groups.stream_advantages(stream, 2), f"{tmp_dir}/out", f"{tmp_dir}/check")
    assert dict(out.dtypes)["step"] == "bigint" and dict(out.dtypes)["slot"] == "string"
    got = [(r.step, r.slot, r.sample_id, r.complete, r.advantage) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(s, t, i, True, i - 0.5) for s, t in keys for i in range(2)], key=str)
