"""W1 / A11 on a stream: group-relative advantages as samples arrive.

A group (step, slot) is held in state until its G samples are there; then each
leaves with the group's mean, its advantage and whether the group is
degenerate, and the state shrinks to the ids that have left. An event-time
timer ends groups that never fill up: what is there leaves with ``complete``
false. Samples that come after their group has left leave at once, flagged
``late``, without an advantage. Redelivered samples are dropped by their
sample_id; a second timer forgets the ids when no such sample is expected any
more. Samples behind the watermark are dropped by Spark.

State is keyed, so it is spread over all tasks and survives a lost executor
through the query's checkpoint; a group holds at most G slim rows. Only
(sample_id, reward) is kept: texts and tokens are joined to the result by key.
Handing a key to Python, its state's way there and back and its timer cost
milliseconds whatever it holds, so neighbouring groups share one key: a block
of 8 steps and 16 slots, 128 groups at most. Samples of one step come together,
so a trigger writes few groups that it didn't change.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors get the processor itself and need no copy of this package

KEYS = ("step", "slot")
BLOCK_BITS = {"step": 3, "slot": 4}  # low bits of a whole-number key in which groups of one block may differ
WHOLE = ("tinyint", "smallint", "int", "bigint")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # what keyed state with timers needs
COLUMNS = ["sample_id", "reward", "group_mean", "group_size", "degenerate", "advantage", "complete", "late"]
GROUP = [*KEYS, "nulls"]  # a group inside its block; nulls: which of the keys are null


def _left(group: tuple, samples: dict[int, float], complete: bool) -> list[tuple]:
    """The rows of a group that leaves."""
    values = list(samples.values())
    mean = sum(values) / len(values)
    same = max(values) == min(values)
    return [(*group, i, r, mean, len(values), same, r - mean, complete, False) for i, r in sorted(samples.items())]


class GroupAdvantages(StatefulProcessor):
    """State per block of groups, one value: for each group the samples so far, the ids that have left and when it ends, and the timer that is set for the first end."""

    def __init__(self, size: int, wait_ms: int):
        self.size, self.wait_ms = size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("group", "groups string, timer long")

    def _load(self) -> tuple[dict[tuple, list], int | None]:
        """{group: [samples, ids that have left, end]} and the timer."""
        row = self.state.get()
        if row is None:
            return {}, None
        return {tuple(g): [dict(zip(ids, rewards, strict=True)), set(gone), until] for g, ids, rewards, gone, until in json.loads(row[0])}, row[1]

    def _save(self, groups: dict[tuple, list], timer: int | None, expired: bool = False) -> None:
        """Keep the groups and have the timer at the first end; a timer that has expired is deleted by Spark."""
        if not groups:
            self.state.clear()
            return
        first = min(until for _, _, until in groups.values())
        if timer != first:
            if timer is not None and not expired:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        text = json.dumps([[g, [*held], [*held.values()], sorted(gone), until] for g, (held, gone, until) in groups.items()], separators=(",", ":"))
        self.state.update((text, first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        groups, timer = self._load()
        watermark, last, out = timerValues.getCurrentWatermarkInMs(), {}, []
        for frame in rows:
            for *group, i, r, t in zip(*[frame[c].tolist() for c in (*GROUP, "sample_id", "reward", "at_ms")], strict=True):
                group = tuple(group)
                last[group] = max(last.get(group, watermark), t)
                held, gone, _ = state = groups.setdefault(group, [{}, set(), None])
                if i in held or i in gone:
                    continue
                if gone:
                    gone.add(i)
                    out.append((*group, i, r, None, None, None, None, False, True))
                    continue
                held[i] = r
                if len(held) == self.size:
                    out += _left(group, held, True)
                    state[:2] = {}, set(held)
        for group, t in last.items():
            groups[group][2] = t + self.wait_ms
        self._save(groups, timer)
        if out:
            yield pd.DataFrame(out, columns=[*GROUP, *COLUMNS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        groups, timer = self._load()
        watermark, out = timerValues.getCurrentWatermarkInMs(), []
        for group in [g for g, (_, _, until) in groups.items() if until <= watermark]:
            held, gone, _ = groups[group]
            if held:
                out += _left(group, held, False)
                groups[group] = [{}, gone | set(held), watermark + self.wait_ms]
            else:
                del groups[group]
        self._save(groups, timer, expired=timer == expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield pd.DataFrame(out, columns=[*GROUP, *COLUMNS])

    def close(self) -> None:
        pass


def _key(name: str, kind: str) -> tuple[Column, Column]:
    """(the key as a number or text without nulls, the block that it is in)."""
    if kind not in WHOLE:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return text, text
    whole = F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))
    return whole, F.shiftright(whole, BLOCK_BITS[name])


def stream_advantages(scored: DataFrame, size: int, event_time: str = "ts", wait: str = "10 minutes") -> DataFrame:
    """scored (step, slot, sample_id, reward, event time, ...), a stream -> KEYS, sample_id, reward, group_mean, group_size, degenerate, advantage, complete, late.

    size: samples of a full group; wait: by how much the watermark trails the
    events, and how long after its last sample a group leaves incomplete.
    Samples without a reward, a sample_id or an event time are left out. Output
    mode append.
    """
    spark = scored.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    kinds = {f.name: f.dataType.simpleString() for f in scored.schema.fields}
    timed = scored.withColumn("at", F.col(event_time).cast("timestamp")).where("reward is not null and sample_id is not null and at is not null").withWatermark("at", wait)
    keys = {k: _key(k, kinds[k]) for k in KEYS}
    nulls = F.lit(0)
    for bit, k in enumerate(KEYS):
        nulls = nulls + F.when(F.col(k).isNull(), F.lit(1 << bit)).otherwise(F.lit(0))
    slim = timed.select(*[block.alias(f"{k}_block") for k, (_, block) in keys.items()], *[value.alias(k) for k, (value, _) in keys.items()], nulls.alias("nulls"),
                        F.col("sample_id").cast("long").alias("sample_id"), F.col("reward").cast("double").alias("reward"), "at", F.unix_millis("at").alias("at_ms"))
    schema = ", ".join([*[f"{k} {'long' if kinds[k] in WHOLE else 'string'}" for k in KEYS], "nulls int, sample_id long, reward double, group_mean double, group_size int, degenerate boolean, advantage double, complete boolean, late boolean"])
    out = slim.groupBy(*[f"{k}_block" for k in KEYS]).transformWithStateInPandas(GroupAdvantages(size, wait_ms), schema, "Append", "EventTime")
    return out.select(*[F.when(F.col("nulls").bitwiseAND(F.lit(1 << bit)) == 0, F.col(k)).cast(kinds[k]).alias(k) for bit, k in enumerate(KEYS)], *COLUMNS)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, into Parquet files at ``path``; the rows written so far."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
