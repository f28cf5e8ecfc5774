"""Scoring completions as they arrive (Structured Streaming).

Extraction and rewards are row-local, so the batch expressions run unchanged
on a stream. Expected values come from a static prompts table (stream-static
join, J2). Late rows beyond the watermark are dropped, redelivered samples
are dropped with ``dropDuplicatesWithinWatermark`` on the sample key, and the
per-step reward summary is an event-time windowed aggregate, emitted in
append mode once the watermark passes the window.

The same function accepts a static DataFrame (watermark and dedup then
behave as their batch equivalents), which is how it is checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolframe.operators import rewards

#: What a redelivered sample shares with its first delivery. A prompt may fill two slots of a step, so the slot tells samples apart.
SAMPLE_KEY = ("step", "slot", "sample_id")


def score_stream(completions: DataFrame, prompts: DataFrame | None = None, *, event_time: str = "ts",
                 watermark: str = "10 minutes", key: tuple[str, ...] = SAMPLE_KEY,
                 gating: str = "always") -> DataFrame:
    """Deduplicated, scored completion rows (one per sample key).

    A TIMESTAMP_NTZ event time is read as a session-time-zone TIMESTAMP,
    which watermarks require.
    """
    if completions.schema[event_time].dataType.typeName() == "timestamp_ntz":
        completions = completions.withColumn(event_time, F.col(event_time).cast("timestamp"))
    if completions.isStreaming:
        s = completions.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(key))
    else:  # batch equivalent: redelivered samples are identical, any one is kept
        s = completions.dropDuplicates(list(key))
    s = rewards.with_calls(s)
    if prompts is not None:
        s = s.join(rewards.with_expected(prompts), "prompt_id", "inner")
    return rewards.score(s, gating=gating)


def step_rewards(scored: DataFrame, *, event_time: str = "ts", window: str = "1 hour") -> DataFrame:
    """Per (event-time window, step): samples, mean reward and mean component rewards."""
    comps = [f"reward_{r.name}" for r in rewards.registered()]
    return (scored.groupBy(F.window(event_time, window).alias("w"), "step")
            .agg(F.count(F.lit(1)).alias("n_samples"), F.avg("reward").alias("reward_mean"),
                 *[F.avg(c).alias(c) for c in comps])
            .select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "step",
                    "n_samples", "reward_mean", *comps))


def start_scoring(stream: DataFrame, prompts: DataFrame | None, sink_path: str, checkpoint: str, *,
                  event_time: str = "ts", watermark: str = "10 minutes", window: str = "1 hour",
                  fmt: str = "parquet", trigger: dict | None = None):
    """Start the streaming job: scored step windows appended to ``sink_path``.

    ``checkpoint`` must be a shared (cluster-visible) directory so the query
    restarts exactly where it stopped after a driver or executor loss.
    """
    out = step_rewards(score_stream(stream, prompts, event_time=event_time, watermark=watermark),
                       event_time=event_time, window=window)
    w = (out.writeStream.outputMode("append").format(fmt).option("path", sink_path)
         .option("checkpointLocation", checkpoint))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
