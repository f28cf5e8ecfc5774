"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up, then ``BENCH_REPS`` timed runs executed
fully through the no-op sink (no collect); the per-query value is the median.
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from toolframe.plans import catalog  # noqa: E402
from toolframe.session import build_session  # noqa: E402

HEADLINE = [
    "a12_step_metrics",            # flagship: extraction -> rewards -> advantages -> step metrics
    "a09_composite_reward_grpo",   # scoring throughput
    "e03_extract_calls",
    "w01_group_advantage",
    "t05_datum_arrays",
    "a07_multi_step_taxonomy",     # evaluation (one aggregation for A4-A7 + latency)
    "c01_stage_comparison",
    "p09_expected_fields",
    "a01_dedup_first",
    "a03_balance_sources",
    "l08_split_exact",
    "l10_epoch_batches",
    "p07_render_conversation",
    "t01_encode",
    "x06_near_duplicates",         # MinHash + LSH components over all documents
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    # local mode runs everything in the driver JVM: give it a realistic heap (default is 1g)
    spark = build_session(f"local[{cpus}]", app="toolframe-bench", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    spark.conf.set("toolframe.spread", str(2 * int(cpus)))  # the tables here are one split each
    out = {}
    for name in names:
        fn = catalog.CATALOG[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times = []
        for _ in range(reps):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": sf, "throughput": throughput(spark, sf_dir, reps)}))


def _median_time(fn, reps):
    fn()
    times = []
    for _ in range(reps):
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return statistics.median(times)


def throughput(spark, sf_dir, reps):
    """BASELINE "our own" rates: completions scored/s and corpus rows prepared/s."""
    from pyspark.sql import functions as F

    from toolframe.operators import prep, rewards
    from toolframe.plans import fixtures as fx
    from toolframe.session import spread

    comp = fx.completions_f2(spark, sf_dir)
    n_comp = comp.count()

    def score():
        rewards.score(spread(comp), gating="always").write.format("noop").mode("overwrite").save()

    corpus = fx.corpus_f1(spark, sf_dir)
    n_rows = corpus.count()

    def prepare():
        df = prep.dedup_first(corpus, F.md5(F.col("text")))
        df = prep.normalize_whitespace(prep.complete_rows(df))
        df = prep.split_exact(prep.balance_sources(df))
        df.write.format("noop").mode("overwrite").save()

    t_score = _median_time(score, reps)
    t_prep = _median_time(prepare, reps)
    return {"completions_scored_per_sec": round(n_comp / t_score, 1),
            "rows_prepared_per_sec": round(n_rows / t_prep, 1)}


if __name__ == "__main__":
    main()
