"""Group-relative advantages and per-step training metrics over scored rollouts.

Input rows are keyed ``(step, slot, sample_id)``; a *group* is the G samples
drawn for one batch slot of one step. A prompt list shorter than the batch puts
one prompt into several slots of a step: those are separate groups. Shuffles:

- J2 (rollouts x prompts) is an equi-join on ``prompt_id``; AQE turns it into
  a broadcast join at runtime when the prompt side is small, otherwise it is a
  sort-merge join with skew splitting.
- W1 exchanges on ``(step, slot)``, which the join on ``prompt_id`` does not
  already satisfy: a group holds G rows by construction, and a prompt that
  occurs in every step is spread over all of them.
- A10-A14 are partial (map-side combined) aggregations; the step-level tables
  have one row per step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toolframe.operators.rewards import registered

GROUP_KEYS = ("step", "slot")


def join_prompts(rollouts: DataFrame, prompts: DataFrame, on: str = "prompt_id") -> DataFrame:
    """Attach each prompt's expected values to its sampled completions."""
    return rollouts.join(prompts, on=on, how="inner")


def explode_samples(groups: DataFrame, completions: str = "completions", aligned: tuple[str, ...] = ()) -> DataFrame:
    """One row per completion of a prompt's array, with its position as ``sample_id``.

    Arrays named in ``aligned`` (tokens, log-probabilities) are taken apart by
    the same position; they must be as long as the completions. Null and empty
    arrays give no rows. The element columns keep their names without a final s.
    """
    names = [completions, *aligned]
    out = groups.select(*[c for c in groups.columns if c not in names],
                        F.posexplode(F.arrays_zip(*[F.col(n) for n in names])).alias("sample_id", "_x"))
    return out.select(*[c for c in out.columns if c != "_x"], *[F.col("_x")[n].alias(n.removesuffix("s")) for n in names])


def group_advantages(scored: DataFrame, reward: str = "reward", normalize: bool = False,
                     keys: tuple[str, ...] = GROUP_KEYS) -> DataFrame:
    """W1 + A10 + A11: ``advantage = reward - mean(group)``, group mean and a degenerate flag.

    The reference subtracts the mean only (no division by std); ``normalize``
    adds the division (NULL-safe: a zero std leaves the centred value).
    A group is degenerate when all its rewards are equal (``max = min``), the
    exact condition under which every centred advantage is zero.
    """
    w = Window.partitionBy(*keys)
    r = F.col(reward)
    out = (scored
           .withColumn("group_mean", F.avg(r).over(w))
           .withColumn("group_size", F.count(F.lit(1)).over(w))
           .withColumn("degenerate", F.max(r).over(w) == F.min(r).over(w)))
    adv = r - F.col("group_mean")
    if normalize:
        std = F.stddev_samp(r).over(w)
        adv = F.when(std > 0, adv / std).otherwise(adv)
    return out.withColumn("advantage", adv)


def group_means(with_adv: DataFrame, keys: tuple[str, ...] = GROUP_KEYS) -> DataFrame:
    """One row per group."""
    return (with_adv.groupBy(*keys)
            .agg(F.first("group_mean").alias("group_mean"),
                 F.count(F.lit(1)).alias("group_size"),
                 F.first("degenerate").alias("degenerate")))


def degenerate_summary(with_adv: DataFrame) -> DataFrame:
    """A11 per step: groups, degenerate groups, their fraction."""
    g = group_means(with_adv)
    return (g.groupBy("step")
            .agg(F.count(F.lit(1)).alias("n_groups"),
                 F.sum(F.col("degenerate").cast("int")).alias("n_degenerate"))
            .withColumn("frac_degenerate", F.col("n_degenerate") / F.col("n_groups")))


def step_metrics(with_adv: DataFrame, components: list[str] | None = None) -> DataFrame:
    """A12 + A13 + A14: one row per step, from one lineage.

    Level 1 groups by ``(step, slot)`` (same keys as the W1 window, so no
    extra shuffle) and keeps per-group partial sums; level 2 groups those G-times
    smaller rows by ``step``. ``reward_mean`` is the mean of group means,
    ``n_datums`` counts the sequences of non-degenerate groups; component means
    and advantage statistics are over all sequences, degenerate ones included.
    The sample standard deviation is rebuilt from count, sum and sum of squares
    of the advantages, which are centred per group, so there is no cancellation.
    """
    comps = components if components is not None else [f"reward_{r.name}" for r in registered()]
    adv = F.col("advantage")
    groups = (with_adv.groupBy(*GROUP_KEYS)
              .agg(F.first("group_mean").alias("group_mean"),
                   F.first("degenerate").alias("degenerate"),
                   F.count(F.lit(1)).alias("group_size"),
                   *[F.sum(c).alias(f"_s_{c}") for c in comps],
                   F.sum(adv).alias("_adv_s"), F.sum(adv * adv).alias("_adv_ss"),
                   F.max(adv).alias("_adv_max"), F.min(adv).alias("_adv_min")))
    n = F.sum("group_size")
    steps = (groups.groupBy("step")
             .agg(F.avg("group_mean").alias("reward_mean"),
                  F.count(F.lit(1)).alias("n_groups"),
                  F.sum(F.col("degenerate").cast("long")).alias("n_degenerate"),
                  F.sum(F.when(~F.col("degenerate"), F.col("group_size")).otherwise(F.lit(0)))
                  .alias("n_datums"),
                  n.alias("_n"),
                  *[F.sum(f"_s_{c}").alias(f"_s_{c}") for c in comps],
                  F.sum("_adv_s").alias("_adv_s"), F.sum("_adv_ss").alias("_adv_ss"),
                  F.max("_adv_max").alias("advantage_max"), F.min("_adv_min").alias("advantage_min")))
    nd = F.col("_n").cast("double")
    mean = F.col("_adv_s") / nd
    var = (F.col("_adv_ss") - F.col("_adv_s") * mean) / (nd - F.lit(1.0))
    return (steps
            .withColumn("frac_degenerate", F.col("n_degenerate") / F.col("n_groups"))
            .select("*", *[(F.col(f"_s_{c}") / nd).alias(c) for c in comps],
                    mean.alias("advantage_mean"),
                    F.when(nd > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("advantage_std"))
            .drop("_n", "_adv_s", "_adv_ss", *[f"_s_{c}" for c in comps]))


def datum_arrays(with_adv: DataFrame, tokens: str = "tokens", logprobs: str = "logprobs",
                 prompt_len: str = "prompt_len") -> DataFrame:
    """T5 + T6: aligned training arrays for sequences of non-degenerate groups.

    ``ob = prompt_len - 1``; ``target_tokens = [0]*ob + tokens``,
    ``padded_logprobs = [0.0]*ob + logprobs`` and
    ``padded_advantages = [0.0]*ob + [a]*(prompt_len + len(tokens[:-1]) - ob)``.
    """
    ob = F.col(prompt_len) - F.lit(1)
    n_tok = F.size(F.col(tokens))
    full_len = F.col(prompt_len) + F.greatest(n_tok - F.lit(1), F.lit(0))
    return (with_adv.filter(~F.col("degenerate"))
            .withColumn("target_tokens", F.concat(F.array_repeat(F.lit(0), ob), F.col(tokens)))
            .withColumn("padded_logprobs",
                        F.concat(F.array_repeat(F.lit(0.0), ob), F.col(logprobs).cast("array<double>")))
            .withColumn("padded_advantages",
                        F.concat(F.array_repeat(F.lit(0.0), ob),
                                 F.array_repeat(F.col("advantage"), full_len - ob)))
            .withColumn("model_input_len", full_len))


def cyclic_batches(prompts: DataFrame, n_prompts: int, steps: int, batch_size: int,
                   start_step: int = 0, pos: str = "prompt_pos") -> DataFrame:
    """Prompts of step ``s`` are positions ``(s*batch + i) mod n``, ``i < batch``.

    The (step, slot) grid is generated by ``range`` in parallel and equi-joined
    to the prompts on their dense position.
    """
    if n_prompts <= 0:
        raise ValueError("no prompts")
    spark = prompts.sparkSession
    grid = (spark.range(start_step * batch_size, steps * batch_size)
            .select((F.col("id") / batch_size).cast("long").alias("step"),
                    F.pmod(F.col("id"), F.lit(batch_size)).alias("slot"),
                    F.pmod(F.col("id"), F.lit(n_prompts)).alias(pos)))
    return grid.join(prompts, on=pos, how="inner")


def sample_log(scored: DataFrame, prompts_text: str = "user", every: int = 10, n: int = 2,
               slot: str = "slot") -> DataFrame:
    """First sample of the first ``n`` batch slots every ``every`` steps.

    Columns (step, sample, prompt[:500], completion[:800], expected_tool,
    reward); the reward is the slot's own tool-name reward (the reference
    indexes the flattened list by prompt position, see Q12).
    """
    return (scored.filter((F.pmod(F.col("step"), F.lit(every)) == 0) & (F.col(slot) < n)
                          & (F.col("sample_id") == 0))
            .select("step", (F.col(slot) + 1).alias("sample"),
                    F.substring(prompts_text, 1, 500).alias("prompt"),
                    F.substring("completion", 1, 800).alias("completion"),
                    "expected_tool", F.col("reward_tool_name").alias("reward")))
