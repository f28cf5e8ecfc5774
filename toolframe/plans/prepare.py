"""The preparation lifecycle as one lazy plan with three sinks.

load + tag (S2/P1/U1) -> dedup (A1) -> completeness (P2) -> whitespace (P3)
-> balance (A3) -> split (L8) -> raw test sink (K2, BEFORE unification)
-> unify text + prune (P4/P5) -> tokenise (T1-T3) -> split sink (K3).

The split is written once to the shared checkpoint area and read back, so the
three sinks and the vocabulary job reuse one materialised split instead of
re-running dedup/balance (and an executor loss re-reads files, not lineage).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolframe.operators import prep, tokens
from toolframe.session import written, written_counted
from toolframe.sources import readers


@dataclass(frozen=True)
class PrepareConfig:
    """Job parameters (the reference's YAML keys that code reads)."""

    sources: tuple[readers.SourceSpec, ...]
    out_dir: str
    seed: int = 42
    train: float = 0.8
    validation: float = 0.1
    remove_duplicates: bool = True
    remove_incomplete: bool = True
    balance_sources: bool = True
    dedup_key: tuple[str, ...] = ()  # none: the whole row
    max_length: int = 2048
    max_vocab: int | None = None


def prepare_rows(df: DataFrame, cfg: PrepareConfig) -> DataFrame:
    """The rows of all sources (tagged) -> dedup, completeness, whitespace, balance, split; written, with a unique row_id."""
    df = prep.with_row_ids(df)
    if cfg.remove_duplicates:
        df = prep.dedup_first(df, prep.dedup_key(df, cfg.dedup_key))
    if cfg.remove_incomplete:
        df = prep.complete_rows(df)
    df = prep.normalize_whitespace(df)
    if cfg.balance_sources:
        df = prep.balance_sources(df, key="row_key", tie="row_id", seed=cfg.seed)
        df = df.withColumn("row_key", F.concat_ws("|", "row_key", F.col("draw").cast("string"))) \
            .withColumn("row_id", F.concat_ws("|", "row_id", F.col("draw").cast("string")))
    df, n = written_counted(df, "balanced")
    return written(prep.split_exact(df, key="row_key", tie="row_id", n=n, seed=cfg.seed, train=cfg.train, val=cfg.validation), "split")


def prepare(spark: SparkSession, cfg: PrepareConfig) -> dict[str, DataFrame]:
    split = prepare_rows(readers.load_all(spark, list(cfg.sources)), cfg)
    raw = split.filter(F.col("split") == "test").drop("split", "row_key")
    readers.write_json(raw, f"{cfg.out_dir}/test_raw")
    flat = prep.unify_text(split.drop("draw", "row_key"), passthrough=("row_id", "split"))
    vocab = written(tokens.build_vocabulary(flat.filter(F.col("split") == "train"), max_vocab=cfg.max_vocab), "vocabulary")
    enc = tokens.encode(flat, vocab, ["row_id", "split"], max_length=cfg.max_length)
    readers.write_splits(enc, f"{cfg.out_dir}/tokenized")
    return {"split": split, "vocab": vocab, "encoded": enc}
