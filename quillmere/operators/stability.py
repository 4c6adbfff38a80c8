"""How far the importance of features agrees over several runs. Tables have a row for each run and feature, so they are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(importances: DataFrame, run: str, feature: str, value: str) -> DataFrame:
    """(run, feature, rank): 1 for a run's largest value; among equal values the first by name ranks first."""
    order = Window.partitionBy(run).orderBy(F.desc(value), feature)
    return importances.select(F.col(run).alias("run"), F.col(feature).alias("feature"), F.row_number().over(order).alias("rank"))


def rank_stability(ranks: DataFrame, top: int = 30, spread: float = 3.0) -> DataFrame:
    """feature, n_runs, rank_mean, rank_std (of the sample), rank_min, rank_max and unstable: among the `top` by mean rank, with a deviation above `spread`."""
    out = ranks.groupBy("feature").agg(F.count("*").alias("n_runs"), F.avg("rank").alias("m"), F.stddev_samp("rank").alias("s"), F.min("rank").alias("rank_min"), F.max("rank").alias("rank_max"))
    unstable = (F.col("m") <= top) & F.coalesce(F.col("s") > spread, F.lit(False))
    return out.select("feature", "n_runs", F.round("m", 6).alias("rank_mean"), F.round("s", 6).alias("rank_std"), "rank_min", "rank_max", unstable.alias("unstable"))


def run_agreement(ranks: DataFrame, tops: tuple[int, ...] = (10, 20)) -> DataFrame:
    """run_a, run_b, n, spearman and top_<k>_overlap of each two runs (a before b): features of both, the correlation of their ranks, and how many are among the first k of both."""
    b = ranks.select(F.col("run").alias("run_b"), "feature", F.col("rank").alias("b"))
    both = ranks.select(F.col("run").alias("run_a"), "feature", F.col("rank").alias("a")).join(b, "feature").filter("run_a < run_b")
    overlaps = [F.count_if((F.col("a") <= k) & (F.col("b") <= k)).alias(f"top_{k}_overlap") for k in tops]
    return both.groupBy("run_a", "run_b").agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 6).alias("spearman"), *overlaps)
