"""Experiments over one prepared table each. Model fits have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators import experiments, splits
from quillmere.plans.audits import small_panel
from quillmere.plans.more import CATEGORIES, NUMBERS, fitted, keyed
from quillmere.plans.registry import Tables

RUNS = experiments.matrix((None, 3, 11), (7, 8), (None, 2000))


@fitted("j17_experiment_matrix")
def experiment_matrix(t: Tables) -> DataFrame:
    """Permutation seed x model seed x sample, in one table."""
    return experiments.boosted_runs(keyed(t), "key", NUMBERS, CATEGORIES, "label", RUNS)


@fitted("j12_horizons")
def horizons(t: Tables) -> DataFrame:
    """The same settings on the panel's labels of 90 and of 180 days, each with its own embargo."""
    seen = small_panel(t).withColumn("gap", F.coalesce(F.date_diff("as_of_date", "last_event"), F.lit(-1)).cast("double"))
    seen = experiments.written(seen.select(
        F.xxhash64("entity", "as_of_date").alias("key"), F.col("events_365d").cast("double").alias("events"), F.col("collapsed_365d").cast("double").alias("days"), "gap", F.month("as_of_date").cast("string").alias("month"),
        *[F.col(f"target_{days}d").cast("double").alias(f"label_{days}") for days in (90, 180)], *[splits.split_of(F.col("as_of_date"), days, "1999-01-31", "2000-06-30")["split"].alias(f"split_{days}") for days in (90, 180)],
    ))
    out = None
    for days in (90, 180):
        rows = seen.select("key", "events", "days", "gap", "month", F.col(f"label_{days}").alias("label"), F.col(f"split_{days}").alias("split")).filter("split in ('train', 'val')")
        line = experiments.boosted_runs(rows, "key", ["events", "days", "gap"], ["month"], "label", [experiments.Run()]).withColumn("horizon", F.lit(days))
        out = line if out is None else out.unionByName(line)
    return out.select("horizon", "n", "prevalence", "average_precision", "roc_auc")
