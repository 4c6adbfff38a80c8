"""Experiments: many fits that read one prepared, written table and are submitted side by side."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillmere.operators import evaluation, models, ordering
from quillmere.sources.sinks import scratch


@dataclass(frozen=True)
class Run:
    """permutation: the seed by which training labels are dealt out anew, or None; sample: so many training rows of each label, or None for all."""

    permutation: int | None = None
    model_seed: int = 7
    sample: int | None = None


def matrix(permutations: tuple[int | None, ...], model_seeds: tuple[int, ...], samples: tuple[int | None, ...]) -> list[Run]:
    return [Run(p, m, s) for p in permutations for m in model_seeds for s in samples]


def written(rows: DataFrame, name: str = "rows") -> DataFrame:
    """rows, written once and read from there: each stage of a fit reads its input anew."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def prepared_table(rows: DataFrame, key: str, numbers: list[str], categories: list[str], label: str, permutations: set[int], columns: tuple[str, ...] = ("features",)) -> DataFrame:
    """(key, split, label, `columns` of the preparation, label_<seed>) of rows (key, split, label and the features' columns), written once: imputing, scaling and categories are fitted on the training rows, whose labels each seed deals out anew.

    rows are read several times, so they ought to be a table, or `written`.
    """
    train = rows.filter("split = 'train'")
    out = Pipeline(stages=models.prepared(numbers, categories)).fit(train).transform(rows).select(key, "split", *columns, F.col(label).cast("double").alias("label"))
    for seed in sorted(permutations):
        dealt = ordering.permuted(train.select(key, F.col(label).cast("double").alias("label")), key, "label", seed)
        out = out.join(dealt.withColumnRenamed("label", f"label_{seed}"), key, "left")
    return written(out, "experiment")


def logistic_scores(table: DataFrame, strength: float, label: str = "label") -> DataFrame:
    """The validation rows of a prepared table with the score of a logistic model of its features, fitted on training rows and `label`."""
    train = table.filter("split = 'train'").select("features", F.col(label).alias("label"))
    return models.probability(LogisticRegression(regParam=strength, maxIter=50).fit(train).transform(table.filter("split = 'val'")))


def family(table: DataFrame, numbers: list[str], categories: list[str], all_numbers: list[str]) -> DataFrame:
    """A table prepared with the columns `scaled` and `<category>_hot`, with `features` of some numbers and categories only."""
    some = VectorSlicer(inputCol="scaled", outputCol="_numbers", indices=[all_numbers.index(c) for c in numbers]).transform(table)
    return VectorAssembler(inputCols=["_numbers", *[f"{c}_hot" for c in categories]], outputCol="features").transform(some)


def boosted_trees(seed: int, rounds: int, depth: int, **more: str) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, **more)


def boosted_run(table: DataFrame, key: str, run: Run, rounds: int = 10, depth: int = 3) -> Row:
    """n, pos, average_precision and roc_auc on validation rows, with their own labels, of boosted trees fitted as `run` says."""
    label = "label" if run.permutation is None else f"label_{run.permutation}"
    train = table.filter("split = 'train'").select(key, "features", F.col(label).alias("label"))
    if run.sample is not None:
        train = ordering.stratified(train, "label", key, run.sample, run.model_seed)
    trees = boosted_trees(run.model_seed, rounds, depth)
    scores = models.probability(trees.fit(train).transform(table.filter("split = 'val'")))
    return evaluation.ranking(scores.select("score", F.col("label").cast("int").alias("label")), [], "score", "label").first()


def run_all(table: DataFrame, key: str, runs: list[Run], fit: Callable[[DataFrame, str, Run], Row] = boosted_run, at_once: int = 4) -> DataFrame:
    """permutation, model_seed, sample, n, prevalence, average_precision, roc_auc and alert of each run; `at_once` of them are submitted at a time, each in a pool of its own for a fair scheduler.

    alert: a model of permuted labels whose average precision is over twice the prevalence. One row a run comes to the driver.
    """
    spark = table.sparkSession

    def one(place: int) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"run-{place % at_once}")
        run, r = runs[place], fit(table, key, runs[place])
        rate = r["pos"] / r["n"]
        return run.permutation, run.model_seed, run.sample, r["n"], round(rate, 6), r["average_precision"], r["roc_auc"], run.permutation is not None and (r["average_precision"] or 0) > 2 * rate

    with ThreadPoolExecutor(at_once) as pool:
        lines = list(pool.map(one, range(len(runs))))
    return spark.createDataFrame(lines, "permutation int, model_seed int, sample int, n long, prevalence double, average_precision double, roc_auc double, alert boolean")


# Trees put a number into 32 bins at most, so rows of equal bins, categories and labels are alike to them. More training rows than MOST_ROWS
# are therefore counted in cells, and a fit reads a cell as weighted rows, MOST_ROWS in all and one more for a cell: its time and memory
# no longer grow with the rows. Every row counts; what differs from a fit by rows is which of them a tree's random 0.8 takes, and where bins end.
MOST_ROWS, BINS, PARTS = 1 << 18, 64, 8


def binned(rows: DataFrame, numbers: list[str]) -> DataFrame:
    """rows (with `split`) with the training rows' median for missing `numbers`, and a number of more than about BINS values as the place of its bin.

    The bins hold about as many training rows each; a value that fills one has it alone. One reading of the training rows.
    """
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in numbers}
    quantiles = [F.percentile_approx(x, [i / BINS for i in range(1, BINS)], 10_000).alias(f"q_{c}") for c, x in known.items()]
    found = rows.filter("split = 'train'").agg(*quantiles, *[F.approx_count_distinct(x).alias(f"n_{c}") for c, x in known.items()]).first()
    rows = rows.withColumns({c: F.coalesce(x, F.lit(found[f"q_{c}"] and found[f"q_{c}"][BINS // 2 - 1])) for c, x in known.items()})
    for c in (c for c in numbers if found[f"n_{c}"] > BINS):
        q = found[f"q_{c}"]
        ends = {*q, *[float(np.nextafter(a, np.inf)) for a, b in zip(q, q[1:], strict=False) if a == b]}
        bins = Bucketizer(splits=sorted({-np.inf, *ends, np.inf}), inputCol=c, outputCol="_bin", handleInvalid="keep")
        rows = bins.transform(rows).drop(c).withColumnRenamed("_bin", c)
    return rows


def weighed(cells: DataFrame, by: list[str]) -> DataFrame:
    """The cells (by, weight, a whole number) as MOST_ROWS rows and one more for each cell at most, with its weight dealt out evenly; in one order and the same PARTS partitions each time."""
    each = F.lit(-(-cells.agg(F.sum("weight")).first()[0] // MOST_ROWS))
    rows = cells.withColumn("_of", F.ceil(F.col("weight") / each)).withColumn("_part", F.explode(F.sequence(F.lit(1).cast("long"), "_of")))
    rows = rows.withColumn("weight", F.floor((F.col("weight") + F.col("_part") - 1) / F.col("_of")).cast("double"))
    return rows.repartition(PARTS, *by, "_part").sortWithinPartitions(*by, "_part").drop("_of", "_part")


def cell_run(train: DataFrame, val: DataFrame, run: Run, rounds: int = 10, depth: int = 3) -> Row:
    """What boosted_run returns, of weighted rows (features, label, weight) to train on and cells of validation rows."""
    model = boosted_trees(run.model_seed, rounds, depth, weightCol="weight").fit(train)
    found = models.probability(model.transform(val)).groupBy("score").agg(F.sum("weight").alias("n"), F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0)).alias("pos"))
    return evaluation.ranking_of_cells(found, [], "score").first()


def boosted_runs(rows: DataFrame, key: str, numbers: list[str], categories: list[str], label: str, runs: list[Run]) -> DataFrame:
    """run_all of boosted trees on rows (key, split, label and the features' columns), a table that is read several times: of a prepared table, or of cells where there are more than MOST_ROWS training rows."""
    seeds = sorted({r.permutation for r in runs} - {None})
    if rows.filter("split = 'train'").count() <= MOST_ROWS:
        return run_all(prepared_table(rows, key, numbers, categories, label, set(seeds)), key, runs)
    by, labels = [*numbers, *categories], ["label", *[f"label_{s}" for s in seeds]]
    coded = binned(rows.select(key, "split", *by, F.col(label).cast("double").alias("label")), numbers)
    train = ordering.dealt(coded.filter("split = 'train'"), key, "label", seeds)
    coded = train.unionByName(coded.filter("split = 'val'"), allowMissingColumns=True)
    if any(r.sample is not None for r in runs):
        coded = written(coded, "coded")
    cells = written(coded.groupBy("split", *by, *labels).agg(F.count("*").alias("weight")), "cells")
    stages = Pipeline(stages=models.prepared(numbers, categories)).fit(cells.filter("split = 'train'"))
    label_of = lambda run: "label" if run.permutation is None else f"label_{run.permutation}"
    alike = lambda split, name: cells.filter(F.col("split") == split).groupBy(*by, F.col(name).alias("label")).agg(F.sum("weight").alias("weight"))
    featured = lambda rows, name: written(stages.transform(rows).select("features", "label", "weight"), name)
    val = featured(alike("val", "label"), "val")
    whole = {name: featured(weighed(alike("train", name), [*by, "label"]), "train") for name in sorted({label_of(r) for r in runs if r.sample is None})}

    def fit(val: DataFrame, key: str, run: Run) -> Row:
        if run.sample is None:
            return cell_run(whole[label_of(run)], val, run)
        some = ordering.stratified(coded.filter("split = 'train'").select(key, *by, F.col(label_of(run)).alias("label")), "label", key, run.sample, run.model_seed, few=True)
        parts = min(PARTS, -(-run.sample * PARTS // MOST_ROWS))
        return cell_run(featured(some.withColumn("weight", F.lit(1.0)).repartition(parts, key).sortWithinPartitions(key), "sample"), val, run)

    return run_all(val, key, runs, fit)
