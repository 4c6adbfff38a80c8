"""Boosted trees and their contributions read their rows a fixed, small number of times, with the same results."""

import random

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quillmere.operators import attribution, explained, models
from quillmere.plans import catalog

NAMES = ["a", "b", "c"]


def table(spark, n=400):
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.choice([None, 1.0, 2.0, 4.0]), rng.random(), i % 4 == 0) for i in range(n)]
    return spark.createDataFrame([(*r, float(r[1] + (r[2] or 0) * r[3] > 1.2)) for r in rows], "id long, a double, b double, c double, held boolean, label double").repartition(3, "id")


def test_boosted_reads_its_rows_once_and_fits_the_same_trees(spark):
    rows, read = table(spark), spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = models.boosted(rows.withColumn("a", F.udf(seen, "double")("a")), NAMES, [], "label", "held", rounds=3)
    assert read.value == 400
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    trees = GBTClassifier(labelCol="label", maxIter=3, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=7, validationIndicatorCol="held", validationTol=0.001)
    want = models.Pipeline(stages=[*models.prepared(NAMES, []), trees]).fit(rows)
    # the deviations that scale the cuts are added up in the order in which tasks end
    a, b = (explained.leaves(m.stages[-1]) for m in (got, want))
    assert [[p[0] for p in path] for _, path in a] == [[p[0] for p in path] for _, path in b]
    assert np.allclose([v for v, _ in a], [v for v, _ in b], rtol=1e-9)


def test_contributions_are_worked_out_once_for_both_reports(spark):
    out = catalog.QUERIES["k01_tree_contributions"](spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapIn") == 1
    assert {r["feature"] for r in out.collect()} == {"l_quantity", "l_extendedprice", "l_tax"}


def test_checked_importance_equals_both_reports(spark):
    rows = spark.sql("select id, 1D as base, 1D + id + (id % 7 = 0)::int as margin, array(named_struct('feature', 'x', 'value', 2D * id), named_struct('feature', 'y', 'value', -1D * id)) as contributions from range(50)")
    got = attribution.checked_importance(rows, ["x", "y"])
    want = attribution.importance(rows).crossJoin(attribution.additivity(rows)).select("feature", "mean_abs", "n", "n_failed")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert {r["n_failed"] for r in got.collect()} == {8}
    assert attribution.checked_importance(rows.filter("id < 0"), ["x", "y"]).collect() == attribution.importance(rows.filter("id < 0")).collect() == []


def test_values_looked_up_are_those_of_each_row(spark):
    rows = VectorAssembler(inputCols=["a", "c"], outputCol="features").transform(table(spark))
    model = GBTClassifier(maxIter=3, maxDepth=5, seed=1).fit(rows)
    found = [*explained.leaves(model), (0.25, [])]  # a tree of one leaf as well
    x = np.random.default_rng(2).random((200, 2))
    base, values = explained.tree_values(x, found)
    alone = [explained.tree_values(x[i : i + 1], found) for i in range(200)]  # too few rows to look anything up
    assert all(abs(b - base) < 1e-12 for b, _ in alone)
    assert np.allclose(values, np.concatenate([v for _, v in alone]), atol=1e-12)
    assert np.allclose(base + values.sum(axis=1), explained.tree_margins(x, found), atol=1e-9)
    out = explained.tree_contributions(rows, model, ["id"], ["a", "c"])
    assert out.count() == 400 and explained.tree_contributions(rows.filter("id < 0"), model, ["id"], ["a", "c"]).count() == 0
    assert out.dtypes == [("id", "bigint"), ("base", "double"), ("margin", "double"), ("contributions", "array<struct<feature:string,value:double>>")]
