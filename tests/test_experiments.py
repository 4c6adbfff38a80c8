"""Experiment tables: what is learnable is learnt, what is permuted is not, and a run can be repeated."""

import random

from quillmere.operators import experiments
from quillmere.operators.experiments import Run


def rows(spark):
    rng = random.Random(1)
    lines = []
    for i in range(1500):
        x = rng.random()
        lines.append((i, "train" if i < 1000 else "val", x if i % 50 else None, rng.choice("ab"), float(x > 0.7)))
    return spark.createDataFrame(lines, "key long, split string, x double, c string, label double")


def test_permuted_labels_teach_nothing_and_runs_repeat(spark):
    table = experiments.prepared_table(rows(spark), "key", ["x"], ["c"], "label", {3, 4})
    train = table.filter("split = 'train'").toPandas()
    assert table.count() == 1500 and table.filter("split = 'val' and label_3 is not null").count() == 0
    assert train.label.sum() == train.label_3.sum() == train.label_4.sum()
    assert 0.4 < (train.label == train.label_3).mean() < 0.75 and (train.label_3 != train.label_4).any()
    runs = [*experiments.matrix((None, 3), (7,), (None, 100)), Run(None, 7, None)]
    out = [r.asDict() for r in experiments.run_all(table, "key", runs).collect()]
    assert [(r["permutation"], r["sample"]) for r in out] == [(None, None), (None, 100), (3, None), (3, 100), (None, None)]
    assert out[0] == out[4] and all(r["n"] == 500 for r in out)
    assert out[0]["roc_auc"] > 0.95 and out[1]["roc_auc"] > 0.95 and all(r["roc_auc"] < 0.9 for r in out[2:4]) and not out[2]["alert"]  # of one feature and 200 rows, chance learns something


def test_a_leak_into_permuted_labels_is_told(spark):
    table = experiments.prepared_table(rows(spark), "key", ["x"], ["c"], "label", {3})
    from pyspark.sql import functions as F

    leaky = table.withColumn("label_3", F.col("label"))  # as if the permutation had left the labels where they were
    assert experiments.run_all(leaky, "key", [Run(3)]).first()["alert"]
