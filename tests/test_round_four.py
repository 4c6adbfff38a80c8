"""What the fourth review found: a part of a table, repeated rows with missing values, and fits that grow with the rows."""

import duckdb
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from quillmere.operators import experiments, ordering
from quillmere.plans import catalog
from tests.test_round_three import no_broadcast, shuffled_rows  # noqa: F401


def lines(spark, tmp_path, values):
    """A lineitem table of (l_orderkey, l_linenumber, l_quantity, l_discount, l_tax), in one file and in this order."""
    rows = spark.createDataFrame(values, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double")
    rows.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))


def both(spark, tmp_path, name):
    """The rows of a query and those of its SQL on one DuckDB thread, where any_value takes the first in the file."""
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    return sorted(map(tuple, df.select(*names).collect()), key=repr), sorted(cur.fetchall(), key=repr)


def test_drivers_are_told_of_all_rows(spark, tmp_path):
    lines(spark, tmp_path, [(k, 1, float(k), 0.01 * k, 0.02) for k in range(1, 10)])
    got, sql = both(spark, tmp_path, "e13_drivers")
    assert got == sql and {r[0] for r in got} == set(range(1, 10))


def test_drivers_of_a_repeated_key_are_each_features_first_values(spark, tmp_path):
    """any_value passes over nulls for each feature by itself; a key with no value at all has no counts."""
    lines(spark, tmp_path, [(1, 1, None, 0.0, None), (1, 1, 50.0, 0.1, None), (1, 1, 1.0, None, 0.0), (2, 1, None, None, None), (2, 1, None, None, None), (3, 1, 20.0, None, 0.08), (None, 1, 1.0, 0.02, 0.01), (None, 1, 50.0, 0.1, 0.08)])
    got, sql = both(spark, tmp_path, "e13_drivers")
    assert got == sql and (1, 1, 2, 1) in got and (2, 1, None, None) in got


def test_dealt_labels_are_the_permuted_ones(spark):
    rows = spark.range(700).select(F.col("id").alias("key"), (F.col("id") % 7 == 0).cast("double").alias("label"))
    got = ordering.dealt(rows, "key", "label", [5, 8]).collect()
    assert len(got) == 700 and all(r["label"] == (r["key"] % 7 == 0) for r in got)
    for seed in (5, 8):
        assert {r["key"]: r[f"label_{seed}"] for r in got} == {r["key"]: r["label"] for r in ordering.permuted(rows, "key", "label", seed).collect()}


def test_a_sample_of_few_groups_shuffles_only_what_it_keeps(spark, no_broadcast):
    rows = spark.range(20_000).select(F.col("id").alias("key"), F.when(F.col("id") % 9 > 0, F.col("id") % 3).alias("g"))
    some = ordering.stratified(rows, "g", "key", 50, 7, few=True)
    assert {tuple(r) for r in some.collect()} == {tuple(r) for r in ordering.stratified(rows, "g", "key", 50, 7).collect()}
    assert shuffled_rows(ordering.stratified(rows, "g", "key", 50, 7, ranges=64)) > 20_000 > 2000 > shuffled_rows(ordering.stratified(rows, "g", "key", 50, 7, ranges=64, few=True))


def test_bins_keep_few_values_fill_missing_ones_and_part_a_frequent_value(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, -1.0).otherwise(F.col("id").cast("double")).alias("x"), F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("double")).alias("y"), F.lit("train").alias("split"))
    got = experiments.binned(rows.withColumn("was", F.col("x")), ["x", "y"]).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["x"], []).append(r["was"])
    assert [set(b) for b in bins.values() if -1.0 in b] == [{-1.0}] and 20 < len(bins) <= 64
    order = [bins[b] for b in sorted(bins)]
    assert all(max(a) < min(b) for a, b in zip(order, order[1:], strict=False))
    assert {r["y"] for r in got} == {0.0, 1.0, 2.0}


def test_cells_are_dealt_out_to_few_weighted_rows(spark, monkeypatch):
    monkeypatch.setattr(experiments, "MOST_ROWS", 100)
    cells = spark.createDataFrame([("a", 1003), ("b", 1), ("c", 250)], "x string, weight long")
    got = experiments.weighed(cells, ["x"]).collect()
    total = lambda x: sum(r["weight"] for r in got if r["x"] == x)
    assert len(got) <= 103 and (total("a"), total("b"), total("c")) == (1003, 1, 250) and max(r["weight"] for r in got) <= 13


def signal(spark):
    """2,000 training and 1,000 validation rows whose label follows from x and c but for a tenth of them."""
    i = F.col("id")
    rows = spark.range(3000).select(i.alias("key"), F.when(i % 3 < 2, "train").otherwise("val").alias("split"), F.when(i % 50 > 0, i * 7919 % 1000 / 1000).alias("x"), F.when(i * 31 % 7 < 3, "a").otherwise("b").alias("c"))
    return experiments.written(rows.withColumn("label", ((F.col("x") > 0.7) | (F.col("c") == "a")) != (F.col("key") % 10 == 3)).withColumn("label", F.coalesce(F.col("label"), F.lit(False)).cast("double")))


def test_fits_on_cells_learn_what_fits_on_rows_learn(spark, monkeypatch):
    rows, runs = signal(spark), [*experiments.matrix((None, 3), (7,), (None, 200)), experiments.Run()]
    by_rows = experiments.boosted_runs(rows, "key", ["x"], ["c"], "label", runs).collect()
    monkeypatch.setattr(experiments, "MOST_ROWS", 500)
    by_cells = experiments.boosted_runs(rows, "key", ["x"], ["c"], "label", runs).collect()
    assert by_cells[0] == by_cells[4]
    for a, b in zip(by_rows, by_cells, strict=True):
        assert a[:5] == b[:5]
    for a, b in zip(by_rows[:2], by_cells[:2], strict=True):
        assert b["roc_auc"] > 0.8 and abs(a["roc_auc"] - b["roc_auc"]) < 0.02 and abs(a["average_precision"] - b["average_precision"]) < 0.04
    assert all(r["roc_auc"] < 0.75 for r in by_cells[2:4])


@pytest.mark.parametrize("name", ["j19_repair_only_seeds", "j12_horizons", "j17_experiment_matrix"])
def test_the_rows_of_a_fit_do_not_grow_with_the_table(spark, monkeypatch, name):
    monkeypatch.setattr(experiments, "MOST_ROWS", 300, raising=False)
    monkeypatch.setattr(experiments, "BINS", 4, raising=False)
    read, fit = [], GBTClassifier._fit

    def counted(self, rows):
        read.append((rows.count(), rows.agg(F.sum("weight")).first()[0] if "weight" in rows.columns else None))
        return fit(self.copy({self.maxIter: 1}), rows)

    monkeypatch.setattr(GBTClassifier, "_fit", counted)
    rows = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    whole = max(weight for _, weight in read)
    assert len(rows) == len(read) and whole > 2000
    assert any(n < weight / 2 for n, weight in read if weight == whole)  # a sample of so few rows is all of them, one by one
