import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.operators import duplicates, explained, ordering, quantiles, resampling, scoring, splits, stability, tables


def test_quantiles_of_groups_with_ties_nulls_and_a_column_named_value(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.integers(0, 50, 6000)] + [(None, float(v)) for v in rng.normal(0, 9, 3000)] + [("one", 7.0), ("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "value string, x double")
    shares = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {r["value"]: (r["_n"], r["_quantiles"]) for r in quantiles.quantiles(df, ["value"], "x", shares).collect()}
    assert set(got) == {"a", None, "one"}
    for g, (n, found) in got.items():
        values = [x for h, x in rows if h == g and x is not None]
        assert n == len(values) and np.allclose(found, np.quantile(values, shares))
    whole = quantiles.quantiles(df, [], "x", shares).first()
    assert np.allclose(whole["_quantiles"], np.quantile([x for _, x in rows if x is not None], shares))
    assert quantiles.quantiles(df.limit(0), ["value"], "x", shares).count() == quantiles.quantiles(df.limit(0), [], "x", shares).count() == 0


@pytest.mark.parametrize("percent", [1, 10, 33.3, 100])
def test_top_percent_breaks_ties_by_key(spark, percent):
    rng = np.random.default_rng(6)
    rows = [(int(k), float(s)) for k, s in zip(rng.permutation(5003), rng.integers(0, 7, 5003), strict=True)] + [(9000, None)]
    top = quantiles.top_percent(spark.createDataFrame(rows, "id long, s double"), "s", "id", percent).collect()
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))[: math.ceil(5003 * percent / 100)]
    assert sorted((r["place"], r["id"], r["rank_percentile"]) for r in top) == [(i, k, pytest.approx((1 - i / 5003) * 100, abs=0.00501)) for i, (k, _) in enumerate(order, 1)]
    assert quantiles.top_percent(spark.createDataFrame([], "id long, s double"), "s", "id", percent).count() == 0


def test_least_hashed_keeps_its_quota_of_each_group_null_among_them(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("g"), F.lit(1).alias("h"))
    quotas = df.groupBy("g", "h").agg(F.when(F.col("g") == "x", 10).when(F.col("g") == "y", 5000).otherwise(77).alias("_quota"))
    kept = ordering.least_hashed(df, ["g", "h"], "id", quotas, 3, ranges=64)
    assert kept.columns == df.columns
    assert {r["g"]: r["count"] for r in kept.groupBy("g").count().collect()} == {"x": 10, "y": 1000, None: 77}
    share = explained.stratified_share(df, ["g"], "id", 0.1, 60, 3)
    assert {r["g"]: r["count"] for r in share.groupBy("g").count().collect()} == {"x": 60, "y": 60, None: 60}
    first = [r["id"] for r in df.filter("g = 'x'").orderBy(ordering.portable_hash(F.col("id"), 3), "id").limit(10).collect()]
    assert sorted(r["id"] for r in kept.filter("g = 'x'").collect()) == sorted(first)


def test_native_keys_follow_the_format_and_do_not_run_together(spark):
    rows = [(1, "a.gpkg", "v", "d", "1"), (2, "a.gpkg", "v", "d", "2"), (3, "a.csv", "v", "d", "1"), (4, "a.csv", "v", "d", "2"), (5, "a.csv", None, "d", "1"), (6, "a.csv", "", "d", "1"), (7, "a.csv", "vd", "", "1"), (8, "b.csv", "v", "d", "1"), (9, None, "v", "d", "1"), (10, "a.csv", "v", "d", "9")]
    df = spark.createDataFrame(rows, "id long, file string, v string, d string, h string")
    key = duplicates.native_key("file", {".gpkg": [F.col("v"), F.col("d"), F.col("h")]}, [F.col("v"), F.col("d")])
    found = duplicates.grouped(df, key)
    sizes = {r["id"]: r["duplicate_multiplicity"] for r in found.collect()}
    assert sizes == {i: 3 if i in (3, 4, 10) else 1 for i in range(1, 11)}
    assert sorted(r["id"] for r in duplicates.first_of_groups(found, ["id"]).collect()) == [1, 2, 3, 5, 6, 7, 8, 9]
    assert [tuple(r) for r in duplicates.sensitivity(found).orderBy("duplicate_multiplicity").collect()] == [(1, 7, 7, 0), (3, 3, 1, 2)]


def test_rank_stability_and_agreement(spark):
    runs = {1: [9, 8, 7, 6], 2: [9, 8, 6, 7], 3: [1, 2, 3, 4]}
    df = spark.createDataFrame([(s, f, float(v)) for s, vs in runs.items() for f, v in zip("abcd", vs, strict=True)], "seed int, f string, v double")
    ranks = stability.ranked(df, "seed", "f", "v")
    out = {r["feature"]: r for r in stability.rank_stability(ranks, spread=1.6).collect()}
    assert (out["a"]["rank_mean"], out["a"]["rank_min"], out["a"]["rank_max"], out["a"]["unstable"]) == (2.0, 1, 4, True)
    assert out["a"]["rank_std"] == pytest.approx(np.std([1, 1, 4], ddof=1), abs=1e-6) and not out["b"]["unstable"]
    pairs = {(r["run_a"], r["run_b"]): (r["n"], r["spearman"], r["top_2_overlap"]) for r in stability.run_agreement(ranks, (2,)).collect()}
    assert pairs == {(1, 2): (4, 0.8, 2), (1, 3): (4, -1.0, 0), (2, 3): (4, -0.8, 0)}


def test_window_coverage_before_at_and_after_the_first_day(spark):
    df = spark.sql("select * from values (date'2020-01-31', date'2020-01-31'), (date'2020-01-31', date'2020-01-02'), (date'2020-01-31', date'2020-01-01'), (date'2020-01-31', date'2020-02-01'), (date'2020-01-31', null) as t(day, first)")
    got = [tuple(r)[2:] for r in tables.window_coverage(df, "day", "first", (30,)).collect()]
    assert got == [(1, 0.033333, 0), (30, 1.0, 1), (30, 1.0, 1), (0, 0.0, 0), (0, 0.0, 0)]


def test_split_arithmetic_lists_parts_of_both_sides(spark):
    rows = spark.createDataFrame([("train",)] * 3 + [("val",)], "s string")
    expected = spark.createDataFrame([("train", 3), ("test", 1)], "part string, expected long")
    assert {tuple(r) for r in splits.arithmetic(rows, "s", expected).collect()} == {("train", 3, 3, True), ("val", 1, 0, False), ("test", 0, 1, False), ("TOTAL", 4, 4, True)}


def test_subgroups_with_few_positives_at_the_top_stay_without_a_lift(spark):
    rows = [(i, "big", float(i), int(i % 2 == 0)) for i in range(100)] + [(i, "low", float(i), int(i < 50)) for i in range(100, 200)] + [(300, None, 1.0, 1)]
    rows = [(i, g, s, int(i < 150) if g == "low" else y) for i, g, s, y in rows]
    df = spark.createDataFrame(rows, "id long, g string, s double, y int")
    got = {r["value"]: r for r in resampling.subgroup_tops(df, ["g"], "s", "id", "y", (10,), 50, 20, 3).collect()}
    assert (got["big"]["tp"], got["big"]["lift"], got["big"]["status"]) == (5, 1.0, "ok")
    assert (got["low"]["tp"], got["low"]["precision"], got["low"]["lift"], got["low"]["status"]) == (0, 0.0, None, "too_few_in_top")
    assert (got["(null)"]["precision"], got["(null)"]["status"]) == (None, "too_few_rows")


def test_calibration_mends_the_loss_and_leaves_the_order(spark):
    rng = np.random.default_rng(8)
    p = rng.uniform(0.02, 0.98, 4000)
    rows = [(float(x**3), int(rng.random() < x)) for x in p]  # scores that are far too low
    df = spark.createDataFrame(rows, "s double, y int")
    got = {r["metric"]: r for r in scoring.calibrated_deltas(df, df, "s", "y").collect()}
    loss = -np.mean([math.log(min(max(s, 1e-6), 1 - 1e-6)) if y else math.log(1 - min(max(s, 1e-6), 1 - 1e-6)) for s, y in rows])
    assert got["log_loss"]["value_a"] == pytest.approx(loss, abs=1e-5) and got["log_loss"]["delta"] < -0.1 and got["brier"]["delta"] < -0.02
    assert got["roc_auc"]["delta"] == got["average_precision"]["delta"] == 0
