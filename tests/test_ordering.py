import numpy as np
from pyspark.sql import functions as F

from quillmere.operators import ordering


def test_prefix_sums_of_groups_of_any_size_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.integers(0, 4000, 9000)] + [(None, float(v)) for v in rng.integers(7000, 7300, 5000)] + [("c", 5.0), ("c", 5.0), ("c", 6.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("one", F.lit(1))
    got = {(r["g"], r["v"]): r["one_to"] for r in ordering.prefix_sum(df, ["g"], "v", ["one"]).collect()}
    for g in ("a", None, "c"):
        values = np.array([v for h, v in rows if h == g])
        assert all(got[g, v] == int((values >= v).sum()) for v in set(values.tolist()))
    assert ordering.prefix_sum(df, ["g"], "v", ["one"]).count() == len(rows)
    whole = {r["v"]: r["one_to"] for r in ordering.prefix_sum(df.drop("g"), [], "v", ["one"]).collect()}
    every = np.array([v for _, v in rows])
    assert all(n == int((every >= v).sum()) for v, n in whole.items())


def test_ranges_follow_each_group(spark):
    one = lambda g, n, lo, hi: spark.range(n).select(F.lit(g).alias("g"), (F.col("id") % 1009 * (hi - lo) / 1009 + lo).alias("v"))
    df = one("x", 10_000, 0, 1000).union(one("y", 10_000, 0, 1000)).union(one("z", 400_000, 500, 501))
    sizes = ordering._ranged(df, ["g"], "v", 256).groupBy("g", "_range").count().collect()
    largest = {g: max(r["count"] for r in sizes if r["g"] == g) for g in "xyz"}
    assert largest["x"] <= 2500 and largest["y"] <= 2500 and largest["z"] <= 4000


def test_prefix_sum_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double, one int")
    assert ordering.prefix_sum(df, ["g"], "v", ["one"]).count() == 0 and ordering.prefix_sum(df, [], "v", ["one"]).count() == 0
