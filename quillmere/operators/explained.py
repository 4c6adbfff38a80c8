"""Exact contributions of features to boosted trees, and roll-ups of contributions to source features, records and subgroups."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quillmere.operators.ordering import least_hashed
from quillmere.operators.quantiles import quantiles

Leaf = tuple[float, list[tuple[int, float, float, float]]]  # value; (feature, above, up to, share of rows) for each feature on its path


def leaves(model) -> list[Leaf]:
    """The leaves of all trees of a fitted Spark model of boosted trees (continuous splits), weighted; the number of nodes bounds them, not the data."""
    out: list[Leaf] = []

    def walk(node, weight: float, path: dict[int, tuple[float, float, float]]) -> None:
        if node.subtreeDepth() == 0:
            out.append((weight * node.prediction(), [(f, *x) for f, x in path.items()]))
            return
        f, cut, n = node.split().featureIndex(), node.split().threshold(), node.impurityStats().count()
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
            walk(child, weight, {**path, f: (*bounds, share * child.impurityStats().count() / n)})

    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        walk(tree._java_obj.rootNode(), float(weight), {})
    return out


def tree_values(x: np.ndarray, found: list[Leaf]) -> tuple[float, np.ndarray]:
    """The base value and, for each row of x, each feature's exact Shapley value of the trees, by their leaves.

    A leaf is a product over the features on its path: 1 or 0 where the feature is known, the share of rows that
    go its way where it is not. With weights of sets by size, the sums over sets are coefficients of a polynomial.
    """
    base, out = 0.0, np.zeros(x.shape)
    for value, path in found:
        d = len(path)
        share = np.array([p[3] for p in path])
        base += value * float(share.prod())
        if not d:
            continue
        goes = np.stack([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in path], axis=1)
        few = 2**d <= len(x)  # then each way to go is worked out once, and rows look theirs up
        ways = (np.arange(2**d)[:, None] >> np.arange(d) & 1 if few else goes).astype(float)
        way = goes @ (1 << np.arange(d)) if few else slice(None)
        for i in range(d):
            poly = np.zeros((len(ways), d))
            poly[:, 0] = 1.0
            for k in range(d):
                if k != i:
                    poly[:, 1:] = poly[:, 1:] * share[k] + poly[:, :-1] * ways[:, k : k + 1]
                    poly[:, 0] *= share[k]
            weight = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])
            out[:, path[i][0]] += (value * (ways[:, i] - share[i]) * (poly @ weight))[way]
    return base, out


def tree_margins(x: np.ndarray, found: list[Leaf]) -> np.ndarray:
    """For each row of x the sum of the leaves that it falls into."""
    out = np.zeros(len(x))
    for value, path in found:
        out += value * np.logical_and.reduce([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in path] or [np.ones(len(x), bool)])
    return out


def tree_contributions(rows: DataFrame, model, key: list[str], names: list[str], features: str = "features") -> DataFrame:
    """key, base, margin and contributions (array of feature, value) of each row; Spark deals the rows, numpy works on each Arrow batch."""
    found, kept = leaves(model), rows.select(*key, vector_to_array(features).alias("_x"))
    schema = StructType([*kept.drop("_x").schema, StructField("base", DoubleType()), StructField("margin", DoubleType()), StructField("_values", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, len(names))
            base, values = tree_values(np.asfortranarray(x), found)
            made = [np.full(len(x), base), tree_margins(x, found)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(names), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in key], *map(pa.array, made), lists], names=schema.names)

    each = [F.struct(F.lit(n).alias("feature"), F.col("_values")[i].alias("value")) for i, n in enumerate(names)]
    return kept.mapInArrow(run, schema).select(*key, "base", "margin", F.array(*each).alias("contributions"))


def source_importance(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """source, total, mean, largest, n_transformed and importance_rank of a table (feature, importance) by a mapping (feature, source); both are small."""
    sums = table.join(F.broadcast(mapping), "feature").groupBy("source").agg(F.sum("importance").alias("total"), F.avg("importance").alias("mean"), F.max("importance").alias("largest"), F.count("*").alias("n_transformed"))
    ranked = sums.withColumn("importance_rank", F.row_number().over(Window.orderBy(F.desc("total"), "source")))
    return ranked.withColumns({c: F.round(c, 6) for c in ("total", "mean", "largest")})


def by_source(rows: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """rows whose contributions are summed to source features within each row."""
    total = lambda names: F.aggregate(F.filter("contributions", lambda c: c["feature"].isin(names)), F.lit(0.0), lambda s, c: s + c["value"])
    return rows.withColumn("contributions", F.array(*[F.struct(F.lit(source).alias("feature"), total(names).alias("value")) for source, names in groups.items()]))


def stratified_share(rows: DataFrame, by: list[str], key: str, share: float, most: int, seed: int) -> DataFrame:
    """Of each stratum the round(share * n) rows, `most` at most (the cap is the sample's size), of the smallest hash of key and seed."""
    sizes = rows.groupBy(*by).agg(F.least(F.round(F.count("*") * share), F.lit(most)).cast("long").alias("_quota"))
    return least_hashed(rows, by, key, sizes, seed)


def subgroup_summaries(rows: DataFrame, dimensions: list[str], value: Column) -> DataFrame:
    """dimension, value, n, share, mean, std (population), median, p75, p90 and the three features with the largest mean absolute contribution; no outcome is read."""
    part = lambda d: F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
    long = rows.select(F.inline(F.array(*map(part, dimensions))), value.alias("score"), "contributions")
    total = rows.agg(F.count("*").alias("total"))
    sums = long.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    found = quantiles(long, ["dimension", "value"], "score", (0.5, 0.75, 0.9)).select(F.col("dimension").alias("_d"), F.col("value").alias("_v"), "_quantiles")
    sums = sums.join(found, F.col("dimension").eqNullSafe(F.col("_d")) & F.col("value").eqNullSafe(F.col("_v")), "left")
    each = long.select("dimension", "value", F.inline("contributions").alias("feature", "c")).groupBy("dimension", "value", "feature").agg(F.avg(F.abs("c")).alias("a"))
    top = each.groupBy("dimension", "value").agg(F.array_sort(F.collect_list(F.struct((-F.round("a", 9)).alias("a"), "feature"))).alias("f"))  # one entry a feature
    top = top.select("dimension", "value", F.array_join(F.transform(F.slice("f", 1, 3), lambda x: x["feature"]), ",").alias("drivers"))
    out = sums.join(top, ["dimension", "value"]).crossJoin(F.broadcast(total))
    q = lambda i, n: F.round(F.col("_quantiles")[i], 6).alias(n)
    return out.select("dimension", "value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), q(0, "median"), q(1, "p75"), q(2, "p90"), "drivers")
