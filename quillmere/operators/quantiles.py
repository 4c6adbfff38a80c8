"""Exact quantiles and places of rows in a total order, from counts of values in ranges: no group is sorted, or held, in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators.ordering import _same, prefix_sum


def quantiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(*by, _n, _quantiles): how many values each group has, and an array of the quantile at each share, interpolated between neighbours.

    Nulls are left out, a null in `by` is a group of its own; a group without values has no row, and no rows at all give none.
    """
    cells = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_measure")).agg(F.count("*").alias("_rows"))
    totals = cells.groupBy(*by).agg(F.sum("_rows").alias("_total")).filter("_total > 0").withColumnsRenamed({c: f"_{c}" for c in by})
    reached = prefix_sum(cells, by, "_measure", ["_rows"])
    reached = reached.join(totals, _same(reached, totals, by)) if by else reached.crossJoin(F.broadcast(totals))
    up_to = F.col("_total") - F.col("_rows_to") + F.col("_rows")  # rows with a value no larger
    at = [(F.col("_total") - 1) * s for s in shares]
    first = lambda place: F.min(F.when(up_to > place, F.col("_measure")))
    ends = [F.struct(first(F.floor(p)).alias("a"), first(F.ceil(p)).alias("b"), F.max(p - F.floor(p)).alias("part")) for p in at]
    found = reached.groupBy(*by).agg(F.max("_total").alias("_n"), F.array(*ends).alias("_ends")).filter("_n is not null")
    return found.select(*by, "_n", F.transform("_ends", lambda e: e["a"] + (e["b"] - e["a"]) * e["part"]).alias("_quantiles"))


def top_percent(rows: DataFrame, score: str, key: str, percent: float) -> DataFrame:
    """The ceil(n * percent / 100) rows of the highest score, ties by the smallest `key`, with place (from 1) and rank_percentile, (1 - place / n) * 100.

    `key` is a unique number. Rows without a score are neither counted nor listed.
    """
    rows = rows.filter(F.col(score).isNotNull())
    n = rows.count()
    most = math.ceil(n * percent / 100)
    cells = prefix_sum(rows.groupBy(score).agg(F.count("*").alias("_n")), [], score, ["_n"])
    above = cells.select(F.col(score).alias("_score"), (F.col("_n_to") - F.col("_n")).alias("_above")).filter(F.col("_above") < most)
    listed = rows.join(above, F.col(score) == F.col("_score")).withColumns({"_key": -F.col(key), "_one": F.lit(1)})
    placed = prefix_sum(listed, ["_score"], "_key", ["_one"]).withColumn("place", F.col("_above") + F.col("_one_to"))
    placed = placed.filter(F.col("place") <= most).withColumn("rank_percentile", F.round((1 - F.col("place") / n) * 100, 2))
    return placed.drop("_score", "_above", "_key", "_one", "_one_to")
