"""Chronological splits without overlap of outcome windows, and baselines that a model has to beat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_of(day: Column, horizon: int, val_first: str, test_first: str) -> Column:
    """A struct of `split` (train, val, test or purged) and `reason` of a row whose outcome is known `horizon` days after `day`.

    A row whose outcome window reaches into the next split is purged.
    """
    val, test, end = F.lit(val_first).cast("date"), F.lit(test_first).cast("date"), F.date_add(day, horizon)
    into_val, into_test = (day < val) & (end >= val), (day >= val) & (day < test) & (end >= test)
    split = F.when(into_val | into_test, "purged").when(day < val, "train").when(day < test, "val").otherwise("test")
    return F.struct(split.alias("split"), F.when(into_val, "reaches_val").when(into_test, "reaches_test").otherwise("kept").alias("reason"))


def purge_gaps(rows: DataFrame, day: str, split: str, horizon: int) -> DataFrame:
    """train_val_gap and val_test_gap: days from the last outcome of a split to the first row of the next; positive where nothing leaks."""
    last = lambda s: F.max(F.when(F.col(split) == s, F.date_add(day, horizon)))
    first = lambda s: F.min(F.when(F.col(split) == s, F.col(day)))
    return rows.agg(F.datediff(first("val"), last("train")).alias("train_val_gap"), F.datediff(first("test"), last("val")).alias("val_test_gap"))


def arithmetic(rows: DataFrame, split: str, expected: DataFrame) -> DataFrame:
    """part, found, expected and agrees of a table of anchors (one row each) against expected (part, expected): each side's parts are listed, and TOTAL."""
    found = rows.groupBy(F.col(split).alias("part")).agg(F.count("*").alias("found"))
    both = found.join(expected, "part", "full").select("part", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("found", "expected")])
    total = both.agg(F.lit("TOTAL").alias("part"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "expected")])
    return both.unionByName(total).withColumn("agrees", F.col("found") == F.col("expected"))


def class_prior(train: DataFrame, rows: DataFrame, by: str, label: str, least: int = 30) -> DataFrame:
    """rows with `score`: the rate of the class in train, or the rate of all of train where it has fewer than `least` rows."""
    rates = train.groupBy(by).agg(F.count("*").alias("_n"), F.avg(label).alias("_rate")).filter(F.col("_n") >= least)
    overall = train.agg(F.avg(label).alias("_all"))
    return rows.join(rates, by, "left").crossJoin(F.broadcast(overall)).withColumn("score", F.coalesce("_rate", "_all")).drop("_n", "_rate", "_all")


def entity_history(train: DataFrame, rows: DataFrame, key: str, label: str, alpha: float = 1.0) -> DataFrame:
    """rows with `score`: (positives + alpha) / (rows + 2 alpha) of the entity in train, or the rate of all of train for an entity that is not there."""
    rates = train.groupBy(key).agg(((F.sum(label) + alpha) / (F.count("*") + 2 * alpha)).alias("_rate"))
    overall = train.agg(F.avg(label).alias("_all"))
    return rows.join(rates, key, "left").crossJoin(F.broadcast(overall)).withColumn("score", F.coalesce("_rate", "_all")).drop("_rate", "_all")


def unseen(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_train, n_rows and n_unseen: distinct values of each column, and those that train does not have."""
    out = None
    for c in columns:
        a, b = (d.select(F.col(c).cast("string").alias("v")).filter("v is not null").distinct() for d in (train, rows))
        both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "v", "full").agg(F.count("a").alias("n_train"), F.count("b").alias("n_rows"), F.count_if(F.col("a").isNull()).alias("n_unseen"))
        row = both.select(F.lit(c).alias("column_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out
