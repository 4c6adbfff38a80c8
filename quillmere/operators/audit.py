"""Duplicates, profiles, coverage and comparison of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.operators.quantiles import quantiles


def collapsed(events: DataFrame, keys: list[str], first: str) -> DataFrame:
    """One row per key: the smallest `first` and the multiplicity."""
    return events.groupBy(*keys).agg(F.min(first).alias("kept_id"), F.count("*").alias("multiplicity"))


def duplicate_flags(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with is_duplicate: 1 for all of a key but the first in `order`."""
    return rows.withColumn("is_duplicate", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1).cast("int"))


def duplicate_profile(rows: DataFrame, key_sets: dict[str, list[str]]) -> DataFrame:
    """key_set, groups, duplicate_groups, excess_rows and largest_group for each set of columns."""
    one = lambda name, keys: rows.groupBy(*keys).count().agg(F.lit(name).alias("key_set"), F.count("*").alias("groups"), F.count_if(F.col("count") > 1).alias("duplicate_groups"), F.sum(F.col("count") - 1).alias("excess_rows"), F.max("count").alias("largest_group"))
    return reduce(DataFrame.union, [one(n, k).select("key_set", "groups", "duplicate_groups", "excess_rows", "largest_group") for n, k in key_sets.items()])


def column_profile(rows: DataFrame) -> DataFrame:
    """column_name, n_rows, n_null, n_blank and n_distinct, one pass over the table."""
    names = rows.columns
    text = lambda c: F.col(c).cast("string")
    aggs = [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.trim(text(c)) == "").alias("n_blank"), F.count_distinct(c).alias("n_distinct")).alias(f"_{i}") for i, c in enumerate(names)]
    return rows.agg(*aggs).select(F.explode(F.array(*[f"_{i}" for i in range(len(names))])).alias("x")).select("x.*")


def numeric_profile(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, extremes, mean and interpolated percentiles of a number in each group."""
    found = quantiles(rows, [by], value, (0.1, 0.25, 0.5, 0.75, 0.9)).select(F.col(by).alias("_by"), "_quantiles")
    out = rows.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"))
    out = out.join(found, F.col(by).eqNullSafe(F.col("_by")), "left")
    return out.select(by, "n", "min", "max", "mean", *[F.round(F.col("_quantiles")[i], 6).alias(c) for i, c in enumerate(("p10", "p25", "p50", "p75", "p90"))])


def compare_versions(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """status (missing, extra, changed, same) and rows, null-safe."""
    a, b = (d.select(key, F.struct(*columns).alias(n)) for d, n in ((old, "_a"), (new, "_b")))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").otherwise("same")
    return a.join(b, key, "full").groupBy(status.alias("status")).agg(F.count("*").alias("n_rows"))


def formula_safe(rows: DataFrame) -> DataFrame:
    """Strings that a spreadsheet would take for a formula get an apostrophe in front."""
    kinds = dict(rows.dtypes)
    return rows.select(*[F.when(F.col(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in rows.columns])


def fallback(primary: DataFrame, secondary: DataFrame, day: str, values: list[str], allowed: list[str], first: str, last: str) -> DataFrame:
    """A full calendar with each value of the primary source, or for allowed ones of the secondary, and <value>_fallback_used."""
    days = primary.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day))
    other = secondary.select(day, *[F.col(v).alias(f"_{v}") for v in values])
    out = days.join(primary.select(day, *values), day, "left").join(other, day, "left")
    cols = [day]
    for v in values:
        use = F.col(v).isNull() & F.col(f"_{v}").isNotNull() & F.lit(v in allowed)
        cols += [F.when(use, F.col(f"_{v}")).otherwise(F.col(v)).alias(v), use.cast("int").alias(f"{v}_fallback_used")]
    return out.select(*cols)


def group_prevalence(rows: DataFrame, by: str, label: str, least: int) -> DataFrame:
    """by, n, pos, prevalence and enough (n >= least); no group is dropped."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("pos"), F.round(F.avg(label), 6).alias("prevalence"), (F.count("*") >= least).alias("enough"))
