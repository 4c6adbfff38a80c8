"""Entity x month-end panels: targets ahead, counts behind, as-of and validity joins.

No range joins: an event knows from its own day which month-ends it matters to, so each event is
exploded to these (at most W / 28 + 1) and joined by equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_ends(first: Column, last: Column) -> Column:
    """The month-ends from that of `first` to that of `last`, none if reversed."""
    months = F.when(F.last_day(first) <= F.last_day(last), F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")))
    return F.transform(F.coalesce(months, F.array().cast("array<date>")), lambda d: F.last_day(d))


def panel(entities: DataFrame, first: str, last: str) -> DataFrame:
    """One row per entity and month-end from first to last (ISO dates)."""
    return entities.withColumn("as_of_date", F.explode(month_ends(F.lit(first).cast("date"), F.lit(last).cast("date"))))


def _at(events: DataFrame, first: Column, last: Column) -> DataFrame:
    """events once for each month-end in [first, last]."""
    return events.withColumn("as_of_date", F.explode(F.filter(month_ends(first, last), lambda t: (t >= first) & (t <= last))))


def future_targets(events: DataFrame, key: str, day: str, horizons: tuple[int, ...]) -> DataFrame:
    """(key, as_of_date, target_<H>d = 1) where an event falls in (t, t + H]. One row for each key and month-end that any horizon hits."""
    far = max(horizons)
    rows = _at(events.select(key, day).distinct(), F.date_sub(day, far), F.date_sub(day, 1))
    ahead = F.datediff(day, "as_of_date")
    return rows.groupBy(key, "as_of_date").agg(*[F.max((ahead <= h).cast("int")).alias(f"target_{h}d") for h in horizons])


def trailing_counts(events: DataFrame, key: str, day: str, windows: tuple[int, ...]) -> DataFrame:
    """(key, as_of_date, events_<W>d, active_days_<W>d): events and their days in (t - W, t]. Events are summed by day first."""
    daily = events.groupBy(key, day).agg(F.count("*").alias("n"))
    rows = _at(daily, F.col(day), F.date_add(day, max(windows) - 1))
    age = F.datediff("as_of_date", day)
    sums = [x for w in windows for x in (F.sum(F.when(age < w, F.col("n")).otherwise(0)).alias(f"events_{w}d"), F.count_if(age < w).alias(f"active_days_{w}d"))]
    return rows.groupBy(key, "as_of_date").agg(*sums)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str]) -> DataFrame:
    """left with the `columns` of the latest right row of the same `by` keys and right_on <= left_on (null where there is none).

    Both sides are put into one stream by key and time, where the last right row is carried on: one shuffle, no range join.
    Of right rows with one key and time the largest by `columns` counts.
    """
    held = F.struct(F.col(right_on), *[F.col(c) for c in columns])
    both = right.select(*by, F.col(right_on).alias("_time"), F.lit(0).alias("_side"), held.alias("_held"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    mine = left.select(*by, F.col(left_on).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(both.schema["_held"].dataType).alias("_held"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy(*by).orderBy("_time", "_side", F.col("_held").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.union(mine).withColumn("_last", F.last("_held", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select("_row.*", f"_last.{right_on}", *[f"_last.{c}" for c in columns])


def validity(lower: Column, upper: Column, at: Column) -> Column:
    """Of an interval-valued date: active (known to lie before `at`), crosses, future or missing."""
    return F.when(lower.isNull() | upper.isNull(), "missing").when(upper <= at, "active").when(lower > at, "future").otherwise("crosses")


def with_row_id(rows: DataFrame, key: str, at: str = "as_of_date", name: str = "segment_month_id") -> DataFrame:
    """rows with `name`: key and month, `<key>_yyyy-MM`; null where one of them is."""
    return rows.withColumn(name, F.concat(F.col(key).cast("string"), F.lit("_"), F.date_format(at, "yyyy-MM")))


def asset_ages(rows: DataFrame, built: tuple[str, str], renewed: tuple[str, str], at: str = "as_of_date") -> DataFrame:
    """rows with the ages of what is known at `at` about two interval-valued dates (lower, upper), in years, and what is hidden.

    An age is given only where its whole interval lies at or before `at`: its lower one from the upper date, its upper one from
    the lower date. Flags are 1 for a construction after `at`, and for intervals that `at` cuts; a date with one bound only is missing.
    """
    day = F.col(at)
    out = {}
    for name, (lower, upper) in (("construction", built), ("resurfacing", renewed)):
        known = validity(F.col(lower), F.col(upper), day) == "active"
        out[f"years_since_{name}_lower"] = F.when(known, F.datediff(day, F.col(upper)) / 365.25)
        out[f"years_since_{name}_upper"] = F.when(known, F.datediff(day, F.col(lower)) / 365.25)
    status = validity(F.col(built[0]), F.col(built[1]), day)
    out["future_asset_record_hidden_flag"] = (status == "future").cast("int")
    out["age_interval_crosses_as_of_flag"] = (status == "crosses").cast("int")
    out["resurfacing_interval_crosses_as_of_flag"] = (validity(F.col(renewed[0]), F.col(renewed[1]), day) == "crosses").cast("int")
    return rows.withColumns(out | {"asset_temporal_eligibility_status": status})


def same_day(rows: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Rows of one key and day as one: count, median, min, max and population deviation of `value` (0 for one row)."""
    return rows.groupBy(key, day).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
