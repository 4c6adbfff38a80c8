"""Daily measurements of stations: windows behind month-ends, yearly counts, audits and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.operators.panel import _at


def freeze_thaw(low: Column, high: Column) -> dict[str, Column]:
    """Three readings of a day that freezes and thaws, null where a temperature is."""
    known = low.isNotNull() & high.isNotNull()
    return {"strict": F.when(known, (low < 0) & (high > 0)), "low_at_most_0": F.when(known, (low <= 0) & (high > 0)), "high_at_least_0": F.when(known, (low < 0) & (high >= 0))}


def trailing_weather(daily: DataFrame, day: str, windows: tuple[int, ...]) -> DataFrame:
    """as_of_date and, for each window (t - W, t], rain_<W>d, mean_<W>d, low_<W>d, high_<W>d, freeze_thaw_<W>d, days_<W>d and coverage_<W>d.

    daily: one row a day with rain, low, mean and high. Each day goes to the month-ends it matters to.
    """
    rows = _at(daily, F.col(day), F.date_add(day, max(windows) - 1)).withColumn("_frozen", freeze_thaw(F.col("low"), F.col("high"))["strict"])
    age, out = F.datediff("as_of_date", day), []
    for w in windows:
        of = lambda c, w=w: F.when(age < w, F.col(c))
        days = F.count(of("mean"))
        out += [F.sum(of("rain")).alias(f"rain_{w}d"), F.avg(of("mean")).alias(f"mean_{w}d"), F.min(of("low")).alias(f"low_{w}d"), F.max(of("high")).alias(f"high_{w}d")]
        out += [F.count_if((age < w) & F.col("_frozen")).alias(f"freeze_thaw_{w}d"), days.alias(f"days_{w}d"), (days / w).alias(f"coverage_{w}d")]
    return rows.groupBy("as_of_date").agg(*out)


def weather_features(daily: DataFrame, day: str, windows: tuple[int, ...]) -> DataFrame:
    """as_of_date and, for each window (t - W, t], the sums, means and extremes of its known days, and how far these can be trusted.

    daily: one row a day with rain, low, mean and high, and for any of them <value>_fallback_used (0 or 1; none counts as 0).
    Sums are null where no day is known. valid_days counts days with rain; complete is 1 where these are all W; each
    reading of freeze and thaw is summed over days with both temperatures; <value>_fallback_days tells how many days came from
    the second source.
    """
    reads = {f"_{n}": c.cast("int") for n, c in freeze_thaw(F.col("low"), F.col("high")).items()}
    rows = _at(daily, F.col(day), F.date_add(day, max(windows) - 1)).withColumns(reads)
    age, out = F.datediff("as_of_date", day), []
    for w in windows:
        of = lambda c, w=w: F.when(age < w, F.col(c))
        valid = F.count(of("rain"))
        out += [F.sum(of("rain")).alias(f"rain_{w}d"), F.avg(of("mean")).alias(f"mean_{w}d"), F.min(of("low")).alias(f"low_{w}d"), F.max(of("high")).alias(f"high_{w}d")]
        out += [F.sum(of(c)).alias(f"freeze_thaw{c}_{w}d") for c in reads]
        out += [valid.alias(f"valid_days_{w}d"), (valid / w).alias(f"coverage_{w}d"), (valid == w).cast("int").alias(f"complete_{w}d")]
        for c in ("rain", "low", "mean", "high"):
            used = f"{c}_fallback_used"
            out.append((F.coalesce(F.sum(of(used)), F.lit(0)) if used in daily.columns else F.lit(0)).cast("long").alias(f"{c}_fallback_days_{w}d"))
    return rows.groupBy("as_of_date").agg(*out)


def freeze_thaw_years(daily: DataFrame, by: str, day: str) -> DataFrame:
    """by, year, n_days, missing_days and the days of each reading of freeze and thaw."""
    reads = freeze_thaw(F.col("low"), F.col("high"))
    return daily.groupBy(by, F.year(day).alias("year")).agg(F.count("*").alias("n_days"), F.count_if(F.col("low").isNull() | F.col("high").isNull()).alias("missing_days"), *[F.count_if(c).alias(n) for n, c in reads.items()])


def date_audit(rows: DataFrame, by: str, day: str) -> DataFrame:
    """by, year, expected_days (of the year), present_days, duplicate_rows and missing_days."""
    days = rows.groupBy(by, F.col(day).alias("_day")).count().groupBy(by, F.year("_day").alias("year")).agg(F.count("*").alias("present_days"), F.sum(F.col("count") - 1).alias("duplicate_rows"))
    expected = F.dayofyear(F.make_date(F.col("year"), F.lit(12), F.lit(31)))
    return days.select(by, "year", expected.alias("expected_days"), "present_days", "duplicate_rows", (expected - F.col("present_days")).alias("missing_days"))


def compared(a: DataFrame, b: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """column_name, n_common, mean_difference, correlation, only_a and only_b of two stations by day (days where both, or one, has the value)."""
    pairs = a.select(day, *[F.col(c).alias(f"_a_{c}") for c in columns]).join(b.select(day, *[F.col(c).alias(f"_b_{c}") for c in columns]), day, "full")
    row = lambda c: F.struct(F.lit(c).alias("column_name"), F.col(f"_a_{c}").cast("double").alias("a"), F.col(f"_b_{c}").cast("double").alias("b"))
    long = pairs.select(F.inline(F.array(*[row(c) for c in columns])))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    only = lambda x, y: F.count_if(F.col(x).isNotNull() & F.col(y).isNull())
    return long.groupBy("column_name").agg(F.count_if(both).alias("n_common"), F.avg(F.col("a") - F.col("b")).alias("mean_difference"), F.corr("a", "b").alias("correlation"), only("a", "b").alias("only_a"), only("b", "a").alias("only_b"))
