"""Gaps between events as survival data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.operators.ordering import prefix_sum


def cohort(events: DataFrame, key: str, day: str, end: str) -> DataFrame:
    """key, interval_index, start_date, duration_days and event_observed: gaps between distinct days (1), and the last one up to `end` (0), if longer than nothing."""
    w = Window.partitionBy(key).orderBy(day)
    rows = events.select(key, day).distinct().select(key, F.col(day).alias("start_date"), F.lead(day).over(w).alias("next"), F.row_number().over(w).alias("interval_index"))
    rows = rows.withColumns({"event_observed": F.col("next").isNotNull().cast("int"), "duration_days": F.datediff(F.coalesce("next", F.lit(end).cast("date")), "start_date")})
    return rows.filter("duration_days > 0").select(key, "interval_index", "start_date", "duration_days", "event_observed")


def kaplan_meier(rows: DataFrame, by: str) -> DataFrame:
    """by, duration_days, at_risk, events, survival and greenwood at each time, times of censoring included; the variance skips at_risk = events."""
    cells = rows.groupBy(by, "duration_days").agg(F.count("*").alias("m"), F.sum("event_observed").cast("long").alias("events"))
    back = Window.partitionBy(by).orderBy(F.desc("duration_days")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy("duration_days").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("at_risk", F.sum("m").over(back))
    step = F.when(F.col("at_risk") == F.col("events"), 0.0).otherwise(F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events"))))
    cells = cells.withColumns({"survival": F.product(1 - F.col("events") / F.col("at_risk")).over(ahead), "step": F.sum(step).over(ahead)})
    return cells.select(by, "duration_days", "at_risk", "events", F.round("survival", 6).alias("survival"), F.round(F.col("survival") * F.col("survival") * F.col("step"), 8).alias("greenwood"))


def kaplan_meier_exact(rows: DataFrame, by: str) -> DataFrame:
    """by, duration_days, at_risk, events, survival and variance_sum (of the increments), not rounded. The windows run over distinct durations of a class."""
    cells = rows.groupBy(by, "duration_days").agg(F.count("*").alias("m"), F.sum("event_observed").cast("long").alias("events"))
    back = Window.partitionBy(by).orderBy(F.desc("duration_days")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy("duration_days").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("at_risk", F.sum("m").over(back))
    step = F.when(F.col("at_risk") == F.col("events"), 0.0).otherwise(F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events"))))
    return cells.select(by, "duration_days", "at_risk", "events", F.product(1 - F.col("events") / F.col("at_risk")).over(ahead).alias("survival"), F.sum(step).over(ahead).alias("variance_sum"))


def with_interval(curve: DataFrame, z: float = 1.96) -> DataFrame:
    """A curve with low and high: the normal interval of the survival, kept within 0 and 1."""
    wide = z * F.col("survival") * F.sqrt("variance_sum")
    return curve.withColumns({"low": F.greatest(F.lit(0.0), F.col("survival") - wide), "high": F.least(F.lit(1.0), F.col("survival") + wide)})


def median_survival(curve: DataFrame, by: str) -> DataFrame:
    """by and median_days: the first duration at which survival is one half or less; null where it stays above."""
    return curve.groupBy(by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("duration_days"))).alias("median_days"))


def largest_classes(rows: DataFrame, by: str, least_events: int = 300, most: int = 5) -> DataFrame:
    """The rows of the `most` classes with most events, of those with `least_events` at least (the report's size is its feature)."""
    counts = rows.groupBy(by).agg(F.sum("event_observed").alias("_events")).filter(F.col("_events") >= least_events)
    return rows.join(F.broadcast(counts.orderBy(F.desc("_events"), by).limit(most).select(by)), by, "left_semi")


def log_rank_p(table: DataFrame) -> DataFrame:
    """A log-rank table with p_value: the tail of chi2 with one degree of freedom, of its one row."""
    chi2 = table.first()["chi2"]
    return table.withColumn("p_value", F.lit(None if chi2 is None else round(math.erfc(math.sqrt(chi2 / 2)), 6)).cast("double"))


def log_rank(rows: DataFrame, group: str) -> DataFrame:
    """observed, expected, variance and chi2 of two groups (column `group`, 1 or 0); times with one at risk are left out."""
    cells = rows.groupBy("duration_days").agg(F.count("*").alias("m"), F.sum(group).alias("ma"), F.sum("event_observed").alias("d"), F.sum(F.col("event_observed") * F.col(group)).alias("da"))
    back = Window.orderBy(F.desc("duration_days")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each distinct duration, of which days bound the number
    cells = cells.withColumns({"n": F.sum("m").over(back), "na": F.sum("ma").over(back)}).filter("n > 1")
    n, na, d = (F.col(c).cast("double") for c in ("n", "na", "d"))  # products of four counts pass 64 bits
    v = na * (n - na) * d * (n - d) / (n * n * (n - 1))
    s = cells.agg(F.sum("da").cast("long").alias("observed"), F.sum(d * na / n).alias("expected"), F.sum(v).alias("variance"))
    return s.select("observed", F.round("expected", 6).alias("expected"), F.round("variance", 6).alias("variance"), F.round((F.col("observed") - F.col("expected")) ** 2 / F.col("variance"), 6).alias("chi2"))


def concordance(rows: DataFrame, duration: str, event: str, score: str, bits: int | None = None) -> DataFrame:
    """pairs, concordant, tied and c_index (Harrell): of two rows of which one is known to fail first, has it the higher score? Tied scores count half.

    A row with an event comes before all that last longer or are censored on that day. Two such places
    (of so many bits as the longest duration takes, unless given; ValueError where that is too few) first differ at one bit: at each bit, cells that agree above it are counted by score,
    so no pairs are formed and work grows with cells * bits.
    """
    longest = rows.agg(F.max((F.col(duration) * 2 + 1 - F.col(event)).cast("long"))).first()[0] or 0
    needed = max(1, int(longest).bit_length())
    if bits is not None and bits < needed:
        raise ValueError(f"durations take {needed} bits, not {bits}")
    bits = needed
    cells = rows.groupBy((F.col(duration) * 2 + 1 - F.col(event)).cast("long").alias("at"), F.col(score).alias("score")).agg(F.count("*").alias("m"))
    levels = cells.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    one = F.expr("shiftright(at, bit) & 1") == 1
    levels = levels.groupBy("bit", F.expr("shiftright(at, bit + 1)").alias("above"), "score").agg(F.sum(F.when(~one & (F.col("at") % 2 == 0), F.col("m")).otherwise(0)).alias("first"), F.sum(F.when(one, F.col("m")).otherwise(0)).alias("later"))
    sums = prefix_sum(levels, ["bit", "above"], "score", ["first"])
    each = sums.groupBy("bit", "above").agg(F.sum(F.col("later") * (F.col("first_to") - F.col("first"))).alias("concordant"), F.sum(F.col("later") * F.col("first")).alias("tied"), (F.sum("first") * F.sum("later")).alias("pairs"))
    total = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("pairs", "concordant", "tied")])
    return total.withColumn("c_index", F.round(F.try_divide(F.col("concordant") + F.col("tied") / 2, "pairs"), 6))
