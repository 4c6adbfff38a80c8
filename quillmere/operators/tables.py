"""Guards, fingerprints and small table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_forbidden(df: DataFrame, parts: tuple[str, ...] = ("target", "eligible", "outcome"), allowed: tuple[str, ...] = ()) -> DataFrame:
    """df, or ValueError where a column name holds one of `parts` and isn't allowed."""
    bad = [c for c in df.columns if c not in allowed and any(p in c.lower() for p in parts)]
    if bad:
        raise ValueError(f"columns that tell the outcome: {bad}")
    return df


def exactly(df: DataFrame, columns: list[str]) -> DataFrame:
    """df projected on `columns`, or ValueError where it lacks one or has others."""
    if set(df.columns) != set(columns):
        raise ValueError(f"missing {sorted(set(columns) - set(df.columns))}, not listed {sorted(set(df.columns) - set(columns))}")
    return df.select(*columns)


def filled(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """df with -1 for missing numbers and "missing" for missing categories."""
    return df.na.fill(-1, numbers).na.fill("missing", categories)


def chosen(df: DataFrame, among: dict[str, list], between: dict[str, tuple]) -> DataFrame:
    """Rows whose values are all among the given ones (an empty list lets all through) and within the given bounds."""
    for c, values in among.items():
        df = df.filter(F.col(c).isin(values)) if values else df
    for c, (low, high) in between.items():
        df = df.filter(F.col(c).between(low, high))
    return df


def fingerprint(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, n_rows, total and parity: sum and exclusive or of 48-bit row hashes, which the order of rows doesn't change. Nulls differ from empty texts."""
    field = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *map(field, columns))), 1, 12), 16, 10).cast("long")
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(h).alias("parity"))


def partition_audit(rows: DataFrame, partition: str, key: str, day: str) -> DataFrame:
    """partition, n_rows, n_keys, repeated_keys and days_ahead (rows with a day after the partition's own)."""
    return rows.groupBy(partition, key).agg(F.count("*").alias("n"), F.count_if(F.col(day) > F.col(partition)).alias("ahead")).groupBy(partition).agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.sum("ahead").alias("days_ahead")
    )


def partition_manifest(rows: DataFrame, partition: str, key: str, day: str, eligible: str, columns: list[str]) -> DataFrame:
    """The audit of each partition with its eligible rows and its fingerprint, in one table."""
    sums = rows.groupBy(partition).agg(F.sum(eligible).cast("long").alias("n_eligible"))
    prints = fingerprint(rows, [partition], columns).drop("n_rows")
    return partition_audit(rows, partition, key, day).join(sums, partition).join(prints, partition)


def domain_coverage(values: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """value and status (not_listed or unused) of values without a reference, and the other way round."""
    a, b = (d.select(F.col(column).alias("value")).filter("value is not null").distinct() for d in (values, reference))
    return a.join(b, "value", "left_anti").withColumn("status", F.lit("not_listed")).unionByName(b.join(a, "value", "left_anti").withColumn("status", F.lit("unused")))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by `order`, by an aggregate: no key's rows are sorted."""
    kept = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return kept.select("_row.*")


def observed(day: Column, first: Column, window: int) -> Column:
    """Days of a trailing window that lie after the first observation."""
    return F.least(F.lit(window), F.greatest(F.lit(0), F.datediff(day, first) + 1))


def window_coverage(anchors: DataFrame, day: str, first: str, windows: tuple[int, ...]) -> DataFrame:
    """anchors with valid_days_<w>d (days of the trailing window since the first observation), coverage_ratio_<w>d and complete_<w>d for each of `windows`; all 0 where nothing was ever observed."""
    out = {}
    for w in windows:
        days = F.when(F.col(first).isNull(), 0).otherwise(observed(F.col(day), F.col(first), w))
        out |= {f"valid_days_{w}d": days, f"coverage_ratio_{w}d": F.round(days / w, 6), f"complete_{w}d": (days == w).cast("int")}
    return anchors.withColumns(out)


def active_months(events: DataFrame, key: str, day: str, at: str) -> DataFrame:
    """key, n_months: distinct months with an event among the twelve up to that of `at` (ISO), none after it."""
    end = F.lit(at).cast("date")
    inside = events.filter((F.col(day) <= end) & (F.col(day) >= F.trunc(F.add_months(end, -11), "month")))
    return inside.groupBy(key).agg(F.count_distinct(F.trunc(day, "month")).alias("n_months"))
