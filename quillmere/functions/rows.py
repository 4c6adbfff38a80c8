"""Functions of single rows: flags, labels, classes and geometry texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision_class(status: Column) -> Column:
    """exact, day, year or unknown of a parsing status."""
    return F.when(status == "precise", "exact").when(status == "date_only", "day").when(status == "imprecise_year", "year").otherwise("unknown")


def asset_date(raw: Column) -> Column:
    """A struct of day and status of a date kept as 14 or 8 digits, an ISO day, or a year; 0, blank and inconnu are missing."""
    x = F.trim(raw.cast("string"))
    gone = x.isNull() | x.isin("", "0") | (F.lower(x) == "inconnu")
    whole = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ("yyyyMMddHHmmss", "yyyyMMdd", "yyyy-MM-dd")]).cast("date")
    year = F.regexp_extract(x, r"(?:^|[^0-9])((?:19|20)[0-9]{2})", 1)
    status = F.when(gone, "missing").when(whole.isNotNull(), "date_only").when(year != "", "imprecise_year").otherwise("parse_failure")
    return F.struct(F.when(status == "date_only", whole).when(status == "imprecise_year", F.make_date(year.try_cast("int"), F.lit(1), F.lit(1))).alias("day"), status.alias("status"))


def resurfacing_interval(raw: Column) -> Column:
    """A struct of lower, upper and precision of a resurfacing date of 14 digits: those that end in 0101000000 or 0701000000 tell the year alone."""
    x = F.trim(raw)
    day = F.try_to_timestamp(F.substring(x, 1, 8), F.lit("yyyyMMdd")).cast("date")
    coarse = x.endswith("0101000000") | x.endswith("0701000000")
    lower = F.when(coarse, F.trunc(day, "year")).otherwise(day)
    upper = F.when(coarse, F.make_date(F.year(day), F.lit(12), F.lit(31))).otherwise(day)
    return F.struct(lower.alias("lower"), upper.alias("upper"), F.when(day.isNull(), "missing").when(coarse, "year").otherwise("exact").alias("precision"))


def precision_flags(precision: Column) -> dict[str, Column]:
    """Flags of a date's precision: known to the day, a stand-in for a longer time, unknown."""
    p = F.coalesce(precision, F.lit("missing"))
    return {"exact_flag": (p == "exact").cast("int"), "proxy_flag": p.isin("month", "year", "5y", "10y").cast("int"), "unknown_flag": (~p.isin("exact", "month", "year", "5y", "10y")).cast("int")}


def split_stamp(raw: Column, iso: Column) -> Column:
    """A struct of raw, day_text and time_text: parted at T where `iso`, else at the first blank."""
    x = F.trim(raw)
    at = F.when(iso, F.split(x, "T", 2)).otherwise(F.split(x, r"\s+", 2))
    return F.struct(raw.alias("raw"), F.get(at, F.lit(0)).alias("day_text"), F.get(at, F.lit(1)).alias("time_text"))


def flexible_stamp(raw: Column) -> Column:
    """A timestamp without zone, with T or a blank, and any number of digits of a second; null where it is none."""
    return F.regexp_replace(F.trim(raw), "T", " ").try_cast("timestamp_ntz")


def event_calendar(day: Column, source_year: Column) -> dict[str, Column]:
    """Year, month and month's start of an event, and whether its year is that of its file: match, mismatch or unknown."""
    status = F.when(day.isNull() | source_year.isNull(), "unknown").when(F.year(day) == source_year, "match").otherwise("mismatch")
    return {"event_year": F.year(day), "event_month": F.month(day), "month_start": F.trunc(day, "month"), "year_status": status}


def campaign_scope(label: Column, arterial: tuple[str, ...], local: tuple[str, ...]) -> Column:
    return F.when(label.isin(*arterial), "arterial").when(label.isin(*local), "local").otherwise("unknown")


def row_parse(day: Column, time: Column, x: Column, y: Column) -> Column:
    """A struct that says of a raw row whether its day, time and coordinates can be read, and the time's form (h:m:s, h:m, none)."""
    form = F.when(time.rlike(r"^\d{1,2}:\d{2}:\d{2}$"), "h:m:s").when(time.rlike(r"^\d{1,2}:\d{2}$"), "h:m").otherwise("none")
    ok_time = F.coalesce(F.try_to_timestamp(time, F.lit("H:mm:ss")), F.try_to_timestamp(time, F.lit("H:mm"))).isNotNull()
    ok_xy = x.try_cast("double").isNotNull() & y.try_cast("double").isNotNull()
    return F.struct(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull().alias("day"), ok_time.alias("time"), ok_xy.alias("place"), form.alias("time_form"))


def sentinel_flag(index: Column, state: Column) -> Column:
    """1 where an index of 0 stands with the state "-": not measured."""
    return ((index == 0) & (F.trim(state) == "-")).cast("int")


def period_labels(day: Column) -> dict[str, Column]:
    return {"quarter": F.concat(F.lit("Q"), F.quarter(day).cast("string")), "year_label": F.year(day).cast("string")}


def source_features(transformed: DataFrame, sources: DataFrame) -> DataFrame:
    """(transformed, source): the longest source name that a transformed name is, or begins with before `_`; null where there is none. Both are small tables of names."""
    hit = (F.col("transformed") == F.col("source")) | F.col("transformed").startswith(F.concat(F.col("source"), F.lit("_")))
    return transformed.join(F.broadcast(sources), hit, "left").groupBy("transformed").agg(F.max_by("source", F.length("source")).alias("source"))


def point_text(x: Column, y: Column) -> Column:
    """The WKT of a point."""
    return F.when(x.isNotNull() & y.isNotNull(), F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")")))


def line_length(line: str) -> Column:
    """The length of an array of (x, y)."""
    step = F.zip_with(line, F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.coalesce(F.hypot(b["x"] - a["x"], b["y"] - a["y"]), F.lit(0.0)))
    return F.aggregate(step, F.lit(0.0), lambda s, v: s + v)
