"""Dates of mixed precision as columns: parsing with a status, time zones, intervals that a date lies in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column, with_time: tuple[str, ...], dates: tuple[str, ...], missing: tuple[str, ...] = ("0",)) -> Column:
    """A struct of `at` (timestamp without zone), `day` and `status` of a text.

    precise: day and time by one of `with_time`; date_only: by one of `dates`; imprecise_year: only a
    year from 1900 to 2099 is found (its first day); missing: null, blank or one of `missing`;
    parse_failure: none of these.
    """
    x = F.trim(c)
    ntz = lambda f: F.try_to_timestamp(x, F.lit(f)).cast("timestamp_ntz")
    gone = x.isNull() | (x == "") | F.lower(x).isin(*missing)
    at, day = F.coalesce(*map(ntz, with_time)), F.coalesce(*map(ntz, dates)).cast("date")
    year = F.regexp_extract(x, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:$|[^0-9])", 1)
    status = F.when(gone, "missing").when(at.isNotNull(), "precise").when(day.isNotNull(), "date_only").when(year != "", "imprecise_year").otherwise("parse_failure")
    found = F.when(gone, None).when(at.isNotNull(), at.cast("date")).when(day.isNotNull(), day).when(year != "", F.make_date(year.try_cast("int"), F.lit(1), F.lit(1)))
    return F.struct(F.when(~gone, at).alias("at"), found.alias("day"), status.alias("status"))


def localised(at: Column, zone: str) -> Column:
    """A struct of `utc` and `status` of a local time without zone: successfully_localized, ambiguous_dst, nonexistent_dst (both without utc) or missing."""
    move = lambda a, b, x: F.convert_timezone(F.lit(a), F.lit(b), x)
    utc = move(zone, "UTC", at)
    back = lambda hours: move("UTC", zone, utc + F.expr(f"interval {hours} hours"))
    status = F.when(at.isNull(), "missing").when(back(0) != at, "nonexistent_dst").when((back(1) == at) | (back(-1) == at), "ambiguous_dst").otherwise("successfully_localized")
    return F.struct(F.when(status == "successfully_localized", utc).alias("utc"), status.alias("status"))


def interval_around(day: Column, precision: Column) -> Column:
    """A struct of `lower` and `upper` of a date known to a precision: exact, month, year, or `<n>y` (n years either way); null for others."""
    years = F.regexp_extract(precision, "^([0-9]+)y$", 1).try_cast("int")
    start, end = F.trunc(day, "year"), F.make_date(F.year(day), F.lit(12), F.lit(31))
    lower = F.when(precision == "exact", day).when(precision == "month", F.trunc(day, "month")).when(precision == "year", start).when(years.isNotNull(), F.add_months(day, -12 * years))
    upper = F.when(precision == "exact", day).when(precision == "month", F.last_day(day)).when(precision == "year", end).when(years.isNotNull(), F.add_months(day, 12 * years))
    return F.struct(lower.alias("lower"), upper.alias("upper"))


def contradiction(before: Column, after: Column) -> Column:
    """Of two intervals of which the first ought to come first: missing_date, none, confirmed (it can't) or possible."""
    gone = before["lower"].isNull() | after["lower"].isNull()
    return F.when(gone, "missing_date").when(before["lower"] > after["upper"], "confirmed").when(before["upper"] > after["lower"], "possible").otherwise("none")


def age_years(day: Column, at: Column) -> Column:
    return F.datediff(at, day) / 365.25


def days_of_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
