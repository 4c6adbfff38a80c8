"""Queries of panel features: asset ages, row ids, weather with a second source, and survival profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators import audit, models, panel, weather
from quillmere.plans.more import fitted
from quillmere.plans.registry import ANCHORS, FIRST, LAST, Tables, gaps, query
from quillmere.plans.wider import DAILY, daily

AGES = ("years_since_construction_lower", "years_since_construction_upper", "years_since_resurfacing_lower", "years_since_resurfacing_upper")
ASSETS = """s as (select o_custkey as entity, l_returnflag as f, l_shipdate::date as d from orders join lineitem on l_orderkey = o_orderkey),
a as (select entity, min(d) filter (where f = 'A') as c_lo, max(d) filter (where f = 'A') as c_hi, min(d) filter (where f = 'R') as r_lo, max(d) filter (where f = 'R') as r_hi from s group by 1)"""


def assets(t: Tables) -> DataFrame:
    """For each customer the first and last day of two kinds of shipments, as two interval-valued dates."""
    rows = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("entity"), "l_returnflag", F.col("l_shipdate").cast("date").alias("d"))
    of = lambda flag: F.when(F.col("l_returnflag") == flag, F.col("d"))
    return rows.groupBy("entity").agg(F.min(of("A")).alias("c_lo"), F.max(of("A")).alias("c_hi"), F.min(of("R")).alias("r_lo"), F.max(of("R")).alias("r_hi"))


def month_rows(t: Tables) -> DataFrame:
    return panel.panel(t("customer").select(F.col("c_custkey").alias("entity")), FIRST, LAST)


@query("c08_asset_ages", f"""with {ANCHORS}, {ASSETS},
p as (select c_custkey || '_' || strftime(t, '%Y-%m') as segment_month_id, t, c_lo, c_hi, r_lo, r_hi, c_lo is not null and c_hi is not null as c, r_lo is not null and r_hi is not null as r from customer cross join anchors left join a on entity = c_custkey)
select segment_month_id, round(case when c and c_hi <= t then (t - c_hi) / 365.25 end, 6) as years_since_construction_lower, round(case when c and c_hi <= t then (t - c_lo) / 365.25 end, 6) as years_since_construction_upper,
round(case when r and r_hi <= t then (t - r_hi) / 365.25 end, 6) as years_since_resurfacing_lower, round(case when r and r_hi <= t then (t - r_lo) / 365.25 end, 6) as years_since_resurfacing_upper,
(c and c_lo > t)::int as future_asset_record_hidden_flag, (c and c_lo <= t and t < c_hi)::int as age_interval_crosses_as_of_flag, (r and r_lo <= t and t < r_hi)::int as resurfacing_interval_crosses_as_of_flag,
case when not c then 'missing' when c_hi <= t then 'active' when c_lo > t then 'future' else 'crosses' end as asset_temporal_eligibility_status from p""")
def asset_ages(t: Tables) -> DataFrame:
    rows = panel.with_row_id(month_rows(t).join(assets(t), "entity", "left"), "entity")
    out = panel.asset_ages(rows, ("c_lo", "c_hi"), ("r_lo", "r_hi")).drop("entity", "as_of_date", "c_lo", "c_hi", "r_lo", "r_hi")
    return out.withColumns({c: F.round(c, 6) for c in AGES})


@query("h13_row_ids", f"""with {ANCHORS} select year(t)::int as year, count(*) as n, count(distinct c_custkey || '_' || strftime(t, '%Y-%m')) as n_ids, min(c_custkey || '_' || strftime(t, '%Y-%m')) as first_id, max(c_custkey || '_' || strftime(t, '%Y-%m')) as last_id from customer, anchors group by 1""")
def row_ids(t: Tables) -> DataFrame:
    """An entity and a month-end make one id, so ids are counted by entity, and only the first and last one of an entity's year are compared as texts."""
    entities = t("customer").select(F.col("c_custkey").alias("entity")).repartition(64, "entity").groupBy("entity").agg(F.count("*").alias("m"))
    years = panel.panel(entities, FIRST, LAST).groupBy("entity", "m", F.year("as_of_date").alias("year")).agg(F.count("*").alias("months"), F.min("as_of_date").alias("first"), F.max("as_of_date").alias("last"))
    ids = panel.with_row_id(panel.with_row_id(years, "entity", "first", "first_id"), "entity", "last", "last_id")
    known = F.when(F.col("entity").isNotNull(), F.col("months")).otherwise(0)
    return ids.groupBy("year").agg(F.sum(F.col("m") * F.col("months")).alias("n"), F.sum(known).alias("n_ids"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


def _weather_sql(w: int) -> str:
    part = f"filter (where day > t - {w})"
    reads = {"strict": "low < 0 and high > 0", "low_at_most_0": "low <= 0 and high > 0", "high_at_least_0": "low < 0 and high >= 0"}
    out = [f"round(sum(rain) {part}, 6) as rain_{w}d, round(avg(mean) {part}, 6) as mean_{w}d, min(low) {part} as low_{w}d, max(high) {part} as high_{w}d"]
    out += [f"sum(case when low is not null and high is not null then ({c})::int end) {part}::bigint as freeze_thaw_{n}_{w}d" for n, c in reads.items()]
    out += [f"count(rain) {part} as valid_days_{w}d, round(count(rain) {part} / {w}, 6) as coverage_{w}d, (count(rain) {part} = {w})::int as complete_{w}d"]
    return ", ".join(out + [f"coalesce(sum({c}_fb) {part}, 0)::bigint as {c}_fallback_days_{w}d" for c in ("rain", "low", "mean", "high")])


@query("d08_weather_features", f"""with {DAILY}, d as (select d::date as day from generate_series(date '1995-01-02', date '2001-11-04', interval 1 day) g(d)), a as (select * from wd where station = 'A' and day(day) % 7 <> 0), b as (select * from wd where station = 'N'),
f as (select d.day, coalesce(a.rain, b.rain) as rain, coalesce(a.low, b.low) as low, coalesce(a.mean, b.mean) as mean, a.high as high, (a.rain is null and b.rain is not null)::int as rain_fb, (a.low is null and b.low is not null)::int as low_fb, (a.mean is null and b.mean is not null)::int as mean_fb, 0 as high_fb from d left join a using (day) left join b using (day)),
an as (select distinct last_day(d::date) as t from generate_series(date '1995-01-01', date '2001-10-31', interval 1 day) g(d))
select t as as_of_date, {_weather_sql(30)}, {_weather_sql(90)} from an join f on day <= t and day > t - 90 group by 1""")
def weather_features(t: Tables) -> DataFrame:
    """One station's days filled from another's, where it may be (not for the highs), behind each month-end."""
    days, values = daily(t), ["rain", "low", "mean", "high"]
    filled = audit.fallback(days.filter("station = 'A' and day(day) % 7 <> 0"), days.filter("station = 'N'"), "day", values, values[:3], "1995-01-02", "2001-11-04")
    out = weather.weather_features(filled, "day", (30, 90)).filter("as_of_date <= '2001-10-31'")
    return out.withColumns({f"{c}_{w}d": F.round(f"{c}_{w}d", 6) for c in ("rain", "mean", "coverage") for w in (30, 90)})


@fitted("l08_survival_profiles")
def survival_profiles(t: Tables) -> DataFrame:
    """For each nation its customers' median balance, the median survival of such a customer, and its survival at four times."""
    customers = t("customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").cast("double").alias("class"), F.col("c_acctbal").cast("double").alias("balance"))
    rows = gaps(t).join(customers, "entity")
    out = models.survival_profiles(rows, ["balance", "class"], "duration_days", "event_observed", models.class_profiles(rows, "class", "balance"), (30, 180, 365, 1000))
    shown = ["balance", "location", "scale", "median_survival", "survival_30d", "survival_180d", "survival_365d", "survival_1000d"]
    return out.withColumns({c: F.round(c, 6) for c in shown})
