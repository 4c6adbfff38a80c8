"""Queries of the audits and quality tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators import panel, profiles, tables
from quillmere.plans.more import DUCK_PRINT, PRINTED
from quillmere.plans.registry import ANCHORS, EV, FIRST, LAST, Tables, query, urgent
from quillmere.plans.wider import DAILY, daily

DUCK_EVENTS = """ev2 as (select event_id, event_type, user_id, case when event_id % 50 <> 0 then ts::date end as day,
case when event_id % 50 = 0 then 'missing' when event_id % 37 = 0 then 'parse_failure' else 'precise' end as status from events)"""


def dated(t: Tables) -> DataFrame:
    status = F.when(F.col("event_id") % 50 == 0, "missing").when(F.col("event_id") % 37 == 0, "parse_failure").otherwise("precise")
    return t("events").select("event_id", "event_type", "user_id", F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("date")).alias("day"), status.alias("status"))


@query("d15_temporal_coverage", f"""with {DUCK_EVENTS}, d as (select day, count(*) as n, count(*) filter (where status = 'parse_failure') as f from ev2 group by day)
select sum(n)::bigint as n, min(day) as earliest, max(day) as latest, coalesce(sum(n) filter (where day is null), 0)::bigint as missing,
sum(f)::bigint as parse_failures, count(*) filter (where day is not null and n > 1) as repeated_days from d""")
def temporal_coverage(t: Tables) -> DataFrame:
    return profiles.temporal_coverage(dated(t), "day", "status")


@query("d16_right_edge", "select max(o_orderdate)::date as latest, h::int as horizon, (max(o_orderdate)::date - h::int)::date as last_eligible from orders, (select unnest([90, 180]) as h) group by h")
def right_edge(t: Tables) -> DataFrame:
    return profiles.right_edge(t("orders").select(F.col("o_orderdate").cast("date").alias("day")), "day", (90, 180))


POLICIES = "pol as (select o_orderstatus as policy, min(o_orderdate)::date + 400 as first, max(o_orderdate)::date as last from orders group by 1)"
ELIGIBLE = f"""{ANCHORS}, {POLICIES}, el as (select policy, h::int as horizon, t, greatest(0, least(t + h::int, last) - greatest(t + 1, first) + 1)::int as covered_days,
case when first > t + 1 then 'before_first_day' when last < t + h::int then 'right_censored' else 'eligible' end as reason from anchors, pol, (select unnest([90, 180]) as h))"""


def eligibility(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    policies = t("orders").groupBy(F.col("o_orderstatus").alias("policy")).agg(F.date_add(F.min(day), 400).alias("first"), F.max(day).alias("last"))
    anchors = panel.panel(t("region").limit(1).select(F.lit(1).alias("one")), FIRST, LAST).select("as_of_date")
    return profiles.window_eligibility(anchors, "as_of_date", policies, (90, 180))


@query("d17_window_eligibility", f"""with {ELIGIBLE} select policy, horizon, t as as_of_date, covered_days, (reason = 'eligible')::int as eligible, reason from el""")
def window_eligibility(t: Tables) -> DataFrame:
    return eligibility(t)


@query("d17_first_ineligible", f"""with {ELIGIBLE}, g as (select policy, horizon, max(t) filter (where reason = 'eligible') as good, count(*) as n_anchors, count(*) filter (where reason = 'eligible') as n_eligible from el group by all)
select g.policy, g.horizon, n_anchors, n_eligible, min(el.t) as first_ineligible, arg_min(el.reason, el.t) as reason from g left join el on el.policy = g.policy and el.horizon = g.horizon and el.reason <> 'eligible' and el.t > good group by all""")
def first_ineligible(t: Tables) -> DataFrame:
    return profiles.first_ineligible(eligibility(t), "as_of_date")


@query("d18_observation_calendar", f"""with {EV}, c as (select day, count(*) as n from ev group by day), e as (select min(day) as low, max(day) as high from c),
d as (select d::date as day from generate_series(date '1994-12-15', date '2001-09-15', interval 1 day) g(d))
select d.day, coalesce(n, 0) as n_events, case when d.day < low then 'before_first' when d.day > high then 'after_last' when n is null then 'quiet' else 'observed' end as status from d left join c using (day), e""")
def observation_calendar(t: Tables) -> DataFrame:
    return profiles.observation_calendar(urgent(t), "day", "1994-12-15", "2001-09-15")


@query("d19_counts_by_period", """select 'day' as grain, o_orderdate::date::varchar as value, count(*) as n from orders group by 2 union all select 'month', strftime(o_orderdate, '%Y-%m'), count(*) from orders group by 2
union all select 'year', year(o_orderdate)::varchar, count(*) from orders group by 2 union all select 'source', o_orderpriority, count(*) from orders group by 2""")
def counts_by_period(t: Tables) -> DataFrame:
    return profiles.counts_by_period(t("orders"), "o_orderdate", "o_orderpriority")


@query("d21_identifier_audit", " union all ".join(f"""select '{c}' as column_name, sum(k)::bigint as n, coalesce(sum(k) filter (where i is null), 0)::bigint as nulls, count(i) as n_distinct, count(*) filter (where i is not null and k > 1) as repeated,
min(i) as lowest, max(i) as highest, coalesce(max(i) - min(i) + 1 = count(i), false) as contiguous from (select {c} as i, count(*) as k from orders group by 1)""" for c in ("o_orderkey", "o_custkey")))
def identifier_audit(t: Tables) -> DataFrame:
    return profiles.identifier_audit(t("orders"), ["o_orderkey", "o_custkey"])


@query("d22_frequencies", "select p_type as value, count(*) as n, round(count(*) / (select count(*) from part), 6) as share, count(*) < 30 as rare from part group by 1")
def frequencies(t: Tables) -> DataFrame:
    return profiles.frequencies(t("part"), "p_type", 30)


@query("d22_type_sets", "select kinds, count(*) as n_entities from (select user_id, string_agg(event_type, '|' order by event_type) as kinds from (select distinct user_id, event_type from events) group by 1) group by 1")
def type_sets(t: Tables) -> DataFrame:
    return profiles.type_sets(t("events"), "user_id", "event_type")


DUCK_PAIR = """pr as (select case when l_orderkey % 17 = 0 then null when l_orderkey % 13 = 0 then -1.0 else l_quantity * 2.2 end as a, case when l_orderkey % 19 = 0 then null when l_orderkey % 23 = 0 then -1.0 else l_discount * 100 end as b from lineitem)"""


def pairs(t: Tables) -> DataFrame:
    k = F.col("l_orderkey")
    a = F.when(k % 17 == 0, None).when(k % 13 == 0, -1.0).otherwise(F.col("l_quantity") * 2.2)
    b = F.when(k % 19 == 0, None).when(k % 23 == 0, -1.0).otherwise(F.col("l_discount") * 100)
    return t("lineitem").select(a.alias("a"), b.alias("b"), "l_returnflag", "l_shipdate")


@query("d24_pair_audit", f"""with {DUCK_PAIR} select count(*) as n, count(*) filter (where a is null) as a_null, count(*) filter (where a = -1) as a_sentinel, count(*) filter (where a <> -1 and not a between 0 and 100) as a_out_of_range,
count(*) filter (where b is null) as b_null, count(*) filter (where b = -1) as b_sentinel, count(*) filter (where b <> -1 and not b between 0 and 8.5) as b_out_of_range, count(*) filter (where (a is null) <> (b is null)) as one_known from pr""")
def pair_audit(t: Tables) -> DataFrame:
    return profiles.pair_audit(pairs(t), "a", "b", {"a": (0, 100), "b": (0, 8.5)}, -1)


DUCK_FIELDS = """fl as (select case when l_orderkey % 11 <> 0 then l_quantity end as q, case when l_orderkey % 7 = 0 then 'T' when l_orderkey % 5 = 0 then 'E' end as qf,
case when l_orderkey % 3 <> 0 then l_tax end as x, case when l_orderkey % 9 = 0 then 'E' end as xf, l_returnflag from lineitem)"""


def fields(t: Tables) -> DataFrame:
    k = F.col("l_orderkey")
    return t("lineitem").select(F.when(k % 11 != 0, F.col("l_quantity")).alias("q"), F.when(k % 7 == 0, "T").when(k % 5 == 0, "E").alias("qf"), F.when(k % 3 != 0, F.col("l_tax")).alias("x"), F.when(k % 9 == 0, "E").alias("xf"), "l_returnflag")


@query("d25_field_inventory", f"with {DUCK_FIELDS} " + " union all ".join(f"""select '{c}' as field, count(*) as n, count(*) filter (where {c} is null) as missing, round(100 * count(*) filter (where {c} is null) / count(*), 6) as missing_percent,
count({c}f) as flagged, count(*) filter (where {c}f = 'T') as traces, count(*) filter (where {c}f = 'E') as estimated from fl""" for c in ("q", "x")))
def field_inventory(t: Tables) -> DataFrame:
    return profiles.field_inventory(fields(t), {"q": "qf", "x": "xf"})


@query("d26_temperature_audit", """select l_returnflag, count(*) as n_days, count(*) filter (where a is not null and m is not null and b is not null) as complete, count(*) filter (where b < a) as reversed, count(*) filter (where m < a or m > b) as mean_outside
from (select l_returnflag, case when l_orderkey % 11 <> 0 then l_quantity end as a, l_quantity + l_discount * 40 as m, l_quantity + l_tax * 50 - 1 as b from lineitem) group by 1""")
def temperature_audit(t: Tables) -> DataFrame:
    rows = t("lineitem").select("l_returnflag", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity")).alias("a"), (F.col("l_quantity") + F.col("l_discount") * 40).alias("m"), (F.col("l_quantity") + F.col("l_tax") * 50 - 1).alias("b"))
    return profiles.temperature_audit(rows, ["l_returnflag"], "a", "m", "b")


@query("d26_rank_quantiles", """with r as (select l_returnflag, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as i, count(*) over (partition by l_returnflag) as n from lineitem)
select l_returnflag, s::double as share, min(v) as value from r, (select unnest([0.05, 0.5, 0.95]) as s) where i = floor(n * s::double) group by 1, 2""")
def rank_quantiles(t: Tables) -> DataFrame:
    return profiles.rank_quantiles(t("lineitem"), ["l_returnflag"], "l_extendedprice", (0.05, 0.5, 0.95))


@query("d28_precipitation_audit", f"with {DUCK_FIELDS} select l_returnflag, count(*) as n, count(*) filter (where v is null) as missing, count(*) filter (where v = 0) as zeros, count(*) filter (where v > 0) as positives, count(*) filter (where v < 0) as negatives, count(*) filter (where qf = 'T') as traces from (select *, q - 10 as v from fl) group by 1")
def precipitation_audit(t: Tables) -> DataFrame:
    return profiles.precipitation_audit(fields(t).withColumn("v", F.col("q") - 10), ["l_returnflag"], "v", "qf")


@query("d30_annual_summary", f"with {DAILY} select station, year(day)::int as year, count(*) as n_days, count(*) filter (where rain is null) as rain_missing, round(sum(rain), 4) as rain_total, round(max(rain), 4) as wettest, round(avg(mean), 6) as mean_of_means, min(low) as lowest, max(high) as highest from wd group by all")
def annual_summary(t: Tables) -> DataFrame:
    return profiles.annual_summary(daily(t), "station", "day")


@query("d31_date_anomalies", """select count(*) as n, count(*) filter (where m is null) as made_missing, count(*) filter (where m > date '2001-01-01') as made_in_future, count(*) filter (where r > date '2001-01-01') as renewed_in_future, count(*) filter (where r < m) as renewed_before_made
from (select case when o_orderkey % 29 <> 0 then o_orderdate::date end as m, case when o_orderkey % 5 = 0 then l_shipdate::date - 60 else l_shipdate::date end as r from orders join lineitem on l_orderkey = o_orderkey)""")
def date_anomalies(t: Tables) -> DataFrame:
    rows = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = F.col("l_shipdate").cast("date")
    rows = rows.select(F.when(F.col("o_orderkey") % 29 != 0, F.col("o_orderdate").cast("date")).alias("made"), F.when(F.col("o_orderkey") % 5 == 0, F.date_sub(shipped, 60)).otherwise(shipped).alias("renewed"))
    return profiles.date_anomalies(rows, "made", "renewed", "2001-01-01")


BOUNDS = {"l_quantity": 45, "l_discount": 0.09, "l_tax": 0.1}


@query("d34_feature_bounds", " union all ".join(f"""select '{c}' as feature, {b}::double as bound, max({c}) as highest, count(distinct {c}) as n_distinct, round(100 * count(*) filter (where {c} is null) / count(*), 6) as missing_percent,
round(corr({c}, (l_returnflag = 'R')::int), 6) as label_correlation, count(*) filter (where {c} > {b}) as over_bound from lineitem""" for c, b in BOUNDS.items()))
def feature_bounds(t: Tables) -> DataFrame:
    return profiles.feature_bounds(t("lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int")), BOUNDS, "label")


@query("d37_anchor_enumeration", f"""with {ANCHORS}, f as (select last_day(o_orderdate::date) as t, count(*) as n from orders where month(o_orderdate) <> 2 group by 1), x as (select t from anchors where year(t) < 2001)
select coalesce(f.t, x.t) as as_of_date, coalesce(n, 0) as n_rows, case when f.t is null then 'missing' when x.t is null then 'unexpected' else 'ok' end as status from f full join x on f.t = x.t""")
def anchor_enumeration(t: Tables) -> DataFrame:
    found = t("orders").filter(F.month("o_orderdate") != 2).select(F.last_day("o_orderdate").alias("as_of_date"))
    expected = panel.panel(t("region").limit(1).select(F.lit(1).alias("one")), FIRST, "2000-12-31")
    return profiles.anchor_enumeration(found, "as_of_date", expected)


RAW_LINE = """case when o_orderkey % 41 = 0 then '  ' when o_orderkey % 31 = 0 then concat(cast(o_orderkey as {s}), ';', o_orderpriority) when o_orderkey % 29 = 0 then concat('7;', o_orderstatus, ';;1')
when o_orderkey % 23 = 0 then concat(cast(o_orderkey as {s}), ';x;1997-13-45;2') when o_orderkey % 19 = 0 then concat(cast(o_orderkey as {s}), ';x;1997-01-05;two') else concat(cast(o_orderkey as {s}), ';', o_orderstatus, ';', {d}, ';', cast(o_custkey as {s})) end"""


@query("d38_structural_csv", f"""with r as (select {RAW_LINE.format(s='varchar', d="strftime(o_orderdate, '%Y-%m-%d')")} as line from orders), g as (select line, string_split(line, ';') as f, count(*) as k from r group by 1),
c as (select *, trim(line) = '' as blank, trim(line) <> '' and len(f) = 4 as whole from g)
select sum(k)::bigint as n_lines, coalesce(sum(k) filter (where blank), 0)::bigint as blank, coalesce(sum(k) filter (where not blank and len(f) <> 4), 0)::bigint as other_width, coalesce(sum(k) filter (where whole and list_contains(list_transform(f, lambda x: trim(x)), '')), 0)::bigint as with_empty,
coalesce(sum(k) filter (where whole and trim(f[3]) <> '' and try_strptime(trim(f[3]), '%Y-%m-%d') is null), 0)::bigint as bad_day,
coalesce(sum(k) filter (where whole and (trim(f[1]) <> '' and try_cast(f[1] as double) is null or trim(f[4]) <> '' and try_cast(f[4] as double) is null)), 0)::bigint as bad_number, coalesce(sum(k - 1) filter (where not blank), 0)::bigint as repeated from c""")
def structural_csv(t: Tables) -> DataFrame:
    lines = t("orders").select(F.expr(RAW_LINE.format(s="string", d="date_format(o_orderdate, 'yyyy-MM-dd')")).alias("line"))
    return profiles.structural_csv(lines, "line", 4, ";", 2, [0, 3])


@query("e07_neighbours", """with r as (select user_id, event_type, ts::date as day, lag(event_type) over w as pe, lag(ts::date) over w as pd from events window w as (partition by user_id order by value, event_id))
select user_id, count(*) filter (where pe = event_type and pd = day) as adjacent_equal, count(*) filter (where day < pd) as steps_back from r group by 1""")
def neighbours(t: Tables) -> DataFrame:
    return profiles.neighbours_in_order(t("events").withColumn("day", F.col("ts").cast("date")), "user_id", ["value", "event_id"], "day", ["event_type", "day"])


def small_panel(t: Tables) -> DataFrame:
    """Entities and month-ends with a target, raw and collapsed counts."""
    key, events = ["entity", "as_of_date"], urgent(t)
    raw = panel.trailing_counts(events, "entity", "day", (365,)).withColumnRenamed("active_days_365d", "collapsed_365d")
    rows = panel.panel(t("customer").select(F.col("c_custkey").alias("entity")), FIRST, LAST)
    rows = rows.join(panel.future_targets(events, "entity", "day", (90, 180)), key, "left").join(raw, key, "left")
    rows = panel.asof_join(rows, events.distinct().withColumn("last_event", F.col("day")), ["entity"], "as_of_date", "day", ["last_event"])
    return rows.na.fill(0, ["target_90d", "target_180d", "events_365d", "collapsed_365d"])


SMALL_PANEL = f"""{EV}, {ANCHORS}, p as (select c_custkey as entity, t from customer, anchors), f as (select entity, t, max((day <= t + 90)::int) as a from p join ev using (entity) where day > t and day <= t + 180 group by all),
h as (select entity, t, count(*) as n, count(distinct day) as d from p join ev using (entity) where day <= t and day > t - 365 group by all), l as (select entity, t, max(day) as le from p join ev using (entity) where day <= t group by all),
pn as (select p.entity, p.t as as_of_date, coalesce(a, 0) as target_90d, (f.entity is not null)::int as target_180d, coalesce(n, 0) as events_365d, coalesce(d, 0) as collapsed_365d, le as last_event from p left join f using (entity, t) left join h using (entity, t) left join l using (entity, t))"""


@query("d13_panel_statistics", f"""with {SMALL_PANEL} select count(*) as n_rows, round(avg(target_90d), 6) as target_90d_rate, round(avg(target_180d), 6) as target_180d_rate, count(*) filter (where events_365d <> collapsed_365d) as counts_differ,
count(*) filter (where last_event is null) as last_event_null, count(distinct entity) as n_entities, count(distinct as_of_date) as n_anchors from pn""")
def panel_statistics(t: Tables) -> DataFrame:
    return profiles.panel_statistics(small_panel(t), "entity", "as_of_date", ["target_90d", "target_180d"], ("events_365d", "collapsed_365d"), ["last_event"])


@query("q02_dataset_expectations", """with f as (select 'orders' as name, count(*) as value from orders union all select 'customers', count(*) from customer union all select 'nations', count(*) from nation union all select 'urgent', count(*) from orders where o_orderpriority = '1-URGENT'),
x as (select * from (values ('nations', 25), ('regions', 5), ('orders', (select count(*) from lineitem) // 4)) v(name, value))
select coalesce(f.name, x.name) as name, f.value as found, x.value::bigint as expected, coalesce(f.value = x.value, false) as ok from f full join x on f.name = x.name""")
def dataset_expectations(t: Tables) -> DataFrame:
    row = lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value")
    found = row("orders", t("orders")).union(row("customers", t("customer"))).union(row("nations", t("nation"))).union(row("urgent", urgent(t)))
    expected = row("nations", t("nation")).select("name", F.lit(25).cast("long").alias("value")).union(t("region").limit(1).select(F.lit("regions"), F.lit(5).cast("long")))
    return profiles.against_expected(found, expected.union(row("orders", t("lineitem")).select("name", F.expr("value div 4"))))


@query("q03_stage_counts", """with k as (select 'kept' as stage, (select count(*) from orders) as n_in, (select count(*) from orders) as n_out, 0::bigint as lost, 0::bigint as gained), u as (select 'filtered', (select count(*) from orders), count(*), (select count(*) from orders) - count(*), 0::bigint from orders where o_orderpriority = '1-URGENT')
select *, lost = 0 and gained = 0 as ok from (select * from k union all select * from u)""")
def stage_counts(t: Tables) -> DataFrame:
    orders = t("orders")
    return profiles.stage_reconciliation([("kept", orders, orders.withColumn("year", F.year("o_orderdate"))), ("filtered", orders, orders.filter("o_orderpriority = '1-URGENT'"))], "o_orderkey")


@query("q06_partition_manifest", f"""with r as (select last_day(o_orderdate::date) as part, o_orderkey, o_orderdate::date as day, {DUCK_PRINT} as h, (o_orderpriority = '1-URGENT')::int as e from orders)
select part, count(*) as n_rows, count(distinct o_orderkey) as n_keys, 0::bigint as repeated_keys, 0::bigint as days_ahead, sum(e)::bigint as n_eligible, sum(h)::varchar as total, bit_xor(h) as parity from r group by 1""")
def partition_manifest(t: Tables) -> DataFrame:
    rows = t("orders").withColumns({"part": F.last_day("o_orderdate"), "day": F.col("o_orderdate").cast("date"), "e": (F.col("o_orderpriority") == "1-URGENT").cast("int")})
    return tables.partition_manifest(rows, "part", "o_orderkey", "day", "e", list(PRINTED))


@query("q08_mart_reconciliation", """with p as (select year(l_shipdate) as y, count(*) as n, count(*) filter (where l_discount > 0.05) as e from lineitem group by 1), k as (select l_orderkey * 10 + l_linenumber as i, count(*) as c from lineitem group by 1)
select (select sum(c)::bigint from k) as n_rows, (select count(*) from k) as n_keys, (select count(*) from k where c > 1) as repeated_keys, count(*) as n_parts, min(n) as least_rows, max(n) as most_rows, sum(e)::bigint as n_explained from p""")
def mart_reconciliation(t: Tables) -> DataFrame:
    rows = t("lineitem").withColumns({"key": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "year": F.year("l_shipdate")})
    return profiles.mart_reconciliation(rows, "key", "year", F.col("l_discount") > 0.05)
