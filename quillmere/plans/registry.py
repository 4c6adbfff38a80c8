"""All queries of the library by name, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators import audit, evaluation, panel, survival

FIRST, LAST = "1995-01-31", "2001-08-31"
FLAGSHIP = "c06_window_targets"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def query(name: str, sql: str) -> Callable:
    def keep(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        SQL[name] = sql
        return f

    return keep


def urgent(t: Tables) -> DataFrame:
    return t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("date").alias("day"))


def surveys(t: Tables) -> DataFrame:
    return t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("date").alias("survey_date"), F.col("o_totalprice").alias("price"))


def scored(t: Tables) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_linestatus").alias("part"), (F.col("l_quantity") / 51).alias("p"), (F.col("l_discount") >= 0.05).cast("int").alias("label"))


EV = "ev as (select o_custkey as entity, o_orderdate::date as day from orders where o_orderpriority = '1-URGENT')"
ANCHORS = f"anchors as (select last_day(d::date) as t from generate_series(date '1995-01-01', date '2001-08-01', interval 1 month) g(d))"
SURVEYS = "sv as (select o_custkey as entity, o_orderdate::date as survey_date, o_totalprice as price from orders where o_orderstatus = 'F')"
SCORED = "sc as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus as part, l_quantity / 51 as p, (l_discount >= 0.05)::int as label from lineitem)"


@query(FLAGSHIP, f"""with {EV}, {ANCHORS}, p as (select c_custkey as entity, t from customer, anchors),
f as (select entity, t, max((day <= t + 90)::int) as a, max(1) as b from p join ev using (entity) where day > t and day <= t + 180 group by all),
h as (select entity, t, count(*) filter (where day > t - 30) as e30, count(*) filter (where day > t - 90) as e90, count(*) as e365, count(distinct day) filter (where day > t - 90) as d90 from p join ev using (entity) where day <= t and day > t - 365 group by all),
l as (select entity, t, max(day) as last_day_ from p join ev using (entity) where day <= t group by all)
select p.entity, p.t as as_of_date, coalesce(a, 0) as target_90d, coalesce(b, 0) as target_180d, coalesce(e30, 0) as events_30d, coalesce(e90, 0) as events_90d, coalesce(e365, 0) as events_365d, coalesce(d90, 0) as active_days_90d,
last_day_ as last_event, date_diff('day', last_day_, p.t)::int as days_since_last, (last_day_ is null)::int as no_prior_flag from p left join f using (entity, t) left join h using (entity, t) left join l using (entity, t)""")
def window_targets(t: Tables) -> DataFrame:
    """Was there an event in the next 90 or 180 days, and how many in the last 30, 90 and 365?"""
    events, key = urgent(t), ["entity", "as_of_date"]
    rows = panel.panel(t("customer").select(F.col("c_custkey").alias("entity")), FIRST, LAST)
    rows = rows.join(panel.future_targets(events, "entity", "day", (90, 180)), key, "left").join(panel.trailing_counts(events, "entity", "day", (30, 90, 365)), key, "left")
    rows = panel.asof_join(rows, events.distinct().withColumn("last_event", F.col("day")), ["entity"], "as_of_date", "day", ["last_event"])
    zero = ["target_90d", "target_180d", "events_30d", "events_90d", "events_365d", "active_days_90d"]
    return rows.select(*key, *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], "last_event", F.datediff("as_of_date", "last_event").alias("days_since_last"), F.col("last_event").isNull().cast("int").alias("no_prior_flag"))


@query("c05_asof_survey", f"""with {SURVEYS}, {ANCHORS}, s as (select entity, survey_date, median(price) as price from sv group by all)
select c_custkey as entity, t as as_of_date, survey_date, round(price, 6) as price, date_diff('day', survey_date, t)::int as staleness_days, (survey_date is null)::int as missing_flag from (select c_custkey, t from customer, anchors) p asof left join s on p.c_custkey = s.entity and p.t >= s.survey_date""")
def asof_survey(t: Tables) -> DataFrame:
    day = panel.same_day(surveys(t), "entity", "survey_date", "price").select("entity", "survey_date", F.col("median").alias("price"))
    rows = panel.asof_join(panel.panel(t("customer").select(F.col("c_custkey").alias("entity")), FIRST, LAST), day, ["entity"], "as_of_date", "survey_date", ["price"])
    return rows.select("entity", "as_of_date", "survey_date", F.round("price", 6).alias("price"), F.datediff("as_of_date", "survey_date").alias("staleness_days"), F.col("survey_date").isNull().cast("int").alias("missing_flag"))


@query("c08_interval_validity", f"""with {ANCHORS}, a as (select o_custkey as entity, min(l_shipdate)::date as lo, max(l_shipdate)::date as hi from orders join lineitem on l_orderkey = o_orderkey group by 1)
select t as as_of_date, case when lo is null or hi is null then 'missing' when hi <= t then 'active' when lo > t then 'future' else 'crosses' end as status, count(*) as n from customer cross join anchors left join a on entity = c_custkey group by all""")
def interval_validity(t: Tables) -> DataFrame:
    spans = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("entity")).agg(F.min("l_shipdate").cast("date").alias("lo"), F.max("l_shipdate").cast("date").alias("hi"))
    rows = panel.panel(t("customer").select(F.col("c_custkey").alias("entity")).join(spans, "entity", "left"), FIRST, LAST)
    return rows.groupBy("as_of_date", panel.validity(F.col("lo"), F.col("hi"), F.col("as_of_date")).alias("status")).agg(F.count("*").alias("n"))


@query("c14_source_fallback", """with s as (select l_shipdate::date as day, l_returnflag as f, round(avg(l_quantity), 6) as q, min(l_quantity) as lo from lineitem group by all), a as (select * from s where f = 'A' and day(day) % 7 <> 0), b as (select * from s where f = 'N'),
d as (select d::date as day from generate_series(date '1995-01-02', date '2001-11-04', interval 1 day) g(d))
select d.day, coalesce(a.q, b.q) as q, (a.q is null and b.q is not null)::int as q_fallback_used, a.lo as lo, 0 as lo_fallback_used from d left join a using (day) left join b using (day)""")
def source_fallback(t: Tables) -> DataFrame:
    daily = t("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"), "l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("q"), F.min("l_quantity").alias("lo"))
    return audit.fallback(daily.filter("l_returnflag = 'A' and day(day) % 7 <> 0"), daily.filter("l_returnflag = 'N'"), "day", ["q", "lo"], ["q"], "1995-01-02", "2001-11-04")


@query("c19_without_events", f"with {EV} select c_mktsegment, count(*) as n from customer where c_custkey not in (select entity from ev) group by 1")
def without_events(t: Tables) -> DataFrame:
    return t("customer").join(urgent(t), F.col("c_custkey") == F.col("entity"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("c24_compare_versions", """with a as (select * from orders where o_orderkey % 7 <> 0), b as (select o_orderkey, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice from orders where o_orderkey % 11 <> 0)
select case when b.o_orderkey is null then 'missing' when a.o_orderkey is null then 'extra' when a.o_orderstatus is distinct from b.o_orderstatus or a.o_totalprice is distinct from b.o_totalprice then 'changed' else 'same' end as status, count(*) as n_rows from a full join b using (o_orderkey) group by 1""")
def versions(t: Tables) -> DataFrame:
    new = t("orders").filter("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return audit.compare_versions(t("orders").filter("o_orderkey % 7 <> 0"), new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("d01_same_day_surveys", f"with {SURVEYS} select entity, survey_date, count(*) as n, round(median(price), 6) as median, min(price) as min, max(price) as max, round(stddev_pop(price), 4) as std from sv group by all")
def same_day_surveys(t: Tables) -> DataFrame:
    return panel.same_day(surveys(t), "entity", "survey_date", "price").withColumns({"median": F.round("median", 6), "std": F.round("std", 4)})


@query("d09_event_collapse", "select user_id, event_type, date_trunc('hour', ts)::timestamp as hour, min(event_id) as kept_id, count(*) as multiplicity from events group by all")
def event_collapse(t: Tables) -> DataFrame:
    return audit.collapsed(t("events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")), ["user_id", "event_type", "hour"], "event_id")


@query("d10_multiplicity", "select multiplicity, count(*) as groups, (count(*) * (multiplicity - 1))::bigint as removed from (select count(*) as multiplicity from events group by user_id, event_type, date_trunc('hour', ts)) group by 1")
def multiplicity(t: Tables) -> DataFrame:
    return event_collapse(t).groupBy("multiplicity").agg(F.count("*").alias("groups")).withColumn("removed", F.col("groups") * (F.col("multiplicity") - 1))


@query("d11_duplicate_profile", " union all ".join(f"select '{n}' as key_set, count(*) as groups, count(*) filter (where c > 1) as duplicate_groups, sum(c - 1)::bigint as excess_rows, max(c) as largest_group from (select count(*) as c from events group by {k})" for n, k in (("user", "user_id"), ("user_type", "user_id, event_type"), ("second", "user_id, event_type, ts"))))
def duplicate_profile(t: Tables) -> DataFrame:
    return audit.duplicate_profile(t("events"), {"user": ["user_id"], "user_type": ["user_id", "event_type"], "second": ["user_id", "event_type", "ts"]})


CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("d20_column_profile", " union all ".join(f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null, count(*) filter (where trim({c}::varchar) = '') as n_blank, count(distinct {c}) as n_distinct from customer" for c in CUSTOMER))
def profile(t: Tables) -> DataFrame:
    return audit.column_profile(t("customer").select(*CUSTOMER))


@query("d23_numeric_profile", "select l_returnflag, count(l_extendedprice) as n, min(l_extendedprice) as min, max(l_extendedprice) as max, round(avg(l_extendedprice), 6) as mean, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q / 100}), 6) as p{q}" for q in (10, 25, 50, 75, 90)) + " from lineitem group by 1")
def numbers(t: Tables) -> DataFrame:
    return audit.numeric_profile(t("lineitem"), "l_returnflag", "l_extendedprice")


@query("d33_group_prevalence", f"with {SCORED} select l_returnflag, count(*) as n, sum(label)::bigint as pos, round(avg(label), 6) as prevalence, count(*) >= 500 as enough from sc group by 1")
def prevalence(t: Tables) -> DataFrame:
    return audit.group_prevalence(scored(t), "l_returnflag", "label", 500)


@query("e01_duplicate_flags", "select is_duplicate, count(*) as n, min(event_id) as first_id from (select event_id, (row_number() over (partition by user_id, event_type, date_trunc('hour', ts) order by event_id) > 1)::int as is_duplicate from events) group by 1")
def flags(t: Tables) -> DataFrame:
    rows = audit.duplicate_flags(t("events").withColumn("hour", F.date_trunc("hour", "ts")), ["user_id", "event_type", "hour"], ["event_id"])
    return rows.groupBy("is_duplicate").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("e02_percentile_bands", """with r as (select o_orderkey, last_day(o_orderdate::date) as anchor, o_totalprice from orders), p as (select *, round((rank() over (partition by anchor order by o_totalprice) + (count(*) over (partition by anchor, o_totalprice) - 1) / 2) / count(*) over (partition by anchor) * 100, 6) as percentile from r)
select o_orderkey, anchor, percentile, case when percentile >= 95 then 'HIGH' when percentile >= 90 then 'MEDIUM' when percentile >= 80 then 'WATCH' else 'OTHER' end as band, percentile >= 95 as top_5, percentile >= 90 as top_10, percentile >= 80 as top_20 from p""")
def bands(t: Tables) -> DataFrame:
    rows = t("orders").select("o_orderkey", F.last_day("o_orderdate").alias("anchor"), "o_totalprice")
    return evaluation.percentile_bands(rows, ["anchor"], "o_totalprice").drop("o_totalprice")


@query("i01_ranking_metrics", f"""with {SCORED}, c as (select part, p, count(*) as n, sum(label) as pos from sc group by all),
w as (select *, sum(n) over (partition by part order by p desc) as seen, sum(pos) over (partition by part order by p desc) as tp from c)
select part, sum(n)::bigint as n, sum(pos)::bigint as pos, round(sum(pos * tp / seen) / sum(pos), 6) as average_precision, round(1 - sum(pos * ((seen - n) - (tp - pos) + (n - pos) / 2)) / (sum(pos) * (sum(n) - sum(pos))), 6) as roc_auc from w group by part""")
def ranking_metrics(t: Tables) -> DataFrame:
    return evaluation.ranking(scored(t), ["part"], "p", "label")


@query("i03_proper_scores", f"with {SCORED} select part, round(avg((p - label) * (p - label)), 6) as brier, round(avg(-case when label = 1 then ln(least(greatest(p, 1e-6), 1 - 1e-6)) else ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) end), 6) as log_loss from sc group by part")
def proper(t: Tables) -> DataFrame:
    return evaluation.proper_scores(scored(t), ["part"], "p", "label")


RELIABILITY = f"{SCORED}, b as (select least(floor(p * 10), 9)::int as bin, count(*) as n, avg(p) as mean_p, avg(label) as rate from sc group by 1), rel as (select r.bin::int as bin, coalesce(n, 0) as n, round(mean_p, 6) as mean_p, round(rate, 6) as rate from range(10) r(bin) left join b using (bin))"


@query("i06_reliability", f"with {RELIABILITY} select * from rel")
def reliability(t: Tables) -> DataFrame:
    return evaluation.reliability(scored(t), "p", "label")


@query("i05_calibration_error", f"with {RELIABILITY} select round(sum(n * abs(mean_p - rate)) / sum(n), 6) as ece from rel")
def ece(t: Tables) -> DataFrame:
    return evaluation.calibration_error(reliability(t))


@query("i08_top_share", f"""with {SCORED}, r as (select *, row_number() over (partition by part order by p desc, l_orderkey, l_linenumber) as place, count(*) over (partition by part) as n, sum(label) over (partition by part) as pos from sc),
k as (select part, percent, ceil(n * percent / 100)::bigint as k, n, pos, sum(label) as tp, min(p) as th from r, (select unnest([1, 5, 10, 20]) as percent) where place <= ceil(n * percent / 100) group by all)
select part, percent, k, round(th, 6) as threshold, tp::bigint as tp, round(tp / k, 6) as precision, round(tp / pos, 6) as recall, round(tp / k / (pos / n), 6) as lift from k""")
def top(t: Tables) -> DataFrame:
    return evaluation.top_share(scored(t).withColumn("key", F.col("l_orderkey") * 100 + F.col("l_linenumber")), ["part"], "p", "key", "label", (1, 5, 10, 20)).withColumn("threshold", F.round("threshold", 6))


@query("i09_confusion", f"with {SCORED}, c as (select count(*) filter (where p >= 0.5 and label = 1) as tp, count(*) filter (where p >= 0.5 and label = 0) as fp, count(*) filter (where p < 0.5 and label = 1) as fn, count(*) filter (where p < 0.5 and label = 0) as tn from sc) select *, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c")
def matrix(t: Tables) -> DataFrame:
    return evaluation.confusion(scored(t), "p", "label", 0.5)


COHORT = f"{EV}, u as (select distinct entity, day from ev), x as (select entity, day as start_date, lead(day) over w as nxt, row_number() over w as interval_index from u window w as (partition by entity order by day)), co as (select entity, interval_index, start_date, date_diff('day', start_date, coalesce(nxt, date '2001-08-01'))::int as duration_days, (nxt is not null)::int as event_observed from x where date_diff('day', start_date, coalesce(nxt, date '2001-08-01')) > 0)"


def gaps(t: Tables) -> DataFrame:
    return survival.cohort(urgent(t), "entity", "day", "2001-08-01")


def of_segments(t: Tables) -> DataFrame:
    return gaps(t).join(t("customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment"), "entity")


@query("l01_interval_cohort", f"with {COHORT} select * from co")
def interval_cohort(t: Tables) -> DataFrame:
    return gaps(t)


@query("l02_kaplan_meier", f"""with {COHORT}, c as (select c_mktsegment, duration_days, count(*) as m, sum(event_observed) as events from co join customer on c_custkey = entity group by all),
r as (select *, sum(m) over (partition by c_mktsegment order by duration_days desc) as at_risk from c),
s as (select *, product(1 - events / at_risk) over w as sv, sum(case when at_risk = events then 0 else events / (at_risk * (at_risk - events)) end) over w as g from r window w as (partition by c_mktsegment order by duration_days))
select c_mktsegment, duration_days, at_risk::bigint as at_risk, events::bigint as events, round(sv, 6) as survival, round(sv * sv * g, 8) as greenwood from s""")
def km(t: Tables) -> DataFrame:
    return survival.kaplan_meier(of_segments(t), "c_mktsegment")


@query("l04_log_rank", f"""with {COHORT}, a as (select duration_days, event_observed, (c_mktsegment < 'C')::int as g from co join customer on c_custkey = entity), c as (select duration_days, count(*) as m, sum(g) as ma, sum(event_observed) as d, sum(event_observed * g) as da from a group by 1),
r as (select *, sum(m) over (order by duration_days desc) as n, sum(ma) over (order by duration_days desc) as na from c), z as (select sum(da) as o, sum(d * na / n) as e, sum(na * (n - na) * d * (n - d) / (n * n * (n - 1))) as v from r where n > 1)
select o::bigint as observed, round(e, 6) as expected, round(v, 6) as variance, round((o - e) ** 2 / v, 6) as chi2 from z""")
def logrank(t: Tables) -> DataFrame:
    return survival.log_rank(of_segments(t).withColumn("g", (F.col("c_mktsegment") < "C").cast("int")), "g")


@query("a13_formula_safe", "select vals, count(*) as n from (select case when regexp_matches(x, '^[=+\\-@]') then '''' || x else x end as vals from (select case when o_orderkey % 3 = 0 then '=' || o_orderstatus when o_orderkey % 3 = 1 then '-' || o_orderstatus else o_orderpriority end as x from orders)) group by 1")
def safe(t: Tables) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("="), "o_orderstatus")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("-"), "o_orderstatus")).otherwise(F.col("o_orderpriority"))
    return audit.formula_safe(t("orders").select(x.alias("vals"))).groupBy("vals").agg(F.count("*").alias("n"))
