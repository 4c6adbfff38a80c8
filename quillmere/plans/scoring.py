"""Queries of row functions, evaluation reports, split tables, explanations and survival by class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions import dates
from quillmere.functions import rows as row_functions
from quillmere.operators import attribution, evaluation, experiments, explained, models, scoring, splits, survival
from quillmere.operators.ordering import portable_hash_sql as hashed
from quillmere.plans.more import CATEGORIES, NUMBERS, fitted, keyed, learnable
from quillmere.plans.registry import COHORT, Tables, gaps, query
from quillmere.plans.wider import DUCK_DATE, LABELLED, MEANS, PARTS, PAST, SPARK_DATE, SPLIT, WEIGHTS, contributions, labelled
from quillmere.sources import files, sinks


@query("h02_precision_class", "select case o_orderkey % 6 when 0 then 'exact' when 1 then 'day' when 2 then 'year' else 'unknown' end as precision_class, count(*) as n from orders group by 1")
def precision_class(t: Tables) -> DataFrame:
    found = dates.parsed(F.expr(SPARK_DATE), ("yyyy-MM-dd HH:mm:ss",), ("yyyy-MM-dd",), ("0", "inconnu"))
    return t("orders").select(row_functions.precision_class(found["status"]).alias("precision_class")).groupBy("precision_class").agg(F.count("*").alias("n"))


ASSET = "case o_orderkey % 6 when 0 then {c} || '103000' when 1 then {c} when 2 then 'vers ' || {y} when 3 then '0' when 4 then 'Inconnu' else 'abc' end"


@query("h04_asset_dates", """select case o_orderkey % 6 when 0 then 'date_only' when 1 then 'date_only' when 2 then 'imprecise_year' when 5 then 'parse_failure' else 'missing' end as status,
case when o_orderkey % 6 < 2 then o_orderdate::date when o_orderkey % 6 = 2 then make_date(year(o_orderdate), 1, 1) end as day, count(*) as n from orders group by all""")
def asset_dates(t: Tables) -> DataFrame:
    raw = F.expr(ASSET.format(c="date_format(o_orderdate, 'yyyyMMdd')", y="cast(year(o_orderdate) as string)"))
    return t("orders").select(row_functions.asset_date(raw).alias("a")).groupBy("a.status", "a.day").agg(F.count("*").alias("n"))


@query("h06_resurfacing", """with r as (select o_orderkey % 3 as k, o_orderdate::date as d from orders)
select case k when 0 then 'exact' else 'year' end as "precision", min(case k when 0 then d else make_date(year(d), 1, 1) end) as lowest, max(case k when 0 then d else make_date(year(d), 12, 31) end) as highest, count(*) as n from r where k > 0 or day(d) <> 1 or month(d) not in (1, 7) group by 1""")
def resurfacing(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "yyyyMMdd")).when(k == 1, F.concat(F.year(d).cast("string"), F.lit("0101"))).otherwise(F.concat(F.year(d).cast("string"), F.lit("0701")))
    rows = t("orders").filter((k > 0) | (F.dayofmonth(d) != 1) | ~F.month(d).isin(1, 7))
    rows = rows.select(row_functions.resurfacing_interval(F.concat(raw, F.lit("000000"))).alias("i"))
    return rows.groupBy("i.precision").agg(F.min("i.lower").alias("lowest"), F.max("i.upper").alias("highest"), F.count("*").alias("n"))


@query("h07_precision_flags", "select sum((o_orderkey % 4 = 0)::int)::bigint as exact, sum((o_orderkey % 4 in (1, 2))::int)::bigint as proxies, sum((o_orderkey % 4 = 3)::int)::bigint as unknown from orders")
def precision_flags(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    rows = t("orders").select(F.when(k == 0, "exact").when(k == 1, "month").when(k == 2, "5y").alias("p")).withColumns(row_functions.precision_flags(F.col("p")))
    return rows.agg(F.sum("exact_flag").alias("exact"), F.sum("proxy_flag").alias("proxies"), F.sum("unknown_flag").alias("unknown"))


@query("h09_split_stamps", "select event_id, strftime(ts, '%Y-%m-%d') as day_text, case when event_id % 3 = 2 then null else strftime(ts, '%H:%M:%S') end as time_text from events")
def split_stamps(t: Tables) -> DataFrame:
    day, time, k = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(day, F.lit("T"), time)).when(k == 1, F.concat(day, F.lit("  "), time)).otherwise(day)
    return t("events").select("event_id", row_functions.split_stamp(raw, k == 0).alias("s")).select("event_id", "s.day_text", "s.time_text")


@query("h10_flexible_stamps", "select event_id, case when event_id % 10 <> 9 then ts end as at from events")
def flexible_stamps(t: Tables) -> DataFrame:
    text, k = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("event_id") % 10
    raw = F.when(k == 9, "soon").when(k < 5, F.regexp_replace(text, " ", "T")).otherwise(text)
    return t("events").select("event_id", row_functions.flexible_stamp(raw).cast("timestamp").alias("at"))


@query("h11_event_calendar", """select year(o_orderdate)::int as event_year, month(o_orderdate)::int as event_month, date_trunc('month', o_orderdate)::date as month_start,
case when o_orderkey % 10 = 0 then 'unknown' when o_orderkey % 10 = 1 then 'mismatch' else 'match' end as year_status, count(*) as n from orders group by all""")
def event_calendar(t: Tables) -> DataFrame:
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 10
    source = F.when(k == 1, F.year(day) + 1).when(k > 1, F.year(day))
    rows = t("orders").select(day.alias("day"), source.alias("source_year")).withColumns(row_functions.event_calendar(F.col("day"), F.col("source_year")))
    return rows.groupBy("event_year", "event_month", "month_start", "year_status").agg(F.count("*").alias("n"))


@query("h12_survey_times", f"""with r as (select o_orderkey % 6 as k, o_orderdate::date as d from orders) select case k when 0 then 'exact' when 1 then 'day' when 2 then 'year' else 'unknown' end as precision_class,
case when k < 3 then year(d) end::int as survey_year, case when k < 2 then date_trunc('month', d) when k = 2 then make_date(year(d), 1, 1) end::date as month_start, count(*) as n, count(case when k = 0 then 1 end) as n_localised from r group by all""")
def survey_times(t: Tables) -> DataFrame:
    rows = t("orders").select(dates.parsed(F.expr(SPARK_DATE), ("yyyy-MM-dd HH:mm:ss",), ("yyyy-MM-dd",), ("0", "inconnu")).alias("p"))
    rows = rows.withColumn("l", dates.localised(F.col("p.at"), "America/Toronto"))
    calendar = row_functions.event_calendar(F.col("p.day"), F.year("p.day"))
    rows = rows.select(row_functions.precision_class(F.col("p.status")).alias("precision_class"), calendar["event_year"].alias("survey_year"), calendar["month_start"].alias("month_start"), F.col("l.status").alias("local"))
    return rows.groupBy("precision_class", "survey_year", "month_start").agg(F.count("*").alias("n"), F.count_if(F.col("local") == "successfully_localized").alias("n_localised"))


@query("h17_campaign_scope", "select case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'arterial' when o_orderpriority = '3-MEDIUM' then 'local' else 'unknown' end as scope, count(*) as n from orders group by 1")
def campaign_scope(t: Tables) -> DataFrame:
    return t("orders").groupBy(row_functions.campaign_scope(F.col("o_orderpriority"), ("1-URGENT", "2-HIGH"), ("3-MEDIUM",)).alias("scope")).agg(F.count("*").alias("n"))


@query("h20_row_parse", """select event_id % 4 <> 3 as day_ok, event_id % 5 < 2 as time_ok, event_id % 7 <> 0 as place_ok, case event_id % 5 when 0 then 'h:m:s' when 1 then 'h:m' else 'none' end as time_form, count(*) as n from events group by all""")
def row_parse(t: Tables) -> DataFrame:
    k = F.col("event_id")
    day = F.when(k % 4 != 3, F.date_format("ts", "yyyy-MM-dd")).otherwise("31/31/2020")
    time = F.when(k % 5 == 0, F.date_format("ts", "HH:mm:ss")).when(k % 5 == 1, F.date_format("ts", "HH:mm")).when(k % 5 == 2, "noon")
    rows = t("events").select(row_functions.row_parse(day, F.coalesce(time, F.lit("")), F.when(k % 7 == 0, "east").otherwise("45.5"), F.lit("-73.6")).alias("p"))
    return rows.groupBy(F.col("p.day").alias("day_ok"), F.col("p.time").alias("time_ok"), F.col("p.place").alias("place_ok"), "p.time_form").agg(F.count("*").alias("n"))


@query("h21_sentinel", "select sum((l_linenumber = 1 and l_returnflag = 'A')::int)::bigint as n_flagged, count(*) as n from lineitem")
def sentinel(t: Tables) -> DataFrame:
    flag = row_functions.sentinel_flag(F.col("l_linenumber") - 1, F.when(F.col("l_returnflag") == "A", " - ").otherwise("B"))
    return t("lineitem").agg(F.sum(flag).alias("n_flagged"), F.count("*").alias("n"))


@query("h22_period_labels", "select 'Q' || quarter(o_orderdate)::varchar as quarter, year(o_orderdate)::varchar as year_label, count(*) as n from orders group by all")
def period_labels(t: Tables) -> DataFrame:
    labels = row_functions.period_labels(F.col("o_orderdate"))
    return t("orders").groupBy(*[c.alias(n) for n, c in labels.items()]).agg(F.count("*").alias("n"))


@query("h25_source_features", """with s as (select distinct p_brand as source from part), x as (select distinct p_brand || '_' || p_type as transformed, p_brand as source from part) select transformed, source from x union all select source, source from s union all select 'other_' || source, null from s""")
def source_features(t: Tables) -> DataFrame:
    sources = t("part").select(F.col("p_brand").alias("source")).distinct()
    made = t("part").select(F.concat_ws("_", "p_brand", "p_type").alias("transformed")).distinct()
    return row_functions.source_features(made.union(sources).union(sources.select(F.concat(F.lit("other_"), "source"))), sources)


@query("h31_point_texts", "select s_suppkey, case when s_suppkey % 4 <> 0 then 'POINT (' || (s_suppkey % 90)::varchar || '.5 ' || (s_suppkey % 45)::varchar || '.25)' end as wkt from supplier")
def point_texts(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t("supplier").select(k, row_functions.point_text(F.when(k % 4 != 0, k % 90 + 0.5), k % 45 + 0.25).alias("wkt"))


SCORES = "so as (select o_orderkey, o_orderstatus, round(o_totalprice / 100) as p, (o_orderpriority in ('1-URGENT', '2-HIGH'))::int as label from orders)"


def order_scores(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") / 100).alias("p"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("label"))


@query("i11_cut_offs", f"with {SCORES} " + " union all ".join(f"select {s}::double as share, round(quantile_cont(p, {s}), 6) as cut_off from so" for s in (0.5, 0.75, 0.9, 0.95)))
def cut_offs(t: Tables) -> DataFrame:
    return scoring.cut_offs(order_scores(t), "p", (0.5, 0.75, 0.9, 0.95))


RANKED = """c as (select {g}, s, count(*) as n, sum(label) as pos from {f} group by all), w as (select *, sum(n) over v as m, sum(pos) over v as tp from c window v as (partition by {g} order by s desc)),
rk as (select {g}, sum(n)::bigint as n, sum(pos)::bigint as pos, round(sum(pos * tp / m) / sum(pos), 6) as average_precision, round(1 - sum(pos * ((m - n) - (tp - pos) + (n - pos) / 2)) / (sum(pos) * (sum(n) - sum(pos))), 6) as roc_auc from w group by {g})"""


@query("i12_suite", f"""with {SCORES}, f as (select o_orderkey, o_orderstatus as g, p / 5000 as s, label from so), {RANKED.format(g='g', f='f')},
b as (select g, round(avg((s - label) ** 2), 6) as brier, round(avg(-case when label = 1 then ln(least(greatest(s, 1e-6), 1 - 1e-6)) else ln(1 - least(greatest(s, 1e-6), 1 - 1e-6)) end), 6) as log_loss from f group by g),
o as (select *, row_number() over (partition by g order by s desc, o_orderkey) as place, count(*) over (partition by g) as total, sum(label) over (partition by g) as yes from f),
k as (select g, percent, sum(label) / ceil(total * percent / 100) as prec, sum(label) / yes as rec, yes / total as rate from o, (select unnest([5, 10]) as percent) where place <= ceil(total * percent / 100) group by g, percent, total, yes),
t5 as (select g, round(prec, 6) as precision_5, round(rec, 6) as recall_5, round(prec / rate, 6) as lift_5 from k where percent = 5), t10 as (select g, round(prec, 6) as precision_10, round(rec, 6) as recall_10, round(prec / rate, 6) as lift_10 from k where percent = 10)
select g, n, pos, average_precision, roc_auc, brier, log_loss, round(pos / n, 6) as prevalence, precision_5, recall_5, lift_5, precision_10, recall_10, lift_10 from rk join b using (g) join t5 using (g) join t10 using (g)""")
def suite(t: Tables) -> DataFrame:
    rows = order_scores(t).select("o_orderkey", F.col("o_orderstatus").alias("g"), (F.col("p") / 5000).alias("s"), "label")
    return scoring.suite(rows, ["g"], "s", "o_orderkey", "label", (5, 10))


@query("i16_null_distribution", f"""with {SCORES}, f as (select r as g, {hashed('o_orderkey', 0).replace('+ 0)', '+ r * 69621)')} as s, label from so, range(1, 21) q(r)), {RANKED.format(g='g', f='f')},
f2 as (select 0 as g, p as s, label from so), c2 as (select s, count(*) as n, sum(label) as pos from f2 group by 1), w2 as (select *, sum(n) over (order by s desc) as m, sum(pos) over (order by s desc) as tp from c2),
ob as (select round(sum(pos * tp / m) / sum(pos), 6) as ap, round(1 - sum(pos * ((m - n) - (tp - pos) + (n - pos) / 2)) / (sum(pos) * (sum(n) - sum(pos))), 6) as auc, sum(pos) / sum(n) as rate from w2)
select 'average_precision' as metric, ap as observed, round(avg(average_precision), 6) as null_mean, round(stddev_samp(average_precision), 6) as null_std, round((ap - avg(average_precision)) / stddev_samp(average_precision), 3) as z, round(100 * avg((average_precision < ap)::int), 2) as rank_percent, round(rate, 6) as constant from rk, ob group by ap, rate
union all select 'roc_auc', auc, round(avg(roc_auc), 6), round(stddev_samp(roc_auc), 6), round((auc - avg(roc_auc)) / stddev_samp(roc_auc), 3), round(100 * avg((roc_auc < auc)::int), 2), 0.5 from rk, ob group by auc""")
def null_distribution(t: Tables) -> DataFrame:
    return scoring.null_distribution(order_scores(t), "o_orderkey", "p", "label", 20)


LOSS = "round(avg(-case when label = 1 then ln(least(greatest({s}, 1e-6), 1 - 1e-6)) else ln(1 - least(greatest({s}, 1e-6), 1 - 1e-6)) end), 6)"


@query("i17_metric_deltas", f"""with {SCORES}, f as (select 'a' as g, p / 5000 as s, label from so union all select 'b', (p / 5000) * (p / 5000), label from so), {RANKED.format(g='g', f='f')},
b as (select g, round(avg((s - label) ** 2), 6) as brier, {LOSS.format(s='s')} as log_loss from f group by g), u as (select g, unnest(['average_precision', 'roc_auc', 'brier', 'log_loss']) as metric, unnest([average_precision, roc_auc, brier, log_loss]) as v from rk join b using (g))
select x.metric, x.v as value_a, y.v as value_b, round(y.v - x.v, 6) as delta from u x join u y on x.metric = y.metric and x.g = 'a' and y.g = 'b'""")
def metric_deltas(t: Tables) -> DataFrame:
    rows = order_scores(t).select((F.col("p") / 5000).alias("raw"), "label").withColumn("other", F.col("raw") * F.col("raw"))
    return scoring.metric_deltas(rows, "raw", "other", "label")


@query("j02_routed_splits", f"with {LABELLED}, s as (select t, {SPLIT(90)} as split from lb) select split, t, count(*) as n from s group by all")
def routed_splits(t: Tables) -> DataFrame:
    rows = labelled(t)
    return scoring.routed(rows, splits.split_of(F.col("t"), 90, "1999-01-31", "2000-06-30")["split"], "t", sinks.scratch(rows.sparkSession, "splits"))


@query("j05_prevalence", f"with {PAST} select o_orderkey, round(a, 6) as score from te, al")
def prevalence(t: Tables) -> DataFrame:
    rows = labelled(t)
    return scoring.prevalence(rows.filter("t < '1999-01-31'"), rows.filter("t >= '1999-01-31'"), "label").select("o_orderkey", F.round("score", 6).alias("score"))


@query("j09_ordinal", "with v as (select p_type, row_number() over (order by p_type) - 1 as c from (select distinct p_type from part where p_partkey % 5 = 0 and p_type is not null)) select p_partkey, coalesce(c, -1)::int as p_type_code from part left join v on v.p_type = case when p_partkey % 7 <> 0 then part.p_type end")
def ordinal(t: Tables) -> DataFrame:
    rows = t("part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("p_type"))
    return scoring.ordinal(t("part").filter("p_partkey % 5 = 0"), rows, ["p_type"]).select("p_partkey", "p_type_code")


@query("d33_correlated_prevalence", """with g as (select o_custkey % 40 as value, avg((o_orderpriority = '1-URGENT')::int) filter (where o_orderstatus = 'F') as a, count(*) filter (where o_orderstatus = 'F') as na, avg((o_orderpriority = '1-URGENT')::int) filter (where o_orderstatus = 'O') as b, count(*) filter (where o_orderstatus = 'O') as nb from orders group by 1), k as (select * from g where na >= 5 and nb >= 5)
select value, round(a, 6) as rate_a, round(b, 6) as rate_b, round(abs(a - b), 6) as difference, (select round(corr(a, b), 6) from k) as correlation from k""")
def correlated_prevalence(t: Tables) -> DataFrame:
    rows = t("orders").select((F.col("o_custkey") % 40).alias("v"), "o_orderstatus", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"))
    return scoring.correlated_prevalence(rows, "v", "o_orderstatus", "F", "O", "label", 5)


GROUPS = {"amounts": ["l_quantity", "l_tax"], "discount": ["l_discount"]}


@query("k04_source_importance", f"""with {PARTS}, i as ({' union all '.join(f"select '{c}' as feature, avg(abs({c})) as importance from k" for c in WEIGHTS)}), s as (select case feature when 'l_discount' then 'discount' else 'amounts' end as source, sum(importance) as total, avg(importance) as mean, max(importance) as largest, count(*) as n_transformed from i group by 1)
select source, round(total, 6) as total, round(mean, 6) as mean, round(largest, 6) as largest, n_transformed, row_number() over (order by total desc, source)::int as importance_rank from s""")
def source_importance(t: Tables) -> DataFrame:
    table = attribution.importance(contributions(t)).select("feature", F.col("mean_abs").alias("importance"))
    mapping = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(s).alias("source")) for s, names in GROUPS.items() for c in names])
    return explained.source_importance(table, table.limit(1).select(F.inline(mapping)))


@query("k05_by_source", f"with {PARTS} select l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) as amounts, round(l_discount, 6) as discount from k")
def by_source(t: Tables) -> DataFrame:
    rows = explained.by_source(contributions(t), GROUPS)
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("contributions")[0]["value"], 6).alias("amounts"), F.round(F.col("contributions")[1]["value"], 6).alias("discount"))


@query("k06_explanation_records", f"""with {PARTS}, r as (select k.*, {' + '.join(f'm_{c} * {w}' for c, w in WEIGHTS.items())} + -1.0 + k.l_quantity + k.l_discount + k.l_tax as margin from k, m),
o as (select *, row_number() over (order by round(margin, 9) desc, l_orderkey, l_linenumber) - 1 as place from r) select l_orderkey, l_linenumber, place::int as place, round((1 - place / 60) * 100, 2) as rank_percentile, round(l_quantity + l_tax, 6) as amounts from o where place < 60""")
def explanation_records(t: Tables) -> DataFrame:
    """The rows of the highest margins with their place and what their source features add."""
    from quillmere.operators import mart

    rows = explained.by_source(contributions(t), GROUPS).withColumn("rounded", F.round("margin", 9))
    top = mart.rank_percentiles(rows, [F.desc("rounded"), F.col("l_orderkey"), F.col("l_linenumber")], 60)
    return top.select("l_orderkey", "l_linenumber", "place", "rank_percentile", F.round(F.col("contributions")[0]["value"], 6).alias("amounts"))


@query("k07_stratified_share", f"""with r as (select o_orderkey, o_orderstatus, o_orderpriority, row_number() over (partition by o_orderstatus, o_orderpriority order by {hashed('o_orderkey', 4)}, o_orderkey) as p, count(*) over (partition by o_orderstatus, o_orderpriority) as n from orders)
select o_orderkey, o_orderstatus, o_orderpriority from r where p <= least(round(n * 0.1), 200)""")
def stratified_share(t: Tables) -> DataFrame:
    return explained.stratified_share(t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 0.1, 200, 4)


@query("k09_subgroup_summaries", f"""with {MEANS}, d as (select l_returnflag as value, {' + '.join(f'{c} * {w}' for c, w in WEIGHTS.items())} - 1.0 as s, {', '.join(f'abs(({c} - m_{c}) * {w}) as a_{c}' for c, w in WEIGHTS.items())} from lineitem, m),
f as (select value, unnest([{', '.join(f"'{c}'" for c in WEIGHTS)}]) as feature, unnest([{', '.join(f'avg(a_{c})' for c in WEIGHTS)}]) as a from d group by value), tp as (select value, string_agg(feature, ',' order by round(a, 9) desc, feature) as drivers from f group by value)
select 'l_returnflag' as dimension, value, count(*) as n, round(count(*) / (select count(*) from d), 6) as share, round(avg(s), 6) as mean, round(stddev_pop(s), 6) as std, round(quantile_cont(s, 0.5), 6) as median, round(quantile_cont(s, 0.75), 6) as p75, round(quantile_cont(s, 0.9), 6) as p90, drivers from d join tp using (value) group by value, drivers""")
def subgroup_summaries(t: Tables) -> DataFrame:
    rows = attribution.linear_contributions(t("lineitem").select("l_returnflag", *WEIGHTS), WEIGHTS, -1.0)
    return explained.subgroup_summaries(rows, ["l_returnflag"], F.col("margin"))


@query("e13_drivers", f"""with {PARTS}, u as (select l_orderkey, l_linenumber, unnest([{', '.join(f"'{c}'" for c in WEIGHTS)}]) as f, unnest([{', '.join(WEIGHTS)}]) as v from k)
select l_orderkey, l_linenumber, sum(v > 0)::bigint as n_raises, sum(v < 0)::bigint as n_lowers from (select distinct * from u) group by 1, 2""".replace("(select distinct * from u)", "(select any_value(v) as v, f, l_orderkey, l_linenumber from u group by f, l_orderkey, l_linenumber)"))
def drivers(t: Tables) -> DataFrame:
    """How many features raise and lower each row's score; a repeated key has the first value of each feature in the file, and a feature without one counts for neither."""
    key = ["l_orderkey", "l_linenumber"]
    rows = attribution.linear_contributions(files.placed(t("lineitem")).select(*key, *WEIGHTS, "place"), WEIGHTS, -1.0)
    rows = attribution.first_contributions(rows, key, "place", list(WEIGHTS))
    known = F.exists("contributions", lambda c: c["value"].isNotNull())
    n = lambda c: F.when(known, F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, ",")))).cast("long")
    out = attribution.drivers(rows, [*key, "contributions"])
    return out.select(*key, n("raises").alias("n_raises"), n("lowers").alias("n_lowers"))


KM = f"""{COHORT}, ks as (select c_mktsegment, duration_days, event_observed from co join customer on c_custkey = entity), big as (select c_mktsegment from ks group by 1 having sum(event_observed) >= 60 order by sum(event_observed) desc, c_mktsegment limit 3),
kc as (select c_mktsegment, duration_days, count(*) as m, sum(event_observed) as d from ks join big using (c_mktsegment) group by all), kr as (select *, sum(m) over (partition by c_mktsegment order by duration_days desc) as n from kc),
kv as (select *, product(1 - d / n) over (partition by c_mktsegment order by duration_days) as s, sum(case when n = d then 0 else d / (n * (n - d)) end) over (partition by c_mktsegment order by duration_days) as g from kr)"""


def segment_gaps(t: Tables) -> DataFrame:
    rows = gaps(t).join(F.broadcast(t("customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment")), "entity")
    return survival.largest_classes(rows, "c_mktsegment", least_events=60, most=3)


@query("l03_survival_by_class", f"with {KM} select c_mktsegment, duration_days, n::bigint as at_risk, round(s, 6) as survival, round(greatest(0, s - 1.96 * s * sqrt(g)), 6) as low, round(least(1, s + 1.96 * s * sqrt(g)), 6) as high from kv")
def survival_by_class(t: Tables) -> DataFrame:
    return survival.with_interval(survival.kaplan_meier_exact(segment_gaps(t), "c_mktsegment")).select("c_mktsegment", "duration_days", "at_risk", *[F.round(c, 6).alias(c) for c in ("survival", "low", "high")])


@query("l02_median_survival", f"with {KM} select c_mktsegment, min(duration_days) filter (where s <= 0.5) as median_days from kv group by 1")
def median_survival(t: Tables) -> DataFrame:
    return survival.median_survival(survival.kaplan_meier_exact(segment_gaps(t), "c_mktsegment"), "c_mktsegment")


@fitted("j15_batch_scores")
def batch_scores(t: Tables) -> DataFrame:
    """Test rows with ids, a model's score and the calibrated one, by score bins."""
    rows = learnable(t)
    model = models.logistic(rows.filter("split = 'train'"), NUMBERS, CATEGORIES, "label", 0.01)
    val, test = (models.probability(model.transform(rows.filter(f"split = '{s}'"))) for s in ("val", "test"))
    out = models.platt(val, test, "score", "label").select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), F.round("calibrated", 6).alias("calibrated"))
    return out


def family_runs(t: Tables, runs: list[tuple[str, list[str], list[str], int | None]]) -> DataFrame:
    """A record of each run (name, numbers, categories, seed of permuted labels or None): validation metrics of a logistic model. All runs read one prepared table."""
    seeds = {seed for *_, seed in runs} - {None}
    table = experiments.prepared_table(keyed(t), "key", NUMBERS, CATEGORIES, "label", seeds, ("scaled", *[f"{c}_hot" for c in CATEGORIES]))
    out = []
    for name, numbers, categories, seed in runs:
        scores = experiments.logistic_scores(experiments.family(table, numbers, categories, NUMBERS), 0.01, "label" if seed is None else f"label_{seed}")
        out.append(scores.select(F.lit(name).alias("run"), F.lit(seed).cast("int").alias("seed"), "score", F.col("label").cast("int").alias("label")))
    table = evaluation.ranking(reduce(DataFrame.unionByName, out), ["run", "seed"], "score", "label")
    table = table.select("run", "seed", "n", "average_precision", "roc_auc", F.round(F.col("pos") / F.col("n"), 6).alias("prevalence"))
    return table.withColumn("alert", (F.col("seed").isNotNull()) & (F.col("average_precision") > 2 * F.col("prevalence")))


@fitted("j17_seed_matrix")
def seed_matrix(t: Tables) -> DataFrame:
    return family_runs(t, [(f"permuted-{s}", NUMBERS, CATEGORIES, s) for s in (3, 11, 29)])


@fitted("j18_family_ablation")
def family_ablation(t: Tables) -> DataFrame:
    return family_runs(t, [("all", NUMBERS, CATEGORIES, None), ("without_price", [c for c in NUMBERS if c != "l_extendedprice"], CATEGORIES, None), ("numbers_with_flag", NUMBERS, ["l_returnflag"], None), ("tax_only", ["l_tax"], CATEGORIES, None)])


@fitted("j12_long_horizon")
def long_horizon(t: Tables) -> DataFrame:
    """The settings of the short horizon on another label's split: 180 days."""
    table = experiments.prepared_table(learnable(t, 180).filter("split in ('train', 'val')"), "l_orderkey", NUMBERS, CATEGORIES, "label", set())
    scores = experiments.logistic_scores(table, 0.01).select("score", F.col("label").cast("int").alias("label"))
    return evaluation.ranking(scores, [], "score", "label")


@fitted("k01_tree_contributions")
def tree_contributions(t: Tables) -> DataFrame:
    """Exact contributions to boosted trees, with the largest residual of base and contributions against the margin."""
    rows = learnable(t).withColumn("held", F.col("split") == "val")
    model = models.boosted(rows.filter("split in ('train', 'val')"), NUMBERS, [], "label", "held", rounds=5)
    made = model.transform(rows.filter("split = 'test'"))
    out = explained.tree_contributions(made, model.stages[-1], ["l_orderkey", "l_linenumber"], NUMBERS)
    return attribution.checked_importance(out, NUMBERS).select("feature", F.round("mean_abs", 4).alias("mean_abs"), "n", "n_failed")
