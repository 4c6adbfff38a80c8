"""Queries on dates, identifiers, geometry, weather, splits, resampling, attribution and concordance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions import dates, geometry, text
from quillmere.operators import attribution, evaluation, ordering, resampling, spatial, splits, survival, weather
from quillmere.operators.ordering import portable_hash_sql as hashed
from quillmere.plans.registry import COHORT, SCORED, Tables, gaps, query, scored

RAW_DATE = "case o_orderkey % 6 when 0 then {iso} || ' 10:15:30' when 1 then {iso} when 2 then 'vers ' || {year} when 3 then '' when 4 then 'inconnu' else 'n/a' end"
DUCK_DATE = RAW_DATE.format(iso="strftime(o_orderdate, '%Y-%m-%d')", year="year(o_orderdate)::varchar")
SPARK_DATE = RAW_DATE.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", year="cast(year(o_orderdate) as string)")


@query("h01_date_status", f"""with r as (select o_orderkey % 6 as k, o_orderdate::date as d, {DUCK_DATE} as raw from orders), p as (select case k when 0 then 'precise' when 1 then 'date_only' when 2 then 'imprecise_year' when 5 then 'parse_failure' else 'missing' end as status, case when k in (0, 1) then d when k = 2 then make_date(year(d), 1, 1) end as day from r)
select status, day, count(*) as n from p group by all""")
def date_status(t: Tables) -> DataFrame:
    found = dates.parsed(F.expr(SPARK_DATE), ("yyyy-MM-dd HH:mm:ss",), ("yyyy-MM-dd", "yyyy/MM/dd"), ("0", "inconnu"))
    return t("orders").select(found.alias("p")).groupBy("p.status", "p.day").agg(F.count("*").alias("n"))


@query("h03_localised", """with e as (select event_id, ts + shift as loc from events, (select unnest([interval 46 day, interval 290 day]) as shift)),
s as (select *, case when loc >= timestamp '2024-03-10 02:00:00' and loc < timestamp '2024-03-10 03:00:00' then 'nonexistent_dst' when loc >= timestamp '2024-11-03 01:00:00' and loc < timestamp '2024-11-03 02:00:00' then 'ambiguous_dst' else 'successfully_localized' end as status, loc >= timestamp '2024-03-10 03:00:00' and loc < timestamp '2024-11-03 01:00:00' as summer from e)
select status, count(*) as n, sum(case when status = 'successfully_localized' then date_diff('hour', loc, loc + case when summer then interval 4 hour else interval 5 hour end) else 0 end)::bigint as hours from s group by 1""")
def localised(t: Tables) -> DataFrame:
    at = t("events").select(F.explode(F.array(F.expr("ts + interval 46 day"), F.expr("ts + interval 290 day"))).alias("at"))
    rows = at.select(F.col("at").cast("timestamp_ntz").alias("at")).withColumn("l", dates.localised(F.col("at"), "America/Toronto"))
    hours = F.coalesce(F.expr("timestampdiff(HOUR, at, l.utc)"), F.lit(0))
    return rows.groupBy("l.status").agg(F.count("*").alias("n"), F.sum(hours).alias("hours"))


@query("h05_date_intervals", """with r as (select o_orderdate::date as d, case o_orderkey % 4 when 0 then 'exact' when 1 then 'month' when 2 then 'year' else '5y' end as p, l_shipdate::date as s from orders join lineitem on l_orderkey = o_orderkey),
i as (select p, s, case p when 'exact' then d when 'month' then date_trunc('month', d) when 'year' then date_trunc('year', d) else d - interval 60 month end::date as lo, case p when 'exact' then d when 'month' then last_day(d) when 'year' then make_date(year(d), 12, 31) else d + interval 60 month end::date as hi from r)
select p as "precision", case when lo > s then 'confirmed' when hi > s then 'possible' else 'none' end as status, count(*) as n, min(lo) as lowest, max(hi) as highest, round(avg((s - lo) / 365.25), 6) as mean_age from i group by all""")
def intervals(t: Tables) -> DataFrame:
    rows = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("o_orderkey") % 4 == 0, "exact").when(F.col("o_orderkey") % 4 == 1, "month").when(F.col("o_orderkey") % 4 == 2, "year").otherwise("5y")
    rows = rows.select(F.col("o_orderdate").cast("date").alias("d"), kind.alias("precision"), F.col("l_shipdate").cast("date").alias("s"))
    rows = rows.withColumn("i", dates.interval_around(F.col("d"), F.col("precision")))
    shipped = F.struct(F.col("s").alias("lower"), F.col("s").alias("upper"))
    return rows.groupBy("precision", dates.contradiction(F.col("i"), shipped).alias("status")).agg(F.count("*").alias("n"), F.min("i.lower").alias("lowest"), F.max("i.upper").alias("highest"), F.round(F.avg(dates.age_years(F.col("i.lower"), F.col("s"))), 6).alias("mean_age"))


RAW_ID = "case o_orderkey % 6 when 0 then cast(o_orderkey as varchar(20)) when 1 then cast(o_orderkey as varchar(20)) || '.0' when 2 then 'NP-' || cast(o_orderkey as varchar(20)) when 3 then 'ct' when 4 then ' ' else cast(o_orderkey as varchar(20)) || '.50' end"


@query("b05_identifiers", """select case o_orderkey % 6 when 0 then 'numeric' when 1 then 'other' when 2 then 'prefixed' when 3 then 'letters' when 4 then 'blank' else 'other' end as class, case o_orderkey % 6 when 1 then 1 when 5 then 2 else 0 end::int as decimals,
count(*) as n, count(case when o_orderkey % 6 in (0, 1) then 1 end) as n_ids, max(case when o_orderkey % 6 in (0, 1) then o_orderkey end)::varchar as largest from orders group by 1, 2""")
def identifiers(t: Tables) -> DataFrame:
    rows = t("orders").select(F.expr(RAW_ID).cast("string").alias("raw")).withColumn("id", text.whole_number_id(F.col("raw")))
    return rows.groupBy(text.id_class(F.col("raw")).alias("class"), text.stored_decimals(F.col("raw")).alias("decimals")).agg(F.count("*").alias("n"), F.count("id").alias("n_ids"), F.max(F.col("id").cast("long")).cast("string").alias("largest"))


P = geometry.Projection()
LON, LAT = "(-74.0 + (c_custkey % 1000) / 1000.0)::double", "(45.3 + (c_custkey * 7 % 500) / 1000.0)::double"
SERIES = lambda f, g: " + ".join(f"{a!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(P.ahead, 1))


@query("h27_projected", f"""with g as (select c_custkey, {LON} as lon, {LAT} as lat from customer), a as (select *, sinh(atanh(sin(radians(lat))) - {P.eccentricity!r} * atanh({P.eccentricity!r} * sin(radians(lat)))) as t, radians(lon) - radians({P.meridian}) as w from g),
b as (select *, atan2(t, cos(w)) as xi, atanh(sin(w) / sqrt(1 + t * t)) as eta from a)
select c_custkey, round({P.easting} + {P.radius!r} * (eta + {SERIES('cos', 'sinh')}), 3) as x, round({P.radius!r} * (xi + {SERIES('sin', 'cosh')}), 3) as y from b""")
def projected(t: Tables) -> DataFrame:
    x, y = P.forward(F.col("lon"), F.col("lat"))
    return placed(t).select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def placed(t: Tables) -> DataFrame:
    lon, lat = (-74.0 + (F.col("c_custkey") % 1000) / 1000.0), (45.3 + (F.col("c_custkey") * 7 % 500) / 1000.0)
    return t("customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))


@query("h28_round_trip", "select count(*) as n, count(*) as n_within_1_mm from customer")
def round_trip(t: Tables) -> DataFrame:
    x, y = P.forward(F.col("lon"), F.col("lat"))
    rows = placed(t).withColumns({"x": x, "y": y})
    lon, lat = P.inverse(F.col("x"), F.col("y"))
    again_x, again_y = P.forward(F.col("lon2"), F.col("lat2"))
    rows = rows.withColumns({"lon2": lon, "lat2": lat}).withColumn("off", F.hypot(again_x - F.col("x"), again_y - F.col("y")))
    near = (F.col("off") < 0.001) & (F.abs(F.col("lon2") - F.col("lon")) < 1e-8) & (F.abs(F.col("lat2") - F.col("lat")) < 1e-8)
    return rows.agg(F.count("*").alias("n"), F.count_if(near).alias("n_within_1_mm"))


POINTS = "pt as (select o_orderkey as point, (o_orderkey * 37 % 1000)::double as x, (o_orderkey * 91 % 1000 + 0.25)::double as y from orders)"
LINES = "ln as (select s_suppkey as line, (s_suppkey * 53 % 1000)::double as x1, (s_suppkey * 71 % 1000)::double as y1, (s_suppkey * 53 % 1000 + 30 + s_suppkey % 17)::double as x2, (s_suppkey * 71 % 1000 + 40 - s_suppkey % 23)::double as y2 from supplier)"
PAIRS = f"""{POINTS}, {LINES}, u as (select *, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) as t from pt, ln),
pairs as (select point, line, sqrt((x - (x1 + t * (x2 - x1))) ** 2 + (y - (y1 + t * (y2 - y1))) ** 2) as d from u)"""


def points(t: Tables) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("point"), (F.col("o_orderkey") * 37 % 1000).cast("double").alias("x"), (F.col("o_orderkey") * 91 % 1000 + 0.25).cast("double").alias("y"))


def lines(t: Tables) -> DataFrame:
    s = F.col("s_suppkey")
    ends = {"x1": s * 53 % 1000, "y1": s * 71 % 1000, "x2": s * 53 % 1000 + 30 + s % 17, "y2": s * 71 % 1000 + 40 - s % 23}
    return t("supplier").select(s.alias("line"), *[c.cast("double").alias(n) for n, c in ends.items()])


@query("c09_nearest_line", f"""with {PAIRS}, n as (select point, min(d) as d, arg_min(line, (d, line)) as line from pairs where d <= 25 group by 1), k as (select n.point, count(*) as c from n join pairs p on p.point = n.point and p.d <= n.d + 0.5 and p.d <= 25 group by 1)
select pt.point, n.line, round(n.d, 6) as distance, case when n.d is null then 'unmatched' when c > 1 then 'review_required' else 'accepted' end as status from pt left join n using (point) left join k using (point)""")
def nearest_line(t: Tables) -> DataFrame:
    return spatial.nearest(points(t), lines(t), "point", "line", 25.0, 0.5).withColumn("distance", F.round("distance", 6))


@query("c10_band_counts", f"with {PAIRS} select point, " + ", ".join(f"count(*) filter (where d <= {b}) as n_{b}" for b in (10, 15, 20, 30, 50)) + " from pairs group by 1")
def band_counts(t: Tables) -> DataFrame:
    return spatial.band_counts(points(t), lines(t), "point", "line", (10, 15, 20, 30, 50))


@query("c12_line_polygon", f"""with {LINES}, sq as (select n_nationkey as polygon, 210.0 * (n_nationkey % 5) as a, 210.0 * (n_nationkey // 5) as b from nation),
u as (select line, polygon, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) as len, least(1, (a + 210 - x1) / (x2 - x1), case when y2 > y1 then (b + 210 - y1) / (y2 - y1) else 1 end) - greatest(0, (a - x1) / (x2 - x1), case when y2 > y1 then (b - y1) / (y2 - y1) else 0 end) as part from ln, sq),
o as (select line, polygon, len, part * len as overlap from u where part > 0), m as (select line, max(overlap) as overlap, arg_min(polygon, (-overlap, polygon)) as polygon, count(*) as n_candidates from o group by 1),
k as (select m.line, count(*) as c from m join o on o.line = m.line and o.overlap >= m.overlap - 0.1 group by 1)
select ln.line, m.polygon, round(m.overlap, 6) as overlap, round(m.overlap / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), 6) as fraction, coalesce(n_candidates, 0) as n_candidates, case when m.line is null then 'none' when c > 1 then 'ambiguous' else 'accepted' end as status from ln left join m using (line) left join k using (line)""")
def line_polygon(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    a, b = (k % 5 * 210).cast("double"), (F.floor(k / 5) * 210).cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    squares = t("nation").select(k.alias("polygon"), F.array(corner(a, b), corner(a + 210, b), corner(a + 210, b + 210), corner(a, b + 210)).alias("corners"))
    edges = lines(t)
    whole = edges.select("line", F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)).alias("length"))
    out = spatial.primary_polygon(spatial.overlaps(edges, squares, "line", "polygon", 100.0), whole, "line", "polygon")
    return out.withColumns({"overlap": F.round("overlap", 6), "fraction": F.round("fraction", 6)})


DAILY = "wd as (select l_returnflag as station, l_shipdate::date as day, sum(l_quantity) as rain, min(l_quantity) - 5 as low, avg(l_quantity) as mean, max(l_quantity) - 45 as high from lineitem group by all)"


def daily(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t("lineitem").groupBy(F.col("l_returnflag").alias("station"), F.col("l_shipdate").cast("date").alias("day")).agg(F.sum(q).alias("rain"), (F.min(q) - 5).alias("low"), F.avg(q).alias("mean"), (F.max(q) - 45).alias("high"))


@query("d08_trailing_weather", f"""with {DAILY}, an as (select distinct last_day(d::date) as t from generate_series(date '1995-01-01', date '2001-12-31', interval 1 day) g(d))
select t as as_of_date, """ + ", ".join(f"round(sum(rain) filter (where day > t - {w}), 6) as rain_{w}d, round(avg(mean) filter (where day > t - {w}), 6) as mean_{w}d, min(low) filter (where day > t - {w}) as low_{w}d, max(high) filter (where day > t - {w}) as high_{w}d, count(*) filter (where day > t - {w} and low < 0 and high > 0) as freeze_thaw_{w}d, count(mean) filter (where day > t - {w}) as days_{w}d, round(count(mean) filter (where day > t - {w}) / {w}, 6) as coverage_{w}d" for w in (30, 90)) + """
from an join wd on day <= t and day > t - 90 where station = 'A' group by 1""")
def trailing_weather(t: Tables) -> DataFrame:
    out = weather.trailing_weather(daily(t).filter("station = 'A'"), "day", (30, 90)).filter("as_of_date <= '2001-12-31'")
    return out.withColumns({f"{c}_{w}d": F.round(f"{c}_{w}d", 6) for c in ("rain", "mean", "coverage") for w in (30, 90)})


@query("d27_freeze_thaw_years", f"with {DAILY} select station, year(day)::int as year, count(*) as n_days, count(*) filter (where low is null or high is null) as missing_days, count(*) filter (where low < 0 and high > 0) as strict, count(*) filter (where low <= 0 and high > 0) as low_at_most_0, count(*) filter (where low < 0 and high >= 0) as high_at_least_0 from wd group by 1, 2")
def freeze_thaw_years(t: Tables) -> DataFrame:
    return weather.freeze_thaw_years(daily(t), "station", "day")


@query("d29_date_audit", "with c as (select l_returnflag, l_shipdate::date as day, count(*) as n from lineitem group by all), y as (select l_returnflag, year(day)::int as year, count(*) as present_days, sum(n - 1)::bigint as duplicate_rows from c group by 1, 2) select *, dayofyear(make_date(year, 12, 31))::int as expected_days, dayofyear(make_date(year, 12, 31)) - present_days as missing_days from y")
def date_audit(t: Tables) -> DataFrame:
    return weather.date_audit(t("lineitem").withColumn("day", F.col("l_shipdate").cast("date")), "l_returnflag", "day")


@query("c25_station_comparison", f"with {DAILY}, j as (select a.rain as ar, b.rain as br, a.mean as am, b.mean as bm from (select * from wd where station = 'A') a full join (select * from wd where station = 'N') b using (day)) " + " union all ".join(f"select '{n}' as column_name, count(*) filter (where {a} is not null and {b} is not null) as n_common, round(avg({a} - {b}), 6) as mean_difference, round(corr({a}, {b}), 6) as correlation, count(*) filter (where {b} is null) as only_a, count(*) filter (where {a} is null) as only_b from j" for n, a, b in (("rain", "ar", "br"), ("mean", "am", "bm"))))
def stations(t: Tables) -> DataFrame:
    d = daily(t)
    return weather.compared(d.filter("station = 'A'"), d.filter("station = 'N'"), "day", ["rain", "mean"]).withColumns({c: F.round(c, 6) for c in ("mean_difference", "correlation")})


LABELLED = "lb as (select o_orderkey, o_custkey, o_orderstatus, last_day(o_orderdate::date) as t, (o_orderpriority = '1-URGENT')::int as label from orders)"


def labelled(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.last_day("o_orderdate").alias("t"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"))


SPLIT = lambda h: f"case when t < date '1999-01-31' and t + {h} >= date '1999-01-31' then 'purged' when t < date '1999-01-31' then 'train' when t < date '2000-06-30' and t + {h} >= date '2000-06-30' then 'purged' when t < date '2000-06-30' then 'val' else 'test' end"


@query("j01_chronological_split", " union all ".join(f"select {h} as horizon, split, case when split <> 'purged' then 'kept' when t < date '1999-01-31' then 'reaches_val' else 'reaches_test' end as reason, count(*) as n, min(t) as first_day, max(t) as last_day from (select *, {SPLIT(h)} as split from (with {LABELLED} select * from lb)) group by all" for h in (90, 180)))
def chronological_split(t: Tables) -> DataFrame:
    rows = labelled(t)
    parts = [rows.select(F.lit(h).alias("horizon"), splits.split_of(F.col("t"), h, "1999-01-31", "2000-06-30").alias("s"), "t") for h in (90, 180)]
    return parts[0].union(parts[1]).groupBy("horizon", "s.split", "s.reason").agg(F.count("*").alias("n"), F.min("t").alias("first_day"), F.max("t").alias("last_day"))


@query("j03_purge_gaps", f"with {LABELLED}, s as (select t, {SPLIT(90)} as split from lb) select (min(t) filter (where split = 'val') - (max(t) filter (where split = 'train') + 90))::int as train_val_gap, (min(t) filter (where split = 'test') - (max(t) filter (where split = 'val') + 90))::int as val_test_gap from s")
def purge_gaps(t: Tables) -> DataFrame:
    rows = labelled(t).withColumn("split", splits.split_of(F.col("t"), 90, "1999-01-31", "2000-06-30")["split"])
    return splits.purge_gaps(rows, "t", "split", 90)


PAST = f"{LABELLED}, tr as (select * from lb where t < date '1999-01-31'), te as (select * from lb where t >= date '1999-01-31'), al as (select avg(label) as a from tr)"


@query("j06_class_prior", f"with {PAST}, g as (select o_orderstatus, avg(label) as r from tr group by 1 having count(*) >= 30) select o_orderkey, round(coalesce(r, a), 6) as score from te left join g using (o_orderstatus), al")
def class_prior(t: Tables) -> DataFrame:
    rows = labelled(t)
    return splits.class_prior(rows.filter("t < '1999-01-31'"), rows.filter("t >= '1999-01-31'"), "o_orderstatus", "label").select("o_orderkey", F.round("score", 6).alias("score"))


@query("j07_entity_history", f"with {PAST}, g as (select o_custkey, (sum(label) + 1) / (count(*) + 2) as r from tr group by 1) select o_orderkey, round(coalesce(r, a), 6) as score from te left join g using (o_custkey), al")
def entity_history(t: Tables) -> DataFrame:
    rows = labelled(t)
    return splits.entity_history(rows.filter("t < '1999-01-31'"), rows.filter("t >= '1999-01-31'"), "o_custkey", "label").select("o_orderkey", F.round("score", 6).alias("score"))


@query("j13_stratified", f"with {LABELLED}, r as (select o_orderkey, label, row_number() over (partition by label order by {hashed('o_orderkey', 3)}, o_orderkey) as p from lb) select o_orderkey, label from r where p <= 1000")
def stratified(t: Tables) -> DataFrame:
    return ordering.stratified(labelled(t), "label", "o_orderkey", 1000, 3).select("o_orderkey", "label")


@query("j16_permuted_labels", f"with {LABELLED}, a as (select o_orderkey, row_number() over (order by {hashed('o_orderkey', 11)}, o_orderkey) as p from lb), b as (select label, row_number() over (order by {hashed('o_orderkey', 12)}, o_orderkey) as p from lb) select o_orderkey, label from a join b using (p)")
def permuted_labels(t: Tables) -> DataFrame:
    return ordering.permuted(labelled(t), "o_orderkey", "label", 11)


@query("j20_unseen_values", f"with {PAST} " + " union all ".join(f"select '{c}' as column_name, (select count(distinct {c}) from tr) as n_train, (select count(distinct {c}) from te) as n_rows, (select count(distinct {c}) from te where {c} not in (select {c} from tr)) as n_unseen" for c in ("o_custkey", "o_orderstatus")))
def unseen_values(t: Tables) -> DataFrame:
    rows = labelled(t)
    return splits.unseen(rows.filter("t < '1999-01-31'"), rows.filter("t >= '1999-01-31'"), ["o_custkey", "o_orderstatus"])


CURVE = f"{SCORED}, c as (select part, p, count(*) as n, sum(label) as pos from sc group by all), k as (select part, p, sum(n) over w as m, sum(pos) over w as tp, sum(n) over (partition by part) as total, sum(pos) over (partition by part) as yes from c window w as (partition by part order by p desc)), cv as (select part, round(p, 6) as p, tp::bigint as tp, (m - tp)::bigint as fp, round(tp / m, 6) as \"precision\", round(tp / yes, 6) as recall, round((m - tp) / (total - yes), 6) as fpr from k)"


@query("i15_curve_points", f"with {CURVE} select * from cv")
def curve_points(t: Tables) -> DataFrame:
    return evaluation.curve(scored(t), ["part"], "p", "label").withColumn("p", F.round("p", 6))


@query("i10_recall_threshold", f'with {CURVE} select part, max(p) as threshold, arg_max(tp, p) as tp, arg_max(fp, p) as fp, arg_max("precision", p) as "precision", arg_max(recall, p) as recall from cv where recall >= 0.4 group by 1')
def recall_threshold(t: Tables) -> DataFrame:
    return evaluation.recall_threshold(scored(t), ["part"], "p", "label", 0.4).withColumn("threshold", F.round("threshold", 6))


@query("i13_cluster_bootstrap", f"""with o as (select o_custkey as u, round(o_totalprice / 1000) as p, (o_orderpriority = '1-URGENT')::int as label from orders), un as (select u, row_number() over (order by {hashed('u', 5)}, u) - 1 as i from (select distinct u from o)), nn as (select count(*) as n from un),
dr as (select r, {hashed('i * 20 + r', 6)} % n as i, count(*) as w from un, nn, range(20) q(r) group by all), ce as (select r, p, sum(w) as n, sum(w * label) as pos from o join un using (u) join dr using (i) group by all),
k as (select *, sum(n) over (partition by r order by p desc) as m, sum(pos) over (partition by r order by p desc) as tp from ce), e as (select r, round(sum(pos * tp / m) / sum(pos), 6) as ap, round(1 - sum(pos * ((m - n) - (tp - pos) + (n - pos) / 2)) / (sum(pos) * (sum(n) - sum(pos))), 6) as auc from k group by 1)
""" + " union all ".join(f"select '{m}' as metric, count(*) as n_used, round(quantile_cont({c}, 0.025), 6) as low, round(quantile_cont({c}, 0.975), 6) as high from e" for m, c in (("average_precision", "ap"), ("roc_auc", "auc"))))
def cluster_bootstrap(t: Tables) -> DataFrame:
    rows = t("orders").select(F.col("o_custkey").alias("u"), F.round(F.col("o_totalprice") / 1000).alias("p"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"))
    return resampling.bootstrap_ranking(rows, "u", "p", "label", 20, 5)


@query("i14_subgroups", f"""with {SCORED}, g as (select 'l_returnflag' as dimension, l_returnflag as value, p, label from sc union all select 'part', part, p, label from sc), c as (select dimension, value, p, count(*) as n, sum(label) as pos from g group by all),
w as (select *, sum(n) over v as m, sum(pos) over v as tp from c window v as (partition by dimension, value order by p desc)),
e as (select dimension, value, sum(n)::bigint as n, sum(pos)::bigint as pos, round(sum(pos * tp / m) / sum(pos), 6) as ap, round(1 - sum(pos * ((m - n) - (tp - pos) + (n - pos) / 2)) / (sum(pos) * (sum(n) - sum(pos))), 6) as auc from w group by all), s as (select *, case when n < 2500 then 'too_few_rows' when pos < 200 then 'too_few_positives' when pos = n then 'one_class' else 'ok' end as status from e)
select dimension, value, n, pos, case when status = 'ok' then ap end as average_precision, case when status = 'ok' then auc end as roc_auc, status from s""")
def subgroup_table(t: Tables) -> DataFrame:
    return resampling.subgroups(scored(t), ["l_returnflag", "part"], "p", "label", 2500, 200)


WEIGHTS = {"l_quantity": 0.02, "l_discount": -3.5, "l_tax": 1.25}
MEANS = "m as (select " + ", ".join(f"avg({c}) as m_{c}" for c in WEIGHTS) + " from lineitem)"
PARTS = f"{MEANS}, k as (select l_orderkey, l_linenumber, " + ", ".join(f"({c} - m_{c}) * {w} as {c}" for c, w in WEIGHTS.items()) + " from lineitem, m)"


def contributions(t: Tables) -> DataFrame:
    return attribution.linear_contributions(t("lineitem").select("l_orderkey", "l_linenumber", *WEIGHTS), WEIGHTS, -1.0)


@query("k02_additivity", "select count(*) as n, true as exact, 0::bigint as n_failed from lineitem")
def additivity(t: Tables) -> DataFrame:
    return attribution.additivity(contributions(t)).select("n", (F.col("max_residual") < 1e-9).alias("exact"), "n_failed")


@query("k03_importance", f"with {PARTS} " + " union all ".join(f"select '{c}' as feature, round(avg(abs({c})), 6) as mean_abs, round(count(*) filter (where {c} > 0) / count(*), 6) as positive_share, round(count(*) filter (where {c} < 0) / count(*), 6) as negative_share from k" for c in WEIGHTS))
def importance(t: Tables) -> DataFrame:
    return attribution.importance(contributions(t)).select("feature", *[F.round(c, 6).alias(c) for c in ("mean_abs", "positive_share", "negative_share")])


@query("l09_concordance", f"""with {COHORT}, c as (select duration_days as d, event_observed as e, entity % 97 as s, count(*) as m from co group by all)
select sum(a.m * b.m)::bigint as pairs, sum(case when a.s > b.s then a.m * b.m else 0 end)::bigint as concordant, sum(case when a.s = b.s then a.m * b.m else 0 end)::bigint as tied, round((sum(case when a.s > b.s then a.m * b.m else 0 end) + sum(case when a.s = b.s then a.m * b.m else 0 end) / 2) / sum(a.m * b.m), 6) as c_index
from c a join c b on a.e = 1 and (a.d < b.d or (a.d = b.d and b.e = 0))""")
def concordance(t: Tables) -> DataFrame:
    return survival.concordance(gaps(t).withColumn("score", F.col("entity") % 97), "duration_days", "event_observed", "score")
