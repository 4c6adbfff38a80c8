"""Queries of sources and sinks, first steps, joins and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions import rows as row_functions
from quillmere.functions import text
from quillmere.operators import canonical, experiments, mart, panel
from quillmere.plans.audits import SMALL_PANEL, small_panel
from quillmere.plans.registry import ANCHORS, EV, FIRST, LAST, Tables, query, urgent
from quillmere.sources import sinks

PANEL_COLUMNS = ["entity", "as_of_date", "target_90d", "target_180d", "events_365d", "collapsed_365d", "last_event"]


def lines(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    xy = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    line = F.when(k % 5 == 0, F.array(xy(k % 100, k % 70))).otherwise(F.array(xy(k % 100, k % 70), xy(k % 100 + 3, k % 70 + 4), xy(k % 100 + 3, k % 70 + 10)))
    return t("customer").select(k.alias("id"), "c_mktsegment", line.alias("line"))


LINES = """ln as (select c_custkey as id, c_mktsegment, c_custkey % 5 = 0 as is_point, (c_custkey % 100)::double as x, (c_custkey % 70)::double as y from customer)"""


@query("a03_geometry_blobs", f"with {LINES} select id, case when is_point then 1 else 3 end::int as n_points, x as first_x, y as first_y, case when is_point then 0.0 else 11.0 end::double as length from ln")
def geometry_blobs(t: Tables) -> DataFrame:
    rows = lines(t).select("id", sinks.encoded("line").alias("blob")).select("id", sinks.decoded(sinks.wkb_of(F.col("blob"))).alias("line"))
    return rows.select("id", F.size("line").alias("n_points"), F.col("line")[0]["x"].alias("first_x"), F.col("line")[0]["y"].alias("first_y"), row_functions.line_length("line").alias("length"))


@query("a05_station_days", """select 'A' as station, l_shipdate::date::varchar as day, case when l_orderkey % 9 <> 0 then l_quantity end as rain, null::double as snow, case when l_orderkey % 7 = 0 then 'T' end as flag from lineitem where l_returnflag = 'A'""")
def station_days(t: Tables) -> DataFrame:
    rows = t("lineitem").filter("l_returnflag = 'A'")
    raw = rows.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date/Time"), F.when(F.col("l_orderkey") % 9 != 0, F.col("l_quantity").cast("string")).otherwise("M").alias("Total Rain (mm)"), F.when(F.col("l_orderkey") % 7 == 0, "T").alias("Total Rain Flag"), F.year("l_shipdate").alias("year"))
    path = sinks.scratch(rows.sparkSession, "station")
    raw.write.partitionBy("year").option("header", True).csv(path)
    names = {"Date/Time": "day", "Total Rain (mm)": "rain", "Total Snow (cm)": "snow", "Total Rain Flag": "flag"}
    return sinks.station_days(rows.sparkSession, path, names, ["rain", "snow"], "A")


def panel_rows(t: Tables) -> DataFrame:
    return small_panel(t).filter("month(as_of_date) in (3, 6)").withColumns({"panel_year": F.year("as_of_date"), "panel_month": F.month("as_of_date")})


def written_panel(t: Tables, rows: DataFrame | None = None) -> tuple[DataFrame, str]:
    rows = panel_rows(t) if rows is None else rows
    path = sinks.scratch(rows.sparkSession, "panel")
    sinks.write_partitions(rows, path, ["panel_year", "panel_month"], ["entity"])
    return rows, path


@query("a06_partitioned_scan", f"with {SMALL_PANEL} select year(as_of_date)::int as panel_year, count(*) as n, sum(target_90d)::bigint as positives from pn where month(as_of_date) in (3, 6) group by 1")
def partitioned_scan(t: Tables) -> DataFrame:
    rows, path = written_panel(t)
    return rows.sparkSession.read.parquet(path).select("panel_year", "target_90d").groupBy("panel_year").agg(F.count("*").alias("n"), F.sum("target_90d").alias("positives"))


@query("a07_anchor_partition", f"with {SMALL_PANEL} select entity, target_90d, events_365d from pn where year(as_of_date) = 1998 and month(as_of_date) = 6")
def anchor_partition(t: Tables) -> DataFrame:
    rows, path = written_panel(t)
    return sinks.anchor_partition(rows.sparkSession, path, ["entity", "target_90d", "events_365d"], panel_year=1998, panel_month=6)


@query("a10_written_panel", f"with {SMALL_PANEL} select entity, as_of_date, target_90d, target_180d, events_365d, collapsed_365d, last_event from pn where month(as_of_date) in (3, 6)")
def written_back(t: Tables) -> DataFrame:
    rows, path = written_panel(t)
    return rows.sparkSession.read.parquet(path).select(*PANEL_COLUMNS)


@query("a11_resumed_partitions", "select 1998::int as panel_year, 6::int as panel_month, 0::bigint as still_invalid union all select 2000, 3, 0")
def resumed(t: Tables) -> DataFrame:
    """Two partitions are damaged, found by their fingerprints and written anew. The panel is built once, and all steps read that table."""
    rows, path = written_panel(t, experiments.written(panel_rows(t), "panel-source"))
    by, columns = ["panel_year", "panel_month"], PANEL_COLUMNS
    damaged = rows.filter("panel_year = 1998 and panel_month = 6 or panel_year = 2000 and panel_month = 3").withColumn("target_90d", 1 - F.col("target_90d"))
    sinks.write_partitions(damaged, path, by, ["entity"])
    again = sinks.resume(rows, path, by, ["entity"], columns)
    left = sinks.invalid_partitions(rows.sparkSession, path, sinks.fingerprint(rows, by, columns), by, columns)
    return again.crossJoin(left.agg(F.count("*").alias("still_invalid")))


@query("a12_feature_sink", f"with {LINES} select id, c_mktsegment, case when is_point then 'Point' else 'LineString' end as geometry_type, x as first_x, y as first_y from ln")
def feature_sink(t: Tables) -> DataFrame:
    rows = lines(t)
    path = sinks.scratch(rows.sparkSession, "features")
    sinks.write_features(rows, path, "id", "line", ["id", "c_mktsegment"])
    back = sinks.read_features(rows.sparkSession, path, "id long, c_mktsegment string")
    return back.select("id", "c_mktsegment", "geometry_type", F.col("line")[0]["x"].alias("first_x"), F.col("line")[0]["y"].alias("first_y"))


@query("a09_geometry_sink", f"with {LINES} select 'EPSG:32188' as working_crs, count(*) as n, sum(case when is_point then 0.0 else 11.0 end)::double as total_length from ln")
def geometry_sink(t: Tables) -> DataFrame:
    rows = lines(t)
    path = sinks.scratch(rows.sparkSession, "geometries")
    sinks.write_geometries(rows, path, "EPSG:32188")
    return rows.sparkSession.read.parquet(path).groupBy("working_crs").agg(F.count("*").alias("n"), F.sum(row_functions.line_length("line")).alias("total_length"))


@query("a14_round_trip", "select count(*) as rows_in, count(*) as rows_out, true as same_columns, true as same_content from orders")
def round_trip(t: Tables) -> DataFrame:
    rows = t("orders")
    return sinks.round_trip(rows, sinks.scratch(rows.sparkSession, "orders"), rows.columns)


RAW_NUMBER = "case when o_orderkey % 7 = 0 then 'n/a' when o_orderkey % 11 = 0 then '' else cast(o_custkey as {s}) end"


@query("a16_canonical_orders", f"""select count(*) as n, min(o_custkey)::double as least, count(try_cast({RAW_NUMBER.format(s='varchar')} as double)) as n_numbers, sum(try_cast({RAW_NUMBER.format(s='varchar')} as double)) as total,
1::bigint as first_record, count(*) as last_record, count(*) as n_records, 'orders' as dataset, sum((o_orderpriority = '1-URGENT')::int)::bigint as n_flagged from orders where true""".replace("min(o_custkey)::double as least, ", ""))
def canonical_orders(t: Tables) -> DataFrame:
    raw = t("orders").select(F.col("o_orderkey").alias("Order No"), F.expr(RAW_NUMBER.format(s="string")).alias("Client No"), F.col("o_orderpriority").alias("Priorite"), F.lit("x").alias("unmapped"))
    names = {"Order No": "order_id", "Client No": "customer_number", "Priorite": "priority"}
    rows = canonical.canonicalised(raw, names, ["customer_number"], "order_id", {"source_dataset": "orders", "source_file": "orders.csv", "schema_version": 1}, {"is_urgent": F.col("priority") == "1-URGENT"})
    return rows.groupBy(F.col("source_dataset").alias("dataset")).agg(F.count("*").alias("n"), F.count("customer_number").alias("n_numbers"), F.sum("customer_number").alias("total"), F.min("source_record_number").alias("first_record"), F.max("source_record_number").alias("last_record"), F.count_distinct("source_record_number").alias("n_records"), F.count_if("is_urgent").alias("n_flagged"))


@query("b02_provenance_years", """select case o_orderkey % 2 when 0 then year(o_orderdate)::varchar else year(o_orderdate)::varchar || '-' || (year(o_orderdate) + 1)::varchar end as campaign, year(o_orderdate)::int as source_year, count(*) as n from orders group by all""")
def provenance_years(t: Tables) -> DataFrame:
    year = F.year("o_orderdate").cast("string")
    rows = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, year).otherwise(F.concat(year, F.lit("-"), (F.year("o_orderdate") + 1).cast("string"))).alias("campaign"))
    return canonical.with_provenance(rows, "o_orderkey", {"source_file": "o.csv"}, "campaign").groupBy("campaign", "source_year").agg(F.count("*").alias("n"))


@query("b04_numbers", f"select o_orderkey, try_cast({RAW_NUMBER.format(s='varchar')} as double) as number from orders")
def numbers(t: Tables) -> DataFrame:
    return canonical.numbers(t("orders").select("o_orderkey", F.expr(RAW_NUMBER.format(s="string")).alias("number")), ["number"])


@query("b06_link_status", "select o_orderstatus as status, coalesce(o_orderstatus in ('F', 'O'), false)::int as accepted, count(*) as n from orders group by all")
def link_status(t: Tables) -> DataFrame:
    return canonical.by_status(t("orders").withColumnRenamed("o_orderstatus", "status"), "status", ("F", "O")).groupBy("status", "accepted").agg(F.count("*").alias("n"))


@query("b08_allowed_anchors", f"with {SMALL_PANEL} select entity, as_of_date, target_90d from pn where as_of_date in (date '1998-03-31', date '1999-06-30')")
def allowed_anchors(t: Tables) -> DataFrame:
    rows = small_panel(t).select("entity", "as_of_date", "target_90d")
    allowed = rows.sparkSession.sql("select explode(array(date'1998-03-31', date'1999-06-30')) as as_of_date")
    return canonical.check_anchors(canonical.only_anchors(rows, "as_of_date", allowed, 2 * t("customer").count()), "as_of_date", allowed)


@query("b14_binary_violations", "select 'late' as column_name, count(*) filter (where l_orderkey % 13 = 0) as n_null, 0::bigint as n_other from lineitem union all select 'l_linenumber', 0, count(*) filter (where l_linenumber not in (0, 1)) from lineitem")
def binary_violations(t: Tables) -> DataFrame:
    rows = t("lineitem").withColumn("late", F.when(F.col("l_orderkey") % 13 != 0, (F.col("l_tax") > 0.04).cast("int")))
    return canonical.binary_violations(rows, ["late", "l_linenumber"])


@query("b15_features_and_target", f"with {SMALL_PANEL} select entity, as_of_date, target_90d as y, events_365d as x_events, collapsed_365d as x_days from pn where year(as_of_date) = 1999")
def features_and_target(t: Tables) -> DataFrame:
    rows = canonical.features_and_target(small_panel(t).filter("year(as_of_date) = 1999"), "target_90d", ["entity", "as_of_date"], ["target_180d", "last_event"])
    return rows.select("entity", "as_of_date", "y", F.col("x.events_365d").alias("x_events"), F.col("x.collapsed_365d").alias("x_days"))


PLACED = "pt as (select o_orderstatus, case when o_orderkey % 17 <> 0 then (o_orderkey * 37 % 1000)::double end as x, (o_orderkey * 91 % 1000)::double as y from orders)"


@query("b16_region_counts", f"with {PLACED}, c as (select *, x is not null as known, x is not null and x between 100 and 800 and y between 50 and 900 as inside from pt) select o_orderstatus, count(*) as n, count(*) filter (where not known) as without, count(*) filter (where inside) as inside, count(*) filter (where known and not inside) as outside from c group by 1")
def region_counts(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t("orders").select("o_orderstatus", F.when(k % 17 != 0, k * 37 % 1000).cast("double").alias("x"), (k * 91 % 1000).cast("double").alias("y"))
    return canonical.region_counts(rows, ["o_orderstatus"], "x", "y", (100, 50, 800, 900))


@query("b17_envelopes", f"""with {LINES}, e as (select x as x0, case when is_point then x else x + 3 end as x1, y as y0, case when is_point then y else y + 10 end as y1 from ln), c as (select x0 >= 20 and x1 <= 80 and y0 >= 10 and y1 <= 50 as inside, x1 < 20 or x0 > 80 or y1 < 10 or y0 > 50 as apart from e)
select count(*) as n, count(*) filter (where inside) as inside, count(*) filter (where not inside and not apart) as partly, count(*) filter (where apart) as apart from c""")
def envelopes(t: Tables) -> DataFrame:
    return canonical.envelope_counts(lines(t), "line", (20, 10, 80, 50))


@query("c02_linked_events", "select o_orderkey, l_linenumber, o_orderstatus, l_shipdate::date as shipped from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus in ('F', 'O') and l_linenumber <= 2")
def linked_events(t: Tables) -> DataFrame:
    links = t("orders").select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("l_linenumber"), "o_orderstatus")
    events = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.lit("other").alias("o_orderstatus"), F.col("l_shipdate").cast("date").alias("shipped"))
    return mart.linked_events(links, events, ["o_orderkey", "l_linenumber"], "o_orderstatus", ("F", "O"))


@query("c03_yearly_enrichment", "select o_orderkey, year(o_orderdate)::int as source_year, round(sum(l_extendedprice), 2) as price, count(l_orderkey) as n_lines from orders left join lineitem on l_orderkey = o_orderkey and year(l_shipdate) = year(o_orderdate) group by 1, 2")
def yearly_enrichment(t: Tables) -> DataFrame:
    """Records joined by (year, number), all years in one join."""
    orders = t("orders").select("o_orderkey", F.year("o_orderdate").alias("source_year"))
    details = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.year("l_shipdate").alias("source_year")).agg(F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("*").alias("n_lines"))
    return orders.join(details, ["o_orderkey", "source_year"], "left").na.fill(0, ["n_lines"])


@query("c04_static_features", """select c_custkey, case when c_custkey % 6 <> 0 then c_nationkey end as area, coalesce(case when c_custkey % 6 <> 0 then n_name end, 'unknown') as area_name, (c_custkey % 6 = 0)::int as unmatched_flag from customer join nation on n_nationkey = c_nationkey""")
def static_features(t: Tables) -> DataFrame:
    crosswalk = t("customer").filter("c_custkey % 6 <> 0").select("c_custkey", F.col("c_nationkey").alias("area"))
    names = t("nation").select(F.col("n_nationkey").alias("area"), F.col("n_name").alias("area_name"))
    return mart.static_features(t("customer").select("c_custkey"), crosswalk, names, "c_custkey", "area", {"area_name": "unknown"})


@query("c07_anchor_weather", f"with {SMALL_PANEL}, w as (select last_day(l_shipdate::date) as as_of_date, round(avg(l_quantity), 6) as mean_q from lineitem group by 1) select as_of_date, count(*) as n, count(mean_q) as n_known, sum(target_90d)::bigint as positives, min(mean_q) as mean_q from pn left join w using (as_of_date) group by 1")
def anchor_weather(t: Tables) -> DataFrame:
    weather = t("lineitem").groupBy(F.last_day("l_shipdate").alias("as_of_date")).agg(F.round(F.avg("l_quantity"), 6).alias("mean_q"))
    rows = mart.per_anchor(small_panel(t), weather, "as_of_date")
    return rows.groupBy("as_of_date").agg(F.count("*").alias("n"), F.count("mean_q").alias("n_known"), F.sum("target_90d").alias("positives"), F.min("mean_q").alias("mean_q"))


@query("c15_aligned", "select c_custkey, c_name, c_acctbal from customer")
def aligned(t: Tables) -> DataFrame:
    return mart.aligned(t("customer").select("c_custkey", "c_name"), t("customer").select("c_custkey", "c_acctbal"), "c_custkey")


@query("c16_join_counts", """with a as (select o_custkey as k, count(*) as x from orders group by 1), b as (select c_custkey as k, 1 as y from customer where c_custkey % 3 <> 0), j as (select coalesce(x, 0) as x, coalesce(y, 0) as y from a full join b using (k))
select sum(x)::bigint as rows_a, sum(y)::bigint as rows_b, count(*) filter (where x > 0) as keys_a, count(*) filter (where y > 0) as keys_b, count(*) filter (where x > 0 and y > 0) as keys_both, sum(x * y)::bigint as rows_joined from j""")
def join_counts(t: Tables) -> DataFrame:
    return mart.join_counts(t("orders").select(F.col("o_custkey").alias("k")), t("customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k")), "k")


@query("c17_explanations", "select c_custkey, coalesce(case when c_acctbal > 5000 then c_mktsegment end, 'no explanation') as explanation, (c_acctbal > 5000)::int as explanation_available from customer")
def explanations(t: Tables) -> DataFrame:
    records = t("customer").filter("c_acctbal > 5000").select("c_custkey", "c_mktsegment")
    return mart.with_explanations(t("customer").select("c_custkey"), records, "c_custkey", "c_mktsegment", "no explanation")


@query("c18_top_geometries", f"with {LINES} select id, c_acctbal, x as first_x from (select c_custkey as id, c_acctbal from customer order by c_acctbal desc, c_custkey limit 40) join ln using (id)")
def top_geometries(t: Tables) -> DataFrame:
    rows = t("customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return mart.top_geometries(rows, lines(t).select("id", F.col("line")[0]["x"].alias("first_x")), "id", [F.desc("c_acctbal"), F.col("id")], 40)


@query("c21_id_coverage", """with a as (select distinct c_custkey as k from customer where c_custkey % 4 <> 0), b as (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT')
select count(a.k) as ids_a, count(b.k) as ids_b, count(*) filter (where a.k = b.k) as ids_both, count(*) filter (where b.k is null) as only_a, count(*) filter (where a.k is null) as only_b, round(count(*) filter (where a.k = b.k) / count(a.k), 6) as share_a from a full join b on a.k = b.k""")
def id_coverage(t: Tables) -> DataFrame:
    return mart.id_coverage(t("customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k")), urgent(t).select(F.col("entity").alias("k")), "k")


@query("c26_name_agreement", """with p as (select r_name, case when n_nationkey % 4 <> 0 then lower(n_name) end as a, case when n_nationkey % 3 = 0 then 'nation_' || (n_nationkey + 1)::varchar else lower(n_name) end as b from nation join region on n_regionkey = r_regionkey)
select r_name, count(*) as n, count(a) as compared, count(*) filter (where a = b) as agreeing, round(count(*) filter (where a = b) / nullif(count(a), 0), 6) as share from p group by 1""")
def name_agreement(t: Tables) -> DataFrame:
    rows = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    a, b = F.when(k % 4 != 0, F.concat(F.lit("  "), F.col("n_name"))), F.when(k % 3 == 0, F.concat(F.lit("Nation_"), (k + 1).cast("string"))).otherwise(F.col("n_name"))
    return mart.name_agreement(rows, ["r_name"], text.cleaned(a), text.cleaned(b))


@query("f05_score_tail", """with r as (select l_quantity as s, (l_discount >= 0.05)::int as y, count(*) over () as n from lineitem), k as (select percent, greatest(1, n * percent // 100)::bigint as k from (select unnest([1, 5, 10, 20]) as percent), (select count(*) as n from lineitem)),
c as (select s, count(*) as n, sum(y) as pos from r group by s), u as (select *, sum(n) over (order by s desc) as n_to, sum(pos) over (order by s desc) as pos_to from c), e as (select percent, k, max(s) as s from k, u where n_to >= k group by all)
select percent, k, e.s as least_score, round(pos_to - pos + (k - (n_to - n)) / n * pos, 6) as positives from e join u on u.s = e.s""")
def score_tail(t: Tables) -> DataFrame:
    rows = t("lineitem").select(F.col("l_quantity").alias("s"), (F.col("l_discount") >= 0.05).cast("int").alias("y"))
    return mart.score_tail(rows, "s", "y", (1, 5, 10, 20))


@query("e04_rank_percentiles", "with r as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) - 1 as place from customer) select c_custkey, place::int as place, round((1 - place / 50) * 100, 2) as rank_percentile from r where place < 50")
def rank_percentiles(t: Tables) -> DataFrame:
    return mart.rank_percentiles(t("customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 50).drop("c_acctbal")


@query("e09_importance_ranks", "select p_brand, row_number() over (order by count(*) desc, p_brand)::int as importance_rank from part group by 1")
def importance_ranks(t: Tables) -> DataFrame:
    return mart.importance_ranks(t("part").groupBy("p_brand").agg(F.count("*").alias("n")), "n", "p_brand").drop("n")


@query("e10_quantile_bins", """with q as (select list_distinct(quantile_cont(c_acctbal, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as e from customer)
select len(list_filter(list_sort(e)[2:-2], lambda x: x < c_acctbal))::int as bin, count(*) as n from customer, q group by 1""")
def quantile_bins(t: Tables) -> DataFrame:
    return mart.quantile_bins(t("customer"), "c_acctbal").groupBy("bin").agg(F.count("*").alias("n"))


@query("f06_ordered_options", "select c_custkey, (c_acctbal > 9000)::int as explained, row_number() over (order by c_acctbal > 9000 desc, c_acctbal desc, c_custkey)::int as place from customer order by place limit 25")
def ordered_options(t: Tables) -> DataFrame:
    """A short list: what is explained first, then by score."""
    rows = t("customer").select("c_custkey", (F.col("c_acctbal") > 9000).cast("int").alias("explained"), "c_acctbal")
    return mart.rank_percentiles(rows, [F.desc("explained"), F.desc("c_acctbal"), F.col("c_custkey")], 25).select("c_custkey", "explained", (F.col("place") + 1).alias("place"))


WINDOWS = (30, 90, 180, 365)


@query("d03_trailing_windows", f"""with {EV}, {ANCHORS}, p as (select c_custkey as entity, t from customer, anchors) select entity, t as as_of_date, """ + ", ".join(f"count(*) filter (where day > t - {w}) as events_{w}d, count(distinct day) filter (where day > t - {w}) as collapsed_{w}d" for w in WINDOWS) + " from p join ev using (entity) where day <= t and day > t - 365 group by all")
def trailing_windows(t: Tables) -> DataFrame:
    """Raw counts and counts of days, for all windows in one shuffle."""
    rows = panel.trailing_counts(urgent(t), "entity", "day", WINDOWS).filter(F.col("as_of_date").between(FIRST, LAST))
    return rows.withColumnsRenamed({f"active_days_{w}d": f"collapsed_{w}d" for w in WINDOWS})


@query("d35_seven_dimensions", " union all ".join(f"select '{n}' as dimension, ({e})::varchar as value, count(*) as n, sum((o_orderpriority = '1-URGENT')::int)::bigint as positives from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 2" for n, e in (("status", "o_orderstatus"), ("segment", "c_mktsegment"), ("nation", "n_name"), ("region", "n_regionkey"), ("year", "year(o_orderdate)"), ("quarter", "quarter(o_orderdate)"), ("rich", "(c_acctbal > 5000)::int"))))
def seven_dimensions(t: Tables) -> DataFrame:
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(t("nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    dims = {"status": F.col("o_orderstatus"), "segment": F.col("c_mktsegment"), "nation": F.col("n_name"), "region": F.col("n_regionkey"), "year": F.year("o_orderdate"), "quarter": F.quarter("o_orderdate"), "rich": (F.col("c_acctbal") > 5000).cast("int")}
    long = rows.select((F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"), F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("value")) for d, c in dims.items()])))
    return long.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
