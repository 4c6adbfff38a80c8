"""Queries of event groups by native keys, window coverage, top shares of records and of subgroups, and stability over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators import attribution, duplicates, evaluation, experiments, explained, models, quantiles, resampling, scoring, splits, stability, tables
from quillmere.operators.ordering import portable_hash_sql
from quillmere.plans.audits import small_panel
from quillmere.plans.more import CATEGORIES, NUMBERS, fitted, learnable
from quillmere.plans.registry import ANCHORS, FIRST, LAST, Tables, query
from quillmere.plans.scoring import SCORES, order_scores
from quillmere.plans.wider import SPLIT

FILES = """ev as (select event_id, user_id, case when event_id % 3 = 0 then 'new.gpkg' else 'old-' || event_id % 2 || '.csv' end as source_file, coalesce(event_type, '') as kind, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%H') as hour from events),
gr as (select *, count(*) over g as m, min(event_id) over g as first from ev window g as (partition by source_file, user_id, kind, day, case when source_file = 'new.gpkg' then hour end))"""


def native_groups(t: Tables) -> DataFrame:
    """Events of two kinds of files, grouped by day, and those of the newer kind by hour too."""
    file = F.when(F.col("event_id") % 3 == 0, "new.gpkg").otherwise(F.concat(F.lit("old-"), (F.col("event_id") % 2).cast("string"), F.lit(".csv")))
    rows = t("events").select("event_id", "user_id", file.alias("source_file"), F.coalesce("event_type", F.lit("")).alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH").alias("hour"))
    whole, dated = ([F.col(c) for c in names] for names in (("user_id", "kind", "day", "hour"), ("user_id", "kind", "day")))
    return duplicates.grouped(rows, duplicates.native_key("source_file", {".gpkg": whole}, dated))


@query("d09_membership", f"with {FILES} select event_id, source_file, first as group_first, m as duplicate_multiplicity from gr")
def membership(t: Tables) -> DataFrame:
    rows = native_groups(t)
    kept = duplicates.first_of_groups(rows, ["event_id"]).select("duplicate_group_id", F.col("event_id").alias("group_first"))
    return rows.join(kept, "duplicate_group_id").select("event_id", "source_file", "group_first", "duplicate_multiplicity")


@query("d09_collapsed_events", f"with {FILES} select event_id, user_id, source_file, kind, day, hour, m as duplicate_multiplicity from gr where event_id = first")
def collapsed_events(t: Tables) -> DataFrame:
    return duplicates.first_of_groups(native_groups(t), ["event_id"]).drop("duplicate_group_id")


@query("d09_sensitivity", f"with {FILES} select m as duplicate_multiplicity, count(*) as n_events, count(*) filter (where event_id = first) as n_groups, count(*) filter (where event_id <> first) as removed from gr group by 1")
def sensitivity(t: Tables) -> DataFrame:
    return duplicates.sensitivity(native_groups(t))


WIDE = (30, 90, 365)


@query("d07_window_coverage", f"""with {ANCHORS}, f as (select o_orderstatus, min(o_orderdate::date) as first_day from orders where o_orderdate >= timestamp '1996-01-01' group by 1), v as (select o_orderstatus, t, {', '.join(f'least({w}, greatest(0, date_diff(\'day\', first_day, t) + 1))::int as v{w}' for w in WIDE)} from f, anchors)
select o_orderstatus, t as as_of_date, {', '.join(f'v{w} as valid_days_{w}d, round(v{w} / {w}, 6) as coverage_ratio_{w}d, (v{w} = {w})::int as complete_{w}d' for w in WIDE)} from v""")
def window_coverage(t: Tables) -> DataFrame:
    from quillmere.operators import panel

    first = t("orders").filter("o_orderdate >= '1996-01-01'").groupBy("o_orderstatus").agg(F.min(F.col("o_orderdate").cast("date")).alias("first_day"))
    rows = panel.panel(first.withColumnRenamed("o_orderstatus", "entity"), FIRST, LAST).select(F.col("entity").alias("o_orderstatus"), "as_of_date")
    return tables.window_coverage(rows.join(F.broadcast(first), "o_orderstatus"), "as_of_date", "first_day", WIDE).drop("first_day")


RECORDS = {"price": 2.0, "month": -0.05}


@query("k06_top_percent_records", """with r as (select o_orderkey, o_totalprice / 100000 as price, month(o_orderdate)::double as month from orders), m as (select avg(price) as mp, avg(month) as mm from r),
s as (select o_orderkey, (price - mp) * 2.0 as price, (month - mm) * -0.05 as month, round((price * 2.0 + month * -0.05 - 3.0) * 4) / 4 as score from r, m), o as (select *, row_number() over (order by score desc, o_orderkey) as place, count(*) over () as n from s)
select o_orderkey, score, place, round((1 - place / n) * 100, 2) as rank_percentile, round(price, 6) as price, round(month, 6) as month from o where place <= ceil(n * 10 / 100)""")
def top_percent_records(t: Tables) -> DataFrame:
    """Contributions of the tenth of all rows with the highest margins, rounded so that many are tied."""
    rows = t("orders").select("o_orderkey", (F.col("o_totalprice") / 100_000).alias("price"), F.month("o_orderdate").cast("double").alias("month"))
    rows = attribution.linear_contributions(rows, RECORDS, -3.0).withColumn("score", F.round(F.col("margin") * 4) / 4)
    top = quantiles.top_percent(rows, "score", "o_orderkey", 10)
    return top.select("o_orderkey", "score", "place", "rank_percentile", *[F.round(F.col("contributions")[i]["value"], 6).alias(c) for i, c in enumerate(RECORDS)])


@query("i14_subgroup_tops", f"""with {SCORES}, g as (select 'status' as dimension, o_orderstatus as value, o_orderkey, p, label from so union all select 'last_digit', (o_orderkey % 10)::varchar, o_orderkey, p, label from so),
o as (select *, row_number() over (partition by dimension, value order by p desc, o_orderkey) as place, count(*) over w as n, sum(label) over w as pos from g window w as (partition by dimension, value)),
k as (select dimension, value, n, pos::bigint as pos, percent, ceil(n * percent / 100)::bigint as k, sum(label)::bigint as tp from o, (select unnest([5, 20]) as percent) where place <= ceil(n * percent / 100) group by all),
s as (select *, case when n < 400 then 'too_few_rows' when pos < 50 then 'too_few_positives' when tp < 10 then 'too_few_in_top' else 'ok' end as status from k)
select dimension, value, percent, n, pos, k, tp, case when n >= 400 then round(tp / k, 6) end as precision, case when n >= 400 and pos > 0 then round(tp / pos, 6) end as recall, case when status = 'ok' then round(tp / k / (pos / n), 6) end as lift, status from s""")
def subgroup_tops(t: Tables) -> DataFrame:
    rows = order_scores(t).withColumns({"status": F.col("o_orderstatus"), "last_digit": F.col("o_orderkey") % 10})
    return resampling.subgroup_tops(rows, ["status", "last_digit"], "p", "o_orderkey", "label", (5, 20), 400, 50, 10)


@fitted("i17_calibrated_deltas")
def calibrated_deltas(t: Tables) -> DataFrame:
    """Metrics of a model's raw scores and of those calibrated on the validation rows, on the test rows."""
    rows = learnable(t)
    model = models.logistic(rows.filter("split = 'train'"), NUMBERS, CATEGORIES, "label", 0.01)
    val, test = (models.probability(model.transform(rows.filter(f"split = '{s}'"))) for s in ("val", "test"))
    return scoring.calibrated_deltas(val, test, "score", "label")


EXPECTED = {90: {"train": 46, "purged": 5, "val": 14, "test": 15}, 180: {"train": 43, "purged": 11, "val": 11, "test": 15}}


@query("j04_split_arithmetic", f"with {ANCHORS}, " + ", ".join(f"f{h} as (select {SPLIT(h)} as part, count(*) as found from anchors group by 1), e{h} as (select unnest({list(x)}) as part, unnest({list(x.values())})::bigint as expected), b{h} as (select {h} as horizon, part, coalesce(found, 0)::bigint as found, coalesce(expected, 0)::bigint as expected from f{h} full join e{h} using (part))" for h, x in EXPECTED.items()) + " ".join(f"{' union all ' if h > 90 else ' '}select *, found = expected as agrees from (select * from b{h} union all select {h}, 'TOTAL', sum(found)::bigint, sum(expected)::bigint from b{h})" for h in EXPECTED))
def split_arithmetic(t: Tables) -> DataFrame:
    """Month-ends of the orders in each split against the numbers that a plan of the study names."""
    from quillmere.operators import panel

    anchors = panel.panel(t("customer").limit(1).select(F.lit(0).alias("entity")), FIRST, LAST)
    out = None
    for h, counts in EXPECTED.items():
        expected = anchors.sparkSession.createDataFrame(list(counts.items()), "part string, expected long")
        part = splits.arithmetic(anchors.withColumn("split", splits.split_of(F.col("as_of_date"), h, "1999-01-31", "2000-06-30")["split"]), "split", expected)
        out = part.withColumn("horizon", F.lit(h)) if out is None else out.unionByName(part.withColumn("horizon", F.lit(h)))
    return out


@fitted("j19_repair_only_seeds")
def repair_only_seeds(t: Tables) -> DataFrame:
    """Models of the events' history alone, each model seed with own labels and with labels dealt out anew."""
    rows = small_panel(t).withColumn("gap", F.coalesce(F.date_diff("as_of_date", "last_event"), F.lit(-1)).cast("double"))
    rows = rows.select(
        F.xxhash64("entity", "as_of_date").alias("key"), F.col("events_365d").cast("double").alias("events"), F.col("collapsed_365d").cast("double").alias("days"), "gap", F.col("target_90d").cast("double").alias("label"),
        splits.split_of(F.col("as_of_date"), 90, "1999-01-31", "2000-06-30")["split"].alias("split"),
    )
    runs = experiments.matrix((None, 5), (7, 8, 9), (None,))
    return experiments.boosted_runs(experiments.written(rows.filter("split in ('train', 'val')")), "key", ["events", "days", "gap"], [], "label", runs)


SEEDS = (42, 137, 2026)
SAMPLED = f"""cu as (select o_orderkey, o_orderstatus, o_totalprice, 'nation-' || c_nationkey as feature from orders join customer on c_custkey = o_custkey), sa as ({' union all '.join(f"select {s} as run, feature, o_totalprice from (select *, row_number() over (partition by o_orderstatus order by {portable_hash_sql('o_orderkey', s)}, o_orderkey) as p, count(*) over (partition by o_orderstatus) as n from cu) where p <= least(round(n * 0.4), 20000)" for s in SEEDS)}),
im as (select run, feature, round(avg(o_totalprice), 2) as importance from sa group by all), ra as (select run, feature, row_number() over (partition by run order by importance desc, feature) as rank from im)"""


def sampled_ranks(t: Tables) -> DataFrame:
    """Ranks of the nations by mean price in stratified samples of orders, one sample a seed."""
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_orderstatus", "o_totalprice", F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("feature"))
    out = None
    for s in SEEDS:
        part = explained.stratified_share(rows, ["o_orderstatus"], "o_orderkey", 0.4, 20_000, s).groupBy("feature").agg(F.round(F.avg("o_totalprice"), 2).alias("importance")).withColumn("run", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return stability.ranked(out, "run", "feature", "importance")


@query("k08_rank_stability", f"with {SAMPLED} select feature, count(*) as n_runs, round(avg(rank), 6) as rank_mean, round(stddev_samp(rank), 6) as rank_std, min(rank)::int as rank_min, max(rank)::int as rank_max, coalesce(avg(rank) <= 30 and stddev_samp(rank) > 3, false) as unstable from ra group by 1")
def rank_stability(t: Tables) -> DataFrame:
    return stability.rank_stability(sampled_ranks(t))


@query("k08_run_agreement", f"with {SAMPLED} select a.run as run_a, b.run as run_b, count(*) as n, round(corr(a.rank, b.rank), 6) as spearman, count(*) filter (where a.rank <= 10 and b.rank <= 10) as top_10_overlap, count(*) filter (where a.rank <= 20 and b.rank <= 20) as top_20_overlap from ra a join ra b using (feature) where a.run < b.run group by all")
def run_agreement(t: Tables) -> DataFrame:
    return stability.run_agreement(sampled_ranks(t))
