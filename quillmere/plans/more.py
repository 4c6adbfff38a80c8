"""Queries on fingerprints, coverage, roll-ups, GeoJSON and models. Model fits have no SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators import experiments, models, splits, tables
from quillmere.plans.registry import EV, QUERIES, Tables, gaps, query, scored, urgent
from quillmere.plans.wider import lines
from quillmere.sources import files

PRINTED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
DUCK_PRINT = "('0x' || substr(md5(concat_ws('|', " + ", ".join(f"coalesce('=' || {c}::varchar, '-')" for c in PRINTED) + ")), 1, 12))::bigint"


@query("q04_fingerprint", f"select o_orderstatus, count(*) as n_rows, sum(h)::varchar as total, bit_xor(h) as parity from (select o_orderstatus, {DUCK_PRINT} as h from orders) group by 1")
def prints(t: Tables) -> DataFrame:
    return tables.fingerprint(t("orders"), ["o_orderstatus"], list(PRINTED))


@query("q01_partition_audit", "with r as (select last_day(o_orderdate::date) as part, o_custkey as k, count(*) as n, count(*) filter (where o_orderdate::date > last_day(o_orderdate::date)) as ahead from orders group by all) select part, sum(n)::bigint as n_rows, count(*) as n_keys, count(*) filter (where n > 1) as repeated_keys, sum(ahead)::bigint as days_ahead from r group by 1")
def partition_audit(t: Tables) -> DataFrame:
    rows = t("orders").select(F.last_day("o_orderdate").alias("part"), "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return tables.partition_audit(rows, "part", "o_custkey", "day")


@query("c23_domain_coverage", "select c_nationkey as value, 'not_listed' as status from (select distinct c_nationkey from customer) where c_nationkey not in (select s_nationkey from supplier where s_nationkey < 15) union all select s_nationkey, 'unused' from (select distinct s_nationkey from supplier where s_nationkey < 15) where s_nationkey not in (select c_nationkey from customer)")
def coverage(t: Tables) -> DataFrame:
    return tables.domain_coverage(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").filter("s_nationkey < 15").select(F.col("s_nationkey").alias("k")), "k")


@query("c20_id_overlap", "select count(*) as n_common from (select distinct o_custkey from orders where o_orderdate < timestamp '1996-01-01') join (select distinct o_custkey from orders where o_orderdate >= timestamp '2001-01-01') using (o_custkey)")
def id_overlap(t: Tables) -> DataFrame:
    early, late = (t("orders").filter(f).select("o_custkey") for f in ("o_orderdate < '1996-01-01'", "o_orderdate >= '2001-01-01'"))
    return early.distinct().join(late, "o_custkey", "left_semi").agg(F.count("*").alias("n_common"))


@query("e12_latest_order", "select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as p from orders) where p = 1")
def latest_order(t: Tables) -> DataFrame:
    return tables.latest(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("d05_active_months", f"with {EV} select entity, count(distinct date_trunc('month', day)) as n_months from ev where day <= date '1998-06-30' and day >= date '1997-07-01' group by 1")
def active_months(t: Tables) -> DataFrame:
    return tables.active_months(urgent(t), "entity", "day", "1998-06-30")


@query("d14_status_rollup", "select year(o_orderdate)::int as year, o_orderstatus, count(*) as n, max(o_totalprice) as max_price from orders group by rollup (year(o_orderdate), o_orderstatus)")
def status_rollup(t: Tables) -> DataFrame:
    return t("orders").rollup(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("max_price"))


@query("d35_grouping_sets", "select l_returnflag, l_linestatus, count(*) as n, grouping_id(l_returnflag, l_linestatus)::bigint as level from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def grouping(t: Tables) -> DataFrame:
    return t("lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query("f02_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderdate desc, o_custkey, o_orderkey limit 100")
def top_k(t: Tables) -> DataFrame:
    return t("orders").orderBy(F.desc("o_totalprice"), F.desc("o_orderdate"), "o_custkey", "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("b07_filtered", "select o_orderstatus, o_orderpriority, count(*) as n from orders where o_orderstatus in ('F', 'O') and o_totalprice between 1000 and 200000 group by all")
def filtered(t: Tables) -> DataFrame:
    kept = tables.chosen(t("orders"), {"o_orderstatus": ["F", "O"], "o_orderpriority": []}, {"o_totalprice": (1000, 200000)})
    return kept.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("a02_geojson", "select s_suppkey::bigint as line, 'LineString' as geometry_type, 2 as n_points, round(sqrt((30 + s_suppkey % 17) ** 2 + (40 - s_suppkey % 23) ** 2), 6) as length from supplier")
def geojson(t: Tables) -> DataFrame:
    from quillmere.functions.geometry import length

    at = F.array(F.array("x1", "y1"), F.array("x2", "y2"))
    feature = F.struct(F.struct(F.col("line").alias("id")).alias("properties"), F.struct(F.lit("LineString").alias("type"), at.alias("coordinates")).alias("geometry"))
    texts = lines(t).select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("text"))
    return files.features(texts, "text", "id: bigint").select(F.col("id").alias("line"), "geometry_type", F.size("line").alias("n_points"), F.round(length(F.col("line")), 6).alias("length"))


def fitted(name: str):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        return f

    return keep


NUMBERS, CATEGORIES = ["l_quantity", "l_extendedprice", "l_tax"], ["l_returnflag", "l_linestatus"]


def learnable(t: Tables, days: int = 90) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return t("lineitem").select("l_orderkey", "l_linenumber", *NUMBERS, *CATEGORIES, (F.col("l_discount") >= 0.05).cast("double").alias("label"), splits.split_of(day, days, "1999-01-31", "2000-06-30")["split"].alias("split"))


def keyed(t: Tables) -> DataFrame:
    """The learnable rows of training and validation with a `key` of their own, written once: of rows with one key the first in the file, whoever asks."""
    rows = learnable(t).select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("key"), F.struct(*NUMBERS, *CATEGORIES, "label", "split").alias("row"), F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    return experiments.written(rows.groupBy("key").agg(F.min_by("row", "place").alias("row")).select("key", "row.*").filter("split in ('train', 'val')"))


@fitted("j10_logistic_grid")
def logistic_grid(t: Tables) -> DataFrame:
    """Log loss and Brier score on validation rows of each strength."""
    from quillmere.operators.evaluation import proper_scores

    table = experiments.prepared_table(learnable(t).filter("split in ('train', 'val')"), "l_orderkey", NUMBERS, CATEGORIES, "label", set())
    scores = [experiments.logistic_scores(table, strength).select("score", "label", F.lit(strength).alias("strength")) for strength in (0.1, 0.01, 0.001)]
    return proper_scores(reduce(DataFrame.unionByName, scores), ["strength"], "score", "label")


@fitted("j11_boosted_trees")
def boosted_trees(t: Tables) -> DataFrame:
    """Ranking and calibration of boosted trees on test rows, before and after a sigmoid fitted on validation rows."""
    from quillmere.operators.evaluation import proper_scores

    rows = learnable(t).withColumn("held", F.col("split") == "val")
    model = models.boosted(rows.filter("split in ('train', 'val')"), NUMBERS, CATEGORIES, "label", "held", rounds=10)
    val, test = (models.probability(model.transform(rows.filter(f"split = '{s}'"))) for s in ("val", "test"))
    both = models.platt(val, test, "score", "label").select("label", F.inline(F.array(F.struct(F.lit("raw").alias("kind"), F.col("score").alias("p")), F.struct(F.lit("calibrated").alias("kind"), F.col("calibrated").alias("p")))))
    return proper_scores(both, ["kind"], "p", "label")


@fitted("i07_calibration_line")
def calibration_line(t: Tables) -> DataFrame:
    return models.calibration_line(scored(t), "p", "label").select(*[F.round(c, 4).alias(c) for c in ("slope", "intercept", "in_the_large")])


@fitted("l05_weibull")
def weibull(t: Tables) -> DataFrame:
    """Median survival by a Weibull model, for each customer's gaps."""
    rows = gaps(t).withColumn("index", F.col("interval_index").cast("double"))
    out = models.weibull(rows, ["index"], "duration_days", "event_observed").transform(rows)
    from pyspark.ml.functions import vector_to_array

    return out.groupBy("interval_index").agg(F.count("*").alias("n"), F.round(F.avg(vector_to_array("quantiles")[0]), 3).alias("median_survival"))
