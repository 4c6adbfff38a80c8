"""Bootstrap intervals at their full size: six metrics, 500 replicates, by entity and by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators import resampling
from quillmere.operators.ordering import portable_hash_sql
from quillmere.plans.registry import Tables, query

REPLICATES, SEED = 500, 42


def bootstrap_sql(unit: str) -> str:
    hashed = f"u * {REPLICATES} + r"
    for i in range(resampling.ROUNDS):
        hashed = portable_hash_sql(hashed, SEED + i)
    weight = " + ".join(f"(h >= {d})::int" for d in resampling.DRAWN)
    named = {"average_precision": "ap", "roc_auc": "auc", "brier": "brier", "precision_at_top": "tpk / k", "recall_at_top": "tpk / p_all", "lift_at_top": "tpk / k / (p_all / n_all)"}
    lines = " union all ".join(f"select '{m}' as metric, {c} as v, r from e where r < 0 or p_all > 0 and p_all < n_all" for m, c in named.items())
    return f"""with o as (select {unit} as u, least(round(o_totalprice / 1000) / 600, 1) as p, (o_orderpriority = '1-URGENT')::int as label from orders), c as (select u, p, count(*) as n, sum(label) as pos from o group by all),
h as (select u, r, {hashed} as h from (select distinct u from o), range({REPLICATES}) q(r)), w as (select u, r, {weight} as w from h union all select distinct u, -1, 1 from o),
ce as (select r, p, sum(n * w)::double as n, sum(pos * w)::double as pos from c join w using (u) where w > 0 group by all), t as (select r, sum(n) as n_all, sum(pos) as p_all, ceil(sum(n) * 10 / 100 - 1e-9) as k from ce group by 1),
g as (select ce.*, sum(n) over (partition by r order by p desc) as m, sum(pos) over (partition by r order by p desc) as tp from ce),
e as (select r, n_all, p_all, k, sum(pos * tp / m) / p_all as ap, 1 - sum(pos * ((m - n) - (tp - pos) + (n - pos) / 2)) / (p_all * (n_all - p_all)) as auc, sum(n * p * p - 2 * p * pos + pos) / n_all as brier, sum(case when m - n < k and k <= m then (tp - pos) + pos * (k - (m - n)) / n else 0 end) as tpk from g join t using (r) group by r, n_all, p_all, k),
l as ({lines})
select metric, round(max(v) filter (where r < 0), 6) as point, round(quantile_cont(v, 0.025) filter (where r >= 0), 6) as low, round(quantile_cont(v, 0.975) filter (where r >= 0), 6) as high, count(*) filter (where r >= 0) as n_used, 'ok' as status from l group by metric"""


def bootstrap(t: Tables, unit: str) -> DataFrame:
    rows = t("orders").select(F.col(unit).alias("u"), F.least(F.round(F.col("o_totalprice") / 1000) / 600, F.lit(1.0)).alias("p"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"))
    return resampling.bootstrap_metrics(rows, "u", "p", "label", REPLICATES, SEED)


@query("i13_entity_bootstrap_500", bootstrap_sql("o_custkey"))
def entity_bootstrap(t: Tables) -> DataFrame:
    return bootstrap(t, "o_custkey")


@query("i13_row_bootstrap_500", bootstrap_sql("o_orderkey"))
def row_bootstrap(t: Tables) -> DataFrame:
    return bootstrap(t, "o_orderkey")
