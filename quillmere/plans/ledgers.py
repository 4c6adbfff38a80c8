"""Queries on ledgers and inventories of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.plans.registry import Tables, query
from quillmere.sources import ledgers
from quillmere.sources.sinks import scratch

ROUTED = """with r as (select o_orderkey as k, case when o_totalprice < 20000 then 'small' when o_orderstatus = 'P' then 'pending' when o_custkey % 10 = 0 then 'barred' end as reason, row_number() over (partition by o_custkey, o_orderdate order by o_orderkey) > 1 as later from orders),
s as (select k, reason, case when reason is not null then 'excluded' when later then 'member' else 'accepted' end as status from r)"""


def routed_orders(t: Tables) -> DataFrame:
    """Orders that are small, pending or of barred customers are excluded; of a customer's orders of one day the first stands for all."""
    later = F.row_number().over(Window.partitionBy("o_custkey", "o_orderdate").orderBy("o_orderkey")) > 1
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice").withColumn("later", later)
    reasons = {"small": F.col("o_totalprice") < 20000, "pending": F.col("o_orderstatus") == "P", "barred": F.col("o_custkey") % 10 == 0}
    return ledgers.routed(rows, reasons, F.col("later"))


@query("a15_ledger", f"{ROUTED} select status as ledger_status, coalesce(reason, 'none') as ledger_reason, count(*) as n_rows from s group by all")
def ledger(t: Tables) -> DataFrame:
    rows = routed_orders(t)
    return ledgers.write_ledger(rows, scratch(rows.sparkSession, "ledger"))


@query("a15_reconciled", "select count(*) as n_in, count(*) as n_out, 0 as n_lost, 0 as n_twice from orders")
def reconciled(t: Tables) -> DataFrame:
    rows = routed_orders(t)
    path = scratch(rows.sparkSession, "ledger")
    ledgers.write_ledger(rows, path)
    return ledgers.reconciled(t("orders"), path, "o_orderkey")
