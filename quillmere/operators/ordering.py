"""Ordered work over whole tables without a window over a whole table: rows fall into ranges first, and only sums of ranges are ordered together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODULUS = 2_147_483_647


def portable_hash(c: Column, seed: int) -> Column:
    """A hash of a whole number in [0, MODULUS), by arithmetic that any SQL engine has."""
    h = (c.cast("long") % MODULUS * 48_271 + seed * 69_621) % MODULUS
    return h.bitwiseXOR(F.shiftright(h, 15)) * 44_485 % MODULUS


def portable_hash_sql(x: str, seed: int) -> str:
    h = f"((({x})::bigint % {MODULUS} * 48271 + {seed * 69_621}) % {MODULUS})"
    return f"(xor({h}, {h} >> 15) * 44485 % {MODULUS})"


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[f"_{n}"]) for n in names])


RANGE_ROWS, MOST_GROUPS = 1000, 1024  # a range has about so many rows at least; so many of the largest groups can have ranges


def _bounds(rows: DataFrame, by: list[str], order: str, ranges: int) -> list[tuple]:
    """(values of `by`, ascending bounds) of the groups that are worth parting: the ranges are dealt out by the rows of each.

    Only the MOST_GROUPS largest groups come to the driver; any other has less than 1 / MOST_GROUPS of the rows.
    """
    q = F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000)
    groups = rows.groupBy(*by).agg(F.count("*").alias("_n"), q.alias("_q")).orderBy(F.desc("_n")).limit(MOST_GROUPS).collect()
    total, out = sum(g["_n"] for g in groups), []
    for g in groups:
        own = min(-(-ranges * g["_n"] // max(total, 1)), g["_n"] // RANGE_ROWS)
        if own > 1:
            out.append((*[g[c] for c in by], sorted({g["_q"][i * ranges // own - 1] for i in range(1, own)})))
    return out


def _reached(bounds: Column, x: Column, ranges: int) -> Column:
    """How many of the ascending bounds x reaches, by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(ranges.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(bounds, at + step - 1) <= x, step).otherwise(0))


def _ranged(rows: DataFrame, by: list[str], order: str, ranges: int) -> DataFrame | None:
    """rows with the `_range` of each within its group; None if no group is worth parting."""
    bounds = _bounds(rows, by, order, ranges)
    if not bounds:
        return None
    if not by:
        return rows.withColumn("_range", _reached(F.array(*[F.lit(b) for b in bounds[0][0]]), F.col(order), ranges))
    kinds = [T.StructField(f"_{c}", rows.schema[c].dataType) for c in by] + [T.StructField("_bounds", T.ArrayType(rows.schema[order].dataType))]
    table = rows.sparkSession.createDataFrame(bounds, T.StructType(kinds))  # at most ranges + MOST_GROUPS bounds in all
    placed = rows.join(F.broadcast(table), _same(rows, table, by), "left")
    return placed.withColumn("_range", F.coalesce(_reached(F.col("_bounds"), F.col(order), ranges), F.lit(0))).drop("_bounds", *[f"_{c}" for c in by])


def prefix_sum(rows: DataFrame, by: list[str], order: str, sums: list[str], ranges: int = 256) -> DataFrame:
    """rows with `<name>_to` for each of `sums`: its sum over rows of the same `by` with a value of `order` at least as large.

    The number column `order` has no null; rows of one value share a range, so ties share their sum.
    Each large group has ranges of its own, as many as its share of the rows asks for. A range is ordered by itself
    and only sums of ranges are ordered by `by`.
    """
    ranged = _ranged(rows, by, order, ranges)
    if ranged is None:
        inside = Window.partitionBy(*by).orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({f"{c}_to": F.sum(c).over(inside) for c in sums})
    rows, key = ranged, [*by, "_range"]
    above = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums])
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_above_{c}") for c in sums])
    inside = Window.partitionBy(*key).orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"{c}_to": F.sum(c).over(inside) for c in sums})
    out = out.join(totals, _same(out, totals, key)).withColumns({f"{c}_to": F.col(f"{c}_to") + F.col(f"_above_{c}") for c in sums})
    return out.drop("_range", *[f"_{k}" for k in key], *[f"_above_{c}" for c in sums])


def row_numbers(rows: DataFrame, key: str, seed: int, name: str = "place", ranges: int = 4096, counted: DataFrame | None = None) -> DataFrame:
    """rows with `name`, gapless from 0, in the order of portable_hash(key) and key. `key` is unique. `counted`: the same keys, where they are cheaper to count."""
    ranged = lambda d: d.withColumn("_hash", portable_hash(F.col(key), seed)).withColumn("_range", F.floor(F.col("_hash") * ranges / MODULUS).cast("int"))
    rows, counted = ranged(rows), ranged(rows if counted is None else counted)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = counted.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", key))
    return rows.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_hash", "_range", "_inside", "_before")


def permuted(rows: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """(key, column) of rows, the values of `column` dealt out anew; as many of each value as before. `key` is unique."""
    to = row_numbers(rows.select(key), key, seed)
    values = row_numbers(rows.select(key, column), key, seed + 1).drop(key)
    return to.join(values, "place").select(key, column)


def dealt(rows: DataFrame, key: str, column: str, seeds: list[int]) -> DataFrame:
    """rows with `<column>_<seed>` for each of `seeds`: the values that `permuted` deals to their keys, without a join by key. `key` is unique."""
    out = rows
    for seed in seeds:
        values = row_numbers(rows.select(key, F.col(column).alias(f"{column}_{seed}")), key, seed + 1).drop(key)
        out = row_numbers(out, key, seed, counted=rows).join(values, "place").drop("place")
    return out


def least_hashed(rows: DataFrame, by: list[str], key: str, quotas: DataFrame, seed: int, ranges: int = 65_536, few: bool = False) -> DataFrame:
    """Of each group of `by` the rows of the smallest portable_hash(key) and key, as many as `_quota` in quotas (*by, _quota) says; a null is a value like others.

    Hash ranges are counted; those below the one that reaches the quota are kept whole, and only that one is ordered.
    With `few` groups, their quotas go to all tasks, so that no rows but those kept are shuffled.
    """
    names = rows.columns
    rows = rows.withColumn("_hash", portable_hash(F.col(key), seed)).withColumn("_range", F.floor(F.col("_hash") * ranges / MODULUS).cast("int"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most `ranges` rows a group
    counts = rows.groupBy(*by, "_range").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    quotas = quotas.withColumnsRenamed({c: f"_{c}" for c in by})
    cut = counts.join(quotas, _same(counts, quotas, by)).filter(F.col("_before") < F.col("_quota"))
    cut = cut.groupBy(*[f"_{c}" for c in by]).agg(F.max_by(F.struct(F.col("_range").alias("at"), (F.col("_quota") - F.col("_before")).alias("left")), "_range").alias("_cut"))
    rows = rows.join(F.broadcast(cut) if few else cut, _same(rows, cut, by)).filter(F.col("_range") <= F.col("_cut.at"))
    whole = rows.filter(F.col("_range") < F.col("_cut.at"))
    last = rows.filter(F.col("_range") == F.col("_cut.at")).withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("_hash", key)))
    return whole.unionByName(last.filter(F.col("_place") <= F.col("_cut.left")).drop("_place")).select(*names)


def stratified(rows: DataFrame, by: str, key: str, quota: int, seed: int, ranges: int = 65_536, few: bool = False) -> DataFrame:
    """Of each value of `by`, the `quota` rows (all, if fewer) of the smallest portable_hash(key) and key. Rows with a null in `by` are left out."""
    rows = rows.filter(F.col(by).isNotNull())
    return least_hashed(rows, [by], key, rows.select(by).distinct().withColumn("_quota", F.lit(quota)), seed, ranges, few)
