"""Joins that put a mart together, with the invariants that each must hold, and ordered reports from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linked_events(links: DataFrame, events: DataFrame, keys: list[str], status: str, accepted: tuple[str, ...]) -> DataFrame:
    """Accepted links with their events by a composite key; columns of both come from the links."""
    mine = links.filter(F.col(status).isin(*accepted))
    return mine.join(events.select(*[c for c in events.columns if c in keys or c not in links.columns]), keys)


def static_features(entities: DataFrame, crosswalk: DataFrame, names: DataFrame, key: str, area: str, defaults: dict[str, str]) -> DataFrame:
    """entities with the names of their areas: defaults where there is none, and unmatched_flag. names is a small table."""
    rows = entities.join(crosswalk.withColumn("matched", F.lit(1)), key, "left").join(F.broadcast(names), area, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()}).withColumn("unmatched_flag", F.col("matched").isNull().cast("int")).drop("matched")


def per_anchor(rows: DataFrame, table: DataFrame, at: str) -> DataFrame:
    """rows with the one row that a small table has for their anchor; each row stays once (ValueError where an anchor has two)."""
    if table.groupBy(at).count().filter("count > 1").limit(1).count():
        raise ValueError(f"more than one row for a value of {at}")
    return rows.join(F.broadcast(table), at, "left")


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two tables of the same keys as one; ValueError where a key is in one only, or twice."""
    n = a.select(key, F.lit(1).alias("x")).unionByName(b.select(key, F.lit(1000).alias("x"))).groupBy(key).agg(F.sum("x").alias("s")).filter("s <> 1001").limit(1).count()
    if n:
        raise ValueError(f"values of {key} that are not once in each table")
    return a.join(b, key)


def join_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys and rows of both sides, common keys, and the rows that their inner join has."""
    x, y = a.groupBy(key).agg(F.count("*").alias("x")), b.groupBy(key).agg(F.count("*").alias("y"))
    both = x.join(y, key, "full").select(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    return both.agg(F.sum("x").alias("rows_a"), F.sum("y").alias("rows_b"), F.count_if(F.col("x") > 0).alias("keys_a"), F.count_if(F.col("y") > 0).alias("keys_b"), F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias("keys_both"), F.sum(F.col("x") * F.col("y")).alias("rows_joined"))


def with_explanations(mart: DataFrame, records: DataFrame, key: str, column: str, message: str) -> DataFrame:
    """mart with explanation_available and the explanation, or the message where there is none."""
    rows = mart.join(records.select(key, F.col(column).alias("explanation")), key, "left")
    return rows.withColumns({"explanation_available": F.col("explanation").isNotNull().cast("int"), "explanation": F.coalesce("explanation", F.lit(message))})


def top_geometries(mart: DataFrame, geometries: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The `most` first rows of mart in a total order (the report's size is its feature), with their geometries."""
    return F.broadcast(mart.orderBy(*order).limit(most)).join(geometries, key)


def id_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct ids of a, of b, in both, in one only, and the share of a's ids that b has."""
    both = a.select(key, F.lit(True).alias("x")).distinct().join(b.select(key, F.lit(True).alias("y")).distinct(), key, "full")
    n = F.count("x")
    return both.agg(n.alias("ids_a"), F.count("y").alias("ids_b"), F.count_if(F.col("x") & F.col("y")).alias("ids_both"), F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"), F.round(F.count_if(F.col("x") & F.col("y")) / n, 6).alias("share_a"))


def name_agreement(rows: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """by, n, compared (both names are there), agreeing, and the share of agreement."""
    known = a.isNotNull() & b.isNotNull()
    agree = F.count_if(known & (a == b))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(known).alias("compared"), agree.alias("agreeing"), F.round(F.try_divide(agree, F.count_if(known)), 6).alias("share"))


def score_tail(scored: DataFrame, score: str, label: str, percents: tuple[int, ...]) -> DataFrame:
    """percent, k (rounded down, 1 at least), the least score and the positives in the top share of all scores.

    Rows are summed by score; ties at the edge count by their share, so no row order is needed.
    """
    from quillmere.operators.evaluation import cells
    from quillmere.operators.ordering import prefix_sum

    c = prefix_sum(cells(scored, [], score, label), [], score, ["n", "pos"])
    total = c.agg(F.sum("n").alias("total"))
    want = total.select(F.inline(F.array(*[F.struct(F.lit(p).alias("percent"), F.greatest(F.lit(1), F.floor(F.col("total") * p / 100)).cast("long").alias("k")) for p in percents])))
    met = c.crossJoin(F.broadcast(want)).filter("n_to >= k")  # cells of distinct scores by a few percents
    edge = met.groupBy("percent", "k").agg(F.max_by(F.struct(F.col(score).alias("s"), "n", "pos", "n_to", "pos_to"), score).alias("e"))
    above = F.col("e.pos_to") - F.col("e.pos")
    inside = (F.col("k") - (F.col("e.n_to") - F.col("e.n"))) / F.col("e.n") * F.col("e.pos")
    return edge.select("percent", "k", F.col("e.s").alias("least_score"), F.round(above + inside, 6).alias("positives"))


def rank_percentiles(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The `most` first rows in a total order with place i (from 0) and percentile (1 - i / n) * 100, n the rows that are listed."""
    top = rows.orderBy(*order).limit(most)
    place = F.row_number().over(Window.orderBy(*order)) - 1  # over the listed rows alone
    n = F.count("*").over(Window.partitionBy())
    return top.withColumn("place", place).withColumn("rank_percentile", F.round((1 - F.col("place") / n) * 100, 2))


def importance_ranks(table: DataFrame, value: str, name: str) -> DataFrame:
    """A small table of features with `importance_rank`, 1 for the largest value; ties go by name."""
    return table.withColumn("importance_rank", F.row_number().over(Window.orderBy(F.desc(value), name)))


def quantile_bins(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """rows with bin: how many inner quantiles (exact, interpolated, equal ones once) are below the value, so that bins are closed on the right; null stays null."""
    from quillmere.operators.quantiles import quantiles

    found = quantiles(rows, [], value, tuple(i / bins for i in range(bins + 1)))
    edges = found.agg(F.max(F.array_distinct("_quantiles")).alias("edges"))  # one row, whatever there is
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    return rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.when(F.col(value).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(value))))).drop("edges")
