"""Reports on scored tables that put several metrics together: cut-offs, one record of all, null distributions, deltas, and their split tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.operators.evaluation import cells, proper_scores, ranking, ranking_by_ranges, ranking_of_cells, top_share
from quillmere.operators.ordering import MODULUS, prefix_sum


def cut_offs(scored: DataFrame, score: str, shares: tuple[float, ...]) -> DataFrame:
    """share and cut_off: the quantile of the scores, interpolated between neighbours. Scores are counted and ordered in ranges."""
    c = scored.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    at = F.array(*[F.struct(F.lit(s).alias("share"), ((F.col("total") - 1) * s).alias("at")) for s in shares])
    want = total.select("total", F.inline(at)).withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    up_to = F.col("total") - F.col("n_to") + F.col("n")
    rows = prefix_sum(c, [], score, ["n"]).crossJoin(F.broadcast(want))
    held = rows.groupBy("share", "at", "low").agg(F.min(F.when(up_to > F.col("low"), F.col(score))).alias("a"), F.min(F.when(up_to > F.col("high"), F.col(score))).alias("b"))
    return held.select("share", F.round(F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("low")), 6).alias("cut_off"))


def suite(scored: DataFrame, by: list[str], score: str, key: str, label: str, percents: tuple[int, ...]) -> DataFrame:
    """One record for each group: n, pos, prevalence, the ranking metrics, Brier score, log loss, and precision, recall and lift at each share."""
    out = ranking(scored, by, score, label).join(proper_scores(scored, by, score, label), by).withColumn("prevalence", F.round(F.col("pos") / F.col("n"), 6))
    tops = top_share(scored, by, score, key, label, percents)
    wide = tops.groupBy(*by).agg(*[F.max(F.when(F.col("percent") == p, F.col(m))).alias(f"{m}_{p}") for p in percents for m in ("precision", "recall", "lift")])
    return out.join(wide, by)


def random_scores(rows: DataFrame, key: str, replicates: int) -> DataFrame:
    """rows once for each replicate, with a score that depends on key and replicate alone."""
    h = (F.col(key).cast("long") % MODULUS * 48_271 + F.col("replicate") * 69_621) % MODULUS
    mixed = h.bitwiseXOR(F.shiftright(h, 15)) * 44_485 % MODULUS
    return rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("random_score", mixed)


SORTED_ROWS = 200_000  # about so many rows of a replicate are sorted together


def null_distribution(rows: DataFrame, key: str, score: str, label: str, replicates: int) -> DataFrame:
    """metric, observed, null_mean, null_std, z, rank_percent (of replicates below the observed value), and constant: what a constant score has. Neither key, score nor label is null."""
    ranges = rows.count() // SORTED_ROWS + 1
    at = F.floor(F.col("random_score") * F.lit(float(ranges)) / MODULUS)  # the scores are even over their range
    null = ranking_by_ranges(random_scores(rows.select(key, label), key, replicates), "replicate", "random_score", label, at)
    seen = ranking(rows, [], score, label).withColumn("rate", F.col("pos") / F.col("n"))
    names = ("average_precision", "roc_auc")
    one = lambda m: F.struct(F.lit(m).alias("metric"), F.col(m).alias("x"), F.col(f"_{m}").alias("observed"), (F.col("rate") if m == names[0] else F.lit(0.5)).alias("constant"))
    both = null.select(*names).crossJoin(F.broadcast(seen.select(*[F.col(m).alias(f"_{m}") for m in names], "rate"))).select(F.inline(F.array(*map(one, names))))
    lines = both.groupBy("metric", "observed", "constant").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.avg((F.col("x") < F.col("observed")).cast("double")).alias("below"))
    return lines.select("metric", "observed", F.round("mean", 6).alias("null_mean"), F.round("std", 6).alias("null_std"), F.round((F.col("observed") - F.col("mean")) / F.col("std"), 3).alias("z"), F.round(100 * F.col("below"), 2).alias("rank_percent"), F.round("constant", 6).alias("constant"))


def metric_deltas(rows: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """metric and its value by score a, by score b, and the difference."""
    one = lambda s: ranking(rows, [], s, label).drop("n", "pos").crossJoin(proper_scores(rows, [], s, label))
    names = ["average_precision", "roc_auc", "brier", "log_loss"]
    both = one(a).select(F.struct(*names).alias("a")).crossJoin(one(b).select(F.struct(*names).alias("b")))
    return both.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col("a")[m].alias("value_a"), F.col("b")[m].alias("value_b"), F.round(F.col("b")[m] - F.col("a")[m], 6).alias("delta")) for m in names])))


def calibrated_deltas(calibration: DataFrame, rows: DataFrame, score: str, label: str) -> DataFrame:
    """metric_deltas of the score against the one that is calibrated (Platt) on calibration rows."""
    from quillmere.operators.models import platt
    from quillmere.sources.sinks import scratch

    path = scratch(rows.sparkSession, "calibrated")
    platt(calibration, rows, score, label).select(score, "calibrated", F.col(label).cast("int").alias(label)).write.parquet(path)
    return metric_deltas(rows.sparkSession.read.parquet(path), score, "calibrated", label)


def tied_metrics(scored: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    return ranking_of_cells(cells(scored, by, score, label), by, score)


def prevalence(train: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """rows with `score`: the rate of the label in train."""
    return rows.crossJoin(F.broadcast(train.agg(F.avg(label).alias("score"))))


def ordinal(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with <column>_code of each category column: its place among the sorted values of train, -1 for null and for values that train does not have."""
    for c in columns:
        values = train.select(c).filter(F.col(c).isNotNull()).distinct()
        codes = values.withColumn(f"{c}_code", F.row_number().over(Window.orderBy(c)) - 1)  # distinct categories, not rows
        rows = rows.join(F.broadcast(codes), c, "left").na.fill(-1, [f"{c}_code"])
    return rows


def routed(rows: DataFrame, split: Column, at: str, path: str) -> DataFrame:
    """Writes rows in one pass to a folder for each split, and returns the manifest that is read back: split, anchor, n."""
    rows.withColumn("split", split).write.partitionBy("split").parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy("split", at).agg(F.count("*").alias("n"))


def leak_audit(columns: list[str], excluded: list[str], suspicious: tuple[str, ...]) -> list[tuple[str, str]]:
    """(column, reason) of feature names that are excluded or look like an outcome."""
    low = [c.lower() for c in columns]
    return [(c, "excluded" if c in excluded else "suspicious") for c, x in zip(columns, low, strict=True) if c in excluded or any(s in x for s in suspicious)]


def correlated_prevalence(rows: DataFrame, by: str, part: str, a: str, b: str, label: str, least: int) -> DataFrame:
    """value, rates in two parts, their difference, and the correlation of the rates over all values with enough rows in both."""
    rates = rows.groupBy(F.col(by).alias("value")).agg(*[x for p in (a, b) for x in (F.avg(F.when(F.col(part) == p, F.col(label))).alias(f"rate_{p}"), F.count_if(F.col(part) == p).alias(f"n_{p}"))])
    rates = rates.filter((F.col(f"n_{a}") >= least) & (F.col(f"n_{b}") >= least))
    whole = rates.agg(F.round(F.corr(f"rate_{a}", f"rate_{b}"), 6).alias("correlation"))
    return rates.crossJoin(F.broadcast(whole)).select("value", F.round(f"rate_{a}", 6).alias("rate_a"), F.round(f"rate_{b}", 6).alias("rate_b"), F.round(F.abs(F.col(f"rate_{a}") - F.col(f"rate_{b}")), 6).alias("difference"), "correlation")
