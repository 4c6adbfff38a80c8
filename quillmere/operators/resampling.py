"""Bootstrap intervals and subgroup tables of ranking metrics, by weights of cells instead of copies of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators.evaluation import ranking, ranking_of_cells, top_share
from quillmere.operators.ordering import MODULUS, portable_hash, row_numbers

RANGES = 256  # of scores; what comes to the driver is so many vectors of replicates
BLOCK = 1 << 20  # weights at once
ROUNDS = 3  # of the hash: after one, neighbouring units and replicates are still alike, and intervals too narrow
METRICS = ("average_precision", "roc_auc", "brier", "precision_at_top", "recall_at_top", "lift_at_top")
# hash values from which a unit is drawn at least once, twice, ...: the distribution of Poisson with mean 1
DRAWN = [int(MODULUS * p) for p in accumulate(math.exp(-1) / math.factorial(k) for k in range(12))]


def draws(units: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, key, weight): how often each unit is drawn when as many as there are are drawn with replacement. Units not drawn have no row."""
    placed = row_numbers(units.select(key).distinct(), key, seed)
    n = placed.count()
    drawn = placed.select(F.col("place").alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = drawn.select("replicate", (portable_hash(F.col("_i") * replicates + F.col("replicate"), seed + 1) % max(n, 1)).alias("place"))
    return drawn.groupBy("replicate", "place").agg(F.count("*").alias("weight")).join(placed, "place").select("replicate", key, "weight")


def bootstrap_ranking(scored: DataFrame, unit: str, score: str, label: str, replicates: int, seed: int) -> DataFrame:
    """metric, n_used, low and high: percentiles 2.5 and 97.5 of average precision and ROC-AUC over replicates of whole units.

    Replicates without both classes are left out; with fewer than two the bounds are null.
    """
    cells = scored.groupBy(unit, score).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("pos"))
    weighted = cells.join(draws(scored, unit, replicates, seed), unit).groupBy("replicate", score).agg(F.sum(F.col("n") * F.col("weight")).alias("n"), F.sum(F.col("pos") * F.col("weight")).alias("pos"))
    each = ranking_of_cells(weighted, ["replicate"], score).filter("pos > 0 and pos < n")
    long = each.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("average_precision", "roc_auc")])))
    out = long.groupBy("metric").agg(F.count("value").alias("n_used"), F.percentile("value", [0.025, 0.975]).alias("_q"))
    bound = lambda i: F.when(F.col("n_used") > 1, F.round(F.col("_q")[i], 6))
    return out.select("metric", "n_used", bound(0).alias("low"), bound(1).alias("high"))


def subgroups(scored: DataFrame, dimensions: list[str], score: str, label: str, least_rows: int, least_positives: int) -> DataFrame:
    """dimension, value, n, pos, average_precision, roc_auc and status of each value of each dimension; small groups keep their row, without metrics."""
    part = lambda d: F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
    long = scored.select(F.inline(F.array(*map(part, dimensions))), F.col(score).alias("score"), F.col(label).alias("label"))
    out = ranking(long, ["dimension", "value"], "score", "label")
    status = F.when(F.col("n") < least_rows, "too_few_rows").when(F.col("pos") < least_positives, "too_few_positives").when(F.col("pos") == F.col("n"), "one_class").otherwise("ok")
    out = out.withColumn("status", status)
    return out.withColumns({m: F.when(F.col("status") == "ok", F.col(m)) for m in ("average_precision", "roc_auc")})


def subgroup_tops(scored: DataFrame, dimensions: list[str], score: str, key: str, label: str, percents: tuple[int, ...], least_rows: int, least_positives: int, least_top: int) -> DataFrame:
    """dimension, value, percent, n, pos, k, tp, precision, recall, lift and status of the top shares of each value of each dimension.

    No group is left out: one of few rows has no metrics, one of few positives, or few of them in its top, no lift, and the status says why.
    """
    part = lambda d: F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
    long = scored.select(F.inline(F.array(*map(part, dimensions))), F.col(score).alias("score"), F.col(key).alias("key"), F.col(label).alias("label"))
    long = long.withColumn("value", F.coalesce("value", F.lit("(null)")))
    sizes = long.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("pos"))
    out = top_share(long, ["dimension", "value"], "score", "key", "label", percents).join(sizes, ["dimension", "value"])
    status = F.when(F.col("n") < least_rows, "too_few_rows").when(F.col("pos") < least_positives, "too_few_positives").when(F.col("tp") < least_top, "too_few_in_top").otherwise("ok")
    out = out.withColumn("status", status).withColumn("lift", F.when(F.col("status") == "ok", F.col("lift")))
    out = out.withColumns({m: F.when(F.col("n") >= least_rows, F.col(m)) for m in ("precision", "recall")})
    return out.select("dimension", "value", "percent", "n", "pos", "k", "tp", "precision", "recall", "lift", "status")


def unit_weights(units: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each unit is drawn in each replicate: a row for a unit, a column for a replicate and at last one of ones. Only a hash decides, so any task finds the same."""
    h = units[:, None] * replicates + np.arange(replicates)
    for i in range(ROUNDS):
        h = (np.fmod(h, MODULUS) * 48_271 + (seed + i) * 69_621) % MODULUS
        h = (h ^ (h >> 15)) * 44_485 % MODULUS
    drawn = np.searchsorted(DRAWN, h.ravel(), side="right").reshape(h.shape)
    return np.concatenate([drawn, np.ones((len(units), 1), np.int64)], axis=1)


def _score_cells(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(range, scores, n, pos) of rows sorted by range and falling score: weighted counts, a row for a score and a column for a replicate. A score's rows may come in several blocks; the last one of a block waits for the next."""
    held = None
    size = max(1, BLOCK // (replicates + 1))
    for batch in (b.slice(i, size) for b in batches for i in range(0, b.num_rows, size)):
        range_, unit, score, n, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        weights = unit_weights(unit.astype(np.int64), replicates, seed)
        starts = np.flatnonzero(np.append(True, (score[1:] != score[:-1]) | (range_[1:] != range_[:-1])))
        sums = [np.add.reduceat(weights * c[:, None], starts, axis=0) for c in (n, pos)]
        keys = [(int(range_[i]), float(score[i])) for i in starts]
        if held is not None:
            if held[0] == keys[0]:
                for s, h in zip(sums, held[1:], strict=True):
                    s[0] += h
            else:
                yield held[0][0], np.array([held[0][1]]), held[1][None], held[2][None]
        held = keys[-1], sums[0][-1], sums[1][-1]
        for r in sorted({k[0] for k in keys[:-1]}):
            at = [i for i, k in enumerate(keys[:-1]) if k[0] == r]
            yield r, np.array([keys[i][1] for i in at]), sums[0][at], sums[1][at]
    if held is not None:
        yield held[0][0], np.array([held[0][1]]), held[1][None], held[2][None]


def bootstrap_metrics(scored: DataFrame, unit: str, score: str, label: str, replicates: int = 500, seed: int = 42, top: int = 10) -> DataFrame:
    """metric, point, low, high, n_used and status of average precision, ROC-AUC, Brier score, and precision, recall and lift of the highest `top` percent: percentiles 2.5 and 97.5 over replicates.

    `unit` is what is drawn: a whole number for an entity, whose rows go together, or for a row. How often a unit is drawn follows from its hash, one Poisson number for
    each replicate, so no replicate is ever a table: rows are put in order of score once, and a task adds the weight vectors of its range of scores. Of
    the scores at the edge of the top a share is taken. Replicates without both classes are left out; if all are, the status is INSUFFICIENT_VARIATION
    and the bounds are null. Rows with a null in any of the three are left out. Rows of one score are one range, whose task takes them block by block.
    """
    from quillmere.sources.sinks import scratch

    spark = scored.sparkSession
    rows = scored.select(F.col(unit).cast("long").alias("unit"), F.col(score).cast("double").alias("score"), F.col(label).cast("long").alias("label")).dropna()
    cells = rows.groupBy("unit", "score").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    path = scratch(spark, "score-ranges")
    cells.repartitionByRange(RANGES, F.desc("score")).select(F.spark_partition_id().alias("range"), "unit", "score", "n", "pos").write.parquet(path)
    ordered = spark.read.parquet(path).repartition("range").sortWithinPartitions("range", F.desc("score"))
    schema = "range int, vectors binary"

    def packed(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["range", "vectors"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for r, p, n, pos in _score_cells(batches, replicates, seed):
            loss = n * p[:, None] ** 2 - 2 * p[:, None] * pos + pos
            found[r] = found.get(r, 0) + np.stack([n.sum(axis=0), pos.sum(axis=0), loss.sum(axis=0)]).astype(float)
        yield packed(found)

    def collected(df: DataFrame) -> dict[int, np.ndarray]:
        return {r["range"]: np.frombuffer(r["vectors"]).reshape(3, replicates + 1) for r in df.collect()}

    sums = collected(ordered.mapInArrow(totals, schema))
    before, whole = {}, np.zeros((3, replicates + 1))
    for r in sorted(sums):
        before[r], whole = whole[:2], whole + sums[r]
    told = spark.sparkContext.broadcast((before, np.ceil(whole[0] * top / 100 - 1e-9)))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, k = told.value
        reached, found = {}, {}
        for r, _, n, pos in _score_cells(batches, replicates, seed):
            start = reached.get(r, before[r])
            m, tp = start[0] + np.cumsum(n, axis=0), start[1] + np.cumsum(pos, axis=0)
            reached[r] = np.stack([m[-1], tp[-1]])
            share = pos * tp / np.maximum(m, 1)
            lost = pos * ((m - n) - (tp - pos) + (n - pos) / 2)
            inside = np.where((m - n < k) & (k <= m), (tp - pos) + pos * (k - (m - n)) / np.maximum(n, 1), 0)
            found[r] = found.get(r, 0) + np.stack([x.sum(axis=0) for x in (share, lost, inside)])
        yield packed(found)

    share, lost, inside = sum(collected(ordered.mapInArrow(ranked, schema)).values(), np.zeros((3, replicates + 1)))
    (n, pos, loss), k = whole, told.value[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        values = np.stack([share / pos, 1 - lost / (pos * (n - pos)), loss / n, inside / k, inside / pos, inside / k / (pos / n)])
    good = (pos > 0) & (pos < n)
    points = [None if math.isnan(v) or math.isinf(v) else float(v) for v in values[:, -1]]
    used = values[:, :-1][:, good[:-1]]
    bounds = np.percentile(used, [2.5, 97.5], axis=1).T if used.size else [(None, None)] * len(METRICS)
    status = "ok" if used.size else "INSUFFICIENT_VARIATION"
    lines = [(m, p, *(None if v is None else float(v) for v in b), used.shape[1], status) for m, p, b in zip(METRICS, points, bounds, strict=True)]
    table = spark.createDataFrame(lines, "metric string, point double, low double, high double, n_used long, status string")
    return table.withColumns({c: F.round(c, 6) for c in ("point", "low", "high")})
