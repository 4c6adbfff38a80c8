"""Contributions of features to linear scores, and what is told from them: additivity, global importance, drivers of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_contributions(rows: DataFrame, coefficients: dict[str, float], intercept: float) -> DataFrame:
    """rows with base, margin and contributions (array of feature, value): coefficient * (x - mean of x over rows)."""
    means = rows.agg(*[F.avg(c).alias(f"_mean_{c}") for c in coefficients])
    rows = rows.crossJoin(F.broadcast(means))
    base = sum((F.col(f"_mean_{c}") * k for c, k in coefficients.items()), F.lit(intercept))
    margin = sum((F.col(c) * k for c, k in coefficients.items()), F.lit(intercept))
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.col(f"_mean_{c}")) * k).alias("value")) for c, k in coefficients.items()])
    return rows.withColumns({"base": base, "margin": margin, "contributions": parts}).drop(*[f"_mean_{c}" for c in coefficients])


def first_contributions(rows: DataFrame, key: list[str], place: str, names: list[str]) -> DataFrame:
    """key and contributions of `names`: of rows with one key the first value by `place`, a number, that each feature has there; null if it has none."""
    values = [F.col("contributions")[i]["value"] for i in range(len(names))]  # in the order of the coefficients
    firsts = [F.struct(F.lit(name).alias("feature"), F.min_by(v, F.when(v.isNotNull(), F.col(place))).alias("value")) for name, v in zip(names, values, strict=True)]
    return rows.groupBy(*key).agg(F.array(*firsts).alias("contributions"))


def residual() -> Column:
    """What base and contributions leave of the margin."""
    return F.abs(F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["value"]) - F.col("margin"))


def additivity(rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """n, max_residual and n_failed of base + contributions against the margin."""
    left = residual()
    return rows.agg(F.count("*").alias("n"), F.max(left).alias("max_residual"), F.count_if(left > tolerance).alias("n_failed"))


def importance(rows: DataFrame) -> DataFrame:
    """feature, mean_abs, mean_signed, positive_share and negative_share over all rows."""
    long = rows.select(F.inline("contributions"))
    share = lambda c: F.count_if(c) / F.count("*")
    return long.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean_signed"), share(F.col("value") > 0).alias("positive_share"), share(F.col("value") < 0).alias("negative_share"))


def checked_importance(rows: DataFrame, names: list[str], tolerance: float = 1e-6) -> DataFrame:
    """feature, mean_abs (as `importance` has it), n and n_failed (as `additivity` has them) in one reading of rows, whose contributions are those of `names` in that order; no rows of no rows."""
    means = [F.struct(F.lit(name).alias("feature"), F.avg(F.abs(F.col("contributions")[i]["value"])).alias("mean_abs")) for i, name in enumerate(names)]
    found = rows.agg(F.count("*").alias("n"), F.count_if(residual() > tolerance).alias("n_failed"), F.array(*means).alias("_means"))
    return found.filter("n > 0").select(F.inline("_means"), "n", "n_failed")


def drivers(rows: DataFrame, key: list[str], top: int = 3) -> DataFrame:
    """key, raises and lowers: the names of at most `top` features with the largest positive and negative contributions, the first by name among equals."""
    def names(sign: int):
        kept = F.filter("contributions", lambda c: c["value"] > 0 if sign > 0 else c["value"] < 0)
        order = F.array_sort(F.transform(kept, lambda c: F.struct((-F.abs(c["value"])).alias("v"), c["feature"].alias("feature"))))
        return F.array_join(F.transform(F.slice(order, 1, top), lambda c: c["feature"]), ",")

    return rows.select(*key, names(1).alias("raises"), names(-1).alias("lowers"))
