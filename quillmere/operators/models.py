"""Models of tabular risk on Spark ML: preparation, regression over a grid, boosted trees, calibration, Weibull survival."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prepared(numbers: list[str], categories: list[str]) -> list:
    """Stages from columns to `features`: medians for missing numbers, scaled without centring; one-hot categories, unknown ones all zero."""
    filled = [f"{c}_filled" for c in numbers]
    indexed, hot = [f"{c}_at" for c in categories], [f"{c}_hot" for c in categories]
    return [
        Imputer(strategy="median", inputCols=numbers, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=False),
        StringIndexer(inputCols=categories, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=["scaled", *hot], outputCol="features"),
    ]


def probability(model_output: DataFrame, name: str = "score") -> DataFrame:
    """The rows with the probability of label 1 as a number."""
    return model_output.withColumn(name, vector_to_array("probability")[1])


def logistic(train: DataFrame, numbers: list[str], categories: list[str], label: str, strength: float):
    """A fitted pipeline; `strength` is the weight of the squared coefficients."""
    return Pipeline(stages=[*prepared(numbers, categories), LogisticRegression(labelCol=label, regParam=strength, maxIter=50)]).fit(train)


def boosted(train: DataFrame, numbers: list[str], categories: list[str], label: str, held: str, rounds: int = 30, depth: int = 4):
    """A fitted pipeline of boosted trees that stops when rows with `held` true no longer gain.

    Stages read their input six times and more; they read its columns from the executors' disks, since memory is for the trees' own rows.
    """
    trees = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=7, validationIndicatorCol=held, validationTol=0.001)
    kept = train.select(*numbers, *categories, label, held).persist(StorageLevel.DISK_ONLY)  # in the order and partitions of train, which tell the trees' samples
    try:
        return Pipeline(stages=[*prepared(numbers, categories), trees]).fit(kept)
    finally:
        kept.unpersist()


def _logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(q / (1 - q))


def calibration_line(scored: DataFrame, p: str, label: str) -> DataFrame:
    """slope and intercept of the label on the logit of p, and in_the_large (rate - mean p)."""
    rows = scored.select(array_to_vector(F.array(_logit(F.col(p)))).alias("features"), F.col(label).cast("double").alias("label"))
    fit = LogisticRegression(regParam=0.0, maxIter=100, standardization=False).fit(rows)
    return scored.agg(F.lit(float(fit.coefficients[0])).alias("slope"), F.lit(float(fit.intercept)).alias("intercept"), (F.avg(label) - F.avg(p)).alias("in_the_large"))


def platt(calibration: DataFrame, rows: DataFrame, p: str, label: str) -> DataFrame:
    """rows with `calibrated`: a sigmoid of the logit of p fitted on calibration rows, or p itself where these have fewer than two rows of a label."""
    counts = calibration.agg(F.sum(label), F.count("*")).first()
    if (counts[0] or 0) < 2 or counts[1] - (counts[0] or 0) < 2:
        return rows.withColumn("calibrated", F.col(p))
    line = calibration_line(calibration, p, label).first()
    return rows.withColumn("calibrated", 1 / (1 + F.exp(-(line["slope"] * _logit(F.col(p)) + line["intercept"]))))


def weibull(rows: DataFrame, numbers: list[str], duration: str, event: str):
    """A fitted accelerated-failure-time model; its output has the median survival as `median_survival`."""
    class_of = AFTSurvivalRegression(labelCol=duration, censorCol=event, quantileProbabilities=[0.5], quantilesCol="quantiles", maxIter=50)
    cast = rows.withColumns({duration: F.col(duration).cast("double"), event: F.col(event).cast("double")})
    return Pipeline(stages=[VectorAssembler(inputCols=numbers, outputCol="features"), class_of]).fit(cast)


def survival_probability(t: Column, mu: Column, scale: Column) -> Column:
    """Weibull survival to time t of location mu and scale."""
    return F.exp(-F.exp((F.log(t) - mu) / scale))


def standardised(rows: DataFrame, numbers: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """rows with z_<number> for each of `numbers`, and the (mean, deviation) that made them; deviations are of the population, and never 0."""
    found = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in numbers], *[F.stddev_pop(c).alias(f"s_{c}") for c in numbers]).first()
    scale = {c: (float(found[f"m_{c}"] or 0), float(found[f"s_{c}"] or 0) + 1e-8) for c in numbers}
    return rows.withColumns({f"z_{c}": (F.col(c) - mean) / spread for c, (mean, spread) in scale.items()}), scale


def class_profiles(rows: DataFrame, by: str, number: str, least: int = 100) -> DataFrame:
    """(by, n, number): each class of `least` rows or more with its median of `number`, exact to a ten-thousandth of its rows."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.percentile_approx(number, 0.5, 10_000).cast("double").alias(number)).filter(F.col("n") >= least)


def survival_profiles(rows: DataFrame, numbers: list[str], duration: str, event: str, profiles: DataFrame, times: tuple[int, ...], most: float = 10_000.0) -> DataFrame:
    """profiles (with the columns `numbers`) with location, scale, median_survival in [1, most] and survival_<t>d for each of `times`.

    A Weibull model is fitted on rows' standardised numbers, and profiles are put on the same scale. Durations have to be positive.
    """
    scaled, by = standardised(rows, numbers)
    fit = weibull(scaled, [f"z_{c}" for c in numbers], duration, event).stages[-1]
    location = F.lit(float(fit.intercept))
    for c, weight in zip(numbers, fit.coefficients, strict=True):
        location = location + float(weight) * (F.col(c) - by[c][0]) / by[c][1]
    out = profiles.withColumn("location", location).withColumn("scale", F.lit(float(fit.scale)))
    median = F.exp(F.col("location") + F.col("scale") * F.log(F.log(F.lit(2.0))))
    shown = {f"survival_{t}d": survival_probability(F.lit(float(t)), F.col("location"), F.col("scale")) for t in times}
    return out.withColumns({"median_survival": F.least(F.greatest(median, F.lit(1.0)), F.lit(most))} | shown)
