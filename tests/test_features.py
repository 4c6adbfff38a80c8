import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.operators import models, panel, weather


def day(text):
    return dt.date.fromisoformat(text)


def test_ages_of_known_hidden_and_cut_intervals(spark):
    at = day("2018-01-31")
    rows = [
        (1, at, day("2015-06-01"), day("2015-12-01"), day("2017-06-01"), day("2018-06-01")),
        (2, at, day("2020-01-01"), day("2020-01-01"), None, day("2010-01-01")),
        (3, at, day("2017-06-01"), day("2018-06-01"), at, at),
        (4, at, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "entity int, as_of_date date, cl date, cu date, rl date, ru date")
    got = {r["entity"]: r for r in panel.with_row_id(panel.asset_ages(df, ("cl", "cu"), ("rl", "ru")), "entity").collect()}
    assert [got[i]["asset_temporal_eligibility_status"] for i in (1, 2, 3, 4)] == ["active", "future", "crosses", "missing"]
    assert got[1]["years_since_construction_lower"] == pytest.approx((at - day("2015-12-01")).days / 365.25)
    assert got[1]["years_since_construction_upper"] == pytest.approx((at - day("2015-06-01")).days / 365.25)
    assert [got[i]["years_since_construction_lower"] for i in (2, 3, 4)] == [None] * 3
    assert [got[i]["future_asset_record_hidden_flag"] for i in (1, 2, 3, 4)] == [0, 1, 0, 0]
    assert [got[i]["age_interval_crosses_as_of_flag"] for i in (1, 2, 3, 4)] == [0, 0, 1, 0]
    assert [got[i]["resurfacing_interval_crosses_as_of_flag"] for i in (1, 2, 3, 4)] == [1, 0, 0, 0]
    assert got[3]["years_since_resurfacing_lower"] == 0 and got[2]["years_since_resurfacing_upper"] is None
    assert got[4]["segment_month_id"] == "4_2018-01"


def test_weather_without_a_known_day_and_with_fallbacks(spark):
    rows = [(day("2020-01-01") + dt.timedelta(i), None, -5.0, 1.0, 2.0 if i % 2 else None, i % 3 == 0) for i in range(31)]
    df = spark.createDataFrame(rows, "day date, rain double, low double, mean double, high double, b boolean").withColumn("low_fallback_used", F.col("b").cast("int")).drop("b")
    r = weather.weather_features(df, "day", (31,)).filter("as_of_date = '2020-01-31'").first()
    assert r["rain_31d"] is None and r["valid_days_31d"] == 0 and r["complete_31d"] == 0
    assert r["freeze_thaw_strict_31d"] == 15 and r["low_fallback_days_31d"] == 11 and r["rain_fallback_days_31d"] == 0
    full = weather.weather_features(df.withColumn("rain", F.lit(1.0)), "day", (31,)).filter("as_of_date = '2020-01-31'").first()
    assert full["rain_31d"] == 31 and full["complete_31d"] == 1 and full["coverage_31d"] == 1


def test_profiles_find_the_model_that_made_the_durations(spark):
    rng = np.random.default_rng(5)
    x, k = rng.uniform(0, 100, 6000), rng.integers(1, 4, 6000)
    t = np.exp(3 + 0.02 * x + 0.3 * k + 0.5 * np.log(rng.exponential(size=6000)))
    rows = spark.createDataFrame([(float(a), float(b), float(c), 1) for a, b, c in zip(x, k, t, strict=True)], "x double, k double, t double, e int")
    out = models.survival_profiles(rows, ["x", "k"], "t", "e", models.class_profiles(rows, "k", "x"), (50,)).collect()
    assert len(out) == 3
    for r in out:
        mu = 3 + 0.02 * r["x"] + 0.3 * r["k"]
        assert r["location"] == pytest.approx(mu, abs=0.05) and r["scale"] == pytest.approx(0.5, abs=0.03)
        assert r["median_survival"] == pytest.approx(math.exp(r["location"] + r["scale"] * math.log(math.log(2))))
        assert r["survival_50d"] == pytest.approx(math.exp(-math.exp((math.log(50) - r["location"]) / r["scale"])))
