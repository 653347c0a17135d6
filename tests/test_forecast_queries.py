"""Forecast queries cover every target and step."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskgrid.spec import DAILY_WEATHER, HOURLY_TARGETS, HOURLY_VARIABLES
from riskgrid.workload import binding as B


def test_hourly_forecast_has_all_targets_and_hours(spark, data):
    got = Counter((r.City, r.variable) for r in entry.queries()["autoregressive_hourly"](spark, data).collect())
    assert {v for _, v in got} == set(HOURLY_TARGETS) and set(got.values()) == {336}


def test_daily_forecasts_have_all_days_and_variables(spark, data):
    for name in ("autoregressive_recursive", "autoregressive_direct"):
        assert set(Counter(r.City for r in entry.queries()[name](spark, data).collect()).values()) == {30}
    assert {r.variable for r in entry.queries()["seasonal_forecast_daily"](spark, data).select("variable").distinct().collect()} == set(DAILY_WEATHER)


def test_hourly_seasonal_forecast_of_all_series(spark, data):
    got = entry.queries()["seasonal_forecast_hourly"](spark, data).collect()
    series = Counter((r.City, r.variable) for r in got)
    assert set(series.values()) == {336} and {v for _, v in series} == set(HOURLY_VARIABLES) and len(series) == 4 * 9
    # least squares over one station's hours
    rows = B.stations_hourly(B.Tables(spark, data)).filter("City = 'STATION_1'").orderBy("Timestamp").select("Timestamp", "Temperature_C").collect()
    origin = np.datetime64("2024-01-01T00:00")
    hour = lambda stamp: float((np.datetime64(stamp.replace(tzinfo=None)) - origin) / np.timedelta64(1, "h"))

    def terms(h):
        seasons = [f(2 * math.pi * k * h / p) for p, n in ((24, 3), (168, 2), (8766, 3)) for k in range(1, n + 1) for f in (math.sin, math.cos)]
        return [1.0, h / 8766, *seasons]

    beta = np.linalg.lstsq(np.array([terms(hour(r.Timestamp)) for r in rows]), np.array([r.Temperature_C for r in rows]), rcond=None)[0]
    ahead = sorted((r.Timestamp, r.value) for r in got if (r.City, r.variable) == ("STATION_1", "Temperature_C"))
    assert hour(ahead[0][0]) == hour(rows[-1].Timestamp) + 1
    assert [v for _, v in ahead] == pytest.approx([float(np.dot(terms(hour(s)), beta)) for s, _ in ahead], abs=1e-4)


def test_whole_daily_feature_table(spark, data):
    out = entry.queries()["engineered_daily_full"](spark, data)
    assert {f"prophet_{v}_{k}" for v in DAILY_WEATHER for k in ("pred", "resid")} <= set(out.columns) and len(out.columns) > 180
    weather = B.weather_daily(B.Tables(spark, data))
    assert out.select("City", "Date").distinct().count() == out.count() == weather.count()
    top = weather.select(F.percentile("Temperature_C_max", 0.99)).first()[0]
    assert out.agg(F.max("Temperature_C_max")).first()[0] == pytest.approx(top)


def test_winner_of_the_validation_rows_is_reported(spark, data):
    q = entry.queries()
    best = q["best_model"](spark, data).first().model
    assert [r.model for r in q["final_metrics"](spark, data).collect()] == [best]
