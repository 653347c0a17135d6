"""Scalar rules, joins and cleaning on hand fixtures."""

import datetime as dt
import math

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from riskgrid.functions import indices as I
from riskgrid.functions import nulls as N
from riskgrid.functions import risk as K
from riskgrid.functions.calendar import add_date_parts
from riskgrid.operators import clean as L
from riskgrid.operators import joins as J
from riskgrid.operators import resample as R
from riskgrid.operators.spatial import match_points
from riskgrid.spec import DAILY


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_tier_edges(spark):
    p = spark.createDataFrame([(0.15,), (0.35,), (0.60,), (0.1499,)], "p double")
    got = p.select(K.risk_tier("p"), K.risk_tier("p", "right")).collect()
    assert [r[0] for r in got] == ["Moderate", "High", "Extreme", "Low"]
    assert [r[1] for r in got] == ["Low", "Moderate", "High", "Low"]


def test_clip_keeps_null_and_flag_does_not(spark):
    null = F.lit(None).cast("double")
    assert one(spark, N.clip(null, low=0.0), N.flag(null > 3), N.ratio(F.lit(1), F.lit(0)), N.clip(F.lit(7.0), 0.0, 5.0)) == (None, 0, 0.0, 5.0)


def test_anchor_hand_values(spark):
    h, d = F.lit(0.90), lambda v: F.lit(v).cast("double")
    assert one(spark, K.anchored(h, d(0.02)), K.anchored(h, d(0.20)), K.anchored(h, d(None))) == (0.15, 0.5, 0.9)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0, 1), st.one_of(st.none(), st.floats(0, 1))), min_size=1, max_size=20))
def test_anchor_never_raises_probability(spark, pairs):
    df = spark.createDataFrame(pairs, "h double, d double")
    assert df.filter(K.anchored("h", "d") > F.col("h")).count() == 0


def test_sentences(spark):
    text = lambda t, w, h, r: one(spark, K.weather_sentence(*[F.lit(x).cast("double") for x in (t, w, h, r)]))[0]
    assert text(30, 20, 30, 3) == "Hot conditions, strong wind, dry air, recent rainfall."
    assert text(None, None, None, None) == "Mild temperatures."
    assert text(12, 17.9, 40.1, 1.9) == "Cool conditions."


def test_iso_calendar_at_year_end(spark):
    r = add_date_parts(spark.createDataFrame([(dt.date(2021, 1, 3),)], "Date date")).first()
    assert (r["WeekOfYear"], r["DayOfWeek"], r["Season"], r["is_winter"], r["is_fire_season"]) == (53, 6, 0, 1, 0)


def test_indices_against_formulas(spark):
    t, h = 31.0, 45.0
    vpd, dew, heat = one(spark, *[f(F.lit(t), F.lit(h)) for f in (I.vapour_pressure_deficit, I.dew_point, I.heat_index)])
    es = 0.6108 * math.exp(17.27 * t / (t + 237.3))
    assert vpd == pytest.approx(es * 0.55)
    gamma = 17.27 * t / (t + 237.3) + math.log(0.45)
    assert dew == pytest.approx(237.3 * gamma / (17.27 - gamma))
    assert 30 < heat < 36 and one(spark, I.heat_index(F.lit(20.0), F.lit(50.0))) == (20.0,)
    assert one(spark, I.vapour_pressure_deficit(F.lit(20.0), F.lit(120.0))) == (0.0,)


def test_box_join_keeps_every_pair_and_the_edge(spark):
    places = spark.createDataFrame([("A", 40.0, 49.0), ("B", 40.1, 49.1), ("C", 45.0, 49.0)], "City string, Latitude double, Longitude double")
    edge = 40.0 - 20 / 111.32
    points = spark.createDataFrame([(1, 40.05, 49.05), (2, edge, 49.0), (3, 43.0, 49.0), (4, -40.0, -49.0)], "id int, latitude double, longitude double")
    assert rows(match_points(points, places).select("id", "City"), "id", "City") == [(1, "A"), (1, "B"), (2, "A")]
    for cell in (0.05, 5.0):
        assert match_points(points, places, cell_degrees=cell).count() == 3


def test_peak_hour_rules(spark):
    stamp = lambda d, h: dt.datetime(2024, 1, d, h)
    data = [("A", stamp(1, 11), 5.0), ("A", stamp(1, 12), 5.0), ("A", stamp(2, 3), 0.0), ("A", stamp(2, 9), None)]
    df = spark.createDataFrame(data, "City string, Timestamp timestamp_ntz, s double")
    got = df.groupBy(F.to_date("Timestamp").alias("d")).agg(R.peak_hour("Timestamp", "s").alias("h"))
    assert [r[1] for r in rows(got, "d")] == [11, 12]


def test_all_null_rain_sums_to_zero(spark):
    df = spark.createDataFrame([("A", dt.datetime(2024, 1, 1, 5), None)], "City string, Timestamp timestamp_ntz, Rain_mm double")
    assert R.roll_up_daily(df).first()["Rain_mm_sum"] == 0.0


def test_sparse_series_on_and_off_grid(spark):
    day = lambda i: dt.date(2024, 1, i)
    panel = spark.createDataFrame([("A", day(2)), ("A", day(4)), ("A", day(9)), ("B", day(1))], "City string, Date date")
    side = spark.createDataFrame([("A", day(3), 0.3), ("A", day(4), 0.4), ("A", day(7), 0.7)], "City string, Date date, NDVI double")
    on = rows(J.attach_sparse(panel, side, DAILY, ["NDVI"]), "City", "Date")
    off = rows(J.attach_sparse(panel, side, DAILY, ["NDVI"], off_grid=True), "City", "Date")
    assert [r[2] for r in on] == [0.4, 0.4, 0.4, None]
    assert [r[2] for r in off] == [0.3, 0.4, 0.7, None]


def test_completion_and_replication(spark):
    df = spark.createDataFrame([("B", 1), ("B", 2), ("C", 3)], "City string, v int")
    need = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "City string")
    assert rows(J.complete_entities(df, need), "City", "v") == [("A", 1), ("A", 2), ("B", 1), ("B", 2), ("C", 3), ("D", 1), ("D", 2)]
    assert J.replicate_to_entities(spark.range(5), need).count() == 20
    assert rows(J.placeholder_rows(df, need), "City", "v") == [("A", 0), ("B", 1), ("B", 2), ("C", 3), ("D", 0)]


def test_repair_rules(spark):
    medians = spark.createDataFrame([("A", 5.0, 7.0)], "City string, Rain_mm_median double, x_lag1_median double")
    df = spark.createDataFrame([("A", 0.0, None, None), ("Z", None, 1.0, 2)], "City string, Rain_mm double, x_lag1 double, Month int")
    got = rows(L.repair_features(df, ["Rain_mm", "x_lag1", "Month", "gone"], medians, ["Rain_mm"], ["Month"]), "City")
    assert got == [("A", 5.0, 7.0, 0.0, 0.0), ("Z", 0.0, 1.0, 2.0, 0.0)]


def test_feature_list_excludes_leaks(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1, 2.0, 3, 4.0)], "City string, Date date, Fire_Occurred int, max_frp double, b int, a double")
    assert L.feature_columns(df) == ["a", "b"]


def test_suffix_repair_and_one_hot_back(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0)], "City string, T double, Rain_sum double")
    assert L.add_mean_suffix(df).columns == ["City", "T_mean", "Rain_sum"]
    hot = L.one_hot(df, "City", ["A", "B"])
    assert hot.select("city_A", "city_B", L.one_hot_value(["city_A", "city_B"])).first() == (1, 0, "A")
