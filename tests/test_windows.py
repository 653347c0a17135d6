"""Window operators: hand values, and chunked form against plain form."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskgrid.operators import panel as P
from riskgrid.spec import Panel

PLAIN = Panel("City", "Date")
CHUNKED = Panel("City", "Date", chunk="month")


def series(spark, values, city="A", name="v"):
    day = dt.date(2020, 1, 1)
    data = [(city, day + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, f"City string, Date date, {name} double")


@pytest.fixture(scope="module")
def noisy(spark):
    """Three places over two years with missing days, nulls and events."""
    rng, data = random.Random(5), []
    for city in ("A", "B", "C"):
        for i in range(730):
            if rng.random() < 0.2:
                continue
            v = None if rng.random() < 0.1 else float(rng.randint(0, 40))
            data.append((city, dt.date(2019, 1, 1) + dt.timedelta(days=i), v, int(rng.random() < 0.05), float(rng.choice([0, 0, 0, 3]))))
    return spark.createDataFrame(data, "City string, Date date, v double, Fire_Occurred int, rain double").cache()


def test_dry_streak_hand_values(spark):
    dry = [0, 1, 1, 0, 1, 1, 1, 0, 0, 1]
    df = series(spark, [0.0 if d else 5.0 for d in dry], name="Rain_mm_sum")
    for panel in (PLAIN, CHUNKED):
        assert [r[-1] for r in rows(P.dry_streak(df, panel), "Date")] == [0, 1, 2, 0, 1, 2, 3, 0, 0, 1]


def test_rows_since_event_hand_values(spark):
    df = series(spark, [0, 1, 0, 0, 1, 0, 0, 0, 1, 0], name="Fire_Occurred")
    for panel in (PLAIN, CHUNKED):
        assert [r[-1] for r in rows(P.rows_since_event(df, panel), "Date")] == [365, 365, 1, 2, 3, 1, 2, 3, 4, 1]


def test_rolls_hand_values(spark):
    got = rows(P.add_rolls(series(spark, [0.0, 1, 2, 3, 4, 5]), PLAIN, ["v"], [3]).select("Date", "v_roll3_mean", F.round("v_roll3_std", 4)), "Date")
    assert [r[1] for r in got] == [None, 0, 0.5, 1, 2, 3]
    assert [r[2] for r in got] == [None, None, 0.7071, 1, 1, 1]


def test_fill_stays_inside_entity(spark):
    a, b = series(spark, [None, None]), series(spark, [7.0, None, 3.0], city="B")
    for panel in (PLAIN, CHUNKED):
        got = rows(P.fill_gaps(a.union(b), panel, ["v"]), "City", "Date")
        assert [r[2] for r in got] == [None, None, 7, 7, 3]


def test_backward_fill_covers_leading_gap(spark):
    got = rows(P.fill_gaps(series(spark, [None, None, 4.0, None]), CHUNKED, ["v"]), "Date")
    assert [r[2] for r in got] == [4, 4, 4, 4]


@pytest.mark.parametrize(
    "make",
    [
        lambda df, p: P.row_features(df, p, [P.lags(["v"], (1, 7, 30)), P.rolls(["v"], (3, 30)), P.event_counts()], 90, block_rows=100),
        lambda df, p: P.row_index(df, p, "n"),
        lambda df, p: P.dry_streak(df, p, "rain"),
        lambda df, p: P.rows_since_event(df, p),
        lambda df, p: P.event_rate_so_far(df, p),
        lambda df, p: P.event_rate_so_far(df.withColumn("m", F.month("Date")), p, by=["m"]),
        lambda df, p: P.fill_gaps(df, p, ["v"]),
        lambda df, p: P.every_nth(df, p, 3),
    ],
)
def test_chunked_equals_plain(noisy, make):
    a, b = rows(make(noisy, PLAIN), "City", "Date"), rows(make(noisy, CHUNKED), "City", "Date")
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert [pytest.approx(v) if isinstance(v, float) else v for v in x] == list(y)


def test_keep_one_and_overlay(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("A", 2, "y"), ("B", 1, "z")], "k string, o int, v string")
    assert rows(P.keep_one(df, ["k"], ["o"]).select("k", "v"), "k") == [("A", "y"), ("B", "z")]
    assert rows(P.keep_one(df, ["k"], ["o"], last=False).select("k", "v"), "k") == [("A", "x"), ("B", "z")]
    new = spark.createDataFrame([("B", "new"), ("C", "c")], "k string, v string")
    old = spark.createDataFrame([("A", "a"), ("B", "b")], "k string, v string")
    assert rows(P.overlay(old, new, ["k"]), "k") == [("A", "a"), ("B", "new"), ("C", "c")]


def test_seasonal_parts_recovers_pure_cycle(spark):
    values = [10 + [-1.0, 0.0, 1.0][i % 3] for i in range(30)]
    got = rows(P.seasonal_parts(series(spark, values), PLAIN, "v", period=3).select("Date", "trend", "seasonal", "resid"), "Date")
    assert got[0][1] is None and got[-1][1] is None
    for i, (_, trend, season, resid) in enumerate(got[1:-1], start=1):
        assert trend == pytest.approx(10) and season == pytest.approx([-1, 0, 1][i % 3]) and resid == pytest.approx(0)
