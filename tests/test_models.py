"""Learning and forecasting on small fixtures."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskgrid.plans import forecast as G
from riskgrid.plans import learn as L
from riskgrid.sources.sinks import load_bundle, save_bundle
from riskgrid.spec import DAILY, HOURLY


@pytest.fixture(scope="module")
def labelled(spark):
    rng, data = random.Random(4), []
    for i in range(900):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        y = int(rng.random() < 1 / (1 + math.exp(-(2.5 * a - 2))))
        data.append((f"P{i % 3}", dt.date(2020, 1, 1) + dt.timedelta(days=i // 3), a if i % 17 else None, b, y))
    df = spark.createDataFrame(data, "City string, Date date, a double, b double, label int")
    split = F.when(F.col("Date") < F.lit("2020-07-01").cast("date"), "train").when(F.col("Date") < F.lit("2020-09-01").cast("date"), "val").otherwise("test")
    return L.prepared_split(df, ["a", "b"], "label", split).cache()


KEY = ["City", "Date", "split", "y"]


def test_models_rank_better_than_chance(labelled, tmp_path):
    train = labelled.filter("split = 'train'")
    models = L.fit_classifiers(train, ["a", "b"], ["logistic", "random_forest", "balanced_forest"], scale=0.05)
    scores = L.cut_lineage(L.score(models, labelled, KEY))
    assert scores.count() == 900 * 3
    report = L.three_way_report(scores)
    assert report.count() == 9 and report.filter("split = 'test' AND roc_auc < 0.75").count() == 0
    top = L.feature_importance(models["random_forest"], ["a", "b"]).first()
    assert top["feature"] == "a"
    moved = L.permutation_importance(models["logistic"], labelled, ["a", "b"], ["City", "Date"], block_rows=300)
    assert moved.first()["feature"] == "a"
    calibrated = L.calibrate(scores, L.calibrators(scores.filter("split = 'val'")))
    assert calibrated.count() == scores.count() and calibrated.filter("p < 0 OR p > 1").count() == 0
    save_bundle(models["logistic"], str(tmp_path / "m"), {"model": "logistic", "threshold": 0.4, "features": ["a", "b"]})
    again, manifest = load_bundle(labelled.sparkSession, str(tmp_path / "m"))
    assert manifest.first()["threshold"] == 0.4
    same = L.score({"logistic": again}, labelled, KEY).join(scores.filter("model = 'logistic'").withColumnRenamed("p", "q"), ["City", "Date"])
    assert same.filter("abs(p - q) > 1e-9").count() == 0


def test_isotonic_is_monotone(spark):
    rng = random.Random(2)
    data = [("m", p, int(rng.random() < p * p)) for p in [rng.random() for _ in range(500)]]
    df = spark.createDataFrame(data, "model string, p double, y int")
    before = df.withColumn("p0", F.col("p"))
    got = rows(L.calibrate(before, L.calibrators(df)).select("p0", "p"), "p0")
    assert all(x[1] <= y[1] + 1e-12 for x, y in zip(got, got[1:]))


def test_stacking_covers_every_key(labelled):
    folds, meta = L.stack(labelled.filter("split = 'train'"), ["a", "b"], ["logistic", "random_forest"], ["City", "Date"], folds=2, scale=0.03)
    out = L.stacked_scores(labelled.filter("split = 'test'"), folds, meta, KEY)
    assert out.count() == labelled.filter("split = 'test'").count() and out.filter("p < 0 OR p > 1 OR p IS NULL").count() == 0


def test_trials_are_repeatable():
    space = {"maxDepth": (3, 4, 5), "stepSize": (0.1, 0.2)}
    assert L.random_trials(space, 5) == L.random_trials(space, 5)


def cyclic(spark, days=800, city="A"):
    start = dt.date(2018, 1, 1)
    value = lambda i: 10 + 0.01 * i + 5 * math.sin(2 * math.pi * ((start - dt.date(2000, 1, 1)).days + i) / 365.25) + (1 if (i % 7) == 2 else 0)
    return spark.createDataFrame([(city, start + dt.timedelta(days=i), value(i)) for i in range(days)], "City string, Date date, v double"), value


def test_seasonal_fit_matches_least_squares(spark):
    df, value = cyclic(spark)
    long = df.select("City", "Date", F.lit("v").alias("variable"), F.col("v").alias("value"))
    terms = G.design("Date", 2, 2)
    beta = G.fit_seasonal(long, terms).first()["beta"]
    x = np.array([list(r) for r in df.orderBy("Date").select(*terms).collect()])
    y = np.array([r["v"] for r in df.orderBy("Date").collect()])
    want, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert x @ np.array(beta) == pytest.approx(x @ want, abs=1e-5)


def test_seasonal_forecast_extends_the_cycle(spark):
    df, value = cyclic(spark)
    got = rows(G.seasonal_forecast(df, DAILY, ["v"], days=30, yearly=1, weekly=3).select("Date", "value"), "Date")
    assert len(got) == 30
    assert max(abs(v - value(800 + i)) for i, (_, v) in enumerate(got)) < 0.1


def test_short_series_are_not_fitted(spark):
    df, _ = cyclic(spark, days=40)
    assert G.seasonal_forecast(df, DAILY, ["v"], days=5).count() == 0
    assert G.seasonal_residuals(df, DAILY, ["v"]).count() == 0


def test_direct_and_recursive_forecasts(spark):
    df, value = cyclic(spark, days=500)
    other, _ = cyclic(spark, days=500, city="B")
    both = df.union(other).cache()
    direct = G.forecast_direct(both, DAILY, "v", G.fit_direct(both, DAILY, "v", horizons=(1, 3, 7), trees=10), days=7)
    recursive = G.forecast_recursive(both, DAILY, "v", G.fit_one_step(both, DAILY, "v", trees=10), days=7, every=3)
    for out in (direct, recursive):
        got = rows(out, "City", "Date")
        assert len(got) == 14 and got[0][1] == dt.date(2018, 1, 1) + dt.timedelta(days=500)
        assert max(abs(v - value(500 + i % 7)) for i, (_, _, v) in enumerate(got)) < 4


def test_recursive_inputs_equal_training_inputs(spark):
    """The array form of the inputs agrees with the window form at the last row."""

    class Echo:
        def transform(self, df):
            self.seen = df
            return df.withColumn("prediction", F.lit(0.0))

    df, _ = cyclic(spark, days=120)
    window = G.origin_features(df, DAILY, "v").orderBy(F.desc("Date")).first()
    echo = Echo()
    G.forecast_recursive(df, DAILY, "v", echo, days=1)
    first = echo.seen.first()
    for c in G.BY_DAY.inputs(direct=False)[:-2]:
        assert first[c] == pytest.approx(window[c]), c


def test_a_gap_costs_a_row_and_not_the_place(spark):
    rng, data = random.Random(5), []
    for p in ("A", "B"):
        for i in range(160):
            gap = p == "B" and i in (80, 150)
            data.append((p, dt.date(2020, 1, 1) + dt.timedelta(days=i), None if gap else 10 * math.sin(i / 9) + rng.random()))
    df = spark.createDataFrame(data, "City string, Date date, v double")
    one = G.fit_one_step(df, DAILY, "v", trees=2)
    out = G.forecast_recursive(df, DAILY, "v", one, days=3)
    assert rows(out.groupBy("City").count(), "City") == [("A", 3), ("B", 3)]
    many = G.fit_direct(df, DAILY, "v", horizons=(1, 3), trees=2)
    assert rows(G.forecast_direct(df, DAILY, "v", many, days=3).groupBy("City").count(), "City") == [("A", 3), ("B", 3)]


def test_hourly_forecasts(spark):
    data = [(p, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 10 + 5 * math.sin(2 * math.pi * i / 24)) for p in ("A", "B") for i in range(800)]
    df = spark.createDataFrame(data, "City string, Timestamp timestamp_ntz, v double")
    ahead = G.seasonal_forecast_hourly(df, HOURLY, ["v"], hours=48)
    got = rows(ahead.filter("City = 'A'"), "Timestamp")
    assert len(got) == 48 and all(abs(r[3] - (10 + 5 * math.sin(2 * math.pi * (800 + i) / 24))) < 1e-3 for i, r in enumerate(got))
    model = G.fit_one_step(df, HOURLY, "v", trees=3, cadence=G.BY_HOUR)
    steps = rows(G.forecast_recursive(df, HOURLY, "v", model, days=3, cadence=G.BY_HOUR).filter("City = 'B'"), "Timestamp")
    assert [r[1] for r in steps] == [dt.datetime(2024, 1, 1) + dt.timedelta(hours=800 + i) for i in range(3)]
    assert all(abs(r[2] - (10 + 5 * math.sin(2 * math.pi * (800 + i) / 24))) < 2.5 for i, r in enumerate(steps))
