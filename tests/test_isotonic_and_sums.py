"""Isotonic fits, radix quantiles, tiled correlations, product seasons and folds against plain computation."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.operators import gram, isotonic
from riskgrid.operators.order import DIGIT, double_of, exact_quantiles, ordered_bits
from riskgrid.plans import forecast as G
from riskgrid.plans.learn import stratified_folds
from riskgrid.spec import DAILY


# ------------------------------------------------------------------- isotonic


def rising(points):
    """Least squares under order: the largest of the smallest means of all stretches around a point."""
    xs = sorted({x for x, _ in points})
    total = [sum(y for x, y in points if x == v) for v in xs]
    weight = [sum(x == v for x, _ in points) for v in xs]
    mean = lambda a, b: Fraction(sum(total[a : b + 1]), sum(weight[a : b + 1]))
    n = len(xs)
    return {xs[i]: max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)}


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_isotonic_steps(spark, block):
    rng = random.Random(block)
    points = {
        "noise": [(rng.randrange(40) / 64, rng.randrange(2)) for _ in range(120)],
        "falling": [(k / 64, 1 - k // 20) for k in range(40)],
        "rising": [(k / 64, k // 20) for k in range(40)],
        "one": [(0.5, 1)],
        "late zero": [(k / 64, k) for k in range(20)] + [(0.9, 0)] * 50,
    }
    rows = [(m, x, y) for m, p in points.items() for x, y in p] + [("noise", None, 1), ("noise", float("nan"), 1), ("noise", 0.1, None)]
    df = spark.createDataFrame(rows, "m string, x double, y int")
    got = isotonic.isotonic_steps(df, ["m"], "x", "y", block=block).collect()
    for m, p in points.items():
        want = rising(p)
        steps = sorted((r.low, r.high, r.value, r.total, r.weight) for r in got if r.m == m)
        assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(steps, steps[1:]))
        assert sum(s[4] for s in steps) == len(p) and sum(s[3] for s in steps) == sum(y for _, y in p)
        for x, v in want.items():
            assert [s[2] for s in steps if s[0] <= x <= s[1]] == [float(v)]


def test_values_between_steps(spark):
    steps = spark.createDataFrame([("a", 0.2, 0.4, 0.1), ("a", 0.6, 0.7, 0.5), ("b", 0.5, 0.5, 1.0)], "m string, low double, high double, value double")
    xs = [None, 0.0, 0.2, 0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.9, 1.0]
    rows = [(m, x) for m in "abc" for x in xs]
    got = {(r.m, r.x): r.v for r in isotonic.apply_steps(spark.createDataFrame(rows, "m string, x double"), steps, ["m"], "x", "v", slots=16).collect()}
    assert len(got) == len(rows)
    for x in xs[1:]:
        assert got["a", x] == pytest.approx(np.interp(x, [0.2, 0.4, 0.6, 0.7], [0.1, 0.1, 0.5, 0.5])) and got["b", x] == 1.0 and got["c", x] is None
    assert got["a", None] is None


# ------------------------------------------------------------------ quantiles


def test_bits_keep_order_and_value(spark):
    values = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1023, 1.0, -1.0, 1.0000000000000002, 0.1, 1e300, -1e300, 1.7976931348623157e308, math.inf, -math.inf, 3.0, 2.0, 2.0**52 + 1, 8.0, 7.999999999999999, 1e-310]
    rng = random.Random(3)
    values += [math.ldexp(rng.random(), rng.randrange(-1070, 1020)) * rng.choice([1, -1]) for _ in range(2000)] + [2.0**k for k in range(-1074, 1024, 7)]
    df = spark.createDataFrame([(v,) for v in [*values, math.nan]], "v double").select("v", ordered_bits(F.col("v")).alias("k")).select("*", double_of(F.col("k")).alias("back"))
    rows = df.collect()
    assert all(r.back == r.v or (math.isnan(r.v) and math.isnan(r.back)) for r in rows)
    ordered = sorted((r for r in rows if not math.isnan(r.v)), key=lambda r: r.v)
    assert all((a.v < b.v) == (a.k < b.k) for a, b in zip(ordered, ordered[1:]))
    assert max(r.k for r in rows) == next(r.k for r in rows if math.isnan(r.v))


def test_quantiles_of_heavy_tails(spark):
    rng = np.random.default_rng(5)
    tail = np.concatenate([1 + rng.random(3000) * 1e-9, 1e6 + rng.random(1000), [1e12] * 50, -(10 ** rng.uniform(-300, 300, 700))])
    same = np.full(500, 7.0)
    rows = [("tail", float(v)) for v in tail] + [("same", float(v)) for v in same] + [("none", None), ("one", 3.5)]
    probabilities = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], ["v"], probabilities).collect()}
    assert set(got) == {"tail", "same", "one"}
    for name, values in (("tail", tail), ("same", same), ("one", np.array([3.5]))):
        assert [got[name][f"q{i}"] for i in range(7)] == pytest.approx(np.quantile(values, probabilities).tolist(), rel=1e-15)
    # nothing that is ordered in one task has more rows than the digits of a level
    assert DIGIT == 16


# --------------------------------------------------------------- correlations


@pytest.mark.parametrize("tile", [2, 3, 64])
def test_correlations_with_gaps(spark, tile):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5)) * [1, 10, 1e-3, 1e4, 1] + [0, 1e6, 0, 5, 3]
    x[:, 4] = 3.0
    x[:, 1] += 4 * x[:, 0]
    cells = [[None if rng.random() < 0.2 else float(v) for v in row] for row in x]
    cells[0][0], cells[1][1] = math.nan, math.inf
    names = list("abcde")
    df = spark.createDataFrame([tuple(c) for c in cells], ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r.a, r.b): r.r for r in gram.correlations(df, names, tile=tile).collect()}
    assert len(got) == 10
    for i in range(5):
        for j in range(i + 1, 5):
            pairs = np.array([(c[i], c[j]) for c in cells if c[i] is not None and c[j] is not None and math.isfinite(c[i]) and math.isfinite(c[j])])
            want = None if 4 in (i, j) else np.corrcoef(pairs.T)[0, 1]
            assert got[names[i], names[j]] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_correlations_without_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert gram.correlations(df, ["a", "b"]).count() == 0


# -------------------------------------------------------------------- seasons


def test_season_that_multiplies_the_trend(spark):
    rng = np.random.default_rng(7)
    days = np.arange(900)
    t = (days + 8766) / 3652.5
    season = 1 + 0.6 * np.sin(2 * np.pi * (days + 8766) / 365.25) + 0.2 * np.cos(2 * np.pi * (days + 8766) / 7)
    start = np.datetime64("2024-01-01")
    rows = []
    for city, noise in (("exact", 0.0), ("noisy", 1.0)):
        value = (2 + 3 * t) * season + noise * rng.normal(size=900)
        rows += [(city, str(start + int(d)), float(v)) for d, v in zip(days, value)]
    df = spark.createDataFrame(rows, "City string, d string, Rain_mm_sum double").select("City", F.to_date("d").alias("Date"), "Rain_mm_sum")
    out = {}
    for r in G.seasonal_residuals(df, DAILY, ["Rain_mm_sum"]).orderBy("City", "Date").collect():
        out.setdefault(r.City, []).append((r.prophet_Rain_mm_sum_pred, r.prophet_Rain_mm_sum_resid))
    assert max(abs(e) for _, e in out["exact"]) < 1e-4
    # brute force: the same turns over the rows themselves
    y = np.array([v for c, _, v in rows if c == "noisy"])
    day = days + 8766.0
    z = np.stack([np.ones(900), *[f(2 * np.pi * k * day / p) for p, n in ((365.25, 3), (7.0, 2)) for k in range(1, n + 1) for f in (np.sin, np.cos)]], 1)
    shape, line = np.eye(z.shape[1])[0], np.stack([np.ones(900), t], 1)
    for _ in range(300):
        trend = np.linalg.lstsq(line * (z @ shape)[:, None], y, rcond=None)[0]
        found = np.linalg.lstsq(z * (line @ trend)[:, None], y, rcond=None)[0]
        trend, shape = trend * found[0], found / found[0]
    assert [p for p, _ in out["noisy"]] == pytest.approx(((line @ trend) * (z @ shape)).tolist(), abs=1e-3)


# ---------------------------------------------------------------------- folds


def test_folds_of_a_rare_class(spark):
    rows = [(k, int(k % 97 == 0), "same") for k in range(1000)] + [(None, 1, "x")] * 4
    df = spark.createDataFrame(rows, "id long, y int, c string")
    got = stratified_folds(df, ["id"], 5)
    assert got.columns == ["id", "y", "c", "fold"] and got.count() == len(rows)
    counts = Counter((r.y, r.fold) for r in got.collect())
    for y in (0, 1):
        sizes = [counts[y, k] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert {r.id: r.fold for r in got.collect() if r.id is not None} == {r.id: r.fold for r in stratified_folds(df.repartition(9), ["id"], 5).collect() if r.id is not None}
