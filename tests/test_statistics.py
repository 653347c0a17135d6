"""Ordered statistics, evaluation and tests against brute force."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskgrid.operators import blend as M
from riskgrid.operators import evaluate as E
from riskgrid.operators import order as O
from riskgrid.operators import stats as S


def brute_areas(y, p):
    order = sorted(set(p), reverse=True)
    pos, neg = sum(y), len(y) - sum(y)
    ap, last = 0.0, 0.0
    for s in order:
        tp = sum(1 for a, b in zip(y, p) if b >= s and a)
        fp = sum(1 for a, b in zip(y, p) if b >= s and not a)
        ap += (tp / pos - last) * tp / (tp + fp)
        last = tp / pos
    wins = sum((a > b) + 0.5 * (a == b) for a, ya in zip(p, y) if ya for b, yb in zip(p, y) if not yb)
    return ap, wins / (pos * neg)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    data = []
    for model in ("a", "b"):
        for _ in range(400):
            y = int(rng.random() < 0.3)
            p = rng.choice([0.15, 0.35, 0.6, round(min(max(rng.gauss(0.3 + 0.3 * y, 0.2), 0), 1), 2)])
            data.append((model, y, float(p)))
    return spark.createDataFrame(data, "model string, y int, p double").cache(), data


def test_areas_match_brute_force(scored):
    df, data = scored
    for model, ap, auc in rows(E.areas(df, ["model"]), "model"):
        pairs = [(y, p) for m, y, p in data if m == model]
        want = brute_areas([y for y, _ in pairs], [p for _, p in pairs])
        assert (ap, auc) == (pytest.approx(want[0]), pytest.approx(want[1]))


def test_areas_do_not_depend_on_row_order(scored):
    df, _ = scored
    shuffled, plain = (rows(E.areas(x, ["model"]), "model") for x in (df.orderBy(F.rand(1)), df))
    for a, b in zip(shuffled, plain):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])


def test_all_negative_group_has_zero_area(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.4)], "y int, p double").withColumn("m", F.lit("x"))
    assert rows(E.areas(df, ["m"]), "m") == [("x", 0.0, 0.0)]


def test_sweep_counts_and_monotone_recall(scored):
    df, data = scored
    got = rows(E.sweep(df, ["model"]).select("model", "threshold", "tp", "fp", "fn", "tn", "recall"), "model", "threshold")
    assert len(got) == 2 * 180
    for model, t, tp, fp, fn, tn, _ in got[::17]:
        mine = [(y, p) for m, y, p in data if m == model]
        assert tp == sum(1 for y, p in mine if y and p >= t) and fp == sum(1 for y, p in mine if not y and p >= t)
        assert fn == sum(1 for y, p in mine if y and p < t) and tn == sum(1 for y, p in mine if not y and p < t)
    recalls = [r[-1] for r in got if r[0] == "a"]
    assert all(x >= y for x, y in zip(recalls, recalls[1:]))


def test_threshold_cascade_levels(spark):
    sweep = lambda data: spark.createDataFrame(
        [("m", t, r, p, 2 * p * r / (p + r), 0.0, 1, 1, 1, 1) for t, r, p in data],
        "model string, threshold double, recall double, precision double, f1 double, f2 double, tp int, fp int, fn int, tn int",
    )
    pick = lambda data: E.pick_threshold(sweep(data), ["model"]).select("threshold", "level").first()
    assert tuple(pick([(0.1, 0.9, 0.31), (0.2, 0.8, 0.35), (0.3, 0.2, 0.9)])) == (0.1, 1)
    assert tuple(pick([(0.1, 0.9, 0.21), (0.2, 0.6, 0.35)])) == (0.1, 2)
    assert tuple(pick([(0.1, 0.9, 0.1), (0.2, 0.6, 0.25)])) == (0.2, 3)
    assert tuple(pick([(0.1, 0.9, 0.1), (0.2, 0.3, 0.15)])) == (0.2, 4)
    assert tuple(pick([(0.3, 0.8, 0.4), (0.2, 0.8, 0.4)])) == (0.2, 1)


def test_quantiles_of_a_skewed_group(spark):
    """One group and one narrow value range hold most rows; slots are forced to split."""
    rng = random.Random(9)
    values = [("hot", 1.0 + rng.random() * 1e-6) for _ in range(3000)] + [("hot", 1e6)] + [("cold", float(i)) for i in range(7)]
    df = spark.createDataFrame(values, "g string, v double")
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = O.running_by_value(counts, ["g"], "v", ["n"], fanout=8, rows_per_slot=50)
    ordered = sorted(v for g, v in values if g == "hot")
    first = {v: i for i, v in reversed(list(enumerate(ordered)))}
    for g, v, _, before, total in placed.select("g", "v", "n", "before_n", "total_n").collect():
        if g == "hot":
            assert (before, total) == (first[v], 3001)
    got = {r["g"]: r for r in O.exact_quantiles(df, ["g"], ["v"], (0.05, 0.5, 0.95)).collect()}
    for g in ("hot", "cold"):
        want = np.quantile([v for k, v in values if k == g], [0.05, 0.5, 0.95])
        assert [got[g][f"q{i}"] for i in range(3)] == pytest.approx(list(want))


def test_profile_bias_correction(spark):
    df = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 2.5, 9.0, 30.0)], "City string, v double")
    row = S.entity_profile(df, ["City"], ["v"]).first()
    assert (row["skew"], row["kurtosis"]) == (pytest.approx(1.902849, abs=1e-6), pytest.approx(3.593688, abs=1e-6))
    assert O.exact_quantiles(df, ["City"], ["v"], (0.95,)).first()["q0"] == pytest.approx(25.8)


def t_tail(t, df, steps=200_000):
    """Two-sided p by quadrature of the density."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    x = np.linspace(0, abs(t), steps)
    return 1 - 2 * np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2), x)


@pytest.mark.parametrize("t,df", [(0.0, 5.0), (0.3, 3.7), (1.96, 40.0), (2.5, 9.3), (-4.0, 120.5), (0.01, 1.0)])
def test_student_p_against_quadrature(spark, t, df):
    assert spark.createDataFrame([(t, df)], "t double, df double").select(S.student_p("t", "df")).first()[0] == pytest.approx(t_tail(t, df), abs=1e-7)


def test_student_p_of_odd_rows_and_log_gamma(spark):
    odd = [(None, 3.0), (1.0, None), (float("nan"), 3.0), (1.0, 0.0), (1.0, float("inf"))]
    assert [r[0] for r in spark.createDataFrame(odd, "t double, df double").select(S.student_p("t", "df")).collect()] == [None] * 5
    assert spark.createDataFrame([(1e200, 4.0)], "t double, df double").select(S.student_p("t", "df")).first()[0] == pytest.approx(0, abs=1e-12)
    z = [0.01, 0.5, 1.0, 2.5, 60.25, 4000.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", S.log_gamma(F.col("z")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.z), rel=1e-12, abs=1e-12) for r in got)


def test_welch_skips_thin_groups(spark):
    data = [("A", float(i), int(i < 6)) for i in range(30)] + [("B", float(i), int(i < 4)) for i in range(30)]
    df = spark.createDataFrame(data, "City string, v double, y int")
    out = S.welch_tests(df, ["City"], ["v"], "y").collect()
    assert [r["City"] for r in out] == ["A"] and out[0]["Significant"]
    assert out[0]["Diff"] == pytest.approx(2.5 - 17.5)


def test_pruning_keeps_the_better_column(spark):
    rng = random.Random(1)
    data = []
    for _ in range(300):
        a, y = rng.gauss(0, 1), rng.random() < 0.4
        data.append((a + 2 * y, a + 2 * y + rng.gauss(0, 0.05), rng.gauss(0, 1), int(y)))
    df = spark.createDataFrame(data, "a double, b double, c double, y int")
    related = {r["variable"]: abs(r["r"]) for r in S.target_correlation(df, ["a", "b"], "y").collect()}
    assert S.prune_correlated(df, ["a", "b", "c"], "y") == [min(related, key=related.get)]


def test_mix_weight_prefers_the_better_forecast(spark):
    df = spark.createDataFrame([("x", float(i), float(i), float(i) + 5) for i in range(10)], "City string, actual double, a double, b double")
    row = M.best_mix(df, ["City"], 20).first()
    assert (row["weight"], row["mae_mix"], row["mae_b"]) == (1.0, 0.0, 5.0)
    tie = spark.createDataFrame([("x", 1.0, 2.0, 2.0)], "City string, actual double, a double, b double")
    assert M.best_mix(tie, ["City"], 10).first()["weight"] == 0.0


def test_role_weights_and_blend(spark):
    report = spark.createDataFrame([("r", 0.9, 0.2, 0.5), ("p", 0.4, 0.6, 0.5), ("b", 0.6, 0.4, 0.5)], "model string, recall double, precision double, pr_auc double")
    weights = {r["model"]: (r["role"], r["weight"]) for r in M.role_weights(report).collect()}
    assert [weights[m][0] for m in "rpb"] == ["recall", "precision", "balanced"]
    assert [weights[m][1] for m in "rpb"] == pytest.approx([2 / 4.5, 1 / 4.5, 1.5 / 4.5])
    scores = spark.createDataFrame([(1, "r", 0.6), (1, "p", 0.0), (1, "b", 0.0), (2, "r", 0.9), (2, "p", 0.9), (2, "b", 0.9)], "id int, model string, p double")
    got = dict(rows(M.role_blend(scores, M.role_weights(report), ["id"]), "id"))
    assert got[1] == pytest.approx(0.6 * 2 / 4.5) and got[2] == pytest.approx(0.99)


def test_regression_report(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0), ("x", 0.0, 1.0), ("x", 3.0, 3.0), ("x", float("nan"), 1.0), ("x", None, 1.0)], "m string, actual double, predicted double")
    r = E.regression_report(df, ["m"]).first()
    assert (r["n"], r["MAE"], r["RMSE"]) == (3, pytest.approx(2 / 3), pytest.approx(math.sqrt(2 / 3)))
    assert r["MAPE"] == pytest.approx(50.0)


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    got = rows(S.histogram(df, "v", 50).select("bin", "n"), "bin")
    assert len(got) == 50 and sum(n for _, n in got) == 101 and got[-1][1] == 3


def test_global_quantiles_are_exact(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.expovariate(0.01), None if i % 9 == 0 else float(i % 13)) for i in range(2500)], "a double, b double")
    wanted = [("a", 0.95, "hot"), ("b", 0.1, "dry"), ("a", 0.01, "low")]
    plain = df.agg(*[F.percentile(c, F.lit(p)) for c, p, _ in wanted]).first()
    assert tuple(S.fit_global_quantiles(df, wanted).first()) == pytest.approx(tuple(plain))


def test_correlation_with_a_constant_column_or_target(spark):
    # the rest of a few partial sums is not exactly the constant, so several tasks take part
    data = [(0.1, float(i % 7), None if i % 3 else float(i % 5), None, i % 2, 1) for i in range(1000)]
    df = spark.createDataFrame(data, "flat double, x double, y double, empty double, target int, always int").repartition(7)
    columns = ["flat", "x", "y", "empty"]
    got = {r[0]: r[1] for r in S.target_correlation(df, columns, "target").collect()}
    assert math.isnan(got["flat"]) and got["empty"] is None
    for k, c in ((1, "x"), (2, "y")):
        both = np.array([(r[k], r[4]) for r in data if r[k] is not None])
        assert got[c] == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-12)
    got = {r[0]: r[1] for r in S.target_correlation(df, columns, "always").collect()}
    assert all(math.isnan(got[c]) for c in ("flat", "x", "y")) and got["empty"] is None


def test_pruning_with_a_constant_column_or_target(spark):
    data = [(float(i % 11), float(i % 11) * 2 + i % 2 * 0.1, 980.0, float(i % 13), i % 2, 1) for i in range(500)]
    df = spark.createDataFrame(data, "a double, b double, flat double, c double, target int, always int").repartition(5)
    columns = ["a", "b", "flat", "c"]
    assert S.prune_correlated(df, columns, "target", limit=0.8) == ["a"]
    assert S.prune_correlated(df, columns, "always", limit=0.8) == ["b"]
    # as in SQL, where NaN is above every number: all go that meet the constant column, which nothing outranks
    assert S.prune_correlated(df, columns, "target", limit=0.8, constant=math.nan) == ["a", "b", "c"]
    assert S.prune_correlated(df, columns, "always", limit=0.8, constant=math.nan) == ["b", "flat"]
