"""Extremely randomised trees and balanced bootstraps against plain counting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.plans import trees as T


def sample(spark, n=600, rare=0.1, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(3)
    y = (x[:, 0] + x[:, 1] > np.quantile(x[:, 0] + x[:, 1], 1 - rare)).astype(int)
    rows = [(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int").repartition(5)


def X():
    return F.array("a", "b", "c", "d")


def leaf_counts(tree, x, y, weight):
    at = T._descend(x, tree.arrays())
    return {k: (int(weight[(at == k) & (y == 0)].sum()), int(weight[(at == k) & (y == 1)].sum())) for k in set(at)}


def test_random_forest_of_random_thresholds(spark):
    x, y, df = sample(spark)
    how = T.Growth(trees=12, depth=6, subset=2, least=3)
    forest = T.grow(df, X(), 4, "y", ["id"], how, (1.0, 9.0))
    again = T.grow(df.repartition(3), X(), 4, "y", ["id"], how, (1.0, 9.0))
    assert [(t.feature, t.threshold, t.counts) for t in forest.trees] == [(t.feature, t.threshold, t.counts) for t in again.trees]
    roots = {(t.feature[0], t.threshold[0]) for t in forest.trees}
    assert len(roots) > 9  # thresholds are drawn, not searched
    ends = np.stack([x.min(0), x.max(0)], 1)
    for k, tree in enumerate(forest.trees):
        features, thresholds = T.candidates(k, np.array([1]), ends[None], np.array([0]), 2, how.seed)
        assert (tree.feature[0], tree.threshold[0]) in set(zip(features[0].tolist(), thresholds[0].tolist()))
        got = leaf_counts(tree, x, y, np.ones(len(y), int))
        assert all(tree.counts[k] == n for k, n in got.items()) and sum(map(sum, got.values())) == len(y)
        assert all(sum(n) >= 3 for n in got.values())
        assert max(tree.number) < 2**7
        # the better of the two candidates is taken
        gains = []
        for f, cut in zip(features[0], thresholds[0]):
            parts = [np.array([(y[m] == 0).sum(), 9 * (y[m] == 1).sum()]) for m in (x[:, f] <= cut, x[:, f] > cut)]
            imp = lambda n: n.sum() - (n * n).sum() / max(n.sum(), 1e-9)
            gains.append(imp(sum(parts)) - sum(map(imp, parts)))
        assert (tree.feature[0], tree.threshold[0]) == (features[0][np.argmax(gains)], thresholds[0][np.argmax(gains)])
    p = np.array([r.p for r in df.select("id", forest.probability(X()).alias("p")).orderBy("id").collect()])
    want = np.mean([forest.shares(t)[T._descend(x, t.arrays())] for t in forest.trees], axis=0)
    assert p == pytest.approx(want) and p[y == 1].mean() > p[y == 0].mean() + 0.3
    assert forest.importances()[:2].sum() > 0.7


def test_balanced_bootstrap(spark):
    x, y, df = sample(spark, 4000, 0.05)
    how = T.Growth(trees=40, depth=5, subset=2, random=False, balanced=True)
    data = df.select("id", F.xxhash64("id").alias("key")).orderBy("id").collect()
    key = np.array([r.key for r in data]).view(np.uint64) & np.uint64(T.WORD)
    means = ((y == 1).sum() / (y == 0).sum(), 1.0)
    used = np.stack([T._weights(t, y, key, how, means) for t in range(40)])
    zero, one = used[:, y == 0].sum(1), used[:, y == 1].sum(1)
    assert abs(zero.mean() / one.mean() - 1) < 0.1 and (abs(zero / one - 1) < 0.45).all()
    assert used[:, y == 0].max(0).min() >= 1  # every row of the larger class is in some tree
    forest = T.grow(df, X(), 4, "y", ["id"], how)
    for t, tree in enumerate(forest.trees):
        got = leaf_counts(tree, x, y, used[t])
        assert all(tree.counts[k] == n for k, n in got.items() if sum(n))
    p = np.array([r.p for r in df.select("id", forest.probability(X()).alias("p")).orderBy("id").collect()])
    assert p[y == 1].min() > np.quantile(p[y == 0], 0.9)


def test_one_class_and_no_rows(spark):
    _, _, df = sample(spark, 20)
    for rows in (df.where("y = 0"), df.where("false")):
        forest = T.grow(rows, X(), 4, "y", ["id"], T.Growth(trees=3))
        assert [t.feature for t in forest.trees] == [[-1]] * 3


def test_poisson_numbers():
    u = T.draw(3, np.arange(200_000), 5)
    for mean in (0.05, 1.0, 4.0):
        k = T.poisson(u, mean)
        assert k.mean() == pytest.approx(mean, rel=0.03) and k.var() == pytest.approx(mean, rel=0.05)
