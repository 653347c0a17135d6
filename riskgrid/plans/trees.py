"""Forests that Spark ML lacks: extremely randomised trees, and forests on a balanced bootstrap of each tree.

All trees grow together, one level per pass: tasks send the rows of their batches down the trees so far and count
classes on both sides of every open node's candidate splits; the counts are summed by one aggregate, which also picks each
node's best split. Only that choice reaches the driver, so its size is bounded by the number of open nodes, that is by the
parameters. Counts are whole numbers, so a recomputed task changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskgrid.operators.order import exact_quantiles
from riskgrid.session import cut_lineage

WORD = (1 << 32) - 1


def mix32(*parts: np.ndarray | int) -> np.ndarray:
    """A 32-bit hash of whole numbers: they are added up with odd factors, then the bits are spread twice."""
    h = np.uint64(0)
    for part, odd in zip(parts, (2654435761, 2246822519, 3266489917, 668265263, 374761393)):
        h = h + np.asarray(part).astype(np.uint64) * np.uint64(odd) & np.uint64(WORD)
    h = h & np.uint64(WORD)
    for shift, odd in ((15, 2246822519), (13, 3266489917)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd) & np.uint64(WORD)
    return h ^ (h >> np.uint64(16))


def draw(*parts: np.ndarray | int) -> np.ndarray:
    """A number of 0 to 1 (excluded) for whole numbers."""
    return mix32(*parts) / float(1 << 32)


def poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson numbers for draws ``u``, by the inverse of the distribution."""
    chance, total, steps = exp(-mean), 0.0, []
    for k in range(200):
        total += chance
        steps.append(total)
        chance *= mean / (k + 1)
        if 1 - total < 1e-12:
            break
    return np.searchsorted(np.array(steps), u, side="right")


@dataclass
class Tree:
    """Nodes in order of their making; ``number`` is 1 for the root, 2i and 2i + 1 for the children of i."""

    number: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)  # -1 for leaves and open nodes
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)  # right is the next one
    counts: list[tuple[int, int]] = field(default_factory=list)

    def add(self, number: int, counts: tuple[int, int]) -> int:
        for values, value in ((self.number, number), (self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.counts, counts)):
            values.append(value)
        return len(self.number) - 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.int32), np.array(self.threshold), np.array(self.left, np.int32)


def _descend(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The node each row ends in; values above a threshold go right."""
    feature, threshold, left = tree
    at = np.zeros(len(x), np.int32)
    moving = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(moving):
        here = at[moving]
        f = feature[here]
        at[moving] = left[here] + (x[moving, f] > threshold[here])
        moving = moving[feature[at[moving]] >= 0]
    return at


@dataclass(frozen=True)
class Growth:
    """How a forest grows.

    ``random`` splits: one threshold per node and feature, drawn by a hash between the ends of the node's range;
    otherwise the best of ``bins`` quantiles of the feature. ``balanced``: a row counts in a tree by a Poisson number, whose
    mean is 1 for the rarer class and makes the other as large; each row of the other counts in one tree at least.
    ``subset`` features are candidates at a node.
    """

    trees: int = 200
    depth: int = 12
    subset: int = 3
    least: int = 1
    random: bool = True
    balanced: bool = False
    bins: int = 32
    tries: int = 8
    seed: int = 42


@dataclass
class Forest:
    """A fitted forest: a row's probability is the mean over the trees of its leaf's share of positive weight."""

    trees: list[Tree]
    width: int
    class_weight: tuple[float, float]

    def shares(self, tree: Tree) -> np.ndarray:
        n = np.array(tree.counts, float) * self.class_weight
        return n[:, 1] / np.maximum(n.sum(1), 1e-12)

    def probability(self, features: str | Column) -> Column:
        """p of an array column of the features (not null, no not-a-numbers)."""
        grown = [(t.arrays(), self.shares(t)) for t in self.trees]

        def of(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=float)
            x = np.stack(batch.to_numpy())
            return pd.Series(sum(p[_descend(x, t)] for t, p in grown) / len(grown))

        return F.pandas_udf(of, "double")(features)

    def importances(self) -> np.ndarray:
        """Weighted fall of impurity by feature, as shares of all."""
        out = np.zeros(self.width)
        for tree in self.trees:
            n = np.array(tree.counts, float) * self.class_weight
            whole = n.sum(1)
            impurity = whole - (n * n).sum(1) / np.maximum(whole, 1e-12)
            for at, f in enumerate(tree.feature):
                if f >= 0:
                    out[f] += impurity[at] - impurity[tree.left[at]] - impurity[tree.left[at] + 1]
        return out / max(out.sum(), 1e-12)


def _weights(tree: int, y: np.ndarray, key: np.ndarray, how: Growth, means: tuple[float, float]) -> np.ndarray:
    """How often each row counts in a tree."""
    if not how.balanced:
        return np.ones(len(y), np.int64)
    u = draw(tree, key, how.seed)
    out = np.zeros(len(y), np.int64)
    for label in (0, 1):
        own = y == label
        if means[label] >= 1:
            out[own] = poisson(u[own], means[label])
        else:
            # a place in one tree for each row, the rest of the mean by chance
            home = (mix32(key[own], how.seed, 7) % np.uint64(how.trees)) == tree
            out[own] = poisson(u[own], max(means[label] - 1 / how.trees, 0.0)) + home
    return out


COUNTS = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("slot", pa.int32()), ("bin", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64())])


def _count(shared, how: Growth, means: tuple[float, float]):
    """Class counts by tree, open node, candidate and side (or bin) of each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]):
        trees, plans, edges = shared.value
        sums = [None] * len(trees)
        bins = 2 if how.random else how.bins
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, key = batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64) & np.uint64(WORD)
            if not how.random:
                binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], 1)
            for t, (tree, (place, features, thresholds)) in enumerate(zip(trees, plans)):
                if not len(features):
                    continue
                row = place[_descend(x, tree)]
                weight = _weights(t, y, key, how, means)
                used = np.flatnonzero((row >= 0) & (weight > 0))
                row, weight, label = row[used], weight[used], y[used]
                slots = features.shape[1]
                total = np.zeros(len(features) * slots * bins * 2) if sums[t] is None else sums[t]
                for k in range(slots):
                    f = features[row, k]
                    side = x[used, f] > thresholds[row, k] if how.random else binned[used, f]
                    total += np.bincount(((row * slots + k) * bins + side) * 2 + label, weight, len(total))
                sums[t] = total
        for t, total in enumerate(sums):
            if total is not None:
                pairs = total.reshape(-1, 2).astype(np.int64)
                at = np.flatnonzero(pairs.any(1))
                slots = plans[t][1].shape[1]
                yield pa.RecordBatch.from_pydict({"tree": np.full(len(at), t, np.int32), "node": at // (slots * bins), "slot": (at // bins % slots).astype(np.int32), "bin": (at % bins).astype(np.int32), "n0": pairs[at, 0], "n1": pairs[at, 1]}, schema=COUNTS)

    return run


def _best(counts: DataFrame, weight: tuple[float, float], least: int) -> DataFrame:
    """Of each open node its best split, and which candidates have all rows on one side."""
    both = ("n0", "n1")
    summed = counts.groupBy("tree", "node", "slot", "bin").agg(*[F.sum(c).alias(c) for c in both])
    candidate = Window.partitionBy("tree", "node", "slot")
    running = candidate.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = summed.select("tree", "node", "slot", "bin", *[F.sum(c).over(running).alias(f"l{c[1]}") for c in both], *[F.sum(c).over(candidate).alias(c) for c in both], F.count(F.lit(1)).over(candidate).alias("sides"))
    sides = sides.withColumns({f"r{c[1]}": F.col(c) - F.col(f"l{c[1]}") for c in both})

    def impurity(zero: str, one: str) -> Column:
        a, b = F.col(zero) * float(weight[0]), F.col(one) * float(weight[1])
        return F.when(a + b > 0, a + b - (a * a + b * b) / (a + b)).otherwise(0.0)

    gain = impurity("n0", "n1") - impurity("l0", "l1") - impurity("r0", "r1")
    fits = (F.col("l0") + F.col("l1") >= least) & (F.col("r0") + F.col("r1") >= least) & (F.col("gain") > 1e-9)
    split = F.struct("slot", "bin", "l0", "l1", "r0", "r1")
    order = F.struct("gain", (-F.col("slot")).alias("s"), (-F.col("bin")).alias("b"))
    return sides.withColumn("gain", gain).groupBy("tree", "node").agg(F.max_by(F.when(fits, split), F.when(fits, order)).alias("split"), F.collect_set(F.when(F.col("sides") == 1, F.struct("slot", "bin"))).alias("one_sided"))


def _ready(rows: DataFrame, features: Column, label: str, key: Sequence[str | Column]) -> DataFrame:
    return cut_lineage(rows.select(features.alias("x"), F.col(label).cast("int").alias("y"), F.xxhash64(*key).alias("key")))


def _ranges(data: DataFrame, width: int) -> tuple[int, int, np.ndarray]:
    """Rows of each class and both ends of each feature."""
    facts = data.agg(F.count(F.when(F.col("y") == 0, 1)), F.count(F.when(F.col("y") == 1, 1)), *[f(F.col("x")[i]) for i in range(width) for f in (F.min, F.max)]).first()
    return facts[0], facts[1], np.array([0.0 if v is None else v for v in facts[2:]], float).reshape(-1, 2)


def _counts(data: DataFrame, trees: list[Tree], plans: list, edges, how: Growth, means: tuple[float, float]) -> DataFrame:
    shared = data.sparkSession.sparkContext.broadcast(([t.arrays() for t in trees], [(p[0], p[2], p[3]) for p in plans], edges))
    return data.mapInArrow(_count(shared, how, means), "tree int, node long, slot int, bin int, n0 long, n1 long")


def grow(rows: DataFrame, features: Column, width: int, label: str, key: Sequence[str | Column], how: Growth, weight: tuple[float, float] = (1.0, 1.0)) -> Forest:
    """Fit a forest on ``features`` (an array column of ``width`` numbers, none missing) and a 0/1 ``label``.

    ``key`` tells rows apart for the bootstrap; ``weight`` is what a row of class 0 and 1 weighs in impurities and leaves.
    """
    data = _ready(rows, features, label, key)
    n0, n1, ends = _ranges(data, width)
    edges = None
    if not how.random and n0 + n1:
        names = [f"f{i}" for i in range(width)]
        cuts = exact_quantiles(data.select(*[F.col("x")[i].alias(c) for i, c in enumerate(names)]), [], names, [k / how.bins for k in range(1, how.bins)]).collect()
        found = {r["variable"]: [r[f"q{i}"] for i in range(how.bins - 1)] for r in cuts}
        edges = [np.unique(found[c]) for c in names]
    few = max(1, min(n0, n1))
    means = (few / max(n0, 1), few / max(n1, 1)) if how.balanced else (1.0, 1.0)
    trees = [Tree() for _ in range(how.trees)]
    open_: list[dict[int, tuple[np.ndarray, int, int]]] = []  # by tree: node -> its ranges, depth, tries
    for tree in trees:
        root = tree.add(1, (n0, n1))
        open_.append({root: (ends, 0, 0)} if n0 and n1 else {})
    subset = min(how.subset, width)
    while any(open_):
        plans = [_plan(t, trees[t], open_[t], how, width, subset) for t in range(how.trees)]
        open_ = [{} for _ in trees]
        # nodes without a row in their tree's bootstrap have no counts and stay leaves
        for r in _best(_counts(data, trees, plans, edges, how, means), weight, how.least).collect():
            t, k = r["tree"], r["node"]
            _, nodes, features_, thresholds, states = plans[t]
            _split(trees[t], open_[t], nodes[k], states[k], r, features_[k], thresholds[k], edges, how)
    return Forest(trees, width, weight)


def root_counts(rows: DataFrame, features: Column, width: int, label: str, key: Sequence[str | Column], how: Growth) -> DataFrame:
    """What the first pass counts: each tree's candidate splits of its root with the classes on both sides."""
    data = _ready(rows, features, label, key)
    n0, n1, ends = _ranges(data, width)
    trees = [Tree() for _ in range(how.trees)]
    for tree in trees:
        tree.add(1, (n0, n1))
    plans = [_plan(t, trees[t], {0: (ends, 0, 0)}, how, width, min(how.subset, width)) for t in range(how.trees)]
    drawn = [(t, k, int(p[2][0, k]), float(p[3][0, k])) for t, p in enumerate(plans) for k in range(p[2].shape[1])]
    drawn = rows.sparkSession.createDataFrame(drawn, "tree int, slot int, feature int, threshold double")
    side = lambda c, b: F.coalesce(F.sum(F.when(F.col("bin") == b, F.col(c))), F.lit(0))
    counts = _counts(data, trees, plans, None, how, (1.0, 1.0)).groupBy("tree", "slot").agg(side("n0", 0).alias("l0"), side("n1", 0).alias("l1"), side("n0", 1).alias("r0"), side("n1", 1).alias("r1"))
    return drawn.join(counts, ["tree", "slot"]).drop("slot")


def candidates(tree: int, numbers: np.ndarray, ranges: np.ndarray, tries: np.ndarray, subset: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and thresholds of nodes: the ``subset`` features of smallest hash, a drawn place in the node's range of each."""
    width = ranges.shape[1]
    node, f = numbers[:, None], np.arange(width)[None, :]
    order = np.argsort(mix32(tree, node, f, seed, 1 + 2 * tries[:, None]), axis=1, kind="stable")[:, :subset]
    u = draw(tree, node, order, seed, 2 + 2 * tries[:, None])
    at = np.arange(len(numbers))[:, None]
    low, high = ranges[at, order, 0], ranges[at, order, 1]
    return order, low + u * (high - low)


def _plan(t: int, tree: Tree, nodes: dict, how: Growth, width: int, subset: int):
    """Of one tree: number among the open nodes by node (else -1), open nodes, candidate features, thresholds, states."""
    place = np.full(len(tree.number), -1, np.int64)
    at = list(nodes)
    place[at] = np.arange(len(at))
    if not at:
        return place, at, np.zeros((0, subset), np.int64), np.zeros((0, subset)), []
    features, thresholds = candidates(t, np.array([tree.number[a] for a in at]), np.stack([nodes[a][0] for a in at]), np.array([nodes[a][2] for a in at]), subset, how.seed)
    return place, at, features, thresholds, [nodes[a] for a in at]


def _split(tree: Tree, nodes: dict, at: int, state: tuple[np.ndarray, int, int], found, features: np.ndarray, thresholds: np.ndarray, edges, how: Growth) -> None:
    """Split a node by what was found, or narrow its ranges by candidates that left all rows on one side.

    ``nodes`` takes what is to be looked at in the next pass.
    """
    ranges, depth, tries = state
    split = found["split"]
    if split is None:
        if how.random and tries + 1 < how.tries and found["one_sided"]:
            ranges = ranges.copy()
            for slot, right in found["one_sided"]:
                ranges[features[slot], 0 if right else 1] = thresholds[slot]
            nodes[at] = (ranges, depth, tries + 1)
        return
    f = int(features[split["slot"]])
    cut = float(thresholds[split["slot"]]) if how.random else float(edges[f][split["bin"]])
    tree.feature[at], tree.threshold[at] = f, cut
    tree.counts[at] = (split["l0"] + split["r0"], split["l1"] + split["r1"])
    for side, counts in enumerate(((split["l0"], split["l1"]), (split["r0"], split["r1"]))):
        child = tree.add(2 * tree.number[at] + side, counts)
        if not side:
            tree.left[at] = child
        if depth + 1 < how.depth and min(counts) > 0 and sum(counts) >= 2 * how.least:
            own = ranges.copy()
            own[f, 1 - side] = cut
            nodes[child] = (own, depth + 1, 0)
