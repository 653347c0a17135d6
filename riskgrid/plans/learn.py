"""Classifiers and regressors on Spark ML with temporal splits, calibration, stacking and search."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskgrid.functions.risk import selection_score_mix
from riskgrid.operators import evaluate as E
from riskgrid.operators.blend import calibration_kept, class_imbalance
from riskgrid.operators.isotonic import apply_steps, isotonic_steps
from riskgrid.operators.order import spread_ranks
from riskgrid.plans import trees as T
from riskgrid.session import cut_lineage, sized_side

SEED = 42


# ------------------------------------------------------------------- registries


def classifiers(features: int, label: str = "y", weight: str = "w", scale: float = 1.0) -> dict[str, Estimator]:
    """Name to estimator.  The boosting variants differ in parameters only; ``scale`` shrinks the tree counts."""
    trees = lambda n: max(int(n * scale), 3)
    common = {"featuresCol": "features", "labelCol": label}
    boosted = lambda n, depth, rate, share: GBTClassifier(
        **common, weightCol=weight, maxIter=trees(n), maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=SEED
    )
    forest = lambda n, depth, subset: RandomForestClassifier(
        **common, weightCol=weight, numTrees=trees(n), maxDepth=depth, featureSubsetStrategy=subset, seed=SEED
    )
    return {
        "logistic": LogisticRegression(**common, weightCol=weight, maxIter=100, regParam=0.01),
        "random_forest": forest(200, 10, "sqrt"),
        "hist_boosting": boosted(100, 5, 0.1, 1.0),
        "boosting_shallow": boosted(150, 4, 0.05, 0.8),
        "boosting_deep": boosted(80, 7, 0.05, 0.8),
        "boosting_slow": boosted(200, 5, 0.03, 0.9),
        "neural": MultilayerPerceptronClassifier(**common, layers=[features, 32, 16, 2], maxIter=trees(100), seed=SEED),
    }


def regressors(label: str = "y", scale: float = 1.0) -> dict[str, Estimator]:
    trees = lambda n: max(int(n * scale), 3)
    common = {"featuresCol": "features", "labelCol": label}
    return {
        "ridge": LinearRegression(**common, regParam=1.0, elasticNetParam=0.0),
        "elastic_net": LinearRegression(**common, regParam=0.1, elasticNetParam=0.5),
        "random_forest": RandomForestRegressor(**common, numTrees=trees(100), maxDepth=10, seed=SEED),
        "boosting": GBTRegressor(**common, maxIter=trees(100), maxDepth=5, stepSize=0.1, seed=SEED),
        "boosting_slow": GBTRegressor(**common, maxIter=trees(200), maxDepth=5, stepSize=0.05, subsamplingRate=0.8, seed=SEED),
    }


# --------------------------------------------------------------------- preparing


def preparation(features: Sequence[str], scale: bool = True, entity: str | None = None) -> list[Estimator]:
    """Median imputation, optional entity one-hot, assembly and standardisation."""
    filled = [f"{c}__f" for c in features]
    stages: list[Estimator] = [Imputer(strategy="median", inputCols=list(features), outputCols=filled)]
    inputs = list(filled)
    if entity:
        stages += [
            StringIndexer(inputCol=entity, outputCol="__i", handleInvalid="keep"),
            OneHotEncoder(inputCols=["__i"], outputCols=["__h"]),
        ]
        inputs.append("__h")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="__v" if scale else "features", handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="__v", outputCol="features", withMean=True))
    return stages


def prepared_split(features: DataFrame, columns: Sequence[str], label: str, split: Column) -> DataFrame:
    """Double-typed inputs, integer label ``y`` and split name; the frame every fit reads."""
    keep = [c for c in ("City", "Date", "Timestamp") if c in features.columns]
    return features.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("int").alias("y"), split.alias("split"))


def weighted(train: DataFrame, cap: float = 20.0) -> DataFrame:
    """Positive rows weigh neg/pos, at most ``cap``."""
    ratio = class_imbalance(train, "y", cap).select("pos_weight").scalar()
    return train.withColumn("w", F.when(F.col("y") == 1, ratio).otherwise(F.lit(1.0)))


@dataclass
class FittedForest:
    """A forest of ``plans.trees`` behind the fitted stages that prepare its inputs."""

    prepare: list
    forest: T.Forest

    @property
    def stages(self) -> list:
        return [*self.prepare, self.forest]


def grown_forests(features: int, scale: float = 1.0) -> dict[str, T.Growth]:
    """Forests that Spark ML doesn't have; ``scale`` shrinks the tree counts."""
    trees, subset = max(int(200 * scale), 3), max(1, int(features**0.5))
    return {
        "extra_trees": T.Growth(trees=trees, depth=12, subset=subset, random=True, seed=SEED),
        "balanced_forest": T.Growth(trees=trees, depth=10, subset=subset, random=False, balanced=True, seed=SEED),
    }


def fit_classifiers(train: DataFrame, columns: Sequence[str], names: Sequence[str], scale: float = 1.0) -> dict[str, PipelineModel | FittedForest]:
    """Fit the named models on one shared, prepared training frame.

    Extra trees weigh the classes like the other families; the balanced forest draws a balanced bootstrap for each tree.
    """
    prepare = Pipeline(stages=preparation(columns)).fit(train)
    ready = cut_lineage(prepare.transform(weighted(train)).select("features", "y", "w"))
    registry, grown = classifiers(len(columns), scale=scale), grown_forests(len(columns), scale)
    out = {}
    for name in names:
        if name in grown:
            inputs = vector_to_array("features")
            positive = 1.0 if grown[name].balanced else ready.agg(F.coalesce(F.max("w"), F.lit(1.0))).first()[0]
            out[name] = FittedForest(prepare.stages, T.grow(ready, inputs, len(columns), "y", [inputs], grown[name], (1.0, positive)))
        else:
            out[name] = PipelineModel(stages=[*prepare.stages, registry[name].fit(ready)])
    return out


def score(models: dict[str, PipelineModel | FittedForest], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long score table: kept columns, model, p.

    Models fitted on the same preparation are applied side by side to one
    prepared frame, so the data is read once per preparation, not per model.
    """
    shared: dict[tuple, list[str]] = {}
    for name, model in models.items():
        shared.setdefault(tuple(stage.uid for stage in model.stages[:-1]), []).append(name)
    parts = None
    for names in shared.values():
        wide = PipelineModel(stages=models[names[0]].stages[:-1]).transform(df).select(*keep, "features")
        columns = [vector_to_array(f"__p{i}")[1].alias(name) for i, name in enumerate(names) if not isinstance(models[name], FittedForest)]
        columns += [models[name].forest.probability(vector_to_array("features")).alias(name) for name in names if isinstance(models[name], FittedForest)]
        for i, name in enumerate(names):
            if isinstance(models[name], FittedForest):
                continue
            last = models[name].stages[-1].copy()
            last.setProbabilityCol(f"__p{i}").setRawPredictionCol(f"__r{i}").setPredictionCol(f"__y{i}")
            wide = last.transform(wide)
        one = wide.select(*keep, *columns).unpivot(list(keep), names, "model", "p")
        parts = one if parts is None else parts.unionByName(one)
    return parts


# ------------------------------------------------------------------- calibration


def calibrators(validation: DataFrame) -> DataFrame:
    """Isotonic fit of outcome on score, all models at once: the steps of each, see ``operators.isotonic``."""
    return cut_lineage(isotonic_steps(validation, ["model"], "p", "y"))


def calibrate(scores: DataFrame, fitted: DataFrame) -> DataFrame:
    """Replace p by its calibrated value; a model without a fit keeps its scores."""
    done = apply_steps(scores, fitted, ["model"], "p", "__c")
    return done.withColumn("p", F.coalesce("__c", "p")).select(*scores.columns)


def keep_calibration(raw: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Per model, whether the calibrated composite holds 95 % of the uncalibrated one (validation reports)."""
    comp = selection_score_mix(F.col("pr_auc"), F.col("f1"), F.col("recall"), F.col("precision"))
    a = raw.select("model", comp.alias("raw"))
    b = calibrated.select("model", comp.alias("cal"))
    return a.join(b, "model").select("model", "raw", "cal", calibration_kept(F.col("raw"), F.col("cal")).alias("kept"))


# --------------------------------------------------------------------- evaluation


def three_way_report(scores: DataFrame, select_on: str = "val") -> DataFrame:
    """Threshold per model from one split by the four-part selection score, then the full report on every split."""
    chosen = E.pipeline_threshold(scores.filter(F.col("split") == select_on), ["model"])
    joined = scores.join(sized_side(chosen.select("model", "threshold")), "model")
    return E.model_report(joined, ["model", "split", "threshold"], F.col("p") >= F.col("threshold"))


# ----------------------------------------------------------------------- stacking


def stratified_folds(rows: DataFrame, key: Sequence[str], folds: int, label: str = "y") -> DataFrame:
    """Add ``fold``: the classes' rows are numbered in hash order and dealt in turn, so a class's folds differ by one row at most."""
    ranked = spread_ranks(cut_lineage(rows), [label], key, "__rank")
    return ranked.withColumn("fold", F.pmod("__rank", F.lit(folds)).cast("int")).drop("__rank")


def stack(train: DataFrame, columns: Sequence[str], names: Sequence[str], key: Sequence[str], folds: int = 5, scale: float = 1.0):
    """Out-of-fold probabilities and the logistic meta model on them; returns (fold models, meta model)."""
    dealt = cut_lineage(stratified_folds(train, key, folds))
    oof, fold_models = None, []
    for k in range(folds):
        models = fit_classifiers(dealt.filter(F.col("fold") != k), columns, names, scale)
        fold_models.append(models)
        part = score(models, dealt.filter(F.col("fold") == k), [*key, "y"])
        oof = part if oof is None else oof.unionByName(part)
    wide = oof.groupBy(*key, "y").pivot("model", sorted(names)).agg(F.first("p"))
    meta = Pipeline(stages=[VectorAssembler(inputCols=sorted(names), outputCol="features"), LogisticRegression(labelCol="y", maxIter=100)]).fit(wide)
    return fold_models, meta


def stacked_scores(df: DataFrame, fold_models, meta, key: Sequence[str], meta_share: float = 0.6) -> DataFrame:
    """0.6 of the meta probability plus 0.4 of the mean base probability."""
    names = sorted(fold_models[0])
    parts = None
    for models in fold_models:
        one = score(models, df, key)
        parts = one if parts is None else parts.unionByName(one)
    base = parts.groupBy(*key).pivot("model", names).agg(F.avg("p"))
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    out = meta.transform(base)
    return out.select(*key, (vector_to_array("probability")[1] * meta_share + mean * (1 - meta_share)).alias("p"))


# ------------------------------------------------------------------------- search


def random_trials(space: dict[str, Sequence], n: int, seed: int = SEED) -> list[dict]:
    """Seeded random parameter sets."""
    rng = random.Random(seed)
    return [{k: rng.choice(list(v)) for k, v in space.items()} for _ in range(n)]


def search(train: DataFrame, validation: DataFrame, columns: Sequence[str], trials: Sequence[dict], base: Estimator | None = None) -> DataFrame:
    """Each parameter set fitted on training rows and judged by average precision on validation rows."""
    base = base or GBTClassifier(featuresCol="features", labelCol="y", weightCol="w", seed=SEED)
    prepare = Pipeline(stages=preparation(columns)).fit(train)
    ready = cut_lineage(prepare.transform(weighted(train)).select("features", "y", "w"))
    held = cut_lineage(prepare.transform(validation).select("features", "y"))
    parts = None
    for i, params in enumerate(trials):
        model = base.copy({base.getParam(k): v for k, v in params.items()}).fit(ready)
        one = model.transform(held).select(F.lit(i).alias("trial"), F.lit(str(params)).alias("params"), "y", vector_to_array("probability")[1].alias("p"))
        parts = one if parts is None else parts.unionByName(one)
    return E.areas(parts, ["trial", "params"]).orderBy(F.desc("pr_auc"), "trial")


# --------------------------------------------------------------------- importance


def feature_importance(model: PipelineModel | FittedForest, columns: Sequence[str]) -> DataFrame:
    """Importance (trees) or absolute coefficient (linear) per input, largest first."""
    last = model.stages[-1]
    if isinstance(last, T.Forest):
        values = last.importances()
    else:
        values = (last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray()
    rows = [(c, abs(float(v))) for c, v in zip(columns, values)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(model: PipelineModel, df: DataFrame, columns: Sequence[str], key: Sequence[str], block_rows: int = 5000, seed: int = SEED) -> DataFrame:
    """Drop in average precision when one input is shuffled, over all rows.

    Rows are dealt to hash blocks of about ``block_rows``; within its block each input is rotated by a step of its
    own, so no window grows with the table.
    """
    blocks = max(1, df.count() // block_rows)
    dealt = df.withColumn("__h", F.xxhash64(F.lit(seed), *key)).withColumn("__b", F.pmod("__h", F.lit(blocks)))
    block = Window.partitionBy("__b")
    dealt = dealt.select("*", F.row_number().over(block.orderBy("__h", *key)).alias("__n"), F.count(F.lit(1)).over(block).alias("__t"))
    sample = cut_lineage(dealt)
    parts = model.transform(sample).select(F.lit("(none)").alias("feature"), "y", vector_to_array("probability")[1].alias("p"))
    for i, c in enumerate(columns):
        # rotate the column through the block by a different step per column
        step = 1 + F.pmod(F.lit(seed * (i + 7)), F.greatest(F.col("__t") - 1, F.lit(1)))
        moved = sample.select("__b", (F.pmod(F.col("__n") - 1 + step, F.col("__t")) + 1).alias("__n"), F.col(c).alias("__v"))
        swapped = sample.join(moved, ["__b", "__n"]).withColumn(c, F.col("__v")).drop("__v")
        parts = parts.unionByName(model.transform(swapped).select(F.lit(c).alias("feature"), "y", vector_to_array("probability")[1].alias("p")))
    found = cut_lineage(E.areas(parts, ["feature"]))
    base = found.filter("feature = '(none)'").select("pr_auc").scalar()
    return found.filter("feature <> '(none)'").select("feature", (base - F.col("pr_auc")).alias("importance")).orderBy(F.desc("importance"), "feature")


# --------------------------------------------------------------- weather regressors


def fit_regressors(train: DataFrame, columns: Sequence[str], target: str, names: Sequence[str], entity: str = "City", scale: float = 1.0) -> dict[str, PipelineModel]:
    """One pooled model per family over all entities, the entity as one-hot input."""
    rows = train.withColumn("y", F.col(target).cast("double")).filter(F.col("y").isNotNull())
    prepare = Pipeline(stages=preparation(columns, entity=entity)).fit(rows)
    ready = cut_lineage(prepare.transform(rows).select("features", "y"))
    registry = regressors(scale=scale)
    return {n: PipelineModel(stages=[*prepare.stages, registry[n].fit(ready)]) for n in names}


def predict(models: dict[str, PipelineModel], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    parts = None
    for name, model in models.items():
        one = model.transform(df).select(*keep, F.lit(name).alias("model"), F.col("prediction").alias("predicted"))
        parts = one if parts is None else parts.unionByName(one)
    return parts
