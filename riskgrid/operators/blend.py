"""Combining the scores of several models or forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskgrid.functions.nulls import ratio
from riskgrid.functions.risk import recall_score_mix
from riskgrid.session import fixed_rows, sized_side


def role_weights(report: DataFrame, model: str = "model") -> DataFrame:
    """Role and normalised weight of each model from its recall, precision and average precision.

    One row per model in and out: the report is evaluated once and carried on as constants.
    """
    report = fixed_rows(report.select(model, "recall", "precision", "pr_auc"))
    medians = report.agg(F.struct(F.median("recall").alias("r"), F.median("precision").alias("p")).alias("m")).scalar()
    r, p = F.col("recall"), F.col("precision")
    mr, mp = medians.getField("r"), medians.getField("p")
    role = F.when((r >= mr) & (p < mp), "recall").when((p >= mp) & (r < mr), "precision").otherwise("balanced")
    base = F.when(F.col("role") == "recall", 2.0).when(F.col("role") == "precision", 1.0).otherwise(1.5)
    raw = report.select(model, "pr_auc", role.alias("role")).select(
        model, "role", (base * (F.coalesce(F.col("pr_auc"), F.lit(0.3)) + 0.5)).alias("raw")
    )
    total = raw.agg(F.sum("raw").alias("t")).scalar()
    return raw.select(model, "role", (F.col("raw") / total).alias("weight"))


def role_blend(scores: DataFrame, weights: DataFrame, key: Sequence[str], model: str = "model", p: str = "p", floor: bool = True) -> DataFrame:
    """Weighted mean per key, raised on consensus and (optionally) by a confident recall model.

    ``scores`` is long: one row per key and model.  Partial sums combine before the shuffle.
    """
    # a shuffle on the model would gather all scores in as many tasks, so the weights are measured and sent where they fit
    joined = scores.join(sized_side(weights.select(model, "role", "weight")), model)
    sums = joined.groupBy(*key).agg(
        F.sum(F.col("weight") * F.col(p)).alias("mean"),
        F.count_if(F.col(p) > 0.15).alias("votes"),
        F.count(F.lit(1)).alias("models"),
        F.max(F.when(F.col("role") == "recall", F.col(p))).alias("recall_peak"),
    )
    agree = F.col("votes") >= F.col("models") * 0.6
    out = F.when(agree, F.least(F.col("mean") * 1.10, F.lit(1.0))).otherwise(F.col("mean"))
    if floor:
        out = F.when(F.coalesce(F.col("recall_peak") > 0.5, F.lit(False)), F.greatest(out, F.lit(0.10))).otherwise(out)
    return sums.select(*key, out.alias("p"))


def soft_vote(scores: DataFrame, key: Sequence[str], members: DataFrame | None = None, model: str = "model", p: str = "p") -> DataFrame:
    """Mean score per key over all models or over those listed in ``members``."""
    use = scores if members is None else scores.join(sized_side(members.select(model)), model, "left_semi")
    return use.groupBy(*key).agg(F.avg(p).alias("p"))


def top_members(report: DataFrame, n: int = 3, model: str = "model") -> DataFrame:
    """The n best models by 0.6 recall + 0.4 F1."""
    return report.orderBy(recall_score_mix(F.col("recall"), F.col("f1")).desc(), model).limit(n)


def calibration_kept(raw: Column, calibrated: Column) -> Column:
    """Whether calibration keeps at least 95 % of the uncalibrated composite."""
    return calibrated >= raw * 0.95


def best_mix(pairs: DataFrame, by: Sequence[str], steps: int, actual: str = "actual", a: str = "a", b: str = "b") -> DataFrame:
    """Weight w in {0, 1/steps, ..., 1} minimising the mean absolute error of w*a + (1-w)*b.

    All weights are evaluated as aggregates of one pass, without multiplying
    the rows; the lowest weight wins ties.
    """
    grid = [i / steps for i in range(steps + 1)]
    errors = [F.avg(F.abs(F.col(actual) - (F.col(a) * w + F.col(b) * (1 - w)))).alias(f"__e{i}") for i, w in enumerate(grid)]
    sq = [F.avg(F.pow(F.col(actual) - (F.col(a) * w + F.col(b) * (1 - w)), F.lit(2.0))).alias(f"__q{i}") for i, w in enumerate(grid)]
    found = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col(actual) - F.col(a))).alias("mae_a"),
        F.avg(F.abs(F.col(actual) - F.col(b))).alias("mae_b"),
        *errors,
        *sq,
    )
    options = F.array(
        *[F.struct(F.col(f"__e{i}").alias("mae"), F.lit(w).alias("weight"), F.sqrt(f"__q{i}").alias("rmse")) for i, w in enumerate(grid)]
    )
    return found.withColumn("best", F.array_min(options)).select(
        *by, "n", "mae_a", "mae_b", F.col("best.weight").alias("weight"), F.col("best.mae").alias("mae_mix"), F.col("best.rmse").alias("rmse_mix")
    )


def apply_mix(pairs: DataFrame, weights: DataFrame, by: Sequence[str], a: str = "a", b: str = "b", name: str = "value", default: float = 0.0) -> DataFrame:
    """Blend two forecasts with fitted weights; a cell without a weight uses ``default``."""
    w = F.coalesce(F.col("weight"), F.lit(default))
    joined = pairs.join(weights.select(*by, "weight"), list(by), "left")
    return joined.withColumn(name, F.col(a) * w + F.col(b) * (1 - w)).drop("weight")


def class_imbalance(df: DataFrame, y: str, cap: float = 20.0) -> DataFrame:
    neg, pos = F.count_if(F.col(y) == 0), F.count_if(F.col(y) == 1)
    return df.agg(
        pos.alias("pos"),
        neg.alias("neg"),
        F.round(neg / F.greatest(pos, F.lit(1)), 1).alias("imbalance"),
        F.least(ratio(F.greatest(neg, F.lit(1)), F.greatest(pos, F.lit(1))), F.lit(cap)).alias("pos_weight"),
    )
