"""Exact classifier and regression evaluation over score tables.

A score table has one row per prediction: grouping columns (model, split,
entity, ...), the 0/1 outcome ``y`` and the score ``p``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskgrid.functions.nulls import ratio
from riskgrid.functions.risk import f_beta, recall_score_mix, selection_score_mix
from riskgrid.operators.order import running_by_value


# ------------------------------------------------------------------ counts


def count_outcomes(scores: DataFrame, by: Sequence[str], predicted: Column, y: str = "y") -> DataFrame:
    hit, real = F.coalesce(predicted, F.lit(False)), F.col(y) == 1
    return scores.groupBy(*by).agg(
        F.count_if(hit & real).alias("tp"),
        F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"),
        F.count_if(~hit & ~real).alias("tn"),
    )


def rates(df: DataFrame) -> DataFrame:
    """Add recall, precision, f1, f2 and accuracy to a frame with tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = df.select("*", ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"))
    return out.select(
        "*",
        f_beta(F.col("precision"), F.col("recall")).alias("f1"),
        f_beta(F.col("precision"), F.col("recall"), 2.0).alias("f2"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def entity_report(scores: DataFrame, by: Sequence[str], predicted: Column, y: str = "y", p: str = "p") -> DataFrame:
    """Per-entity counts, rates and score statistics; rates are null without events."""
    hit, real = F.coalesce(predicted, F.lit(False)), F.col(y) == 1
    base = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_days"),
        F.count_if(real).alias("actual_fires"),
        F.count_if(hit).alias("predicted_fires"),
        F.avg(p).alias("mean_probability"),
        F.max(p).alias("max_probability"),
        F.count_if(hit & real).alias("tp"),
        F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"),
        F.count_if(~hit & ~real).alias("tn"),
    )
    out = rates(base).withColumn("fire_rate", ratio(F.col("actual_fires"), F.col("total_days")))
    return out


# ----------------------------------------------------------- areas and curves


def score_steps(scores: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """One row per distinct score with cumulative counts at and above it.

    The first aggregate combines equal scores before the shuffle; the ordering
    then runs over distinct scores dealt by value.
    """
    steps = (
        scores.filter(F.col(p).isNotNull())
        .groupBy(*by, F.col(p).alias("score"))
        .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    )
    placed = running_by_value(steps, by, "score", ["pos", "neg"], bounds=(0.0, 1.0))
    return placed.select(
        *by,
        "score",
        "pos",
        "neg",
        F.col("before_neg").alias("neg_below"),
        (F.col("total_pos") - F.col("before_pos")).alias("tp"),
        (F.col("total_neg") - F.col("before_neg")).alias("fp"),
        F.col("total_pos").alias("all_pos"),
        F.col("total_neg").alias("all_neg"),
    )


def areas(scores: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Average precision (step sum, not trapezoid) and ROC area with tied scores averaged."""
    s = score_steps(scores, by, y, p)
    gain = F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    wins = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)
    return (
        s.groupBy(*by)
        .agg(F.sum(gain).alias("__ap"), F.sum(wins).alias("__auc"), F.max("all_pos").alias("__p"), F.max("all_neg").alias("__n"))
        .select(
            *by,
            ratio(F.col("__ap"), F.col("__p")).alias("pr_auc"),
            ratio(F.col("__auc"), F.col("__p") * F.col("__n")).alias("roc_auc"),
        )
    )


def curve_points(scores: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Precision-recall and ROC points, one per distinct score."""
    s = score_steps(scores, by, y, p)
    return s.select(
        *by,
        "score",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("all_pos")).alias("recall"),
        ratio(F.col("fp"), F.col("all_neg")).alias("false_positive_rate"),
    )


def model_report(scores: DataFrame, by: Sequence[str], predicted: Column, y: str = "y", p: str = "p") -> DataFrame:
    """Counts, rates and both areas per group."""
    return rates(count_outcomes(scores, by, predicted, y)).join(areas(scores, by, y, p), list(by), "left")


# ------------------------------------------------------------ threshold search


@dataclass(frozen=True)
class Grid:
    """Thresholds first/1000, (first+step)/1000, ...; kept in thousandths so points are exact."""

    first: int
    step: int
    points: int

    def threshold(self, index: Column) -> Column:
        return (index * self.step + self.first) / F.lit(1000.0)

    def points_at_or_below(self, p: Column) -> Column:
        """How many grid points do not exceed ``p``: arithmetic guess, then corrected by comparison."""
        guess = F.floor((p * 1000 - self.first) / self.step).cast("bigint") + 1
        guess = (
            F.when(p >= self.threshold(guess), guess + 1).when(p < self.threshold(guess - 1), guess - 1).otherwise(guess)
        )
        return F.greatest(F.least(guess, F.lit(self.points)), F.lit(0)).cast("int")


# The three threshold grids in use.
GRID_SEARCH = Grid(50, 5, 180)
GRID_PIPELINE = Grid(50, 5, 160)
GRID_TRADEOFF = Grid(10, 5, 158)


def sweep(scores: DataFrame, by: Sequence[str], grid: Grid = GRID_SEARCH, y: str = "y", p: str = "p") -> DataFrame:
    """Counts and rates at every grid threshold, in one pass over the scores.

    Scores shrink to at most ``points + 1`` rows per group before anything is ordered.
    """
    slot = grid.points_at_or_below(F.col(p)).alias("slot")
    counted = scores.groupBy(*by, slot).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )
    axis = counted.select(*by).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(grid.points))))
    full = axis.join(counted, [*by, "slot"], "left").fillna({"pos": 0, "neg": 0})
    whole = Window.partitionBy(*by)
    above = whole.orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = full.select(
        *by,
        "slot",
        grid.threshold(F.col("slot") - 1).alias("threshold"),
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("__p"),
        F.sum("neg").over(whole).alias("__n"),
    ).filter(F.col("slot") > 0)
    out = out.select(
        *by, "threshold", "tp", "fp", (F.col("__p") - F.col("tp")).alias("fn"), (F.col("__n") - F.col("fp")).alias("tn")
    )
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return rates(out).withColumn("positive_rate", ratio(F.col("tp") + F.col("fp"), total))


# Fixed values: (precision floor, recall floor) tried in this order.
GATES = ((0.30, 0.70), (0.20, 0.70), (0.20, 0.50))


def pick_threshold(swept: DataFrame, by: Sequence[str], score: Column | None = None, gates=GATES) -> DataFrame:
    """Best threshold behind the first pair of gates any threshold passes, else the best F1.

    Equal scores go to the lowest threshold.  The default score is 0.6 recall + 0.4 F1.
    """
    score = recall_score_mix(F.col("recall"), F.col("f1")) if score is None else score
    last = len(gates) + 1
    level = F.lit(last)
    for i, (precision, recall) in reversed(list(enumerate(gates, start=1))):
        level = F.when((F.col("precision") >= precision) & (F.col("recall") >= recall), i).otherwise(level)
    ranked = swept.withColumn("level", level)
    worth = F.when(F.col("level") == last, F.col("f1")).otherwise(score)
    best = F.struct(-F.col("level"), worth, -F.col("threshold"))
    keep = ["threshold", "level", "recall", "precision", "f1", "f2", "tp", "fp", "fn", "tn"]
    return ranked.groupBy(*by).agg(F.max_by(F.struct(*keep), best).alias("r")).select(*by, "r.*")


def pipeline_threshold(scores: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Threshold search under the four-part selection score, which includes average precision."""
    swept = sweep(scores, by, GRID_PIPELINE, y, p).join(areas(scores, by, y, p), list(by))
    score = selection_score_mix(F.col("pr_auc"), F.col("f1"), F.col("recall"), F.col("precision"))
    return pick_threshold(swept, by, score)


def tradeoff_table(scores: DataFrame, by: Sequence[str], grid: Grid = GRID_TRADEOFF, y: str = "y", p: str = "p") -> DataFrame:
    """Published trade-off rows, rounded to four places."""
    swept = sweep(scores, by, grid, y, p).join(areas(scores, by, y, p), list(by))
    r4 = lambda c, n: F.round(F.col(c), 4).alias(n)
    return swept.select(
        *by,
        r4("threshold", "threshold"),
        r4("recall", "recall"),
        r4("precision", "precision"),
        r4("f1", "F1"),
        r4("f2", "F2"),
        r4("pr_auc", "PR_AUC"),
        F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
        F.col("tp").alias("true_positives"),
        F.col("tn").alias("true_negatives"),
        r4("positive_rate", "predicted_positive_rate"),
    )


def pick_tradeoff(table: DataFrame, by: Sequence[str], recall_floor: float = 0.70, precision_floor: float = 0.30) -> DataFrame:
    """Best F2 behind both gates, else behind the recall gate, else the highest recall; gates see rounded values."""
    recalls = F.col("recall") >= recall_floor
    level = F.when(recalls & (F.col("precision") >= precision_floor), 1).when(recalls, 2).otherwise(3)
    ranked = table.withColumn("level", level)
    worth = F.when(F.col("level") == 3, F.col("recall")).otherwise(F.col("F2"))
    best = F.struct(-F.col("level"), worth, -F.col("threshold"))
    keep = [c for c in table.columns if c not in by] + ["level"]
    return ranked.groupBy(*by).agg(F.max_by(F.struct(*keep), best).alias("r")).select(*by, "r.*")


def tradeoff_limits(table: DataFrame, by: Sequence[str], recall_floor: float = 0.70, precision_floor: float = 0.30) -> DataFrame:
    """Highest precision at the recall floor and highest recall at the precision floor."""
    return table.groupBy(*by).agg(
        F.max(F.when(F.col("recall") >= recall_floor, F.col("precision"))).alias("max_precision_at_recall"),
        F.max(F.when(F.col("precision") >= precision_floor, F.col("recall"))).alias("max_recall_at_precision"),
    )


def threshold_note(threshold: Column, recall: Column, precision: Column, fn: Column, fp: Column) -> Column:
    """One sentence on the chosen threshold, by which of the two gates it meets."""
    both = F.format_string(
        "Threshold %.3f meets both targets: recall %.3f, precision %.3f, missed %d, false alarms %d.",
        threshold, recall, precision, fn, fp,
    )
    recall_only = F.format_string(
        "Threshold %.3f favours recall %.3f; precision %.3f is below target, missed %d, false alarms %d.",
        threshold, recall, precision, fn, fp,
    )
    neither = F.format_string("Threshold %.3f is the best available: recall %.3f, precision %.3f.", threshold, recall, precision)
    return F.when((recall >= 0.70) & (precision >= 0.30), both).when(recall >= 0.70, recall_only).otherwise(neither)


# ---------------------------------------------------------------- leaderboards


def leaderboard(report: DataFrame, model: str = "model") -> DataFrame:
    """Add the composite and whether all published gates hold; ranked best first, names break ties."""
    r, p, f, a = (F.col(c) for c in ("recall", "precision", "f1", "pr_auc"))
    ranked = report.select(
        "*",
        recall_score_mix(r, f).alias("composite"),
        selection_score_mix(a, f, r, p).alias("selection_score"),
        ((r >= 0.70) & (p >= 0.30) & (a >= 0.20)).alias("qualified"),
    )
    return ranked.orderBy(F.desc("composite"), model)


def best_model(board: DataFrame, model: str = "model") -> DataFrame:
    """Best qualified model by composite, or the best of all when none qualifies."""
    return board.orderBy(F.desc("qualified"), F.desc("composite"), model).limit(1)


def train_gap(report: DataFrame, by: Sequence[str], split: str = "split", reference: str = "train", against: str = "test") -> DataFrame:
    """F1 on one split minus F1 on another, flagged above 0.15."""
    f1 = lambda s: F.max(F.when(F.col(split) == s, F.col("f1")))
    gap = f1(reference) - f1(against)
    return report.groupBy(*by).agg(gap.alias("gap"), F.coalesce(gap > 0.15, F.lit(False)).alias("overfit"))


# -------------------------------------------------------------------- regression


def regression_report(df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE, R2 and MAPE (over non-zero truth) of finite pairs."""
    a, b = F.col(actual), F.col(predicted)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    err = a - b
    n = F.count(F.lit(1))
    return (
        df.filter(finite(a) & finite(b))
        .groupBy(*by)
        .agg(
            n.alias("n"),
            F.avg(F.abs(err)).alias("MAE"),
            F.sqrt(F.avg(err * err)).alias("RMSE"),
            F.when(n > 1, 1 - F.try_divide(F.sum(err * err), F.var_pop(a) * n)).otherwise(F.lit(0.0)).alias("R2"),
            (F.avg(F.when(a != 0, F.abs(err / a))) * 100).alias("MAPE"),
        )
    )
