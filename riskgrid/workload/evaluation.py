"""Classifier evaluation, thresholds, blending and forecast scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrid.functions.risk import selection_score_mix
from riskgrid.operators import blend as M
from riskgrid.operators import evaluate as E
from riskgrid.operators.resample import lengthen
from riskgrid.session import sized_side
from riskgrid.workload import binding as B
from riskgrid.workload.joining import FORECASTS, naive_forecasts
from riskgrid.workload.registry import query

BY = ["model", "split"]
RATES_SQL = """coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tp / nullif(tp + fp, 0), 0) AS precision"""
F_SQL = """CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
      CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2"""


def counts_sql(source: str, by: str, hit: str) -> str:
    return f"""SELECT {by}, CAST(count(*) FILTER ({hit} AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER ({hit} AND y = 0) AS DOUBLE) AS fp,
      CAST(count(*) FILTER (NOT {hit} AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT {hit} AND y = 0) AS DOUBLE) AS tn FROM {source} GROUP BY ALL"""


def areas_sql(source: str, by: str = "model, split") -> str:
    """Average precision and ROC area by window sums over distinct scores."""
    return f"""st AS (SELECT {by}, p, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS neg FROM {source} GROUP BY ALL),
    cm AS (SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY p DESC) AS ctp, sum(neg) OVER (PARTITION BY {by} ORDER BY p DESC) AS cfp,
      sum(pos) OVER (PARTITION BY {by}) AS ap, sum(neg) OVER (PARTITION BY {by}) AS an FROM st),
    areas AS (SELECT {by}, coalesce(sum(pos * ctp / (ctp + cfp)) / nullif(max(ap), 0), 0) AS pr_auc,
      coalesce(sum(pos * (an - cfp + neg / 2)) / nullif(max(ap) * max(an), 0), 0) AS roc_auc FROM cm GROUP BY ALL)"""


def ints(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


REPORT = f"""c AS ({counts_sql('scores', 'model, split', 'p >= 0.5')}), r AS (SELECT *, {RATES_SQL} FROM c), f AS (SELECT *, {F_SQL} FROM r), {areas_sql('scores')}"""


def report(t):
    return E.model_report(B.scores(t), BY, F.col("p") >= 0.5)


@query(
    f"""WITH {B.SCORES}, {REPORT} SELECT model, split, {ints('tp', 'fp', 'fn', 'tn')}, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1,
      round(f2, 6) AS f2, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM f JOIN areas USING (model, split)"""
)
def model_report(t):
    return B.round_all(report(t))


@query(f"""WITH {B.SCORES}, {areas_sql('scores', 'model, "City"')} SELECT model, "City", round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM areas""")
def areas_per_place(t):
    return B.round_all(E.areas(B.scores(t), ["model", "City"]))


@query(
    f"""WITH {B.SCORES}, {areas_sql('scores')} SELECT model, split, p AS score, round(ctp / (ctp + cfp), 6) AS precision, round(coalesce(ctp / nullif(ap, 0), 0), 6) AS recall,
      round(coalesce(cfp / nullif(an, 0), 0), 6) AS false_positive_rate FROM cm"""
)
def curve_points(t):
    return B.round_all(E.curve_points(B.scores(t), BY), keep=("score",))


def sweep_sql(source: str, first: int, points: int, by: str = "model, split") -> str:
    join = " AND ".join(f"gr.{b.strip()} = s.{b.strip()}" for b in by.split(","))
    keys = ", ".join(f"gr.{b.strip()}" for b in by.split(","))
    return f"""grid AS (SELECT ({first} + 5 * i) / 1000.0::DOUBLE AS threshold FROM (SELECT unnest(generate_series(0, {points - 1})) AS i)),
    u AS (SELECT {by}, p, y, count(*) AS n FROM {source} GROUP BY ALL),
    c AS (SELECT {keys}, gr.threshold, CAST(coalesce(sum(n) FILTER (p >= gr.threshold AND y = 1), 0) AS DOUBLE) AS tp, CAST(coalesce(sum(n) FILTER (p >= gr.threshold AND y = 0), 0) AS DOUBLE) AS fp,
      CAST(coalesce(sum(n) FILTER (p < gr.threshold AND y = 1), 0) AS DOUBLE) AS fn, CAST(coalesce(sum(n) FILTER (p < gr.threshold AND y = 0), 0) AS DOUBLE) AS tn
      FROM (SELECT * FROM grid, (SELECT DISTINCT {by} FROM {source})) gr JOIN u s ON {join} GROUP BY ALL),
    r AS (SELECT *, {RATES_SQL} FROM c), f AS (SELECT *, {F_SQL}, (tp + fp) / (tp + fp + fn + tn) AS positive_rate FROM r)"""


@query(
    f"""WITH {B.SCORES}, {sweep_sql('scores', 50, 180)} SELECT model, split, threshold, {ints('tp', 'fp', 'fn', 'tn')}, round(recall, 6) AS recall, round(precision, 6) AS precision,
      round(f1, 6) AS f1, round(f2, 6) AS f2, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(positive_rate, 6) AS positive_rate FROM f"""
)
def threshold_sweep(t):
    return B.round_all(E.sweep(B.scores(t), BY), keep=("threshold",))


CASCADE = """l AS (SELECT *, CASE WHEN precision >= 0.3 AND recall >= 0.7 THEN 1 WHEN precision >= 0.2 AND recall >= 0.7 THEN 2
      WHEN precision >= 0.2 AND recall >= 0.5 THEN 3 ELSE 4 END AS level FROM f{extra}),
    k AS (SELECT *, CASE WHEN level = 4 THEN f1 ELSE {score} END AS worth FROM l)
    SELECT model, split, threshold, CAST(level AS INTEGER) AS level, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1, round(f2, 6) AS f2,
      {ints} FROM k QUALIFY row_number() OVER (PARTITION BY model, split ORDER BY level, worth DESC, threshold) = 1"""


@query(
    f"""WITH {B.SCORES}, {sweep_sql('scores', 50, 180)}, """
    + CASCADE.format(extra="", score="recall * 0.6 + f1 * 0.4", ints=ints("tp", "fp", "fn", "tn"))
)
def threshold_cascade(t):
    return B.round_all(E.pick_threshold(E.sweep(B.scores(t), BY), BY), keep=("threshold",))


@query(
    f"""WITH {B.SCORES}, {sweep_sql('scores', 50, 160)}, {areas_sql('scores')}, """
    + CASCADE.format(
        extra=" JOIN areas USING (model, split)",
        score="pr_auc * 0.35 + f1 * 0.30 + recall * 0.20 + precision * 0.15",
        ints=ints("tp", "fp", "fn", "tn"),
    )
)
def threshold_cascade_selection(t):
    return B.round_all(E.pipeline_threshold(B.scores(t), BY), keep=("threshold",))


ROUND4 = "round({c} - 1e-9, 4) + 0.0"
TRADEOFF = f"""{sweep_sql('scores', 10, 158)}, {areas_sql('scores')}, tt AS (SELECT model, split, round(threshold, 4) AS threshold, round(recall, 4) AS recall,
      round(precision, 4) AS precision, round(f1, 4) AS "F1", round(f2, 4) AS "F2", round(pr_auc, 4) AS "PR_AUC", {', '.join(f'CAST({a} AS BIGINT) AS {b}' for a, b in
      (('fp', 'false_positives'), ('fn', 'false_negatives'), ('tp', 'true_positives'), ('tn', 'true_negatives')))}, round(positive_rate, 4) AS predicted_positive_rate
      FROM f JOIN areas USING (model, split))"""


@query(f"""WITH {B.SCORES}, {TRADEOFF} SELECT * FROM tt""")
def tradeoff_table(t):
    return E.tradeoff_table(B.scores(t), BY)


PICK = """pk AS (SELECT *, CAST(CASE WHEN recall >= 0.7 AND precision >= 0.3 THEN 1 WHEN recall >= 0.7 THEN 2 ELSE 3 END AS INTEGER) AS level FROM tt),
    best AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY model, split ORDER BY level, CASE WHEN level = 3 THEN recall ELSE "F2" END DESC, threshold) = 1)"""


@query(f"""WITH {B.SCORES}, {TRADEOFF}, {PICK} SELECT * FROM best""")
def tradeoff_choice(t):
    return E.pick_tradeoff(E.tradeoff_table(B.scores(t), BY), BY)


@query(
    f"""WITH {B.SCORES}, {TRADEOFF} SELECT model, split, max(precision) FILTER (recall >= 0.7) AS max_precision_at_recall, max(recall) FILTER (precision >= 0.3) AS max_recall_at_precision
    FROM tt GROUP BY 1, 2"""
)
def tradeoff_limits(t):
    return E.tradeoff_limits(E.tradeoff_table(B.scores(t), BY), BY)


@query(
    f"""WITH {B.SCORES}, {TRADEOFF}, {PICK}, v AS (SELECT model, threshold FROM best WHERE split = 'val'), s2 AS (SELECT s.*, v.threshold FROM scores s JOIN v USING (model) WHERE split = 'test'),
    cc AS ({counts_sql('s2', 'model, threshold', 'p >= threshold')}), rr AS (SELECT *, {RATES_SQL} FROM cc)
    SELECT model, threshold, {ints('tp', 'fp', 'fn', 'tn')}, round(recall, 6) AS recall, round(precision, 6) AS precision,
      CASE WHEN recall >= 0.7 AND precision >= 0.3 THEN printf('Threshold %.3f meets both targets: recall %.3f, precision %.3f, missed %d, false alarms %d.', threshold, recall, precision, CAST(fn AS BIGINT), CAST(fp AS BIGINT))
        WHEN recall >= 0.7 THEN printf('Threshold %.3f favours recall %.3f; precision %.3f is below target, missed %d, false alarms %d.', threshold, recall, precision, CAST(fn AS BIGINT), CAST(fp AS BIGINT))
        ELSE printf('Threshold %.3f is the best available: recall %.3f, precision %.3f.', threshold, recall, precision) END AS note FROM rr"""
)
def tradeoff_verified_on_test(t):
    """Threshold chosen on validation rows, counted on test rows, with its sentence."""
    rows = B.scores(t)
    chosen = E.pick_tradeoff(E.tradeoff_table(rows.filter("split = 'val'"), ["model"]), ["model"]).select("model", "threshold")
    test = rows.filter("split = 'test'").join(sized_side(chosen), "model")
    out = E.rates(E.count_outcomes(test, ["model", "threshold"], F.col("p") >= F.col("threshold")))
    note = E.threshold_note(*[F.col(c) for c in ("threshold", "recall", "precision", "fn", "fp")])
    return B.round_all(out.withColumn("note", note).drop("f1", "f2", "accuracy"), keep=("threshold",))


BOARD = f"""b AS (SELECT model, recall, precision, f1, pr_auc, recall * 0.6 + f1 * 0.4 AS composite, pr_auc * 0.35 + f1 * 0.30 + recall * 0.20 + precision * 0.15 AS selection_score,
      recall >= 0.7 AND precision >= 0.3 AND pr_auc >= 0.2 AS qualified FROM f JOIN areas USING (model, split) WHERE split = 'val')"""
WINNER = f"""{REPORT}, {BOARD}, winner AS (SELECT model FROM b ORDER BY qualified DESC, composite DESC, model LIMIT 1),
    won AS (SELECT * FROM scores WHERE split = 'test' AND model = (SELECT model FROM winner))"""


def winner_scores(t):
    """Test rows of the model that the validation rows choose."""
    best = E.best_model(E.leaderboard(report(t).filter("split = 'val'")))
    return B.scores(t).filter("split = 'test'").filter(F.col("model") == best.select("model").scalar())


@query(
    f"""WITH {B.SCORES}, {WINNER}, c2 AS (SELECT "City", count(*) AS total_days, CAST(sum(y) AS BIGINT) AS actual_fires, count(*) FILTER (p >= 0.5) AS predicted_fires, avg(p) AS mean_probability,
      max(p) AS max_probability, CAST(count(*) FILTER (p >= 0.5 AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (p >= 0.5 AND y = 0) AS DOUBLE) AS fp,
      CAST(count(*) FILTER (p < 0.5 AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (p < 0.5 AND y = 0) AS DOUBLE) AS tn FROM won GROUP BY 1),
    r2 AS (SELECT *, {RATES_SQL} FROM c2), f2s AS (SELECT *, {F_SQL} FROM r2)
    SELECT "City", total_days, actual_fires, predicted_fires, round(mean_probability, 6) AS mean_probability, round(max_probability, 6) AS max_probability, {ints('tp', 'fp', 'fn', 'tn')},
      round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1, round(f2, 6) AS f2, round((tp + tn) / total_days, 6) AS accuracy, round(actual_fires / total_days, 6) AS fire_rate FROM f2s"""
)
def place_risk_summary(t):
    rows = winner_scores(t)
    return B.round_all(E.entity_report(rows, ["City"], F.col("p") >= 0.5))


@query(
    f"""WITH {B.SCORES}, {REPORT}, {BOARD} SELECT model, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1, round(pr_auc, 6) AS pr_auc,
      round(composite, 6) AS composite, round(selection_score, 6) AS selection_score, qualified FROM b"""
)
def leaderboard(t):
    board = E.leaderboard(report(t).filter("split = 'val'"))
    return B.round_all(board.select("model", "recall", "precision", "f1", "pr_auc", "composite", "selection_score", "qualified"))


@query(
    f"""WITH {B.SCORES}, {REPORT}, {BOARD} SELECT model, round(composite, 6) AS composite FROM b ORDER BY qualified DESC, b.composite DESC, model LIMIT 1"""
)
def best_model(t):
    return B.round_all(E.best_model(E.leaderboard(report(t).filter("split = 'val'"))).select("model", "composite"))


@query(
    f"""WITH {B.SCORES}, {REPORT}, g AS (SELECT model, max(f1) FILTER (split = 'train') - max(f1) FILTER (split = 'test') AS gap FROM f GROUP BY 1)
    SELECT model, round(gap, 6) AS gap, coalesce(gap > 0.15, false) AS overfit FROM g"""
)
def train_test_gap(t):
    return B.round_all(E.train_gap(report(t), ["model"]))


ROLES = f"""v AS (SELECT model, recall, precision, pr_auc FROM f JOIN areas USING (model, split) WHERE split = 'val'),
    med AS (SELECT quantile_cont(recall, 0.5) AS mr, quantile_cont(precision, 0.5) AS mp FROM v),
    ro AS (SELECT model, pr_auc, CASE WHEN recall >= mr AND precision < mp THEN 'recall' WHEN precision >= mp AND recall < mr THEN 'precision' ELSE 'balanced' END AS role FROM v, med),
    rw AS (SELECT model, role, (CASE role WHEN 'recall' THEN 2.0 WHEN 'precision' THEN 1.0 ELSE 1.5 END) * (pr_auc + 0.5) AS raw FROM ro),
    wt AS (SELECT model, role, raw / (SELECT sum(raw) FROM rw) AS weight FROM rw)"""


@query(f"""WITH {B.SCORES}, {REPORT}, {ROLES} SELECT model, role, round(weight, 6) AS weight FROM wt""")
def role_weights(t):
    return B.round_all(M.role_weights(report(t).filter("split = 'val'")))


def keyed(t):
    """Scores summed to one row per line key and model, since the key repeats in the table."""
    return B.scores(t).groupBy("row_order", "row_line", "model").agg((F.sum(F.col("p") * 1000).cast("bigint") / F.count(F.lit(1)) / 1000).alias("p"))


KEYED = """keyed AS (SELECT row_order, row_line, model, CAST(CAST(sum(p * 1000) AS BIGINT) AS DOUBLE) / count(*) / 1000 AS p FROM scores GROUP BY ALL)"""


@query(
    f"""WITH {B.SCORES}, {REPORT}, {ROLES}, {KEYED}, bl AS (SELECT row_order, row_line, sum(weight * p) AS m, count(*) FILTER (p > 0.15) AS votes, count(*) AS n,
      max(p) FILTER (role = 'recall') AS peak FROM keyed JOIN wt USING (model) GROUP BY 1, 2),
    bo AS (SELECT *, CASE WHEN votes >= 0.6 * n THEN least(m * 1.1, 1.0) ELSE m END AS p FROM bl)
    SELECT row_order, row_line, round(CASE WHEN peak > 0.5 THEN greatest(p, 0.10) ELSE p END, 6) AS p FROM bo"""
)
def role_blend(t):
    weights = M.role_weights(report(t).filter("split = 'val'"))
    return B.round_all(M.role_blend(keyed(t), weights, ["row_order", "row_line"]))


@query(
    f"""WITH {B.SCORES}, {REPORT}, {KEYED}, top AS (SELECT model FROM f WHERE split = 'val' ORDER BY recall * 0.6 + f1 * 0.4 DESC, model LIMIT 2)
    SELECT row_order, row_line, round(avg(p), 6) AS p FROM keyed WHERE model IN (SELECT model FROM top) GROUP BY 1, 2"""
)
def soft_vote_top(t):
    members = M.top_members(report(t).filter("split = 'val'"), 2)
    return B.round_all(M.soft_vote(keyed(t), ["row_order", "row_line"], members))


FINITE = "a IS NOT NULL AND b IS NOT NULL"


@query(
    f"""WITH {B.WEATHER}, {FORECASTS}, l AS (SELECT "City", 'a' AS model, actual, a AS predicted FROM fc WHERE a IS NOT NULL UNION ALL SELECT "City", 'b', actual, b FROM fc WHERE b IS NOT NULL)
    SELECT "City", model, count(*) AS n, round(avg(abs(actual - predicted)), 6) AS "MAE", round(sqrt(avg((actual - predicted) ** 2)), 6) AS "RMSE",
      round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 6) AS "R2",
      round(100 * avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END), 6) AS "MAPE" FROM l GROUP BY 1, 2"""
)
def forecast_metrics(t):
    long = lengthen(naive_forecasts(t), ["City", "Date", "actual"], ["a", "b"], "model", "predicted")
    return B.round_all(E.regression_report(long, ["City", "model"]))


def mix_sql(steps: int) -> str:
    return f"""wg AS (SELECT i / {steps}.0::DOUBLE AS w FROM (SELECT unnest(generate_series(0, {steps})) AS i)),
    er AS (SELECT "City", w, count(*) AS n, avg(abs(actual - a)) AS mae_a, avg(abs(actual - b)) AS mae_b, avg(abs(actual - (a * w + b * (1 - w)))) AS mae,
      sqrt(avg((actual - (a * w + b * (1 - w))) ** 2)) AS rmse FROM fc, wg WHERE {FINITE} GROUP BY 1, 2),
    bw AS (SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY "City" ORDER BY mae, w) = 1)"""


@query(
    f"""WITH {B.WEATHER}, {FORECASTS}, {mix_sql(20)} SELECT "City", n, round(mae_a, 6) AS mae_a, round(mae_b, 6) AS mae_b, w AS weight, round(mae, 6) AS mae_mix, round(rmse, 6) AS rmse_mix FROM bw"""
)
def mix_weight_search(t):
    pairs = naive_forecasts(t).filter("a IS NOT NULL AND b IS NOT NULL")
    return B.round_all(M.best_mix(pairs, ["City"], 20), keep=("weight",))


@query(
    f"""WITH {B.WEATHER}, {FORECASTS}, {mix_sql(10)} SELECT 'daily' AS granularity, round(avg(mae_a), 6) AS mae_a, round(avg(mae_b), 6) AS mae_b, round(avg(mae), 6) AS mae_mix, count(*) AS cells FROM bw"""
)
def forecast_leaderboard(t):
    pairs = naive_forecasts(t).filter("a IS NOT NULL AND b IS NOT NULL")
    best = M.best_mix(pairs, ["City"], 10)
    mean = [F.avg(c).alias(c) for c in ("mae_a", "mae_b", "mae_mix")]
    return B.round_all(best.groupBy(F.lit("daily").alias("granularity")).agg(*mean, F.count(F.lit(1)).alias("cells")))


@query(
    f"""WITH {B.SCORES}, {REPORT} SELECT model, pr_auc * 0.35 + f1 * 0.30 + recall * 0.20 + precision * 0.15 >= 0.95 * (SELECT max(pr_auc) FROM areas WHERE split = 'val') AS kept
    FROM f JOIN areas USING (model, split) WHERE split = 'val'"""
)
def calibration_keep_rule(t):
    val = report(t).filter("split = 'val'")
    top = val.agg(F.max("pr_auc").alias("m")).scalar()
    score = selection_score_mix(*[F.col(c) for c in ("pr_auc", "f1", "recall", "precision")])
    return val.select("model", M.calibration_kept(top, score).alias("kept"))
