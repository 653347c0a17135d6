"""Learning, calibration, forecasting and landed-payload queries.

Model outputs have no SQL twin; they run over the whole tables and are checked
by tests on small fixtures.  Data-side steps have their twin as usual.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from riskgrid.functions.calendar import hour_index, temporal_split
from riskgrid.operators import evaluate as E
from riskgrid.operators.isotonic import isotonic_steps
from riskgrid.operators.resample import lengthen
from riskgrid.plans import forecast as G
from riskgrid.plans import learn as L
from riskgrid.plans import trees as T
from riskgrid.sources.readers import explode_axis, explode_payload
from riskgrid.spec import API_NAMES, DAILY, DAILY_WEATHER, HOURLY, HOURLY_TARGETS, HOURLY_VARIABLES
from riskgrid.workload import binding as B
from riskgrid.workload.registry import query

INPUTS = ["Temperature_C_mean", "Humidity_percent_mean", "Rain_mm_sum", "Wind_Speed_kmh_mean", "Pressure_hPa_mean", "Solar_Radiation_Wm2_mean"]
NAMES = ["logistic", "random_forest", "hist_boosting"]
TREES = 4  # of the autoregressive models, for the same reason as SMALL
SMALL = 0.02  # share of the full tree counts, to keep the registered queries short


def frame(t):
    split = temporal_split("Date", "1999-01-01", "2000-01-01")
    return L.prepared_split(B.labelled_daily(t), INPUTS, "Fire_Occurred", split)


def fitted(t, names=NAMES):
    rows = L.cut_lineage(frame(t))
    return rows, L.fit_classifiers(rows.filter("split = 'train'"), INPUTS, names, scale=SMALL)


KEY = ["City", "Date", "split", "y"]


@query()
def classifier_report(t):
    """All nine classifier families, threshold from validation, report per split."""
    rows, models = fitted(t, [*NAMES, "extra_trees", "balanced_forest", "boosting_shallow", "boosting_deep", "boosting_slow", "neural"])
    return L.three_way_report(L.cut_lineage(L.score(models, rows, KEY)))


def complete():
    return F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in INPUTS])


_ROOTS = T.Growth(trees=40, subset=2)


@query(
    f"""WITH {B.LABELLED}, x AS (SELECT "Fire_Occurred" AS y, [{", ".join(f'coalesce("{c}", 0)' for c in INPUTS)}] AS v FROM panel),
    ends AS (SELECT f, min(v) AS low, max(v) AS high FROM (SELECT unnest(range({len(INPUTS)})) AS f, unnest(v) AS v FROM x) GROUP BY f),
    h0 AS (SELECT tree, f, c, (tree * 2654435761 + 2246822519 + f * 3266489917 + {42 * 668265263} + c * 374761393) % 4294967296 AS h
      FROM (SELECT unnest(range(40)) AS tree), (SELECT unnest(range({len(INPUTS)})) AS f), (SELECT unnest([1, 2]) AS c)),
    h1 AS (SELECT tree, f, c, CAST(CAST(xor(h, h >> 15) AS HUGEINT) * 2246822519 % 4294967296 AS BIGINT) AS h FROM h0),
    h2 AS (SELECT tree, f, c, CAST(CAST(xor(h, h >> 13) AS HUGEINT) * 3266489917 % 4294967296 AS BIGINT) AS h FROM h1),
    h3 AS (SELECT tree, f, c, xor(h, h >> 16) AS h FROM h2),
    picked AS (SELECT tree, f FROM (SELECT tree, f, row_number() OVER (PARTITION BY tree ORDER BY h, f) AS k FROM h3 WHERE c = 1) WHERE k <= 2),
    drawn AS (SELECT tree, f, low + (CAST(h AS DOUBLE) / 4294967296) * (high - low) AS threshold FROM picked JOIN (SELECT * FROM h3 WHERE c = 2) USING (tree, f) JOIN ends USING (f))
    SELECT CAST(tree AS INTEGER) AS tree, CAST(f AS INTEGER) AS feature, round(threshold, 6) AS threshold,
      count(*) FILTER (y = 0 AND v[f + 1] <= threshold) AS l0, count(*) FILTER (y = 1 AND v[f + 1] <= threshold) AS l1,
      count(*) FILTER (y = 0 AND v[f + 1] > threshold) AS r0, count(*) FILTER (y = 1 AND v[f + 1] > threshold) AS r1
    FROM drawn, x GROUP BY tree, f, threshold"""
)
def extra_trees_root_counts(t):
    """The drawn splits of the roots of 40 extremely randomised trees, and the classes on both sides."""
    return B.round_all(T.root_counts(B.labelled_daily(t), complete(), len(INPUTS), "Fire_Occurred", ["City", "Date"], _ROOTS))


@query()
def extra_trees_scores(t):
    """200 extremely randomised trees over all labelled days: probability of every day."""
    days = B.labelled_daily(t)
    forest = T.grow(days, complete(), len(INPUTS), "Fire_Occurred", ["City", "Date"], T.Growth(trees=200, depth=12, subset=2), (1.0, 4.0))
    return days.select("City", "Date", forest.probability(complete()).alias("p"))


@query()
def balanced_forest_scores(t):
    """200 trees, each on its own balanced bootstrap of all labelled days: probability of every day."""
    days = B.labelled_daily(t)
    how = T.Growth(trees=200, depth=10, subset=2, random=False, balanced=True)
    forest = T.grow(days, complete(), len(INPUTS), "Fire_Occurred", ["City", "Date"], how)
    return days.select("City", "Date", forest.probability(complete()).alias("p"))


@query()
def classifier_calibrated_report(t):
    rows, models = fitted(t)
    scores = L.cut_lineage(L.score(models, rows, KEY))
    calibrated = L.calibrate(scores, L.calibrators(scores.filter("split = 'val'")))
    return L.three_way_report(L.cut_lineage(calibrated))


@query(
    f"""WITH {B.SCORES}, d AS (SELECT model, p, sum(y) AS s, count(*) AS w FROM scores GROUP BY 1, 2),
    c AS (SELECT model, p, s, w, row_number() OVER o AS i, sum(s) OVER o AS cs, sum(w) OVER o AS cw FROM d WINDOW o AS (PARTITION BY model ORDER BY p)),
    m AS (SELECT a.model, a.i AS j, b.i AS k, CAST(b.cs - a.cs + a.s AS DOUBLE) / CAST(b.cw - a.cw + a.w AS DOUBLE) AS mean FROM c a JOIN c b ON a.model = b.model AND a.i <= b.i),
    low AS (SELECT model, j, k, min(mean) OVER (PARTITION BY model, j ORDER BY k DESC) AS mean FROM m),
    fit AS (SELECT model, k AS i, max(mean) AS value FROM low GROUP BY 1, 2)
    SELECT model, min(p) AS low, max(p) AS high, round(value, 6) AS value, CAST(sum(s) AS BIGINT) AS total, CAST(sum(w) AS BIGINT) AS weight
    FROM fit JOIN c USING (model, i) GROUP BY model, value"""
)
def isotonic_calibration_steps(t):
    """Isotonic regression of outcome on score for every model over all scored rows."""
    return B.round_all(isotonic_steps(B.scores(t), ["model"], "p", "y", block=256), keep=("low", "high"))


@query()
def calibration_kept(t):
    rows, models = fitted(t)
    val = L.cut_lineage(L.score(models, rows, KEY).filter("split = 'val'"))
    calibrated = L.cut_lineage(L.calibrate(val, L.calibrators(val)))
    report = lambda s: L.three_way_report(s)
    return L.keep_calibration(report(val), report(calibrated))


@query(
    f"""WITH {B.LABELLED}, c AS (SELECT "Fire_Occurred" AS y, count(*) AS n FROM panel GROUP BY 1)
    SELECT CAST(y AS INTEGER) AS y, CAST(fold AS INTEGER) AS fold, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS n
    FROM c, (SELECT unnest(range(5)) AS fold) WHERE n > fold"""
)
def stratified_fold_counts(t):
    """Rows of each class in each of five stratified folds."""
    rows = B.labelled_daily(t).select("City", "Date", F.col("Fire_Occurred").cast("int").alias("y"))
    return L.stratified_folds(rows, ["City", "Date"], 5).groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"))


@query()
def stacked_ensemble(t):
    rows = L.cut_lineage(frame(t))
    folds, meta = L.stack(rows.filter("split = 'train'"), INPUTS, NAMES[:2], ["City", "Date"], scale=SMALL)
    scores = L.stacked_scores(rows.filter("split <> 'train'"), folds, meta, KEY)
    return E.areas(L.cut_lineage(scores), ["split"])


@query()
def parameter_search(t):
    rows = L.cut_lineage(frame(t))
    trials = L.random_trials({"maxIter": (3, 5), "maxDepth": (3, 4, 5), "stepSize": (0.05, 0.1, 0.2)}, 4)
    return L.search(rows.filter("split = 'train'"), rows.filter("split = 'val'"), INPUTS, trials)


@query()
def importance_table(t):
    _, models = fitted(t, ["random_forest"])
    return L.feature_importance(models["random_forest"], INPUTS)


@query()
def importance_by_permutation(t):
    rows, models = fitted(t, ["random_forest"])
    return L.permutation_importance(models["random_forest"], rows.filter("split = 'test'"), INPUTS, ["City", "Date"])


@query()
def weather_regressor_report(t):
    """Pooled regressors of the daily temperature, judged on the last 30 days."""
    rows = L.cut_lineage(G.origin_features(B.weather_daily(t).select("City", "Date", "Temperature_C_mean"), DAILY, "Temperature_C_mean"))
    known = rows.select("City", "Date", "Temperature_C_mean", *[F.lag(c, 1).over(DAILY.window()).alias(c) for c in ("lag_1", "lag_2", "lag_7", "roll_7_mean")])
    last = known.agg(F.max("Date").alias("m")).scalar()
    cut = F.date_sub(last, 30)
    inputs = ["lag_1", "lag_2", "lag_7", "roll_7_mean"]
    models = L.fit_regressors(known.filter(F.col("Date") <= cut), inputs, "Temperature_C_mean", ["ridge", "elastic_net", "random_forest", "boosting"], scale=SMALL)
    out = L.predict(models, known.filter(F.col("Date") > cut), ["City", "Date", F.col("Temperature_C_mean").alias("actual")])
    return E.regression_report(out, ["model"])


# ------------------------------------------------------------------- forecasting

TARGETS = list(DAILY_WEATHER)


@query()
def seasonal_residual_features(t):
    return G.seasonal_residuals(B.weather_daily(t), DAILY, TARGETS)


@query()
def seasonal_forecast_daily(t):
    return G.seasonal_forecast(B.weather_daily(t), DAILY, DAILY_WEATHER)


@query(
    f"""WITH {B.WEATHER}, x AS (SELECT "City", CAST(date_diff('day', DATE '2000-01-01', "Date") AS DOUBLE) / 3652.5 AS d, "Temperature_C_mean" AS v FROM weather),
    c AS (SELECT "City", regr_slope(v, d) AS b, regr_intercept(v, d) AS a, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 60)
    SELECT "City", round(a, 4) AS a, round(b, 4) AS b FROM c"""
)
def seasonal_trend_only(t):
    """The normal-equation solver without seasonal terms is the ordinary regression line."""
    long = B.weather_daily(t).select("City", "Date", F.lit("T").alias("variable"), F.col("Temperature_C_mean").alias("value"))
    fitted_ = G.fit_seasonal(long, G.design("Date", yearly=0, weekly=0))
    return fitted_.select("City", F.round(F.col("beta")[0], 4).alias("a"), F.round(F.col("beta")[1], 4).alias("b"))


def _hourly_terms(h: str) -> list[str]:
    """The terms of ``forecast.hourly_design`` in SQL."""
    turns = [f"{f}({2 * math.pi * k / period!r} * {h})" for period, order in ((24.0, 3), (168.0, 2), (8766.0, 3)) for k in range(1, order + 1) for f in ("sin", "cos")]
    return ["1.0::DOUBLE", f"{h} / 8766.0::DOUBLE", *turns]


_TERMS = len(_hourly_terms("h"))


@query(
    f"""WITH {B.STATIONS_HOURLY}, long AS ({" UNION ALL ".join(f"""SELECT "City", '{v}' AS variable, CAST(date_diff('hour', TIMESTAMP '2024-01-01', "Timestamp") AS DOUBLE) AS h, "{v}" AS y FROM stations""" for v in HOURLY_VARIABLES)}),
    x AS (SELECT "City", variable, y, {", ".join(f"{e} AS x{i}" for i, e in enumerate(_hourly_terms("h")))} FROM long WHERE y IS NOT NULL)
    SELECT "City", variable, count(*) AS n, {", ".join(f"round(sum(x{i} * x{j}), 4) AS g{i}_{j}" for i in range(_TERMS) for j in range(i, _TERMS))},
      {", ".join(f"round(sum(x{i} * y), 4) AS m{i}" for i in range(_TERMS))} FROM x GROUP BY 1, 2"""
)
def seasonal_sums_hourly(t):
    """The normal equations that ``seasonal_forecast_hourly`` solves, of all nine variables at every station."""
    rows = lengthen(B.stations_hourly(t), HOURLY.key, HOURLY_VARIABLES)
    sums = G.seasonal_sums(rows, G.hourly_design(G.hours_since("Timestamp"), yearly=3))
    return sums.select("City", "variable", "n", *[F.round(c, 4).alias(c) for c in sums.columns[3:]])


@query()
def seasonal_fit_hourly(t):
    """How well the hourly seasonal fit follows all nine variables, by station."""
    rows = lengthen(B.stations_hourly(t), HOURLY.key, HOURLY_VARIABLES)
    terms = G.hourly_design(G.hours_since("Timestamp"), yearly=3)
    done = G.apply_seasonal(rows, G.fit_seasonal(rows, terms, min_rows=720), terms)
    return E.regression_report(done.select("City", "variable", F.col("value").alias("actual"), F.col("pred").alias("predicted")), ["City", "variable"])


@query()
def seasonal_forecast_hourly(t):
    """Every hourly variable 336 hours ahead."""
    return G.seasonal_forecast_hourly(B.stations_hourly(t), HOURLY, HOURLY_VARIABLES)


@query()
def autoregressive_hourly(t):
    """The next 336 hours of each hourly target from lags of up to a week, long."""
    hourly = L.cut_lineage(B.weather_hourly(t).select("City", "Timestamp", *HOURLY_TARGETS))
    out = []
    for target in HOURLY_TARGETS:
        model = G.fit_direct(hourly, HOURLY, target, horizons=(1, 6, 24, 48, 72, 168, 336), trees=TREES, cadence=G.BY_HOUR)
        ahead = G.forecast_direct(hourly, HOURLY, target, model, days=336, cadence=G.BY_HOUR)
        out.append(ahead.select("City", "Timestamp", F.lit(target).alias("variable"), F.col(target).alias("value")))
    return reduce(DataFrame.unionAll, out)


@query()
def autoregressive_direct(t):
    daily = L.cut_lineage(B.weather_daily(t).select("City", "Date", "Temperature_C_mean"))
    return G.forecast_direct(daily, DAILY, "Temperature_C_mean", G.fit_direct(daily, DAILY, "Temperature_C_mean", trees=TREES))


@query()
def autoregressive_recursive(t):
    daily = L.cut_lineage(B.weather_daily(t).select("City", "Date", "Temperature_C_mean"))
    return G.forecast_recursive(daily, DAILY, "Temperature_C_mean", G.fit_one_step(daily, DAILY, "Temperature_C_mean", trees=TREES))


@query(
    f"""WITH {B.WEATHER}, p AS (SELECT "City", "Date", "Temperature_C_mean" * 2 AS a, "Soil_Temp_C_mean" AS b FROM weather),
    lim AS (SELECT max("Date") AS m FROM weather WHERE "Date" < DATE '2001-01-01')
    SELECT "City", "Date", round(least(greatest(0.75 * a + 0.25 * b, -60), 60), 6) AS "Temperature_C_mean" FROM p, lim WHERE "Date" > m"""
)
def blended_forecast_bounds(t):
    daily = B.weather_daily(t)
    pairs = daily.select("City", "Date", (F.col("Temperature_C_mean") * 2).alias("a"), F.col("Soil_Temp_C_mean").alias("b"))
    weights = daily.select("City").distinct().withColumn("weight", F.lit(0.75))
    actual = daily.filter(F.col("Date") < F.lit("2001-01-01").cast("date"))
    return B.round_all(G.blended_forecast(pairs, weights, actual, DAILY, "Temperature_C_mean"))


# ------------------------------------------------------------------ landed payloads


@query(
    f"""WITH {B.HOURLY} SELECT "City", "Timestamp", round("Temperature_C", 6) AS "Temperature_C", round("Rain_mm", 6) AS "Rain_mm", round("Soil_Moisture", 6) AS "Soil_Moisture" FROM hourly"""
)
def payload_to_rows(t):
    """Hourly rows packed into one JSON document per station and day, then read back."""
    hourly = B.weather_hourly(t)
    item = F.struct(F.date_format("Timestamp", "yyyy-MM-dd'T'HH:mm").alias("time"), *[F.col(n).alias(a) for a, n in API_NAMES.items()])
    days = hourly.groupBy("City", F.to_date("Timestamp").alias("d")).agg(F.sort_array(F.collect_list(item)).alias("h"))
    arrays = F.struct(*[F.col(f"h.{a}").alias(a) for a in ("time", *API_NAMES)])
    documents = days.select("City", F.to_json(F.struct(arrays.alias("hourly"))).alias("payload"))
    out = explode_payload(documents)
    return B.round_all(out.select("City", "Timestamp", "Temperature_C", "Rain_mm", "Soil_Moisture"))


@query(
    """WITH d AS (SELECT event_type AS "City", CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT "City", CAST(day AS TIMESTAMP) + to_hours(CAST(i AS INTEGER)) AS "Timestamp", CAST(n + i AS DOUBLE) AS v FROM d, (SELECT unnest(generate_series(0, 23)) AS i)"""
)
def axis_to_rows(t):
    """Values on a half-open axis given by start, end and step."""
    days = t.events.groupBy(F.col("event_type").alias("City"), F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    start = F.datediff("d", F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    blocks = days.select(
        "City",
        start.alias("start"),
        (start + 86400).alias("end"),
        F.lit(3600).cast("bigint").alias("step"),
        F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: (F.col("n") + i).cast("double")).alias("v"),
    )
    return explode_axis(blocks, ["v"])


@query("""SELECT event_type AS "City", date_trunc('day', min(ts)) AS "first", count(*) AS n FROM events GROUP BY 1""")
def pruned_scan(t):
    """Reads two columns of the event table."""
    return t.events.groupBy(F.col("event_type").alias("City")).agg(F.to_date(F.min("ts")).cast("timestamp_ntz").alias("first"), F.count(F.lit(1)).alias("n"))


