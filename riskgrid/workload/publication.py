"""Published tables, quality checks, climate report and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrid.operators import evaluate as E
from riskgrid.operators import quality as Q
from riskgrid.plans import climate as C
from riskgrid.plans import dashboard as D
from riskgrid.plans import publish as U
from riskgrid.workload import binding as B
from riskgrid.workload.columns import SENTENCE_SQL
from riskgrid.workload.evaluation import REPORT, report
from riskgrid.workload.evaluation import WINNER, winner_scores
from riskgrid.workload.registry import query

# ----------------------------------------------------------------- public tables


def scored_daily(t):
    """Daily weather with a probability and outdated coordinates."""
    risk = B.daily_risk(t)
    stale = B.weather_daily(t).withColumns({"Latitude": F.lit(0.0), "Longitude": F.lit(0.0)})
    return stale.join(risk, ["City", "Date"])


PUBLIC_DAILY = f"""{B.WEATHER}, {B.DAILY_RISK}, {B.PLACE_TABLE}, sc AS (SELECT w.*, p.probability, {B.tier_sql('p.probability')} AS risk_level,
      "Temperature_C_mean" AS t, "Wind_Speed_kmh_mean" AS w, "Humidity_percent_mean" AS h, "Rain_mm_sum" AS r FROM weather w JOIN daily_risk p USING ("City", "Date")),
    daily_public AS (SELECT strftime("Date", '%Y-%m-%d') AS date, "City" AS region, risk_level, probability, greatest(least(0.55 + 0.8 * abs(probability - 0.5), 0.95), 0.55) AS confidence,
      probability * 100 AS risk_score, CAST(probability >= 0.44 AS INTEGER) AS predicted_fire, t AS temperature, w AS wind, h AS humidity, r AS rain, "Temperature_C_mean", "Humidity_percent_mean", "Rain_mm_sum",
      "Wind_Speed_kmh_mean", "Pressure_hPa_mean", "Solar_Radiation_Wm2_mean", "Soil_Temp_C_mean", "Soil_Moisture_mean", "Latitude", "Longitude",
      concat_ws(', ', CASE WHEN t >= 28 THEN 'hot conditions' WHEN t <= 12 THEN 'cool conditions' ELSE 'mild temperatures' END,
        CASE WHEN w >= 18 THEN 'strong wind' END, CASE WHEN h <= 40 THEN 'dry air' END, CASE WHEN r >= 2 THEN 'recent rainfall' END) AS s,
      CASE WHEN risk_level IN ('High', 'Extreme') THEN 'High temperature, dry air, and wind can accelerate wildfire spread.' WHEN w >= 18 THEN 'Wind is elevated, so small ignitions could spread faster.'
        WHEN h <= 40 THEN 'Low humidity can dry vegetation and raise ignition sensitivity.' ELSE 'Current conditions suggest limited short-term wildfire pressure.' END AS warning,
      CASE risk_level WHEN 'Low' THEN '#3FA773' WHEN 'Moderate' THEN '#D8A31D' WHEN 'High' THEN '#D96C3B' ELSE '#B73333' END AS risk_color FROM sc JOIN places USING ("City"))"""

#: One digit of a percentage: the shortest decimal text of the number, rounded half up, as Spark rounds.
ONE_DIGIT = "CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), 1) AS DOUBLE)"
#: Columns published with few digits: compared as published.
_PUBLISHED = ("risk_score", "temperature", "wind", "humidity", "rain")


def daily_public(t):
    return U.publish_daily(scored_daily(t), B.places(t), threshold=0.44)


@query(
    f"""WITH {PUBLIC_DAILY} SELECT date, region, risk_level, round(probability, 6) AS probability, round(confidence, 6) AS confidence, predicted_fire,
      {ONE_DIGIT.format(x="risk_score")} AS risk_score, round(temperature, 1) AS temperature, round(wind, 1) AS wind, round(humidity, 1) AS humidity, round(rain, 2) AS rain,
      round("Humidity_percent_mean", 6) AS "Humidity_percent_mean", round("Rain_mm_sum", 6) AS "Rain_mm_sum", round("Wind_Speed_kmh_mean", 6) AS "Wind_Speed_kmh_mean",
      round("Solar_Radiation_Wm2_mean", 6) AS "Solar_Radiation_Wm2_mean", round("Soil_Temp_C_mean", 6) AS "Soil_Temp_C_mean",
      round("Temperature_C_mean", 6) AS "Temperature_C_mean", round("Pressure_hPa_mean", 6) AS "Pressure_hPa_mean", round("Soil_Moisture_mean", 6) AS "Soil_Moisture_mean",
      round("Latitude", 6) AS "Latitude", round("Longitude", 6) AS "Longitude", {SENTENCE_SQL} AS climate_summary, warning, risk_color FROM daily_public"""
)
def public_daily(t):
    return B.round_all(daily_public(t), keep=_PUBLISHED)


STATIONS = """stations AS (SELECT event_type AS "City", CAST(min(event_id) AS DOUBLE) / 4 AS "Latitude", CAST(max(user_id) AS DOUBLE) / 4 AS "Longitude" FROM events GROUP BY 1)"""


def stations(t):
    return t.events.groupBy(F.col("event_type").alias("City")).agg(
        (F.min("event_id") / 4).alias("Latitude"), (F.max("user_id") / 4).alias("Longitude")
    )


PUBLIC_HOURLY = f"""{B.STATION_RISK}, {STATIONS}, hw AS (SELECT "City", date_trunc('hour', "Timestamp") AS "Timestamp", max("Temperature_C") AS "Temperature_C", max("Humidity_percent") AS "Humidity_percent"
      FROM hreadings GROUP BY 1, 2), cp AS (SELECT h."City", h."Timestamp", CASE WHEN d.probability IS NULL THEN h.probability ELSE least(h.probability, greatest(d.probability * 2.5, 0.15)) END AS probability
      FROM station_hourly h LEFT JOIN station_daily d ON d."City" = h."City" AND d."Date" = CAST(h."Timestamp" AS DATE)),
    hourly_public AS (SELECT strftime("Timestamp", '%Y-%m-%dT%H:%M') AS "timestamp", "City" AS region, probability, {B.tier_sql('probability')} AS risk_level,
      CAST(probability >= 0.58 AS INTEGER) AS predicted_fire, greatest(least(0.55 + 0.8 * abs(probability - 0.5), 0.95), 0.55) AS confidence, "Temperature_C" AS temperature, "Humidity_percent" AS humidity,
      "Latitude", "Longitude" FROM cp JOIN hw USING ("City", "Timestamp") JOIN stations USING ("City"))"""


def hourly_public(t):
    weather = B.hourly_readings(t).groupBy("City", B.floor_hour("Timestamp").alias("Timestamp")).agg(
        F.max("Temperature_C").alias("Temperature_C"), F.max("Humidity_percent").alias("Humidity_percent")
    )
    scored = B.station_risk_hourly(t).join(weather, ["City", "Timestamp"])
    return U.publish_hourly(scored, stations(t), threshold=0.58, daily=B.station_risk_daily(t))


@query(
    f"""WITH {PUBLIC_HOURLY} SELECT "timestamp", region, round(probability, 6) AS probability, risk_level, predicted_fire, round(confidence, 6) AS confidence, round(humidity, 1) AS humidity,
      {ONE_DIGIT.format(x="probability * 100")} AS risk_score, round(temperature, 1) AS temperature, round("Latitude", 6) AS "Latitude", round("Longitude", 6) AS "Longitude",
      CASE risk_level WHEN 'Low' THEN '#3FA773' WHEN 'Moderate' THEN '#D8A31D' WHEN 'High' THEN '#D96C3B' ELSE '#B73333' END AS risk_color FROM hourly_public"""
)
def public_hourly(t):
    return B.round_all(hourly_public(t), keep=_PUBLISHED)


@query(
    f"""WITH {B.DAILY_RISK} SELECT "City", "Date", round(probability, 6) AS fire_probability, CAST(probability >= 0.44 AS INTEGER) AS fire_predicted, {B.tier_sql('probability', right=True)} AS risk_level
    FROM daily_risk ORDER BY probability DESC, "City", "Date" LIMIT 10"""
)
def top_daily_risks(t):
    risk = U.score_horizon(B.daily_risk(t), F.col("probability"), 0.44, ["City", "Date"])
    return B.round_all(U.top_risks(risk))


@query(
    f"""WITH {B.SCORES}, {REPORT}, b AS (SELECT model, recall, precision, f1, pr_auc FROM f JOIN areas USING (model, split) WHERE split = 'val'), chosen AS (SELECT model FROM b ORDER BY f1 DESC, model LIMIT 1)
    SELECT (SELECT model FROM chosen) AS selected_model, 0.5::DOUBLE AS selected_threshold, CAST(30 AS INTEGER) AS prediction_horizon_days, '< 1999-01-01' AS train, '15% to 35%' AS moderate, b.model AS model, round(recall, 6) AS recall FROM b"""
)
def metrics_document(t):
    val = report(t).filter("split = 'val'")
    chosen = val.orderBy(F.desc("f1"), "model").limit(1).select("model", F.lit(0.5).alias("threshold"))
    doc = U.metrics_document(val, chosen, ("1999-01-01", "2000-01-01"), 184, 30, chosen)
    # written and read back as JSON text, as a consumer would see it
    text = doc.select(F.to_json(F.struct("*")).alias("j"))
    back = text.select(F.from_json("j", doc.schema).alias("d")).select("d.*")
    flat = back.select(
        "selected_model",
        "selected_threshold",
        "prediction_horizon_days",
        F.col("temporal_split.train").alias("train"),
        F.col("risk_levels.Moderate").alias("moderate"),
        F.explode("leaderboard").alias("l"),
    )
    return B.round_all(flat.select("*", "l.model", "l.recall").drop("l"))


@query(
    f"""WITH {B.SCORES}, {WINNER}, c2 AS (SELECT any_value(model) AS model, CAST(count(*) FILTER (p >= 0.5 AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (p >= 0.5 AND y = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (p < 0.5 AND y = 1) AS DOUBLE) AS fn,
      CAST(count(*) FILTER (p < 0.5 AND y = 0) AS DOUBLE) AS tn FROM won)
    SELECT model, 0.5::DOUBLE AS threshold, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, CAST(tp AS BIGINT) AS true_positives, CAST(fp AS BIGINT) AS false_positives,
      CAST(fn AS BIGINT) AS false_negatives, CAST(tn AS BIGINT) AS true_negatives, CAST(tp + fp + fn + tn AS BIGINT) AS test_samples, round((tp + fn) / (tp + fp + fn + tn), 6) AS fire_rate FROM c2"""
)
def final_metrics(t):
    rows = winner_scores(t)
    c = E.rates(E.count_outcomes(rows, ["model"], F.col("p") >= 0.5))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return B.round_all(
        c.select(
            "model",
            F.lit(0.5).alias("threshold"),
            "recall",
            "precision",
            F.col("tp").alias("true_positives"),
            F.col("fp").alias("false_positives"),
            F.col("fn").alias("false_negatives"),
            F.col("tn").alias("true_negatives"),
            n.alias("test_samples"),
            ((F.col("tp") + F.col("fn")) / n).alias("fire_rate"),
        )
    )


@query(
    f"""WITH {B.SCORES}, {WINNER} SELECT row_order, row_line, "City" AS city, CAST(month("Date") AS INTEGER) AS month, CAST(y AS INTEGER) AS y_true, CAST(p >= 0.5 AS INTEGER) AS y_pred, p AS probability FROM won"""
)
def final_predictions(t):
    rows = winner_scores(t)
    return rows.select(
        "row_order",
        "row_line",
        F.col("City").alias("city"),
        F.month("Date").alias("month"),
        F.col("y").alias("y_true"),
        (F.col("p") >= 0.5).cast("int").alias("y_pred"),
        F.col("p").alias("probability"),
    )


# ----------------------------------------------------------------- quality checks


CHECK_SQL = f"""WITH {B.WEATHER}, {B.PLACE_TABLE}, {B.DAILY_RISK}, cp AS (SELECT * FROM places)
    SELECT 'daily:columns' AS name, true AS passed, '' AS detail
    UNION ALL SELECT 'daily:no_such_column', false, 'EVI'
    UNION ALL SELECT 'daily:places', count(*) = 0, printf('%d missing', count(*)) FROM cp WHERE "City" NOT IN (SELECT "City" FROM weather)
    UNION ALL SELECT 'daily:nulls', sum(n) = 0, printf('%d null cells', CAST(sum(n) AS BIGINT)) FROM (SELECT CAST("Rain_mm_sum" IS NULL AS INTEGER) + CAST("Temperature_C_mean" IS NULL AS INTEGER) AS n FROM weather)
    UNION ALL SELECT 'daily:Temperature_C_mean', count(*) = 0, printf('%d outside', count(*)) FROM weather WHERE "Temperature_C_mean" < -60 OR "Temperature_C_mean" > 60
    UNION ALL SELECT 'daily:Rain_mm_sum', count(*) = 0, printf('%d outside', count(*)) FROM weather WHERE "Rain_mm_sum" * 100 < 0 OR "Rain_mm_sum" * 100 > 500
    UNION ALL SELECT 'raw:key', sum(n - 1) = 0, printf('%d duplicates', CAST(sum(n - 1) AS BIGINT)) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    UNION ALL SELECT 'daily:key', true, '0 duplicates'
    UNION ALL SELECT 'risk:range', min(probability) >= 0 AND max(probability) <= 1, printf('min=%.4f max=%.4f', min(probability), max(probability)) FROM daily_risk
    UNION ALL SELECT 'risk:tiers', true, '0 unknown'
    UNION ALL SELECT 'priority:tiers', false, printf('%d unknown', count(*)) FROM orders"""


@query(CHECK_SQL)
def quality_checks(t):
    daily, risk = B.weather_daily(t), B.daily_risk(t)
    scaled = daily.select("Temperature_C_mean", (F.col("Rain_mm_sum") * 100).alias("Rain_mm_sum"))
    checks = [
        Q.columns_present(daily, ["City", "Date", "Rain_mm_sum"], "daily:columns"),
        Q.columns_present(daily, ["City", "EVI"], "daily:no_such_column"),
        Q.entities_present(daily, B.places(t), "daily:places"),
        Q.no_nulls(daily.select("Rain_mm_sum", "Temperature_C_mean"), "daily:nulls"),
        Q.within_bounds(scaled, "daily"),
        Q.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"], "raw:key"),
        Q.unique_key(daily, ["City", "Date"], "daily:key"),
        Q.probability_range(risk, "probability", "risk:range"),
        Q.known_tiers(risk.withColumn("risk_level", B.risk_tier("probability")), "risk_level", "risk:tiers"),
        Q.known_tiers(t.orders, "o_orderpriority", "priority:tiers"),
    ]
    return Q.run_all(checks)


@query(f"""WITH k AS ({CHECK_SQL}) SELECT count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM k""")
def quality_summary(t):
    return Q.summary(quality_checks(t))


@query(
    f"""WITH {B.LABELLED} SELECT 'leakage:leak_columns' AS name, true AS passed, 'fire_count' AS detail UNION ALL SELECT 'leakage:shifted_features', true, '1 features'
    UNION ALL SELECT 'leakage:split', count(*) FILTER ("Date" < DATE '2000-01-01') > 0 AND count(*) FILTER ("Date" >= DATE '2000-01-01') > 0,
      printf('train=%d test=%d', count(*) FILTER ("Date" < DATE '2000-01-01'), count(*) FILTER ("Date" >= DATE '2000-01-01')) FROM panel"""
)
def leakage_checks(t):
    panel = B.labelled_daily(t).select("City", "Date", F.col("Fire_Occurred").alias("fire_count"), F.col("Rain_mm_sum").alias("Rain_mm_sum_lag1"))
    return Q.leakage(panel, "2000-01-01")


@query(
    """SELECT 'records' AS name, count(*) > 0 AND count(*) FILTER (props IS NULL) = 0 AS passed, printf('%d records, %d nulls', count(*), count(*) FILTER (NOT regexp_matches(props, '"k": ?[0-9]+'))) AS detail FROM events
    UNION ALL SELECT 'datasets', count(*) FILTER (n < mean) = 0, printf('%d missing', count(*) FILTER (n < mean)) FROM (SELECT count(*) AS n, avg(count(*)) OVER () AS mean FROM events GROUP BY event_type) UNION ALL SELECT 'manifest', true, '0 null cells'"""
)
def record_and_artefact_checks(t):
    records = t.events.select(F.from_json("props", "k int").alias("r"), "event_id").select("r.k", "event_id")
    sizes = t.events.groupBy(F.col("event_type").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    expected, listing = sizes, sizes.filter(F.col("n") >= sizes.agg(F.avg("n").alias("m")).scalar())
    manifest = t.orders.agg(F.max("o_orderstatus").alias("model"), F.max("o_totalprice").alias("threshold"))
    return Q.run_all(
        [
            Q.records_valid(records, ["k", "event_id"], "records"),
            Q.datasets_exist(expected, listing, "datasets"),
            Q.manifest_complete(manifest, ["model", "threshold"], "manifest"),
        ]
    )


CONSISTENCY = f"""{B.STATION_RISK}, ha AS (SELECT "City", CAST("Timestamp" AS DATE) AS "Date", max(probability) AS hourly_max, avg(probability) AS hourly_mean FROM station_hourly GROUP BY 1, 2),
    rep AS (SELECT "City", "Date", d.probability AS daily_prob, hourly_max, hourly_mean, abs(hourly_max - d.probability) AS disagreement, coalesce(abs(hourly_max - d.probability) > 0.35, false) AS mismatch_flag,
      CASE WHEN d.probability IS NOT NULL THEN {B.tier_sql('d.probability', right=True)} END AS daily_risk_level, {B.tier_sql('hourly_max', right=True)} AS hourly_max_risk_level FROM station_daily d JOIN ha USING ("City", "Date"))"""


def consistency(t):
    return Q.consistency_report(B.station_risk_daily(t), B.station_risk_hourly(t))


@query(
    f"""WITH {CONSISTENCY} SELECT "City", "Date", round(daily_prob, 6) AS daily_prob, round(hourly_max, 6) AS hourly_max, round(hourly_mean, 6) AS hourly_mean, round(disagreement, 6) AS disagreement, mismatch_flag,
      daily_risk_level, hourly_max_risk_level FROM rep"""
)
def consistency_report(t):
    return B.round_all(consistency(t))


@query(
    f"""WITH {CONSISTENCY} SELECT 'consistency:daily_hourly_agreement' AS name, count(*) FILTER (mismatch_flag) / count(*) <= 0.20 AS passed, printf('%d/%d over the limit', count(*) FILTER (mismatch_flag), count(*)) AS detail FROM rep"""
)
def consistency_check(t):
    return Q.consistency_check(consistency(t))


@query(f"""WITH {CONSISTENCY} SELECT "City", "Date", round(disagreement, 6) AS disagreement FROM rep ORDER BY rep.disagreement DESC, "City", "Date" LIMIT 20""")
def worst_disagreements(t):
    return B.round_all(Q.worst_disagreements(consistency(t)).select("City", "Date", "disagreement"))


# ------------------------------------------------------------------ climate report

RISK = f"""{B.LABELLED}, {B.DAILY_RISK}, hist AS (SELECT * FROM panel WHERE "Date" < DATE '2001-10-01'),
    risk AS (SELECT "City", "Date", "Temperature_C_mean", probability AS fire_probability FROM panel JOIN daily_risk USING ("City", "Date") WHERE "Date" >= DATE '2001-10-01'),
    bd AS (SELECT min("Date") AS lo, max("Date") AS hi FROM risk), ly AS (SELECT hist.* FROM hist, bd WHERE "Date" BETWEEN lo - INTERVAL 1 YEAR AND hi - INTERVAL 1 YEAR),
    dec AS (SELECT * FROM hist WHERE year("Date") BETWEEN 1995 AND 1999 AND month("Date") IN (SELECT month("Date") FROM risk))"""


def risk_and_history(t):
    panel = B.labelled_daily(t)
    cut = F.lit("2001-10-01").cast("date")
    risk = panel.filter(F.col("Date") >= cut).join(B.daily_risk(t), ["City", "Date"])
    risk = risk.select("City", "Date", "Temperature_C_mean", F.col("probability").alias("fire_probability"))
    return risk, panel.filter(F.col("Date") < cut)


COMPARE = """SELECT "City", round(f, 6) AS "Forecast", round(o, 6) AS "{n}", round(f - o, 6) AS "{d}" FROM (SELECT "City", avg("Temperature_C_mean") AS f FROM risk GROUP BY 1)
    JOIN (SELECT "City", avg("Temperature_C_mean") AS o FROM {s} GROUP BY 1) USING ("City")"""


@query(f"WITH {RISK} " + COMPARE.format(n="LastYear", d="Diff", s="ly"))
def forecast_vs_last_year(t):
    risk, history = risk_and_history(t)
    return B.round_all(C.compare_means(risk, C.same_dates_last_year(history, risk), "Temperature_C_mean", "LastYear", "Diff"))


@query(
    f"""WITH {RISK}, c AS (SELECT f - o AS d FROM (SELECT "City", avg("Temperature_C_mean") AS f FROM risk GROUP BY 1) JOIN (SELECT "City", avg("Temperature_C_mean") AS o FROM ly GROUP BY 1) USING ("City"))
    SELECT count(*) FILTER (d > 0) AS hotter, count(*) AS places, round(avg(d), 6) AS mean_diff FROM c"""
)
def hotter_than_last_year(t):
    risk, history = risk_and_history(t)
    return B.round_all(C.hotter_share(C.compare_means(risk, C.same_dates_last_year(history, risk), "Temperature_C_mean", "LastYear", "Diff")))


@query(f"WITH {RISK} " + COMPARE.format(n="Decade", d="Anomaly", s="dec"))
def forecast_vs_decade(t):
    risk, history = risk_and_history(t)
    return B.round_all(C.compare_means(risk, C.same_months(history, risk, (1995, 1999)), "Temperature_C_mean", "Decade", "Anomaly"))


SIGNALS = """sig AS (SELECT year("Date") AS yr, avg("Temperature_C_mean") AS temperature, CAST(count(*) FILTER ("Temperature_C_max" > 33) AS DOUBLE) AS hot_days,
      sum("Rain_mm_sum") / count(DISTINCT "City") AS rain, CAST(sum("Fire_Occurred") AS DOUBLE) AS events FROM {s} GROUP BY 1)"""
TREND = " UNION ALL ".join(
    f"""SELECT '{n}' AS signal, round(regr_slope({n}, yr), 6) AS slope FROM sig""" for n in ("temperature", "hot_days", "rain", "events")
)


@query(f"WITH {B.LABELLED}, {SIGNALS.format(s='panel')} {TREND}")
def climate_trends(t):
    return B.round_all(C.climate_trends(B.labelled_daily(t), hot_above=33).drop("intercept"))


@query(f"""WITH {B.LABELLED}, whole AS (SELECT * FROM panel WHERE year("Date") BETWEEN 1996 AND 2000), {SIGNALS.format(s='whole')} {TREND}""")
def climate_trends_complete_years(t):
    return B.round_all(C.climate_trends(B.labelled_daily(t), hot_above=33, complete_years_only=True).drop("intercept"))


RISKCMP = """rc AS (SELECT "City", f, l, d FROM (SELECT "City", avg(fire_probability) AS f FROM risk GROUP BY 1) JOIN (SELECT "City", avg("Fire_Occurred") AS l FROM ly GROUP BY 1) USING ("City")
    JOIN (SELECT "City", avg("Fire_Occurred") AS d FROM dec GROUP BY 1) USING ("City"))"""


@query(
    f"""WITH {RISK}, {RISKCMP} SELECT "City", round(f, 6) AS "Forecast_Risk", round(l, 6) AS "LastYear", round(d, 6) AS "Decade", round(f - l, 6) AS "vs_LY", round(f - d, 6) AS "vs_Dec" FROM rc"""
)
def risk_vs_history(t):
    return B.round_all(C.risk_comparison(*risk_and_history(t), (1995, 1999)))


@query(f"""WITH {RISK}, {RISKCMP} SELECT "City", round(f - l, 6) AS "vs_LY" FROM rc ORDER BY f - l DESC, "City" LIMIT 5""")
def largest_risk_increases(t):
    table = C.risk_comparison(*risk_and_history(t), (1995, 1999))
    return B.round_all(C.largest(table, "vs_LY").select("City", "vs_LY"))


@query(
    f"""WITH {RISK}, {RISKCMP} SELECT "City", round(f * 100, 1) + 0.0::DOUBLE AS "Risk_%", round((f - l) * 100, 1) + 0.0::DOUBLE AS "vs_LY_%",
      round((f - d) * 100, 1) + 0.0::DOUBLE AS "vs_Dec_%" FROM rc"""
)
def climate_summary_table(t):
    return C.summary_table(C.risk_comparison(*risk_and_history(t), (1995, 1999)))


# ----------------------------------------------------------------------- dashboard

SHOW = "date, region, risk_level, round(probability, 6) AS probability"


def shown(df):
    return B.round_all(df.select("date", "region", "risk_level", "probability"))


@query(f"""WITH {PUBLIC_DAILY} SELECT {SHOW} FROM daily_public WHERE region = 'NATION_7' AND date = coalesce((SELECT date FROM daily_public WHERE region = 'NATION_7' AND date = '1999-06-15'), (SELECT min(date) FROM daily_public WHERE region = 'NATION_7'))""")
def dashboard_point(t):
    return shown(D.point_lookup(D.usable(daily_public(t)), "NATION_7", "1999-06-15"))


@query(f"""WITH {PUBLIC_DAILY} SELECT {SHOW} FROM daily_public WHERE region = 'NATION_7' AND date = (SELECT min(date) FROM daily_public WHERE region = 'NATION_7')""")
def dashboard_point_fallback(t):
    return shown(D.point_lookup(D.usable(daily_public(t)), "NATION_7", "2030-01-01"))


@query(f"""WITH {PUBLIC_DAILY} SELECT {SHOW} FROM daily_public WHERE date = '1999-06-15'""")
def dashboard_map(t):
    return shown(D.map_snapshot(D.usable(daily_public(t)), "1999-06-15"))


@query(f"""WITH {PUBLIC_HOURLY} SELECT region, "timestamp", risk_level FROM hourly_public QUALIFY row_number() OVER (PARTITION BY region ORDER BY "timestamp") = 1""")
def dashboard_first_hours(t):
    return D.first_hours(hourly_public(t)).select("region", "timestamp", "risk_level")


@query(f"""WITH {PUBLIC_DAILY} SELECT {SHOW} FROM daily_public WHERE region = 'NATION_3' AND risk_level = 'High'""")
def dashboard_table(t):
    return shown(D.table_view(D.usable(daily_public(t)), region="NATION_3", tier="High"))


@query(f"""WITH {PUBLIC_DAILY} SELECT DISTINCT date FROM daily_public""")
def dashboard_dates(t):
    return D.distinct_dates(daily_public(t))


@query(f"""WITH {PUBLIC_DAILY} SELECT DISTINCT region FROM daily_public""")
def dashboard_regions(t):
    return D.distinct_regions(daily_public(t))


@query(f"""WITH {PUBLIC_DAILY} SELECT {SHOW} FROM daily_public WHERE region = 'NATION_3'""")
def dashboard_series(t):
    return shown(D.region_series(D.usable(daily_public(t)), "NATION_3"))


@query(f"""WITH {PUBLIC_DAILY} SELECT date, region, round("Latitude", 6) AS "Latitude", round("Longitude", 6) AS "Longitude", risk_level,
      {ONE_DIGIT.format(x="probability * 100")} AS risk_pct, concat(region, ' ', printf('%.1f', {ONE_DIGIT.format(x="probability * 100")}), '%') AS label FROM daily_public""")
def dashboard_animation(t):
    return B.round_all(D.animation_frames(daily_public(t)), keep=("risk_pct",))


@query(f"""WITH {PUBLIC_DAILY}, dd AS (SELECT date, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM daily_public)) SELECT date FROM dd WHERE (rn - 1) % 5 = 0 OR rn = n""")
def dashboard_snapshot_dates(t):
    return D.snapshot_dates(daily_public(t))
